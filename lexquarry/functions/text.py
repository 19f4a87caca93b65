"""Text normalisation and line predicates as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexquarry.functions import patterns as P
from lexquarry.functions import spacing


#: A whole run of white space. It is only looked at from its front, so a run that doesn't fit costs its length once. The
#: look ahead lets all other characters go by at once.
RUN = f"(?={P.WS})(?<!{P.WS}){P.WS}++"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{P.WS}++|{RUN}$", "")


#: Every Unicode line break.
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def split_lines(text: Column) -> Column:
    """Lines at every Unicode line break, without an empty last one; none for an empty text."""
    return spacing.split_lines(text)


def normalize_spaces(x: Column) -> Column:
    return spacing.normalize_spaces(x)


def normalize_typography(x: Column) -> Column:
    return spacing.normalize_typography(x)


def canonical(x: Column) -> Column:
    return F.lower(spacing.single_spaced(x))


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def opens_as(x: Column, pattern: str, front: str) -> Column:
    """Whether pattern, which only fits at the front of a text, fits; front: what its first characters have to fit then."""
    return F.rlike(F.substring(x, 1, P.FRONT), F.lit(front)) & F.rlike(x, F.lit(pattern))


def article_number(block: Column) -> Column:
    """Base, suffix and sub-number of a block that opens an article, else null."""
    part = lambda i: F.nullif(F.regexp_extract(block, P.ARTICLE, i), F.lit(""))
    return F.when(opens_as(block, P.ARTICLE, P.ARTICLE_FRONT), F.concat_ws(" ", part(1), F.lower(part(2)), part(3)))


def slug(number: Column) -> Column:
    return F.regexp_replace(F.lower(strip(number)), f"{P.WS}+", "-")


def plain_number(number: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(strip(number)), F.lit("."), F.lit(" ")), f"{P.WS}+", " ")


def article_reference(query: Column) -> Column:
    return plain_number(F.nullif(F.regexp_extract(query, P.REFERENCE, 1), F.lit("")))


def citations(answer: Column) -> Column:
    """Every number cited, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(P.REFERENCE), F.lit(1)), plain_number)


def normalize_text(x: Column) -> Column:
    x = F.regexp_replace(F.lower(x), rf"[^a-z0-9{P.WS[1:-1]}]", " ")
    return strip(F.regexp_replace(x, f"{P.WS}+", " "))


def tokens(x: Column) -> Column:
    clean = normalize_text(x)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def letters(clean: Column) -> Column:
    """A text's characters; make it a column of its own before it is used in trigrams."""
    return F.split(clean, "")


def trigrams(chars: Column, n: Column) -> Column:
    """Different three-letter windows of n characters; fewer are their own only window. Windows are put together from an
    array: a substring would walk its text from the front each time."""
    at = lambda i: F.get(chars, i)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.concat_ws("", at(i), F.when(n > 1, at(i + 1)), F.when(n > 2, at(i + 2))))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(windows))


def expand_query(query: Column) -> Column:
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in P.SYNONYMS.items() for x in pair))
    words = F.flatten(F.transform(tokens(query), lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.when(F.size(words) == 0, query).otherwise(F.concat_ws(" ", query, F.array_join(words, " ")))


def preview(x: Column, n: int = 220) -> Column:
    return F.substring(x, 1, n)


def clip(x: Column, n: int = 900) -> Column:
    return F.when(F.length(x) > n, F.concat(F.regexp_replace(F.substring(x, 1, n), f"{RUN}$", ""), F.lit("..."))).otherwise(x)


def drop_reason(line: Column, line_no: Column) -> Column:
    """Why a typographically normalised line goes: the first that holds, else null."""
    cover = (line_no <= P.COVER_LINES) & reduce(lambda a, b: a | b, (F.startswith(line, F.lit(p)) for p in P.COVER_PREFIXES))
    return (
        F.when(opens_as(line, P.PAGE, P.PAGE_FRONT), "page_marker")
        .when(opens_as(line, P.ORPHAN, P.ORPHAN_FRONT), "orphan")
        .when(line.isin(P.EDITORIAL) | cover, "editorial")
        .when(line == "", "blank")
    )


#: A text of at most MOST_WORDS words and at least LEAST_LETTERS letters, four in five of them capitals, is a heading.
MOST_WORDS, LEAST_LETTERS = 8, 8


def few_words(x: Column) -> Column:
    return ~F.rlike(F.substring(x, 1, P.MANY_FRONT), F.lit(P.MANY_WORDS)) & F.rlike(x, F.lit(P.FEW_WORDS))


def heading_counts(x: Column) -> tuple[Column, Column, Column]:
    """Words, letters and capitals: what tells if a text without a heading's opening word is one. A text of more than
    MOST_WORDS words never is: of it only that is told, and its letters aren't looked at."""
    few = few_words(x)
    letters = F.regexp_replace(x, f"[^{P.LATIN}]++", "")
    upper = F.length(F.regexp_replace(letters, "[^A-ZÀ-ÖØ-Þ]++", ""))
    words = F.when(few, F.regexp_count(x, F.lit(f"[^{P.WS[1:-1]}]++"))).otherwise(MOST_WORDS + 1)
    return words, F.when(few, F.length(letters)).otherwise(0), F.when(few, upper).otherwise(0)


def is_heading(line: Column) -> Column:
    """A heading's opening word, or few words nearly all in capitals; the cheap test comes first."""
    _, letters, upper = heading_counts(line)
    shouted = few_words(line) & (letters >= LEAST_LETTERS) & (upper * 5 >= letters * 4)
    return opens_as(line, P.HEADING, P.HEADING_FRONT) | shouted


def starts_block(line: Column) -> Column:
    fronts = {P.ARTICLE: P.ARTICLE_FRONT, P.HEADING: P.HEADING_FRONT, P.BULLET: P.BULLET_FRONT}
    return reduce(lambda a, b: a | b, (opens_as(line, p, front) for p, front in fronts.items()))


def closes_up(before: Column, line: Column) -> Column:
    """Whether a line goes on with a word that was cut at the hyphen before it."""
    return F.endswith(before, F.lit("-")) & F.rlike(F.substring(line, 1, 1), F.lit(r"^\p{Ll}"))


def joined_to(line: Column, after: Column) -> Column:
    """A line as it stands before the next one of its text: hyphens at the end of a line and elisions close up."""
    return (
        F.when(after.isNull(), line)
        .when(closes_up(line, after), F.regexp_replace(line, "-$", ""))
        .when(F.endswith(line, F.lit("'")), line)
        .otherwise(F.concat(line, F.lit(" ")))
    )


def hierarchy_level(block: Column) -> Column:
    """Which level's label a block is, else null; prose that is too long never is."""
    low, short = F.lower(block), F.length(block) <= 90
    test = F.lit(None).cast("string")
    for level in reversed(P.LEVELS):
        fits = short & F.startswith(low, F.lit(level))
        if level in ("section", "chapitre"):
            fits &= ~F.contains(strip(block), F.lit(" ")) | F.rlike(block, F.lit(rf"(?iu)^{P.WS}*{level}\b"))
        test = F.when(fits, level).otherwise(test)
    return test


def asks_low_confidence(query: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(query), F.lit(p)) for p in P.LOW_CONFIDENCE))

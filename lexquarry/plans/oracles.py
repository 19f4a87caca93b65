"""DuckDB SQL for the queries: expression builders and chains of common table expressions."""

from __future__ import annotations

from lexquarry.functions import patterns as P

EDGE = r"[^\p{L}\p{N}_]"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return lit(pattern.replace("(?iu)", "(?i)"))


HEADING = re2(P.HEADING.removesuffix(r"\b") + rf"({EDGE}|$)")
REFERENCE = re2(P.REFERENCE.replace(r"(?iu)\b", rf"(?iu)(?:^|{EDGE})").removesuffix(r"\b") + rf"(?:{EDGE}|$)")
CLUSTER = re2(rf"(?:^|{EDGE})((?:[{P.LATIN}]{P.WS}+){{3,}}[{P.LATIN}])(?:{EDGE}|$)")
SPACES = lit(f"{P.WS}+")


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {by}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{P.WS}+|{P.WS}+$", "''")


def spaces(x: str) -> str:
    x = sub(f"replace({x}, chr(160), ' ')", "[ \t]+", "' '")
    x = sub(x, f"{P.WS}+([,.;:!?])", r"'\1'")
    x = sub(x, rf"([(\[{{]){P.WS}+", r"'\1'")
    return strip(sub(x, rf"{P.WS}+([)\]}}])", r"'\1'"))


def typography(x: str) -> str:
    x = f"""replace(translate({x}, '‘’“”–—−', '''''""---'), '…', '...')"""
    return spaces(sub(x, f"{P.WS}+-{P.WS}+", "' - '"))


def canonical(x: str) -> str:
    return f"lower({strip(sub(x, f'{P.WS}+', chr(39) + ' ' + chr(39)))})"


def plain_number(x: str) -> str:
    return sub(f"replace(lower({strip(x)}), '.', ' ')", f"{P.WS}+", "' '")


def normal(x: str) -> str:
    return strip(sub(sub(f"lower({x})", rf"[^a-z0-9{P.WS[1:-1]}]", "' '"), f"{P.WS}+", "' '"))


def tokens(x: str) -> str:
    return f"CASE WHEN {normal(x)} = '' THEN [] ELSE string_split({normal(x)}, ' ') END"


def heading(x: str) -> str:
    letters = sub(x, f"[^{P.LATIN}]", "''")
    upper = sub(letters, "[^A-ZÀ-ÖØ-Þ]", "''")
    return f"(regexp_matches({x}, {HEADING}) OR (length({letters}) >= 8 AND length({upper}) * 5 >= length({letters}) * 4 AND len(string_split_regex({strip(x)}, {SPACES})) <= 8))"


def starts_block(x: str) -> str:
    return f"(regexp_matches({x}, {re2(P.ARTICLE)}) OR regexp_matches({x}, {HEADING}) OR regexp_matches({x}, {re2(P.BULLET)}))"


def merge(a: str, b: str) -> str:
    return rf"CASE WHEN ends_with({a}, '-') AND regexp_matches({b}, '^\p{{Ll}}') THEN regexp_replace({a}, '-$', '') || {b} WHEN ends_with({a}, '''') THEN {a} || {b} ELSE {a} || ' ' || {b} END"


def round_to(x: str, places: int) -> str:
    return f"floor(({x}) * {float(10**places)}::DOUBLE + 0.5::DOUBLE) / {float(10**places)}::DOUBLE"


def article_number(x: str) -> str:
    part = lambda i: f"nullif(regexp_extract({x}, {re2(P.ARTICLE)}, {i}), '')"
    return f"CASE WHEN regexp_matches({x}, {re2(P.ARTICLE)}) THEN concat_ws(' ', {part(1)}, lower({part(2)}), {part(3)}) END"


def level(x: str) -> str:
    def fits(v: str) -> str:
        test = f"starts_with(lower({x}), '{v}') AND length({x}) <= 90"
        if v in ("section", "chapitre"):
            test += f" AND (NOT contains({strip(x)}, ' ') OR regexp_matches({x}, {re2(f'(?iu)^{P.WS}*{v}({EDGE}|$)')}))"
        return f"WHEN {test} THEN '{v}'"

    return f"CASE {' '.join(map(fits, P.LEVELS))} END"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(map(lit, words)) + ")"


#: Marks, headings and wraps laid over the documents' lines, so that each rule has lines to work on. Spark and DuckDB read
#: the same text.
DECORATED = """CASE WHEN line_no % 31 = 0 THEN '## Page ' || line_no
  WHEN line_no % 37 = 0 THEN '' WHEN line_no % 41 = 0 THEN '87 bis' WHEN line_no % 43 = 0 THEN 'Les Editions'
  WHEN line_no % 29 = 0 THEN 'TITRE ' || (line_no % 9) WHEN line_no % 17 = 0 THEN 'Chapitre ' || (line_no % 9)
  WHEN line_no % 19 = 0 THEN 'DISPOSITIONS GENERALES'
  WHEN line_no % 7 = 2 THEN 'Art. ' || (line_no + doc_id % 5) || ' bis - ' || line
  WHEN line_no % 7 = 4 THEN line || ' fin. Art. ' || (doc_id % 90) || ' - ' || line || '; Art. 5 - suite'
  WHEN line_no % 13 = 5 THEN '1) ' || line WHEN line_no % 11 = 6 THEN line || '-' WHEN line_no % 11 = 8 THEN line || ''''
  WHEN line_no % 5 = 1 THEN '  ' || line || ' ( a b ) ;' ELSE line END"""

RAW = rf"""raw AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1)::BIGINT AS line_no FROM (
    SELECT doc_id, CASE WHEN p[-1] = '' THEN list_slice(p, 1, len(p) - 1) ELSE p END AS parts FROM (
      SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS p FROM documents)))"""
CLEAN = f"""decorated AS (SELECT doc_id, line_no, {DECORATED} AS line FROM raw),
typed AS (SELECT doc_id, line_no, {typography("line")} AS line FROM decorated),
cleaned AS (
  SELECT *, CASE WHEN regexp_matches(line, {re2(P.PAGE)}) THEN 'page_marker' WHEN regexp_matches(line, {re2(P.ORPHAN)}) THEN 'orphan'
    WHEN line IN {in_list(P.EDITORIAL)} OR (line_no <= {P.COVER_LINES} AND ({" OR ".join(f"starts_with(line, {lit(p)})" for p in P.COVER_PREFIXES)})) THEN 'editorial'
    WHEN line = '' THEN 'blank' END AS reason FROM typed)"""
_NOW = r"regexp_extract(acc, '[^\x1d]*$')"
BLOCKS = f"""islands AS (
  SELECT *, sum((reason IS NOT NULL OR {starts_block("line")})::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island
  FROM cleaned WHERE reason IS NULL OR reason = 'blank'),
folded AS (
  SELECT doc_id, island, string_split(list_reduce(list(line ORDER BY line_no),
    lambda acc, x: CASE WHEN {heading(_NOW)} THEN acc || chr(29) || x ELSE left(acc, length(acc) - length({_NOW})) || {merge(_NOW, "x")} END), chr(29)) AS parts
  FROM islands WHERE reason IS NULL GROUP BY ALL),
flushed AS (
  SELECT doc_id, island, generate_subscripts(parts, 1) AS pos, unnest(parts) AS part FROM folded),
blocks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island, pos) - 1 AS block_idx, block
  FROM (SELECT doc_id, island, pos, {spaces("part")} AS block FROM flushed) WHERE block <> '')"""
_MARKED = sub("block", P.INLINE.replace("(?iu)", "(?i)"), r"'\1' || chr(30) || '\2'")
SPLIT = rf"""cut AS (
  SELECT doc_id, block_idx, CASE WHEN length({_MARKED}) - length(block) + regexp_matches(block, {re2(P.INLINE_START)})::INT >= 2
    THEN list_filter(list_transform(string_split({_MARKED}, chr(30)), lambda p: {strip("p")}), lambda p: p <> '') ELSE [block] END AS parts
  FROM blocks),
split AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, pos) - 1 AS block_idx, block
  FROM (SELECT doc_id, block_idx, generate_subscripts(parts, 1) AS pos, unnest(parts) AS block FROM cut))"""
MARKED = f"""marked AS (
  SELECT *, min(block_idx) OVER (PARTITION BY doc_id, hash) AS first_idx FROM (SELECT *, sha256({canonical("block")}) AS hash FROM split)),
uniq AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS block_idx, block FROM marked WHERE block_idx = first_idx)"""
_WORDS = f"regexp_extract_all(block, {lit(P.TOKEN)})"
SCORED = f"""measured AS (
  SELECT *, len(words) AS n, greatest(len(words), 1)::DOUBLE AS base, len(list_filter(words, lambda t: length(t) = 1 AND NOT regexp_matches(t, {lit(f"^{P.ROMAN}$")}))) AS single,
    len(list_filter(words, lambda t: regexp_matches(t, {lit(f"^{P.CONSONANTS}$")}))) AS hard, len(regexp_extract_all(block, {CLUSTER})) AS clusters,
    len(regexp_extract_all(block, {lit(P.BAD)})) / greatest(length(block), 1)::DOUBLE AS bad
  FROM (SELECT *, {_WORDS} AS words FROM uniq)),
rated AS (SELECT *, single / base AS r1, clusters / greatest(base / 35.0::DOUBLE, 1.0::DOUBLE) AS r2, hard / base AS r3, n = 0 OR {heading("block")} AS perfect FROM measured),
scored AS (
  SELECT doc_id, block_idx, block,
    CASE WHEN perfect THEN 1.0 WHEN n <= 5 AND clusters = 0 THEN 0.95
      ELSE greatest(0.0, least(1.0, 1.0 - least(1.0::DOUBLE, 0.7::DOUBLE * r1 + 1.3::DOUBLE * r2 + 1.0::DOUBLE * r3 + 1.4::DOUBLE * bad))) END::DOUBLE AS score,
    CASE WHEN perfect OR (n <= 5 AND clusters = 0) THEN [] ELSE
      list_filter([CASE WHEN r1 > 0.22 THEN '{P.REASONS[0]}' END, CASE WHEN r2 > 0.18 THEN '{P.REASONS[1]}' END, CASE WHEN r3 > 0.08 THEN '{P.REASONS[2]}' END, CASE WHEN bad > 0.015 THEN '{P.REASONS[3]}' END], lambda r: r IS NOT NULL) END AS reasons
  FROM rated)"""
ARTICLES = f"""told AS (SELECT *, CASE WHEN level IS NULL THEN {article_number("block")} END AS number FROM (SELECT *, {level("block")} AS level FROM scored)),
carried AS (
  SELECT *, count(number) OVER w AS article_ord, {", ".join(f"last_value(CASE WHEN level = '{v}' THEN block END IGNORE NULLS) OVER w AS {v}" for v in P.LEVELS)}
  FROM told WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rolled AS (
  SELECT doc_id, article_ord, max(number) AS article_number, {", ".join(f"max(CASE WHEN number IS NOT NULL THEN {v} END) AS {v}" for v in P.LEVELS)},
    count(*) AS block_count, count(*) FILTER (WHERE score < 0.70) AS low_score_block_count,
    count(*) FILTER (WHERE list_has_any(reasons, {P.CRITICAL})) AS critical_reason_hits,
    list_sort(list_distinct(flatten(list(reasons)))) AS reasons, {round_to("avg(score)", 4)} AS ocr_quality_score, string_agg(block, chr(10) || chr(10) ORDER BY block_idx) AS text
  FROM carried WHERE article_ord > 0 AND level IS NULL GROUP BY doc_id, article_ord),
articles AS (
  SELECT *, CASE WHEN ocr_quality_score < 0.70 OR critical_reason_hits >= 2 OR low_score_block_count / greatest(block_count, 1)::DOUBLE > 0.20 THEN 'C'
    WHEN ocr_quality_score >= 0.88 AND critical_reason_hits = 0 AND low_score_block_count = 0 THEN 'A' ELSE 'B' END AS filter_tier,
    {round_to("low_score_block_count / greatest(block_count, 1)::DOUBLE", 4)} AS low_block_ratio,
    'art-' || {sub(f"lower({strip('article_number')})", f"{P.WS}+", "'-'")} AS id
  FROM rolled)"""
CORPUS = [RAW, CLEAN, BLOCKS, SPLIT, MARKED, SCORED, ARTICLES]


def corpus(stages: int, select: str) -> str:
    return "WITH " + ",\n".join(CORPUS[:stages]) + "\n" + select


#: Articles, queries and vectors made of the given tables by plain projections that both engines read alike.
INDEXED = """SELECT doc_id AS ord, 'art-' || (doc_id % 300 + 1) || CASE WHEN doc_id % 7 = 0 THEN '-bis' ELSE '' END AS id,
  (doc_id % 300 + 1) || CASE WHEN doc_id % 7 = 0 THEN ' bis' ELSE '' END AS article_number,
  CASE WHEN doc_id % 10 < 6 THEN 'A' WHEN doc_id % 10 < 9 THEN 'B' ELSE 'C' END AS tier,
  CAST(doc_id % 101 AS DOUBLE) / 100 AS quality, coalesce(text, '') AS text FROM documents"""
#: Every passage of the benchmark as a query, in forms that lead down each way: whole or cut short, with an article's number,
#: with words that allow tier C, or meaningless; every third has a vector.
ASKED = """SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN item_id END AS vec,
  CASE WHEN item_id % 8 = 1 THEN text || ' Art. ' || (item_id % 300 + 8) WHEN item_id % 8 = 2 THEN substring(text, 1, 40) || ' law penalty uncertain'
    WHEN item_id % 8 = 3 THEN 'zq xj' WHEN item_id % 8 = 4 THEN substring(text, 1, 60) WHEN item_id % 8 = 5 THEN 'vol'
    WHEN item_id % 8 = 6 THEN 'zq xj art. ' || (item_id % 30 * 10 + 10) ELSE text END AS query,
  item_id % 5 = 0 OR item_id % 8 = 6 AS allow FROM benchmark"""
#: Every turn of every conversation, for what looks at a query alone.
TURNS = """SELECT conv_id * 1000 + turn AS query_id, NULL AS vec,
  CASE WHEN turn % 4 = 1 THEN text || ' Art. ' || (conv_id % 300 + 8 + turn) WHEN turn % 4 = 2 THEN text || ' law penalty uncertain' ELSE text END AS query,
  turn % 3 = 0 AS allow FROM conversations"""

SEARCH = f"""indexed AS ({INDEXED}),
asked AS ({ASKED}),
hints AS (SELECT * FROM (VALUES {", ".join(f"({lit(k)}, {lit(' '.join(v))})" for k, v in P.SYNONYMS.items())}) t(word, extra)),
referenced AS (
  SELECT query_id, vec, query, {plain_number(f"nullif(regexp_extract(query, {REFERENCE}, 1), '')")} AS reference,
    coalesce(allow, false) OR {" OR ".join(f"contains(lower(query), {lit(p)})" for p in P.LOW_CONFIDENCE)} AS allow_low, {tokens("query")} AS words FROM asked),
extras AS (
  SELECT query_id, string_agg(extra, ' ' ORDER BY pos) AS extra
  FROM (SELECT query_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM referenced) JOIN hints USING (word) GROUP BY query_id),
parsed AS (SELECT query_id, vec, query, reference, allow_low, CASE WHEN extra IS NULL THEN query ELSE query || ' ' || extra END AS expanded FROM referenced LEFT JOIN extras USING (query_id))"""
_GRAMS = "CASE WHEN clean = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length(clean) - 2, 1) + 1), lambda i: substring(clean, i, 3))) END"
LEXICAL = f"""qtok AS (SELECT query_id, token, count(*) AS qn FROM (SELECT query_id, unnest({tokens("expanded")}) AS token FROM parsed) GROUP BY ALL),
atok AS (SELECT ord, token, count(*) AS n FROM (SELECT ord, unnest({tokens("text")}) AS token FROM indexed) GROUP BY ALL),
qsize AS (SELECT query_id, sum(qn) AS qs FROM qtok GROUP BY ALL),
asize AS (SELECT ord, sum(n) AS sz FROM atok GROUP BY ALL),
lex AS (
  SELECT query_id, ord, common / sqrt(qs::DOUBLE * sz::DOUBLE) AS lexical
  FROM (SELECT query_id, ord, sum(least(qn, n)) AS common FROM qtok JOIN atok USING (token) GROUP BY ALL) JOIN qsize USING (query_id) JOIN asize USING (ord))"""
TRIGRAM = f"""qgram AS (SELECT query_id, {_GRAMS} AS qg FROM (SELECT query_id, {normal("expanded")} AS clean FROM parsed)),
agram AS (SELECT ord, {_GRAMS} AS g FROM (SELECT ord, {normal("text")} AS clean FROM indexed)),
gramcommon AS (
  SELECT query_id, ord, count(*) AS common FROM (SELECT query_id, unnest(qg) AS x FROM qgram) JOIN (SELECT ord, unnest(g) AS x FROM agram) USING (x) GROUP BY ALL),
tri AS (
  SELECT query_id, ord, CASE WHEN len(qg) + len(g) - common > 0 THEN common / (len(qg) + len(g) - common)::DOUBLE ELSE 0.0 END AS trigram
  FROM (SELECT query_id, ord, qg, g, coalesce(common, 0) AS common FROM agram CROSS JOIN qgram LEFT JOIN gramcommon USING (query_id, ord)))"""


def unit(x: str) -> str:
    v = f"{x}::DOUBLE[]"
    return f"CASE WHEN list_inner_product({v}, {v}) > 0 THEN list_transform({v}, lambda e: e / sqrt(list_inner_product({v}, {v}))) ELSE {v} END"


VECTOR = f"""qvec AS (SELECT query_id, {unit("embedding")} AS q FROM parsed JOIN embeddings ON vec_id = vec),
avec AS (SELECT ord, tier, id, {unit("embedding")} AS v FROM indexed JOIN embeddings ON vec_id = ord),
knn AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY raw DESC, ord) AS rank
  FROM (SELECT query_id, ord, tier, id, list_inner_product(q, v) AS raw FROM qvec CROSS JOIN avec)),
byid AS (SELECT query_id, tier, id, max(greatest(0.0, least(1.0, (raw + 1.0) / 2.0))) AS vector FROM knn WHERE rank <= 20 GROUP BY ALL)"""
_EXACT = f"CASE WHEN reference IS NOT NULL AND {plain_number('article_number')} = reference THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
SCORES = f"""pairs AS (
  SELECT query_id, ord, id, article_number, tier, quality, reference, coalesce(lexical, 0.0)::DOUBLE AS lexical, trigram::DOUBLE AS trigram, coalesce(vector, 0.0)::DOUBLE AS vector, {_EXACT} AS exact
  FROM tri LEFT JOIN lex USING (query_id, ord) JOIN indexed USING (ord) JOIN parsed USING (query_id) LEFT JOIN byid USING (query_id, tier, id)),
cands AS (
  SELECT query_id, ord, id, article_number, tier, reference, {round_to("lexical", 5)} AS lexical, {round_to("trigram", 5)} AS trigram, {round_to("vector", 5)} AS vector, exact,
    {round_to("CASE WHEN reference IS NOT NULL THEN 0.55::DOUBLE * exact + 0.25::DOUBLE * lexical + 0.10::DOUBLE * vector + 0.10::DOUBLE * trigram ELSE 0.45::DOUBLE * vector + 0.30::DOUBLE * lexical + 0.20::DOUBLE * trigram + 0.05::DOUBLE * exact END * CASE tier WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.82::DOUBLE ELSE 0.55::DOUBLE END * (0.7::DOUBLE + 0.3::DOUBLE * greatest(0.0, least(1.0, quality)))", 5)} AS fused
  FROM pairs)"""
TOP = """hits AS (SELECT *, max(exact) OVER (PARTITION BY query_id, tier) > 0 AS hit FROM cands),
topk AS (
  SELECT * EXCLUDE (hit) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY fused DESC, ord) AS rank FROM hits
    WHERE (hit AND exact > 0) OR (NOT hit AND (fused >= 0.08 OR exact > 0))) WHERE rank <= 15)"""
GATES = """sums AS (
  SELECT query_id, allow_low, coalesce(max(exact) FILTER (WHERE tier = 'A'), 0) AS ea, coalesce(max(exact) FILTER (WHERE tier = 'B'), 0) AS eb,
    count(*) FILTER (WHERE tier = 'A') AS na, max(fused) FILTER (WHERE tier = 'A') AS ta, max(fused) FILTER (WHERE tier = 'B') AS tb
  FROM parsed LEFT JOIN topk USING (query_id) GROUP BY ALL),
gate_b AS (SELECT *, ea = 0 AND (na < 2 OR ta < 0.2) AS use_b FROM sums),
gate AS (
  SELECT query_id, use_b, allow_low AND greatest(ea, CASE WHEN use_b THEN eb ELSE 0 END) = 0
    AND (coalesce(ta, CASE WHEN use_b THEN tb END) IS NULL OR coalesce(ta, CASE WHEN use_b THEN tb END) < 0.2) AS use_c FROM gate_b)"""
MERGED = """used AS (SELECT topk.* FROM topk JOIN gate USING (query_id) WHERE tier = 'A' OR (tier = 'B' AND use_b) OR (tier = 'C' AND use_c)),
best AS (SELECT *, min(tier || lpad(rank::VARCHAR, 6, '0')) OVER (PARTITION BY query_id, id) AS first, row_number() OVER (PARTITION BY query_id, id ORDER BY fused DESC, tier, rank) AS nth FROM used),
selected AS (
  SELECT query_id, final_rank, ord, id, article_number, tier, fused
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first) AS final_rank FROM best WHERE nth = 1) WHERE final_rank <= 12)"""
RANKING = [SEARCH, LEXICAL, TRIGRAM, VECTOR, SCORES, TOP, GATES, MERGED]


def search(stages: int, select: str, *more: str) -> str:
    return "WITH " + ",\n".join([*RANKING[:stages], *more]) + "\n" + select

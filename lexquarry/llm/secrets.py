"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

A candidate's value is aggregated by the different repositories and owners that hold it. What many owners hold is a
copied example; what looks like a key and one owner alone holds is taken for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import materialize, table, text_or_empty

#: Kinds in their order: pattern, group of the value, least length of the value. The last one is the method's own.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "owned": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
#: From so many owners on, a value is a widely copied example.
EXAMPLE_OWNERS = 3
#: Different characters that a live-looking value has at least.
LIVE_VARIETY = 8


def _hits(text: Column, kind: str) -> Column:
    """Matches in order as (n, gap, found, value): gap is the length of the text since the match before."""
    pattern, group, _ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), value.alias("value"))
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), x["gap"].alias("gap"), F.length(x["found"]).alias("size"), x["value"].alias("value")))
    return F.when(F.rlike(text, F.lit(pattern)), rows)


def _looks_live(value: Column) -> Column:
    variety = F.size(F.array_distinct(F.split(value, "")))
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (variety >= LIVE_VARIETY)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a row number for each document, and what the patterns match in it, with code-point places."""
    none = F.array().cast("array<struct<kind:string,n:int,gap:int,size:int,value:string>>")
    hits = F.concat(*(F.coalesce(_hits(text_or_empty(), k), none) for k in KINDS))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), owner.alias("owner"), repository.alias("repository"), hits.alias("hits"))
    rows = materialize(own, "secret-hits")
    each = rows.where(F.size("hits") > 0).select("row", "owner", "repository", F.inline("hits"))
    upto = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    least = F.element_at(F.create_map(*(F.lit(x) for k in KINDS for x in (k, KINDS[k][2]))), F.col("kind"))
    placed = each.select("row", "owner", "repository", "kind", (end - F.col("size")).alias("start"), end.alias("end"), "value")
    spans = placed.where((F.length("value") >= least) & ((F.col("kind") != "owned") | _looks_live(F.col("value"))))
    return rows.select("row", "doc_id"), materialize(spans.withColumn("value_hash", F.sha2("value", 256)).drop("value"), "secret-spans")


def ownership(spans: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repositories; holders are made distinct first, in as many tasks as there are holders."""
    held = spans.select("value_hash", "owner", "repository").distinct()
    return held.groupBy("value_hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repository").alias("n_repositories"))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """A row per document: doc_id and spans (array of start, rank, end, kind, value_hash, n_owners, n_repositories,
    verdict) by start, then kind.

    verdict: example (many owners), live (one owner), or shared. A span of the method's own kind stays only if it is
    live and no base span overlaps it. owner and repository default to the source, and the source with the language; a
    null counts as a name of its own. Null or empty text: no spans. Repeated rows are one row each.
    """
    columns = {c.lower() for c in docs.columns}
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in columns else F.lit("")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in columns else F.lit("")
    owner = source if owner is None else owner
    rows, spans = candidates(docs, owner, F.concat_ws("/", owner, lang) if repository is None else repository)
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")
    verdict = F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    known = spans.join(ownership(spans), "value_hash").withColumn("verdict", verdict).withColumn("rank", rank)
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(1, Window.unboundedFollowing)
    base = F.col("kind").isin(*BASE)
    reached = F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(0))
    following = F.min(F.when(base, F.col("start"))).over(after)
    clear = (F.col("verdict") == "live") & (reached <= F.col("start")) & (following.isNull() | (following >= F.col("end")))
    kept = known.withColumn("_clear", clear).where(base | F.col("_clear"))
    one = F.struct("start", "rank", "end", "kind", "value_hash", "n_owners", "n_repositories", "verdict")
    listed = kept.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    empty = F.array().cast(listed.schema["spans"].dataType)
    return rows.join(listed, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    def text(kinds: Column) -> Column:
        return F.array_join(F.transform(kinds, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count("kind", k).alias(f"n_{k}") for k in BASE),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        *(count("verdict", v).alias(f"n_{v}") for v in ("live", "example")),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The same in SQL, where letters in either case are spelled out: its (?i) would fold others than A-Z too.
_SQL_PATTERNS = {k: p.replace("(?i:(password|passwd|secret|token|api_?key))", f"({'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})").replace("'", "''") for k, (p, _, _) in KINDS.items()}
_EACH = " UNION ALL ".join(
    f"""SELECT row, owner, repository, '{kind}' AS kind, {rank} AS rank, {KINDS[kind][2]} AS least, unnest(regexp_extract_all(text, '{p}')) AS found,
    unnest(regexp_extract_all(text, '{p}', {KINDS[kind][1]})) AS value, unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS gap,
    generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS n FROM rows WHERE regexp_matches(text, '{p}')"""
    for rank, (kind, p) in enumerate(_SQL_PATTERNS.items(), 1)
)
SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
hits AS ({_EACH}),
placed AS (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY row, kind ORDER BY n)::BIGINT AS stop FROM hits),
spans AS (
  SELECT row, owner, repository, kind, rank, value, stop - length(found) AS start, stop FROM placed
  WHERE length(value) >= least AND (kind <> 'owned' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {LIVE_VARIETY}))),
owned AS (SELECT value, count(DISTINCT owner) AS owners FROM spans GROUP BY value),
known AS (
  SELECT *, kind <> 'owned' AS base, CASE WHEN owners >= {EXAMPLE_OWNERS} THEN 'example' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS verdict FROM spans JOIN owned USING (value)),
beside AS (
  SELECT *, coalesce(max(CASE WHEN base THEN stop END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached,
         min(CASE WHEN base THEN start END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following
  FROM known WINDOW w AS (PARTITION BY row ORDER BY start, rank)),
kept AS (SELECT *, kind || ':' || start || ':' || stop AS told FROM beside WHERE base OR (verdict = 'live' AND reached <= start AND (following IS NULL OR following >= stop))),
listed AS (
  SELECT row, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(told, ',' ORDER BY start, rank) FILTER (WHERE base) AS base,
         string_agg(told, ',' ORDER BY start, rank) AS spans, count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example
  FROM kept GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM rows LEFT JOIN listed USING (row)
"""

"""Every query by name: (spark, sf_dir) -> DataFrame, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import patterns as P
from lexquarry.functions import text as T
from lexquarry.functions.quality import rounded
from lexquarry.operators import answer as A
from lexquarry.operators import corpus as C
from lexquarry.operators import search as S
from lexquarry.operators import vectors as V
from lexquarry.operators.topk import best_candidates
from lexquarry.plans import oracles as O
from lexquarry.sources.shared import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cleaned(spark, d) -> DataFrame:
    raw = C.lines(C.dealt(table(spark, d, "documents").select("doc_id", "text")))
    return C.clean(raw.select("doc_id", "line_no", F.expr(O.DECORATED).alias("line")))


def _blocks(spark, d) -> DataFrame:
    return C.blocks(_cleaned(spark, d))


def _split(spark, d) -> DataFrame:
    return C.split_blocks(_cleaned(spark, d))


def _scored(spark, d) -> DataFrame:
    return C.scored(C.unique_blocks(C.mark_duplicates(_split(spark, d))))


def _reasons(column: str = "reasons"):
    return F.array_join(column, ",").alias("reasons")


@query(f"WITH {O.RAW} SELECT doc_id, line_no, {O.typography('line')} AS line, sha256({O.canonical('line')}) AS hash FROM raw")
def normalize_lines(spark, d):
    line = F.col("line")
    return C.lines(table(spark, d, "documents")).select("doc_id", "line_no", T.normalize_typography(line).alias("line"), T.digest(T.canonical(line)).alias("hash"))


@query(O.corpus(2, "SELECT doc_id, line_no, reason FROM cleaned WHERE reason IS NOT NULL"))
def line_drop_reasons(spark, d):
    return _cleaned(spark, d).where("reason is not null").select("doc_id", "line_no", "reason")


@query(O.corpus(2, "SELECT count(*) AS total_lines, " + ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}_lines" for r in ("page_marker", "orphan", "editorial", "blank")) + " FROM cleaned"))
def clean_stats(spark, d):
    return C.clean_stats(_cleaned(spark, d))


@query(O.corpus(3, "SELECT doc_id, block_idx, block FROM blocks"))
def block_reconstruct(spark, d):
    return _blocks(spark, d)


@query(O.corpus(4, "SELECT doc_id, block_idx, block FROM split"))
def block_split_articles(spark, d):
    return _split(spark, d).select("doc_id", "block_idx", "block")


@query(O.corpus(5, "SELECT doc_id, block_idx, block FROM uniq"))
def exact_dedup(spark, d):
    return C.unique_blocks(C.mark_duplicates(_split(spark, d))).select("doc_id", "block_idx", "block")


@query(O.corpus(5, "SELECT doc_id, block_idx AS duplicate_block_index, first_idx AS first_seen_block_index, hash, left(block, 220) AS preview FROM marked WHERE block_idx > first_idx"))
def duplicate_log(spark, d):
    return C.duplicate_log(C.mark_duplicates(_split(spark, d)))


@query(O.corpus(5, "SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY block_idx) || chr(10) AS text FROM uniq GROUP BY doc_id"))
def cleaned_text(spark, d):
    return C.cleaned_text(C.unique_blocks(C.mark_duplicates(_split(spark, d))))


@query(O.corpus(6, f"SELECT doc_id, block_idx, {O.round_to('score', 6)} AS score, array_to_string(reasons, ',') AS reasons FROM scored"))
def ocr_quality(spark, d):
    return _scored(spark, d).select("doc_id", "block_idx", rounded(F.col("score"), 6).alias("score"), _reasons())


@query(O.corpus(6, f"SELECT doc_id, block_idx AS block_index, {O.round_to('score', 4)} AS ocr_quality_score, array_to_string(reasons, ',') AS reasons, left(block, 320) AS excerpt FROM scored WHERE score < 0.78"))
def suspicious_blocks(spark, d):
    return C.suspicious(_scored(spark, d)).select("doc_id", "block_index", "ocr_quality_score", _reasons(), "excerpt")


@query(O.corpus(7, f"SELECT doc_id, block_idx, level, {', '.join(P.LEVELS)} FROM carried"))
def hierarchy_carry(spark, d):
    return C.with_hierarchy(_scored(spark, d)).select("doc_id", "block_idx", "level", *P.LEVELS)


@query(O.corpus(7, "SELECT doc_id, block_idx, article_ord, number FROM carried WHERE article_ord > 0 AND level IS NULL"))
def article_sessions(spark, d):
    return C.with_hierarchy(_scored(spark, d)).where("article_ord > 0 and level is null").select("doc_id", "block_idx", "article_ord", "number")


@query(O.corpus(7, f"SELECT doc_id, article_ord, id, article_number, {', '.join(P.LEVELS)}, block_count, low_score_block_count, critical_reason_hits, array_to_string(reasons, ',') AS reasons, ocr_quality_score, sha256(text) AS text_hash FROM articles"))
def article_rollup(spark, d):
    out = C.articles(_scored(spark, d))
    return out.select("doc_id", "article_ord", "id", "article_number", *P.LEVELS, "block_count", "low_score_block_count", "critical_reason_hits", _reasons(), "ocr_quality_score", T.digest(F.col("text")).alias("text_hash"))


_REASON = "CASE filter_tier " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.TIER_REASONS.items()) + " END"


@query(O.corpus(7, f"SELECT doc_id, article_ord, ocr_quality_score, low_block_ratio, filter_tier, {_REASON} AS filter_reason FROM articles"))
def tier_classify(spark, d):
    return C.articles(_scored(spark, d)).select("doc_id", "article_ord", "ocr_quality_score", "low_block_ratio", "filter_tier", "filter_reason")


@query(O.corpus(7, "SELECT count(*) AS articles, " + ", ".join(f"count(*) FILTER (WHERE filter_tier = '{t}') AS tier_{t.lower()}" for t in "ABC") + " FROM articles"))
def tier_counts(spark, d):
    return C.tier_counts(C.articles(_scored(spark, d)))


@query(O.corpus(6, f"SELECT {O.round_to('avg(score)', 4)} AS avg_score, {O.round_to('min(score)', 4)} AS min_score, {O.round_to('max(score)', 4)} AS max_score FROM scored"))
def quality_report(spark, d):
    return C.quality_report(_scored(spark, d))


@query(
    O.corpus(
        7,
        """SELECT (SELECT count(*) FROM cleaned) AS total_lines, (SELECT count(*) FROM cleaned WHERE reason IS NOT NULL) AS removed_lines,
      (SELECT count(*) FROM split) AS blocks_before, (SELECT count(*) FROM uniq) AS blocks_after, (SELECT count(*) FROM split) - (SELECT count(*) FROM uniq) AS duplicates,
      (SELECT count(*) FROM scored WHERE score < 0.78) AS suspicious, (SELECT count(*) FROM articles) AS articles""",
    )
)
def corpus_report(spark, d):
    cleaned = materialize(_cleaned(spark, d), "cleaned")
    marked = materialize(C.mark_duplicates(C.split_articles(C.blocks(cleaned))), "marked")
    rows = materialize(C.scored(C.unique_blocks(marked)), "scored")
    one = cleaned.agg(F.count("*").alias("total_lines"), F.count("reason").alias("removed_lines"))
    one = one.join(marked.agg(F.count("*").alias("blocks_before"), F.count_if(F.col("block_idx") > F.col("first_idx")).alias("duplicates")))
    one = one.join(rows.agg(F.count("*").alias("blocks_after"), F.count_if(F.col("score") < 0.78).alias("suspicious")))
    return one.join(C.articles(rows).agg(F.count("*").alias("articles")))


@query(f"WITH indexed AS ({O.INDEXED}) SELECT tier, ord, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY ord) AS rank, count(*) OVER (PARTITION BY tier) AS n FROM indexed) WHERE rank <= floor(n * 0.8::DOUBLE)")
def head_fraction(spark, d):
    return C.head_fraction(_indexed(spark, d), "tier", "ord").select("tier", "ord", "id", "rank")


def _view(spark, d, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", f"FROM parquet.`{d}/{name}.parquet`"))


def _indexed(spark, d) -> DataFrame:
    return _view(spark, d, "documents", O.INDEXED)


def _parsed(spark, d) -> DataFrame:
    return S.parse_queries(_view(spark, d, "benchmark", O.ASKED))


def _turns(spark, d) -> DataFrame:
    return S.parse_queries(_view(spark, d, "conversations", O.TURNS))


@query(O.search(1, "SELECT query_id, reference, allow_low FROM parsed").replace(O.ASKED, O.TURNS))
def query_parse(spark, d):
    return _turns(spark, d).select("query_id", "reference", "allow_low")


@query(O.search(1, "SELECT query_id, expanded FROM parsed").replace(O.ASKED, O.TURNS))
def query_expand(spark, d):
    return _turns(spark, d).select("query_id", "expanded")


@query(O.search(2, f"SELECT query_id, ord, {O.round_to('lexical', 5)} AS lexical FROM lex"))
def lexical_overlap(spark, d):
    return S.lexical(_parsed(spark, d), _indexed(spark, d).repartition("ord")).select("query_id", "ord", rounded(F.col("lexical"), 5).alias("lexical"))


@query(O.search(3, f"SELECT query_id, ord, {O.round_to('trigram', 5)} AS trigram FROM tri WHERE trigram > 0"))
def trigram_jaccard(spark, d):
    return S.trigram_scores(_parsed(spark, d), _indexed(spark, d).repartition("ord")).select("query_id", "ord", rounded(F.col("trigram"), 5).alias("trigram"))


def _vectors(spark, d) -> DataFrame:
    """query_id, tier, id, vector: articles of a tier that share an id share it."""
    held, articles = table(spark, d, "embeddings"), _indexed(spark, d).select("ord", "tier", "id")
    asked = _view(spark, d, "benchmark", O.ASKED)
    queries = held.join(asked, F.col("vec_id") == F.col("vec")).select("query_id", "embedding")
    graded = held.withColumnRenamed("vec_id", "ord").join(articles.select("ord", "tier"), "ord")
    near = V.nearest(queries, graded, S.SearchLimits().vector_candidates, part="tier")
    return V.scores_by_id(near.join(articles.select("ord", "id"), "ord"))


def _top(spark, d) -> DataFrame:
    return S.top_by_tier(best_candidates(_parsed(spark, d), _indexed(spark, d).repartition("ord"), materialize(_vectors(spark, d), "vectors")))


_CANDIDATE = "query_id, ord, id, article_number, tier, lexical, trigram, vector, exact, fused, rank"


@query(O.search(6, f"SELECT {_CANDIDATE} FROM topk"))
def hybrid_topk(spark, d):
    return _top(spark, d).select(*_CANDIDATE.split(", "))


@query(O.search(6, "SELECT query_id, tier, ord, article_number, fused, rank FROM topk WHERE exact > 0"))
def exact_override(spark, d):
    return _top(spark, d).where("exact > 0").select("query_id", "tier", "ord", "article_number", "fused", "rank")


@query(O.search(7, "SELECT query_id, use_b, coalesce(use_c, false) AS use_c FROM gate"))
def tier_fallback(spark, d):
    return S.gates(_parsed(spark, d), _top(spark, d)).select("query_id", "use_b", F.coalesce("use_c", F.lit(False)).alias("use_c"))


def _selected(spark, d) -> DataFrame:
    top = materialize(_top(spark, d), "top")  # for the gates and for the merge
    return S.merged(top, S.gates(_parsed(spark, d), top))


@query(O.search(8, "SELECT query_id, final_rank, ord, id, article_number, tier, fused FROM selected"))
def merge_candidates(spark, d):
    return _selected(spark, d)


_OUTCOME = f"""outcome AS (
  SELECT query_id, coalesce(list_sort(list_distinct(list(tier) FILTER (WHERE tier IS NOT NULL))), []) AS path FROM parsed LEFT JOIN selected USING (query_id) GROUP BY query_id),
final AS (
  SELECT query_id, array_to_string(path, '>') AS tier_path, len(path) = 0 AS needs_clarification,
    CASE WHEN len(path) = 0 OR list_contains(path, 'C') THEN 'LOW' WHEN list_contains(path, 'B') THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
    concat_ws(' ', CASE WHEN list_contains(path, 'B') THEN {O.lit(P.WARN_B)} END, CASE WHEN list_contains(path, 'C') THEN {O.lit(P.WARN_C)} END, CASE WHEN len(path) = 0 THEN {O.lit(P.WARN_NONE)} END) AS warnings
  FROM outcome)"""


@query(O.search(8, "SELECT query_id, tier_path, needs_clarification, confidence FROM final", _OUTCOME))
def confidence_level(spark, d):
    return S.outcome(_parsed(spark, d), _selected(spark, d)).select("query_id", "tier_path", "needs_clarification", "confidence")


@query(O.search(8, "SELECT query_id, warnings FROM final", _OUTCOME))
def retrieval_warnings(spark, d):
    return S.outcome(_parsed(spark, d), _selected(spark, d)).select("query_id", F.array_join("warnings", " ").alias("warnings"))


#: Drafts that cite: the query's own text, and with some queries the best article and one that does not exist.
_DRAFT = "CASE WHEN query_id % 2 = 0 THEN query || ' (Art. ' || article_number || ', art. 99999, article ' || article_number || ')' ELSE query END"
_DRAFTS = f"""drafts AS (SELECT query_id, {_DRAFT} AS draft FROM parsed LEFT JOIN selected USING (query_id) WHERE coalesce(final_rank, 1) = 1),
cites AS (SELECT query_id, unnest(list_transform(regexp_extract_all(draft, {O.REFERENCE}, 1), lambda c: {O.plain_number("c")})) AS c, generate_subscripts(regexp_extract_all(draft, {O.REFERENCE}, 1), 1) AS pos FROM drafts),
kept AS (SELECT query_id, c, min(pos) AS pos FROM cites WHERE EXISTS (SELECT 1 FROM selected s WHERE s.query_id = cites.query_id AND {O.plain_number("s.article_number")} = c) GROUP BY ALL),
listed AS (SELECT query_id, string_agg(c, ', ' ORDER BY pos) AS cited FROM kept GROUP BY query_id),
firsts AS (SELECT query_id, string_agg(n, ', ' ORDER BY r) AS first FROM (SELECT query_id, {O.plain_number("article_number")} AS n, min(final_rank) AS r FROM selected WHERE final_rank <= 2 GROUP BY ALL) GROUP BY query_id),
verified AS (SELECT query_id, coalesce(cited, first, '') AS cited, cited IS NULL AND first IS NOT NULL AS attached, CASE WHEN cited IS NULL AND first IS NOT NULL THEN {O.lit(P.WARN_CITATION)} END AS warning FROM drafts LEFT JOIN listed USING (query_id) LEFT JOIN firsts USING (query_id))"""


def _drafts(parsed: DataFrame, selected: DataFrame) -> DataFrame:
    first = selected.where("final_rank = 1").select("query_id", "article_number")
    return parsed.join(first, "query_id", "left").select("query_id", F.expr(_DRAFT).alias("draft"))


@query(O.search(8, "SELECT query_id, pos - 1 AS pos, c AS number FROM cites", _DRAFTS))
def extract_citations(spark, d):
    drafts = _drafts(_parsed(spark, d), _selected(spark, d))
    return drafts.select("query_id", F.posexplode(T.citations(F.coalesce("draft", F.lit(""))))).select("query_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("number"))


def _verified(spark, d) -> tuple[DataFrame, DataFrame]:
    parsed, selected = _parsed(spark, d), materialize(_selected(spark, d), "selected")
    return selected, A.verify_citations(_drafts(parsed, selected), selected)


@query(O.search(8, "SELECT query_id, cited, attached, warning FROM verified", _DRAFTS))
def verify_citations(spark, d):
    return _verified(spark, d)[1]


@query(
    O.search(
        8,
        f"""SELECT query_id, final_rank, '- Art. ' || article_number || ' (tier ' || tier || ', score ' || fused || ')' AS source FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, {O.plain_number("article_number")} ORDER BY final_rank DESC) AS nth FROM selected) s
    WHERE nth = 1 AND EXISTS (SELECT 1 FROM verified v WHERE v.query_id = s.query_id AND list_contains(string_split(v.cited, ', '), {O.plain_number("s.article_number")}))""",
        _DRAFTS,
    )
)
def source_lines(spark, d):
    selected, cited = _verified(spark, d)
    return A.source_lines(selected, cited).select("query_id", "final_rank", "source")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 AND role IN ('user', 'assistant') AND text <> ''")
def history_window(spark, d):
    return A.history(table(spark, d, "conversations"), 6)


@query(O.search(8, rf"""SELECT query_id, final_rank AS rank, '[' || final_rank || '] Art. ' || article_number || ' | tier=' || tier || ' | score=' || fused || chr(10) || CASE WHEN length(text) > 900 THEN regexp_replace(left(text, 900), '{P.WS}+$', '') || '...' ELSE text END AS context FROM selected JOIN indexed USING (ord, id, article_number, tier)"""))
def context_blocks(spark, d):
    # Written first: of so few rows Spark knows the size, and sends them to the texts.
    return A.context_blocks(materialize(_selected(spark, d), "selected"), _indexed(spark, d)).select("query_id", "rank", "context")


def _nearest(spark, d, metric: str) -> DataFrame:
    held = table(spark, d, "embeddings").withColumnRenamed("vec_id", "ord")
    queries = held.where("ord % 100 = 0").select(F.col("ord").alias("query_id"), "embedding")
    return V.nearest(queries, held, 20, metric)


def _knn_sql(raw: str, order: str, vector: str) -> str:
    q, v = (O.unit("a.embedding"), O.unit("b.embedding")) if order == "DESC" else ("a.embedding::DOUBLE[]", "b.embedding::DOUBLE[]")
    return f"""SELECT query_id, ord, rank, {O.round_to(vector, 5)} AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw {order}, ord) AS rank FROM (
        SELECT query_id, ord, {raw} AS raw FROM (SELECT a.vec_id AS query_id, b.vec_id AS ord, {q} AS q, {v} AS v FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0))) WHERE rank <= 20"""


@query(_knn_sql("list_inner_product(q, v)", "DESC", "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (raw + 1.0) / 2.0))"))
def vector_topk_ip(spark, d):
    from lexquarry.functions.scoring import vector_score

    return _nearest(spark, d, "ip").select("query_id", "ord", "rank", rounded(vector_score(F.col("raw"), "ip"), 5).alias("score"))


@query(_knn_sql("list_sum(list_transform(list_zip(q, v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))", "ASC", "1.0 / (1.0 + greatest(0.0::DOUBLE, raw))"))
def vector_topk_l2(spark, d):
    from lexquarry.functions.scoring import vector_score

    return _nearest(spark, d, "l2").select("query_id", "ord", "rank", rounded(vector_score(F.col("raw"), "l2"), 5).alias("score"))


@query(O.search(4, f"SELECT query_id, ord, {O.round_to('vector', 5)} AS vector FROM indexed JOIN byid USING (tier, id)"))
def vector_scores(spark, d):
    return _indexed(spark, d).select("ord", "tier", "id").join(_vectors(spark, d), ["tier", "id"]).select("query_id", "ord", rounded(F.col("vector"), 5).alias("vector"))


_FINGER = "indexed AS ({}), lines AS (SELECT tier, ord, id || '|' || article_number || '|' || sha256(text) AS line FROM indexed)".format(O.INDEXED)


@query(f"WITH {_FINGER} SELECT tier, count(*) AS rows, sha256(string_agg(line || chr(10), '' ORDER BY ord)) AS fingerprint FROM lines GROUP BY tier")
def tier_fingerprint(spark, d):
    return V.fingerprints(_indexed(spark, d))


_CHUNK = f"SELECT tier, ord // {V.DIGEST_ROWS} AS chunk, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY ord)) AS d FROM lines GROUP BY ALL"


@query(f"WITH {_FINGER}, parts AS ({_CHUNK}) SELECT tier, sum(n)::BIGINT AS rows, sha256(string_agg(d, chr(10) ORDER BY chunk)) AS fingerprint FROM parts GROUP BY tier")
def tier_fingerprint_chunked(spark, d):
    return V.chunked_fingerprints(_indexed(spark, d))


@query(f"WITH indexed AS ({O.INDEXED}) SELECT tier, ord, id, article_number, coalesce(quality, 0.0)::DOUBLE AS ocr_quality_score, sha256(text) AS text_hash FROM indexed")
def index_meta(spark, d):
    return V.index_meta(_indexed(spark, d))


@query(
    f"""WITH {_FINGER}, parts AS ({_CHUNK}), now AS (SELECT tier, sha256(string_agg(d, chr(10) ORDER BY chunk)) AS f FROM parts GROUP BY tier),
    fewer AS ({_CHUNK.replace("FROM lines", "FROM lines WHERE tier <> 'C' AND NOT (tier = 'B' AND ord = 8)")}),
    before AS (SELECT tier, sha256(string_agg(d, chr(10) ORDER BY chunk)) AS f FROM fewer GROUP BY tier)
    SELECT tier, before.f AS stored, now.f AS expected, before.f IS NOT DISTINCT FROM now.f AS valid FROM before FULL JOIN now USING (tier)"""
)
def manifest_check(spark, d):
    now = _indexed(spark, d)
    before = now.where("tier <> 'C' and not (tier = 'B' and ord = 8)")
    return V.manifest_check(V.chunked_fingerprints(before), V.chunked_fingerprints(now))


@query(f"WITH indexed AS ({O.INDEXED}) SELECT tier, ord, ((row_number() OVER (PARTITION BY tier ORDER BY ord) - 1) // 40)::BIGINT AS batch FROM indexed")
def embed_batches(spark, d):
    return V.batches(_indexed(spark, d), "tier", "ord").select("tier", "ord", "batch")

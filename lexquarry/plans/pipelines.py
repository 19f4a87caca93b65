"""The two halves as objects: preparing a corpus, and asking it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.config import EngineConfig
from lexquarry.functions import patterns as P
from lexquarry.functions import text as T
from lexquarry.operators import answer as A
from lexquarry.operators import corpus as C
from lexquarry.operators import search as S
from lexquarry.operators import vectors as V
from lexquarry.operators.topk import best_candidates
from lexquarry.providers import EMBEDDERS, GENERATORS, draft_answers, embed_queries, embed_stored, make, rewrite_queries
from lexquarry.sources import files
from lexquarry.sources.shared import in_one_step, materialize

CLARIFY = "Je n'ai pas trouvé de disposition pertinente. Pouvez-vous préciser votre question ?"
UNAVAILABLE = "Des dispositions pertinentes ont été trouvées, mais aucune réponse ne peut être rédigée pour le moment. Cause : "
EMPTY = "Aucune réponse n'a été rédigée. Veuillez préciser votre question."
WARN_VECTORS = "Vector search is not available for now (%s); lexical search only."
WARN_DRAFT = "The text service failed; the answer names the articles found."
NOTES = [
    "Layout noise is removed; article numbers and references are kept.",
    "Suspicious blocks are listed for review, not removed.",
    "Search tier A first, then B; C only where low confidence is allowed.",
]


@dataclass
class CorpusPipeline:
    """Documents (doc_id, text), or their lines (doc_id, line_no, line), to cleaned lines, blocks, scores, graded articles."""

    docs: DataFrame
    config: EngineConfig = EngineConfig()

    def __post_init__(self):
        # Lines are cleaned where they are read, and dealt by document after that.
        self.cleaned = C.dealt(C.clean(self.docs if "line_no" in self.docs.columns else C.lines(self.docs)))
        self.marked = C.mark_duplicates(C.split_articles(C.blocks(self.cleaned))).persist()
        self.unique = C.unique_blocks(self.marked)
        self.scored = C.scored(self.unique)
        self.articles = C.articles(self.scored, self.config.tiers)

    def report(self, source: str = "", path: str = "") -> DataFrame:
        """One row: where from and to, counts, scores, limits, routing, files and notes."""
        one = C.clean_stats(self.cleaned).join(self.marked.agg(F.count("*").alias("blocks_before"), F.count_if(F.col("block_idx") > F.col("first_idx")).alias("duplicates")))
        one = one.join(self.scored.agg(F.count("*").alias("blocks_after"), F.count_if(F.col("score") < self.config.tiers.suspicious).alias("suspicious")))
        one = one.join(C.quality_report(self.scored)).join(C.tier_counts(self.articles))
        limits = F.struct(*(F.lit(v).alias(k) for k, v in vars(self.config.tiers).items()))
        files_ = F.struct(*(F.lit(f"{path}/{name}").alias(name) for name in ("articles", "text", "duplicates", "suspicious", "report")))
        one = one.withColumn("limits", limits).withColumn("routing", F.lit(P.ROUTING)).withColumn("files", files_)
        return one.withColumn("notes", F.array(*map(F.lit, NOTES))).withColumn("input", F.lit(source)).withColumn("output", F.lit(path))

    def write(self, path: str, mode: str = "errorifexists", source: str = "") -> None:
        with in_one_step(self.docs.sparkSession, path, mode) as stage:
            files.write_records(self.articles, f"{stage}/articles")
            files.write_text(self.unique, f"{stage}/text")
            C.duplicate_log(self.marked).write.json(f"{stage}/duplicates")
            C.suspicious(self.scored, self.config.tiers).write.json(f"{stage}/suspicious")
            files.write_report(self.report(source, path), f"{stage}/report")

    def release(self) -> None:
        """Let go of the blocks that are held for further writes."""
        self.marked.unpersist()


@dataclass
class HybridSearch:
    """Articles (ord, id, article_number, tier, quality, text), with or without an index of their embeddings."""

    articles: DataFrame
    config: EngineConfig = EngineConfig()
    index: DataFrame | None = None
    #: What went wrong when the search was loaded; every outcome repeats it.
    warnings: tuple[str, ...] = ()

    def vectors(self, queries: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """(scores, notes on queries that could not be embedded); queries: query_id, query."""
        if self.index is None or not self.config.use_vectors:
            return None, None
        asked = materialize(embed_queries(queries.select("query_id", "query"), self.config.embedder, self.config.dimension, self.config.embed_attempts), "query-vectors")
        metric, told = self.config.metric, self.articles.select("ord", "tier", "id")
        near = V.nearest(asked.where("embedding is not null"), self.index, self.config.search.vector_candidates, metric, "tier")
        best = V.scores_by_id(near.join(told.select("ord", "id"), "ord"), metric)
        notes = asked.where("outage is not null").select("query_id", F.format_string(WARN_VECTORS, "outage").alias("note"))
        return told.join(best, ["tier", "id"]).select("query_id", "ord", "vector"), notes

    def ask(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(parsed, selected, outcome) of queries (query_id, query, allow)."""
        limits = self.config.search
        seen = S.parse_queries(queries).select("query_id", "reference")
        sought = materialize(rewrite_queries(queries.join(seen, "query_id"), self.config.generator).drop("reference"), "queries")
        parsed = S.parse_queries(sought)
        vectors, notes = self.vectors(sought.select("query_id", F.col("retrieval").alias("query")))
        top = materialize(S.top_by_tier(best_candidates(parsed, self.articles, vectors, limits), limits), "top")
        selected = materialize(S.merged(top, S.gates(parsed, top, limits), limits), "selected")
        return parsed, selected, S.outcome(parsed, selected, notes, self.warnings)


class AnswerPipeline:
    """Questions to answers with verified citations; keeps each conversation's last turns.

    Queries with a conv_id belong to conversations of their own: each prompt has its conversation's last turns. Turns are
    kept in a table at memory, which a new pipeline goes on with. Without conv_id there is one conversation, in this object.
    """

    def __init__(self, search: HybridSearch, memory: str | None = None):
        self.search, self.config, self.turns, self.memory = search, search.config, [], memory
        make(GENERATORS, self.config.generator)  # a name that is not known, or a service that can't be set up, fails here

    def said(self) -> DataFrame:
        """conv_id, turn, role, text of all conversations so far."""
        spark, schema = self.search.articles.sparkSession, "conv_id string, turn long, role string, text string"
        try:
            return spark.read.schema(schema).parquet(self.memory)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    def converse(self, queries: DataFrame) -> DataFrame:
        """As answers, of queries with a conv_id: with their conversations' turns, to which questions and answers are added.
        Of several queries of a conversation, each has the turns before the batch; they are kept in order of query_id."""
        if not self.memory:
            raise ValueError("conversations need a memory: a folder for their turns")
        said = materialize(self.said(), "turns")
        last = A.history(said.join(queries.select(F.col("conv_id").cast("string")).distinct(), "conv_id", "left_semi"), self.config.history_prompt)
        turn = F.struct("turn", "role", F.col("text").alias("content"))
        recent = last.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))
        own = queries.withColumn("conv_id", F.col("conv_id").cast("string"))
        out = materialize(self.answers(own.join(recent, "conv_id", "left")), "answers")
        ends = said.groupBy("conv_id").agg(F.max("turn").alias("end"))
        place = F.coalesce("end", F.lit(0)) + 2 * F.row_number().over(Window.partitionBy("conv_id").orderBy("query_id"))
        both = own.join(out.select("query_id", "answer"), "query_id").join(ends, "conv_id", "left").select("conv_id", place.alias("at"), "query", "answer")
        each = F.explode(F.array(*(F.struct((F.col("at") + n).alias("turn"), F.lit(role).alias("role"), F.col(text).alias("text")) for n, role, text in ((-1, "user", "query"), (0, "assistant", "answer")))))
        both.select("conv_id", each.alias("t")).select("conv_id", "t.*").write.mode("append").parquet(self.memory)
        return out

    def answers(self, queries: DataFrame) -> DataFrame:
        """query_id, answer, cited (plain numbers), cited_articles, attached, tier_path, needs_clarification, confidence,
        warnings. A service that fails doesn't end the query: the answer says so, and the articles found are attached."""
        parsed, selected, outcome = self.search.ask(queries)
        blocks = A.context_blocks(selected, self.search.articles).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "context"))), lambda x: x["context"]), "\n\n").alias("context"))
        history, asked = self.turns[-self.config.history_prompt :], parsed.join(blocks, "query_id", "left")
        if "turns" in queries.columns:
            history, asked = None, asked.join(queries.select("query_id", "turns"), "query_id")
        drafts = draft_answers(asked, self.config.generator, history, self.config.temperature)
        drafts = materialize(drafts.withColumn("draft", T.strip(F.col("draft"))), "drafts")
        text = F.when(F.col("failure").isNotNull(), F.concat(F.lit(UNAVAILABLE), "failure")).otherwise(F.col("draft"))
        cited = A.verify_citations(drafts.select("query_id", text.alias("draft")), selected)
        rows = outcome.join(drafts, "query_id").join(cited, "query_id").join(A.cited_articles(A.source_lines(selected, cited)), "query_id", "left")
        answer = F.when(F.coalesce(text, F.lit("")) == "", EMPTY).otherwise(text)
        told = F.when(F.col("needs_clarification"), CLARIFY).otherwise(F.concat_ws("\n\nSources:\n", answer, "sources"))
        warnings = F.concat("warnings", F.array_compact(F.array(F.when(F.col("failure").isNotNull(), WARN_DRAFT), "warning")))
        names = F.coalesce("cited_articles", F.array().cast("array<string>")).alias("cited_articles")
        return rows.select("query_id", told.alias("answer"), "cited", names, "attached", "tier_path", "needs_clarification", "confidence", warnings.alias("warnings"))

    def ask(self, query: str, allow_low_confidence: bool = False) -> dict:
        spark: SparkSession = self.search.articles.sparkSession
        asked = spark.createDataFrame([(0, query, allow_low_confidence)], "query_id long, query string, allow boolean")
        state = self.answers(asked).first().asDict()
        turns = [{"role": "user", "content": query}, {"role": "assistant", "content": state["answer"]}]
        self.turns = [*self.turns, *turns][-self.config.history_keep :]
        return state


def build_index(articles: DataFrame, config: EngineConfig, force: bool = False) -> None:
    vectors = embed_stored(articles, config.embedder, config.model, config.dimension, f"{config.index}.embeddings", config.embed_batch)
    files.write_index(vectors, config.index, _settings(config), force)


def refresh_index(articles: DataFrame, config: EngineConfig) -> list[tuple[str, int]]:
    """Bring a stored index up to its articles and return the (tier, chunk)s that were not the same: only articles of those
    are embedded, all others keep their stored vectors. An index that was built with other settings raises."""
    spark = articles.sparkSession
    vectors, manifest = files.read_index(spark, config.index)
    if not files.same_settings(manifest, _settings(config)):
        raise ValueError("the index was built with other settings; it has to be built anew")
    chunk = V.chunk_of(F.col("ord")).alias("chunk")
    changed = materialize(V.changed_chunks(files.read_chunks(spark, config.index), V.chunk_digests(articles)), "changed-chunks")
    dealt = articles.select("*", chunk)
    kept = dealt.join(changed, ["tier", "chunk"], "left_anti").drop("chunk").join(vectors.select("tier", "ord", "embedding"), ["tier", "ord"])
    touched = dealt.join(changed, ["tier", "chunk"], "left_semi").drop("chunk")
    fresh = embed_stored(touched, config.embedder, config.model, config.dimension, f"{config.index}.embeddings", config.embed_batch)
    files.write_index(kept.unionByName(fresh), config.index, _settings(config), True)
    return sorted((r["tier"], r["chunk"]) for r in changed.limit(files.NAMED).collect())


def _settings(config: EngineConfig) -> dict:
    return {"provider": config.embedder, "model": config.model, "dimension": config.dimension, "metric": config.metric}


def load_search(spark: SparkSession, config: EngineConfig) -> tuple[HybridSearch, list[str]]:
    """The search over the stored corpus, with the index if it is fit; else without, and why."""
    rows = files.read_corpus(spark, f"{config.corpus}/articles")
    rows = rows.withColumn("ord", F.col("ord") + F.when(F.col("tier") == "B", 1 << 40).when(F.col("tier") == "C", 1 << 41).otherwise(0))
    articles = rows.select("ord", "id", "article_number", "tier", F.col("ocr_quality_score").alias("quality"), "text")
    expected = _settings(config)
    if not config.use_vectors:
        return HybridSearch(articles, config), []
    if config.embedder not in EMBEDDERS:
        return _lexical(articles, config, f"no embedder named {config.embedder}")
    for attempt in range(2):
        try:
            vectors, manifest = files.read_index(spark, config.index)
            problem = files.index_problem(vectors, manifest, files.read_chunks(spark, config.index), articles, expected)
        except Exception as e:
            vectors, problem = None, f"no index could be read ({type(e).__name__})"
        if problem is None:
            return HybridSearch(articles, config, vectors.select("ord", "tier", "embedding")), []
        if attempt or not config.auto_build:
            break
        try:
            build_index(articles, config)
        except Exception as e:
            problem = f"the index could not be built ({type(e).__name__})"
            break
    return _lexical(articles, config, problem)


def _lexical(articles: DataFrame, config: EngineConfig, problem: str) -> tuple[HybridSearch, list[str]]:
    warnings = [f"{problem}; lexical search only"]
    return HybridSearch(articles, config, warnings=tuple(warnings)), warnings

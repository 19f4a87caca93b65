"""Context, citations, sources and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import patterns as P
from lexquarry.functions import text as T


def context_blocks(selected: DataFrame, articles: DataFrame) -> DataFrame:
    """query_id, rank, context: a header and the clipped text of each selected article."""
    header = F.concat(F.lit("["), F.col("final_rank").cast("string"), F.lit("] Art. "), "article_number", F.lit(" | tier="), "tier", F.lit(" | score="), F.col("fused").cast("string"))
    rows = selected.join(articles.select("ord", "text"), "ord")
    return rows.select("query_id", F.col("final_rank").alias("rank"), F.concat(header, F.lit("\n"), T.clip(F.col("text"))).alias("context"))


def verify_citations(drafts: DataFrame, selected: DataFrame) -> DataFrame:
    """query_id, cited, attached, warning: citations of a draft (query_id, draft) that the selection holds, in order of the
    draft and once each; without any, the numbers of the first two selected are attached."""
    number = T.plain_number(F.col("article_number"))
    held = selected.groupBy("query_id").agg(
        F.collect_set(number).alias("numbers"),
        F.array_distinct(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("final_rank", number.alias("n")))), 1, 2), lambda x: x["n"])).alias("first"),
    )
    none = F.array().cast("array<string>")
    rows = drafts.join(held, "query_id", "left").withColumn("numbers", F.coalesce("numbers", none)).withColumn("first", F.coalesce("first", none))
    valid = F.array_distinct(F.array_intersect(T.citations(F.coalesce("draft", F.lit(""))), F.col("numbers")))
    rows = rows.withColumn("valid", valid)
    attach = (F.size("valid") == 0) & (F.size("first") > 0)
    return rows.select("query_id", F.array_join(F.when(attach, F.col("first")).otherwise(F.col("valid")), ", ").alias("cited"), attach.alias("attached"), F.when(attach, P.WARN_CITATION).alias("warning"))


def source_lines(selected: DataFrame, cited: DataFrame) -> DataFrame:
    """query_id, pos, final_rank, article_number, source of the selected articles that are cited (cited: comma-joined
    numbers), by their place in the citations. Of articles with one number the last counts."""
    wanted = cited.select("query_id", F.posexplode(F.split("cited", ", ")).alias("pos", "number"))
    numbered = selected.withColumn("number", T.plain_number(F.col("article_number")))
    last = Window.partitionBy("query_id", "number").orderBy(F.desc("final_rank"))
    kept = numbered.withColumn("nth", F.row_number().over(last)).where("nth = 1").join(wanted, ["query_id", "number"])
    line = F.concat(F.lit("- Art. "), "article_number", F.lit(" (tier "), "tier", F.lit(", score "), F.col("fused").cast("string"), F.lit(")"))
    return kept.select("query_id", F.col("pos").cast("long").alias("pos"), "final_rank", "article_number", line.alias("source"))


def cited_articles(sources: DataFrame) -> DataFrame:
    """query_id, cited_articles (Art. and the number as the article has it) and sources, the lines as one text."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.concat(F.lit("Art. "), "article_number").alias("name"), "source")))
    return sources.groupBy("query_id").agg(ordered.alias("x")).select("query_id", F.col("x.name").alias("cited_articles"), F.array_join("x.source", "\n").alias("sources"))


def history(turns: DataFrame, keep: int = 12) -> DataFrame:
    """The last turns of each conversation; the role and emptiness filter comes after the cut."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = turns.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")
    return kept.where(F.col("role").isin("user", "assistant") & (F.col("text") != ""))

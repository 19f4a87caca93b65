"""Texts, JSON lines, tiered corpora, reports and vector indexes as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.operators import corpus as C
from lexquarry.operators import vectors as V
from lexquarry.sources.shared import in_one_step, materialize

RECORD = (
    "doc_id long, article_ord long, id string, article_number string, hierarchy struct<livre:string,titre:string,chapitre:string,section:string>, ocr_quality_score double, "
    "quality_signals struct<block_count:long,low_score_block_count:long,critical_reason_hits:long,reasons:array<string>>, text string, filter_tier string, filter_reason string, "
    "filter_metrics struct<ocr_quality_score:double,block_count:long,low_score_block_count:long,low_block_ratio:double,critical_reason_hits:long>"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, text: one row a file, whole; ids follow the paths' order by hash."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, line_no (from 1), line: what corpus.lines makes of read_texts, but many tasks read a file. Each reads a part
    of it; how many lines stand before a part is a sum over the parts. A byte order mark is not part of the first line.
    In a compressed file, an empty line after a last break other than a newline's counts as a line."""
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_block_start")]
    read = spark.read.option("lineSep", "\n").text(path).select(*meta, F.monotonically_increasing_id().alias("_at"), F.col("value"))
    # Breaks other than newlines are within the value; a carriage return before the newline belongs to it.
    inner = F.split(F.regexp_replace("value", r"\r\z", ""), T.BREAKS, -1)
    read = materialize(read.withColumn("_bytes", F.octet_length("value") + 1).withColumn("_lines", inner).withColumn("_return", F.endswith("value", F.lit("\r"))).drop("value"), "file-lines")
    whole = Window.partitionBy("file_path")
    parts = read.groupBy("file_path", "file_size", "file_block_start").agg(F.sum(F.size("_lines")).alias("_n"), F.sum("_bytes").alias("_sum"), F.max("_at").alias("_last"))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.sum("_sum").over(whole) - F.col("file_size")  # 1 if the file has no newline at its end; 3 less with a mark
    end = F.when(over.isin(1, -2) & (F.col("file_block_start") == F.max("file_block_start").over(whole)), F.col("_last"))
    parts = parts.select("file_path", "file_block_start", before.alias("_before"), end.alias("_end"))
    told = read.drop("file_size").join(parts, ["file_path", "file_block_start"])
    cut = F.col("_at").eqNullSafe(F.col("_end")) & (F.element_at("_lines", -1) == "") & ~F.col("_return")
    lines = F.when(cut, F.slice("_lines", 1, F.size("_lines") - 1)).otherwise(F.col("_lines"))
    upto = F.sum(F.size("_lines")).over(Window.partitionBy("file_path", "file_block_start").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    placed = told.select(F.xxhash64("file_path").alias("doc_id"), (F.col("_before") + F.coalesce(upto, F.lit(0))).alias("_start"), lines.alias("_lines"))
    return placed.select("doc_id", "_start", F.posexplode("_lines").alias("_pos", "line")).select("doc_id", (F.col("_start") + F.col("_pos") + 1).cast("long").alias("line_no"), "line")


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_records(graded: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Articles as JSON lines in a folder a tier; null levels are kept."""
    rows = C.records(graded).withColumn("tier", F.col("filter_tier"))
    rows.write.mode(mode).option("ignoreNullFields", "false").partitionBy("tier").json(path)


def read_corpus(spark: SparkSession, path: str, fraction: float = 0.8) -> DataFrame:
    """The first part of each tier, with ord, the place in the tier's file order: doc_id, then article."""
    rows = read_records(spark, path, RECORD + ", tier string")
    return C.head_fraction(rows.withColumn("_key", F.struct("doc_id", "article_ord")), "tier", "_key", fraction).drop("_key").withColumnRenamed("rank", "ord")


def write_text(unique: DataFrame, path: str, mode: str = "errorifexists") -> None:
    C.cleaned_text(unique).write.mode(mode).parquet(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report.coalesce(1).write.mode(mode).json(path)  # one row


def write_index(vectors: DataFrame, path: str, manifest: dict, force: bool = False) -> None:
    """Vectors with their meta rows, and a manifest with counts and fingerprints; an index that stands is kept without
    force. What was written is counted and measured before the manifest says that it is there."""
    spark = vectors.sparkSession
    with in_one_step(spark, path, "overwrite" if force else "errorifexists") as stage:
        V.index_meta(vectors).join(vectors.select("tier", "ord", "embedding"), ["tier", "ord"]).write.partitionBy("tier").parquet(f"{stage}/vectors")
        V.chunk_digests(vectors).write.parquet(f"{stage}/chunks")
        prints = V.over_chunks(spark.read.parquet(f"{stage}/chunks"))
        if problem := _misfit(spark.read.parquet(f"{stage}/vectors"), prints, manifest["dimension"]):
            raise ValueError(problem)
        given = spark.createDataFrame([manifest]).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
        prints.join(given).write.json(f"{stage}/manifest")  # one row a tier


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.json(f"{path}/manifest")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The digests of the stored articles' chunks: tier, chunk, n, d."""
    return spark.read.parquet(f"{path}/chunks")


def same_settings(manifest: DataFrame, expected: dict) -> bool:
    stored = manifest.select(*expected).distinct().limit(2).collect()
    return len(stored) == 1 and stored[0].asDict() == expected


#: Changed chunks that are told by name at most.
NAMED = 20


def _misfit(vectors: DataFrame, counted: DataFrame, dimension: int) -> str | None:
    """What is wrong with stored vectors: their number by tier (counted: tier, rows), or their dimension."""
    held = vectors.groupBy("tier").agg(F.count("*").alias("held"), F.count_if(~F.size("embedding").eqNullSafe(F.lit(dimension))).alias("odd"))
    bad = held.join(counted.select("tier", "rows"), "tier", "full_outer").where("not (held <=> rows) or odd > 0").limit(1).collect()
    return f"tier {bad[0]['tier']} has {bad[0]['held']} vectors for {bad[0]['rows']} articles, {bad[0]['odd']} of another dimension" if bad else None


def index_problem(vectors: DataFrame, manifest: DataFrame, chunks: DataFrame, articles: DataFrame, expected: dict) -> str | None:
    """Why a stored index (with its chunks' digests) can't be used for these articles, or None."""
    if not same_settings(manifest, expected):
        return "the index was built with other settings"
    changed = V.changed_chunks(chunks, V.chunk_digests(articles)).orderBy("tier", "chunk").limit(NAMED + 1).collect()
    if changed:
        named = ", ".join(f"{r['tier']}/{r['chunk']}" for r in changed[:NAMED])
        return f"the corpus has changed in chunks {named}{' and more' if len(changed) > NAMED else ''}"
    return _misfit(vectors, manifest, expected["dimension"])

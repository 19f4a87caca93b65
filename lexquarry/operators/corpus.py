"""From raw documents to graded articles: cleaning, reflow, exact dedup, scoring, headings, sections, tiers.

Every stage is one lazy plan over rows keyed by doc_id and an explicit ordinal; all windows are partitioned by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import patterns as P
from lexquarry.functions import spacing
from lexquarry.functions import text as T
from lexquarry.functions.quality import TierLimits, ocr_measures, ocr_score, rounded, tier, tier_reason, token_counts
from lexquarry.operators.numbering import numbered
from lexquarry.operators.reflow import heading_cuts


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by document. Whole texts are dealt before they are taken apart: a file whose texts are in one part (a
    Parquet row group) would else be split and cleaned by one task, however large it is. A plan that stores clean lines for
    several uses deals them once; else the windows do it. Spark keeps no dealing over a Python function, so all that lines
    need of such is done before."""
    return rows.repartition("doc_id")


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no (from 1), line. No line looks at another, so nothing is exchanged."""
    split = docs.select("doc_id", T.split_lines(F.coalesce(F.col(text), F.lit(""))).alias("parts")).select("doc_id", F.posexplode("parts").alias("pos", "line"))
    return split.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def clean(raw: DataFrame) -> DataFrame:
    """doc_id, line_no, line (typographically normal), reason (why it goes, else null)."""
    normal = made_once(raw.withColumn("_line", T.normalize_typography(F.col("line"))).drop("line"), "line", F.col("_line")).drop("_line")
    return made_once(normal, "reason", T.drop_reason(F.col("line"), F.col("line_no")))


def made_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is made once a row: as the output of a generator it can't be copied into filters and into the
    columns that are made of it, as Spark does with plain columns."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def clean_stats(cleaned: DataFrame) -> DataFrame:
    """Counters per drop reason; blank lines count as removed though they end a paragraph."""
    count = lambda reason: F.count_if(F.col("reason") == reason).alias(f"{reason}_lines")
    return cleaned.agg(F.count("*").alias("total_lines"), *(count(r) for r in ("page_marker", "orphan", "editorial", "blank")))


def blocks(cleaned: DataFrame) -> DataFrame:
    """doc_id, block_idx, block: paragraphs rebuilt from lines."""
    return renumber(rebuilt(cleaned), "part")


def rebuilt(cleaned: DataFrame) -> DataFrame:
    """doc_id, part, block: paragraphs, in the order of part.

    Blank lines and lines that open a block cut a document into islands; an island is cut again after text that has become
    a heading, which a scan over the lines tells. What a line adds to its block depends on the next line alone.
    """
    line, order = F.col("line"), Window.partitionBy("doc_id").orderBy("line_no")
    kept = cleaned.where(F.col("reason").isNull() | (F.col("reason") == "blank"))
    opens = F.col("reason").isNotNull() | T.starts_block(line)
    islands = kept.select("doc_id", "line_no", "line", "reason", F.sum(opens.cast("int")).over(order).alias("island"), F.row_number().over(order).alias("nth"))
    told = islands.where(F.col("reason").isNull()).select("doc_id", "line_no", "line", "island", heading_cuts(F.col("nth"), F.col("island"), line).alias("cut"))
    told = told.withColumn("part", F.struct("island", F.sum(F.col("cut").cast("int")).over(order).alias("nth")))
    after = F.when(F.lead("part").over(order) == F.col("part"), F.lead("line").over(order))
    pieces = told.select("doc_id", "part", "line_no", T.joined_to(line, after).alias("piece"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), "")
    built = made_once(pieces.groupBy("doc_id", "part").agg(whole.alias("_block")), "block", T.normalize_spaces(F.col("_block")))
    return built.where("block <> ''").drop("_block")


def renumber(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with block_idx, by their order; what was told of a block (TOLD) goes along."""
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return rows.select("doc_id", idx.cast("long").alias("block_idx"), "block", *(c for c in TOLD if c in rows.columns))


#: Columns that split_blocks makes of a block, for what comes later.
TOLD = ("hash", "counts")


def split_blocks(cleaned: DataFrame) -> DataFrame:
    """As split_articles(blocks(cleaned)), with hash and counts. All that Python makes of a block comes before one numbering,
    so that blocks are dealt once more and later windows by document find them dealt."""
    parts = rebuilt(cleaned).select("doc_id", "part", spacing.split_articles(F.col("block")).alias("parts")).select("doc_id", "part", F.posexplode("parts").alias("pos", "block"))
    return renumber(parts.withColumn("hash", block_hash(F.col("block"))).withColumn("counts", token_counts(F.col("block"))), "part", "pos")


def block_hash(block: Column) -> Column:
    return T.digest(T.canonical(block))


def split_articles(built: DataFrame) -> DataFrame:
    """Blocks with several article starts are cut at each: a start counts at the front, or after a mark that ends a sentence."""
    parts = built.select("doc_id", "block_idx", spacing.split_articles(F.col("block")).alias("parts"))
    return renumber(parts.select("doc_id", "block_idx", F.posexplode("parts").alias("pos", "block")), "block_idx", "pos")


def mark_duplicates(built: DataFrame) -> DataFrame:
    """Adds hash (of the canonical form) and first_idx, the first block of the document with that hash."""
    hashed = built if "hash" in built.columns else built.withColumn("hash", block_hash(F.col("block")))
    return hashed.withColumn("first_idx", F.min("block_idx").over(Window.partitionBy("doc_id", "hash")))


def unique_blocks(marked: DataFrame) -> DataFrame:
    return renumber(marked.where("block_idx = first_idx").drop("hash"), "block_idx")


def duplicate_log(marked: DataFrame) -> DataFrame:
    rest = marked.where("block_idx > first_idx")
    return rest.select("doc_id", F.col("block_idx").alias("duplicate_block_index"), F.col("first_idx").alias("first_seen_block_index"), "hash", T.preview(F.col("block")).alias("preview"))


def scored(unique: DataFrame) -> DataFrame:
    counted = unique if "counts" in unique.columns else unique.withColumn("counts", token_counts(F.col("block")))
    measured = made_once(counted, "m", ocr_measures(F.col("block"), F.col("counts")))
    return made_once(measured, "q", ocr_score(F.col("m"))).select("doc_id", "block_idx", "block", "q.score", "q.reasons")


def suspicious(rows: DataFrame, limits: TierLimits = TierLimits()) -> DataFrame:
    low = rows.where(F.col("score") < limits.suspicious)
    return low.select("doc_id", F.col("block_idx").alias("block_index"), rounded(F.col("score"), 4).alias("ocr_quality_score"), "reasons", T.preview(F.col("block"), 320).alias("excerpt"), F.col("block").alias("text"))


def with_hierarchy(rows: DataFrame) -> DataFrame:
    """Adds level (of a label), number, article_ord and the last label seen of each level; lower ones are not reset."""
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    block = F.col("block")
    # A block is a label first; only others can open an article.
    told = rows.withColumn("level", T.hierarchy_level(block)).withColumn("number", F.when(F.col("level").isNull(), T.article_number(block)))
    seen = {v: F.last(F.when(F.col("level") == v, block), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for v in P.LEVELS}
    opened = F.sum(F.col("number").isNotNull().cast("long")).over(order)
    return told.select("*", opened.alias("article_ord"), *(x.alias(v) for v, x in seen.items()))


def articles(rows: DataFrame, limits: TierLimits = TierLimits()) -> DataFrame:
    """One row an article: its blocks' text, signals and tier. Labels do not close an article; blocks before the first go."""
    body = with_hierarchy(rows).where((F.col("article_ord") > 0) & F.col("level").isNull())
    opens = F.col("number").isNotNull()
    critical = F.arrays_overlap("reasons", F.array(*map(F.lit, P.CRITICAL)))
    rolled = body.groupBy("doc_id", "article_ord").agg(
        F.max(F.when(opens, F.col("number"))).alias("article_number"),
        *(F.max(F.when(opens, F.col(v))).alias(v) for v in P.LEVELS),
        F.count("*").alias("block_count"),
        F.count_if(F.col("score") < limits.low_block).alias("low_score_block_count"),
        F.count_if(critical).alias("critical_reason_hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
        rounded(F.avg("score"), 4).alias("ocr_quality_score"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "block"))), lambda b: b["block"]), "\n\n").alias("text"),
    )
    grade = tier(F.col("ocr_quality_score"), F.col("critical_reason_hits"), F.col("low_score_block_count"), F.col("block_count"), limits)
    graded = rolled.withColumn("filter_tier", grade).withColumn("filter_reason", tier_reason(F.col("filter_tier")))
    ratio = rounded(F.col("low_score_block_count") / F.greatest(F.col("block_count"), F.lit(1)), 4)
    return graded.withColumn("low_block_ratio", ratio).withColumn("id", F.concat(F.lit("art-"), T.slug(F.col("article_number"))))


def records(graded: DataFrame) -> DataFrame:
    """Articles in the nested shape in which they are written."""
    return graded.select(
        "doc_id",
        "article_ord",
        "id",
        "article_number",
        F.struct(*P.LEVELS).alias("hierarchy"),
        "ocr_quality_score",
        F.struct("block_count", "low_score_block_count", "critical_reason_hits", "reasons").alias("quality_signals"),
        "text",
        "filter_tier",
        "filter_reason",
        F.struct("ocr_quality_score", "block_count", "low_score_block_count", "low_block_ratio", "critical_reason_hits").alias("filter_metrics"),
    )


def quality_report(rows: DataFrame) -> DataFrame:
    """Mean, least and greatest block score; 1 for an empty corpus."""
    told = lambda f, name: F.coalesce(rounded(f("score"), 4), F.lit(1.0)).alias(name)
    return rows.agg(told(F.avg, "avg_score"), told(F.min, "min_score"), told(F.max, "max_score"))


def tier_counts(graded: DataFrame) -> DataFrame:
    return graded.agg(F.count("*").alias("articles"), *(F.count_if(F.col("filter_tier") == t).alias(f"tier_{t.lower()}") for t in "ABC"))


def head_fraction(rows: DataFrame, by: str, order: str, fraction: float = 0.8) -> DataFrame:
    """The first part of each group, in order; the number kept is rounded down."""
    return numbered(rows, by, order).where(F.col("rank") <= F.floor(F.col("total") * F.lit(fraction))).drop("total")


def cleaned_text(unique: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "block"))), lambda b: b["block"]), "\n\n")
    return unique.groupBy("doc_id").agg(F.concat(joined, F.lit("\n")).alias("text"))

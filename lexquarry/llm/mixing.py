"""Temperature mixing of sources, in DataFrame functions only.

A source's weight is its token share to the power of alpha, made to sum to one. alpha falls from 1 (natural shares) to 0
(equal weights) as far as a target entropy asks and a limit on repetition allows. It is found by bisection; several levels
of it are weighed by one pass over the sources, and only their sums come to the driver. The weights are then realised:
each source's documents are permuted epoch by epoch, laid end to end until its share of the budget is met, and cut into
blocks, each of which holds every source in its proportion, permuted again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import fresh, materialize, table, text_or_empty

#: Target entropy as a part of the way from the natural one to that of equal weights.
ENTROPY_LIFT = 0.5
#: How often a source's documents may be repeated, at most.
MAX_EPOCHS = 4.0
#: Tokens of the mix, in those of the input.
BUDGET = 1.0
BLOCK_TOKENS = 4_000_000
LEVELS, PASSES = 6, 6
SEED = 7
#: Documents of one source and epoch are laid out in groups of about this many.
GROUP_DOCS = 20_000


@dataclass(frozen=True)
class Mix:
    entropy_lift: float = ENTROPY_LIFT
    max_epochs: float = MAX_EPOCHS
    budget: float = BUDGET
    block_tokens: int = BLOCK_TOKENS
    seed: int = SEED


def word_tokens(text: Column) -> Column:
    """Tokens as runs of other than white space; at least one, so that every document has a place."""
    return F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def find_alpha(shares: DataFrame, mix: Mix) -> float:
    """The greatest alpha whose weights reach the target entropy, or else the least that keeps the repetition limit.

    shares: source, tokens, p. If the limit does not even hold for natural shares (a budget over max_epochs), 1.
    """
    log_p = F.log("p")
    natural, n = shares.agg(-F.sum(F.col("p") * log_p), F.count("*")).first()
    if not n or n == 1:
        return 1.0
    target = natural + mix.entropy_lift * (math.log(n) - natural)

    def weigh(alphas: list[float]) -> list[tuple[float, float]]:
        """(entropy, largest number of epochs) for each alpha."""
        each = shares.select("p", F.posexplode(F.array(*map(F.lit, alphas))).alias("i", "a"))
        raised = F.exp(F.col("a") * log_p)
        rows = each.groupBy("i").agg(F.sum(raised).alias("z"), F.sum(raised * F.col("a") * log_p).alias("zl"), F.max(raised / F.col("p")).alias("top")).collect()
        found = {r["i"]: (math.log(r["z"]) - r["zl"] / r["z"], mix.budget * r["top"] / r["z"]) for r in rows}
        return [found[i] for i in range(len(alphas))]

    def bisect(good) -> float:
        """The greatest alpha in [0, 1] for which good(entropy, epochs) still holds as alpha falls past it; the interval
        is halved LEVELS times for each pass."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            parts = 1 << LEVELS
            points = [low + (high - low) * i / parts for i in range(1, parts)]
            states = weigh(points)
            a, b = 0, parts
            while b - a > 1:
                middle = (a + b) // 2
                a, b = (middle, b) if good(*states[middle - 1]) else (a, middle)
            low, high = low + (high - low) * a / parts, low + (high - low) * b / parts
        return low

    by_entropy = bisect(lambda entropy, _: entropy >= target) if mix.entropy_lift > 0 else 1.0
    if weigh([by_entropy])[0][1] <= mix.max_epochs:
        return by_entropy
    if weigh([1.0])[0][1] > mix.max_epochs:
        return 1.0
    # Epochs rise as alpha falls, so the least alpha within the limit is next to the greatest beyond it.
    return min(1.0, bisect(lambda _, epochs: epochs > mix.max_epochs) + 2.0 ** -(LEVELS * PASSES))


def plan(sized: DataFrame, mix: Mix) -> DataFrame:
    """source, tokens, docs, weight, quota (tokens of the mix), blocks: one row a source. sized: source, tokens, doc rows."""
    totals = materialize(sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = materialize(totals.withColumn("p", F.col("tokens") / F.lit(float(total or 1))), "shares")
    alpha = find_alpha(shares, mix)
    z = shares.agg(F.sum(F.exp(F.log("p") * alpha))).first()[0] or 1.0
    weight = F.exp(F.log("p") * alpha) / F.lit(float(z))
    budget = mix.budget * total
    blocks = max(1, math.ceil(budget / mix.block_tokens))
    quota = F.greatest(F.floor(weight * F.lit(float(budget)) + 0.5).cast("long"), F.lit(1))
    return shares.select("source", "tokens", "docs", weight.alias("weight"), quota.alias("quota"), F.lit(blocks).cast("long").alias("blocks"))


def order_key(seed: int, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)).cast("binary"))


def mix_rows(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as rows: doc_id, copy, source, tokens, epoch, start (tokens of its source before it), block, place.

    sized: doc_id, copy (tells rows that repeat a doc_id apart), source, tokens. Within an epoch the order is that of a
    digest of seed, epoch and row; a document is taken if its source's quota is not yet met where it starts. Sums run
    within groups of a source's digests and over the groups, so a large source is laid out by many tasks.
    """
    planned = plan(sized, mix)
    rows = sized.join(planned.withColumnRenamed("tokens", "all"), "source")
    epochs = F.ceil(F.col("quota") / F.col("all")).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1))).withColumn("key", order_key(mix.seed, "epoch", "doc_id", "copy"))
    groups = F.greatest(F.ceil(F.col("docs") / GROUP_DOCS), F.lit(1)).cast("long")
    leading = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("group", F.shiftright(leading * groups, 32))
    sums = rows.groupBy("source", "epoch", "group").agg(F.sum("tokens").alias("size"))
    earlier = Window.partitionBy("source", "epoch").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "epoch", "group", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "epoch", "group").orderBy("key", "doc_id", "copy", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(sums, ["source", "epoch", "group"])
    start = F.col("epoch") * F.col("all") + F.col("before") + F.col("inside")
    laid = laid.withColumn("start", start).where("start < quota").withColumn("block", F.expr("start * blocks div quota"))
    return laid.select("doc_id", "copy", "source", "tokens", "epoch", "start", "block", order_key(mix.seed + 1, "block", "epoch", "doc_id", "copy").alias("place"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, copy, source and tokens of docs. Null doc_id, source or text: 0, '' and one token. copy: a digest of the row's
    text; rows that agree in all of this are told apart by a number, in no set order (they are alike)."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("t"), source.alias("source"), word_tokens(text_or_empty()).alias("tokens"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "t", "source").orderBy("tokens"))
    return materialize(base.withColumn("copy", F.concat_ws("-", F.col("t").cast("string"), nth.cast("string"))).select("doc_id", "copy", "source", "tokens"), "sized")


def remix(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs as the mix takes them: rows left out, kept or repeated, with their own columns.

    The rows of a block stand together in one partition, in the order of the block's permutation; rows that repeat each
    other are told apart by a number, in no set order (they are alike).
    """
    times = fresh(docs, "times")
    names = {c: fresh(docs, c) for c in ("doc_id", "t", "source")}
    rows = mix_rows(sized(docs), mix).withColumn("t", F.split("copy", "-(?=[0-9]+$)")[0].cast("long"))
    # Rows that repeat each other are interchangeable: each gets the places of one of them.
    per_copy = rows.groupBy("doc_id", "t", "source", "copy").agg(F.sort_array(F.collect_list(F.struct("block", "place"))).alias("spots"))
    counts = per_copy.groupBy("doc_id", "t", "source").agg(F.sort_array(F.collect_list("spots")).alias(times))
    counts = counts.select(times, *(F.col(c).alias(n) for c, n in names.items()))
    source = F.coalesce(docs["source"].cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    nth = fresh(docs, "nth")
    number = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), source).orderBy(F.lit(1)))
    numbered = docs.withColumn(nth, number)
    same = (F.coalesce(numbered["doc_id"].cast("long"), F.lit(0)) == F.col(names["doc_id"])) & (F.xxhash64(numbered["text"]) == F.col(names["t"])) & (source == F.col(names["source"]))
    joined = numbered.join(counts, same).where(F.col(nth) <= F.size(times))
    placed = joined.select(*(numbered[c] for c in docs.columns), F.explode(F.element_at(F.col(times), F.col(nth))).alias(times))
    block, place = F.col(times)["block"], F.col(times)["place"]
    return placed.repartition(block).sortWithinPartitions(block, place).select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text"))
    rows = docs.select(F.col("doc_id"), F.lit("").alias("copy"), F.coalesce("source", F.lit("")).alias("source"), word_tokens(text_or_empty()).alias("tokens"))
    return mix_rows(materialize(rows, "sized")).select("doc_id", "source", "tokens", "epoch", "start", "block", "place")


#: The same in SQL. Bisection is a recursive query: PASSES * LEVELS halvings of [0, 1].
SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(source, '') AS source,
         greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1)::BIGINT AS tokens
  FROM documents),
totals AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM sized GROUP BY source),
shares AS (SELECT *, tokens / (SELECT sum(tokens)::DOUBLE FROM totals) AS p FROM totals),
target AS (SELECT -sum(p * ln(p)) AS plain, count(*) AS n FROM shares),
entropy AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN (low + high) / 2 ELSE low END, CASE WHEN good THEN high ELSE (low + high) / 2 END
  FROM (SELECT step, low, high,
               (SELECT ln(sum(exp((low + high) / 2 * ln(p)))) - sum(exp((low + high) / 2 * ln(p)) * (low + high) / 2 * ln(p)) / sum(exp((low + high) / 2 * ln(p))) FROM shares)
               >= (SELECT plain + {ENTROPY_LIFT} * (ln(n) - plain) FROM target) AS good
        FROM entropy WHERE step < {LEVELS * PASSES})),
by_entropy AS (SELECT CASE WHEN (SELECT n FROM target) = 1 THEN 1.0 ELSE low END AS a FROM entropy WHERE step = {LEVELS * PASSES}),
reached AS (SELECT {BUDGET} * max(exp(a * ln(p)) / p) / sum(exp(a * ln(p))) AS epochs FROM shares, by_entropy),
epochs AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN (low + high) / 2 ELSE low END, CASE WHEN good THEN high ELSE (low + high) / 2 END
  FROM (SELECT step, low, high,
               (SELECT {BUDGET} * max(exp((low + high) / 2 * ln(p)) / p) / sum(exp((low + high) / 2 * ln(p))) FROM shares) > {MAX_EPOCHS} AS good
        FROM epochs WHERE step < {LEVELS * PASSES})),
alpha AS (
  SELECT CASE WHEN (SELECT epochs FROM reached) <= {MAX_EPOCHS} THEN (SELECT a FROM by_entropy)
              WHEN {BUDGET} > {MAX_EPOCHS} THEN 1.0
              ELSE least(1.0, (SELECT low FROM epochs WHERE step = {LEVELS * PASSES}) + power(2, -{LEVELS * PASSES})) END AS a),
weights AS (SELECT shares.*, exp(ln(p) * a) / (SELECT sum(exp(ln(p) * a)) FROM shares, alpha) AS weight FROM shares, alpha),
plan AS (
  SELECT source, tokens AS total, greatest(floor(weight * ({BUDGET} * (SELECT sum(tokens) FROM totals)) + 0.5)::BIGINT, 1) AS quota,
         greatest(1, ceil({BUDGET} * (SELECT sum(tokens) FROM totals) / {BLOCK_TOKENS}))::BIGINT AS blocks
  FROM weights),
rows AS (
  SELECT doc_id, source, tokens, total, quota, blocks, unnest(range(0, ceil(quota / total)::BIGINT)) AS epoch
  FROM sized JOIN plan USING (source)),
keyed AS (SELECT *, md5('{SEED}|' || epoch || '|' || doc_id || '|') AS key FROM rows),
laid AS (
  SELECT *, epoch * total + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM keyed)
SELECT doc_id, source, tokens, epoch::INTEGER AS epoch, start::BIGINT AS start, (start * blocks // quota)::BIGINT AS block,
       md5('{SEED + 1}|' || (start * blocks // quota)::BIGINT || '|' || epoch || '|' || doc_id || '|') AS place
FROM laid WHERE start < quota
"""

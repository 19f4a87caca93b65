"""Quality rules: counting rules, and perplexity bands of a modified Kneser-Ney n-gram model.

The model is over UTF-16 code units, one for each language: an n-gram of four is exactly 64 bits, whatever the script,
and contexts and lower orders are parts of those bits. Spark counts n-grams and lower orders and works out their
probabilities as tables that grow with the corpus. No task and no driver holds the model: documents are dealt into
groups, the n-grams of a group are joined with the table, and come back as the group's own sorted hash arrays, which
its texts probe by binary search. Texts without surprise pass; bands on both sides reject the others by language.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import fresh, materialize, shrunk, table, text_or_empty

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Code units in an n-gram, and bits of one. A text begins after ORDER - 1 times EDGE.
ORDER, UNIT = 4, 16
EDGE = 0xFFFF
#: Symbols that are scored or counted at once.
CHUNK = 1_000_000
#: Symbols of the documents in a group, about.
GROUP_SYMBOLS = 24_000_000
#: Seen n-grams always leave this much to unseen ones, so no probability is zero.
LEAST_DISCOUNT = 0.01
#: A document is rejected if its mean surprise is so many (robust) deviations, and BAND_SLACK nats, off its language's median.
BAND_DEVIATIONS = 5.0
BAND_SLACK = 0.01
#: Steps of surprise, per nat, in which medians are counted.
STEPS = 1000

_SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def segments(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(document numbers, starts, n-grams as 64-bit keys) of some documents, or parts of one, of about CHUNK symbols."""
    held, owners, size = [], [], 0

    def out():
        s = np.concatenate(held).astype(np.uint64)
        keys = s[: len(s) - ORDER + 1].copy()
        for i in range(1, ORDER):
            keys = keys << np.uint64(UNIT) | s[i : len(s) - ORDER + 1 + i]
        sizes = np.array([len(h) for h in held])
        # n-grams that reach over into the next part are not its own.
        real = np.ones(len(keys), bool)
        real[(np.cumsum(sizes)[:-1, None] - np.arange(1, ORDER)).ravel()] = False
        return owners, np.concatenate([[0], np.cumsum(sizes - ORDER + 1)[:-1]]), keys[real].view(np.int64)

    for n, text in enumerate(texts):
        own = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
        own = np.concatenate([np.full(ORDER - 1, EDGE, np.uint16), own])
        for at in range(0, len(own) - ORDER + 1, CHUNK):
            held.append(own[at : at + CHUNK + ORDER - 1])
            owners.append(n)
            size += len(held[-1])
            if size >= CHUNK:
                yield out()
                held, owners, size = [], [], 0
    if held:
        yield out()


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of texts in order, and how often each occurs."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, _, own in segments(texts):
        more, n = np.unique(own, return_counts=True)
        keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    return keys, counts


def _by_lang(pdf: pd.DataFrame, texts: list[str]) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    langs = pdf["lang"].to_numpy()
    for lang in dict.fromkeys(langs):
        rows = np.flatnonzero(langs == lang)
        yield lang, rows, [texts[i] for i in rows]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, key, n of every n-gram in docs (lang, text); tasks sum their own before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, _, texts in _by_lang(batch, batch["text"].tolist()):
                keys, n = ngrams(texts)
                yield pd.DataFrame({"lang": np.full(len(keys), lang, object), "key": keys, "n": n})

    return docs.select("lang", "text").mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def discounts(level: DataFrame) -> DataFrame:
    """lang and d1, d2, d3: modified Kneser-Ney discounts for counts of one, two, and more (column n of level)."""
    counted = level.groupBy("lang").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)))
    some = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def of(i: int, otherwise: float) -> Column:  # where counts of counts are too few to estimate from
        d = i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        return F.when(some, F.least(F.greatest(d, F.lit(LEAST_DISCOUNT)), F.lit(float(i)))).otherwise(otherwise).alias(f"d{i}")

    return counted.select("lang", of(1, 0.5), of(2, 0.75), of(3, 0.9))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, key, logp of every n-gram in counts (lang, key, n).

    Below the top order, counts are of the different units that come before. A context has no more n-grams than there
    are code units, so no window grows with the corpus.
    """
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        rest = F.col("key").bitwiseAND(F.lit((1 << UNIT * order) - 1).cast("long")).alias("key")
        levels[order] = materialize(levels[order + 1].groupBy("lang", rest).agg(F.count("*").alias("n")), "ngrams")
    every = [discounts(level).withColumn("order", F.lit(order)) for order, level in levels.items()]
    told = materialize(functools.reduce(DataFrame.unionByName, every).coalesce(1), "discounts")  # ORDER rows a language
    lower = None
    for order in range(1, ORDER + 1):
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = levels[order].join(told.where(F.col("order") == order), "lang").select("lang", "key", "n", off.alias("off"))
        context = Window.partitionBy("lang", F.shiftrightunsigned("key", UNIT) if order > 1 else F.lit(0))
        total = F.sum("n").over(context)
        share, left = (F.col("n") - F.col("off")) / total, F.sum("off").over(context) / total
        if lower is None:  # below single units all are alike
            lower = rows.select("lang", "key", (share + left / F.count("*").over(context)).alias("p"))
            continue
        rest = F.col("key").bitwiseAND(F.lit((1 << UNIT * (order - 1)) - 1).cast("long"))
        rows = rows.select("lang", "key", rest.alias("rest"), share.alias("share"), left.alias("left"))
        lower = rows.join(lower.withColumnRenamed("key", "rest"), ["lang", "rest"]).select("lang", "key", (F.col("share") + F.col("left") * F.col("p")).alias("p"))
    return lower.select("lang", "key", F.log("p").alias("logp"))


@dataclass
class SortedHashArray:
    """64-bit keys in order, and their values."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> SortedHashArray:
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; all of them are held."""
        at = np.searchsorted(self.keys, keys)
        if len(keys) and (at.max() >= len(self.keys) or (self.keys[at] != keys).any()):
            raise KeyError("n-gram without a probability")
        return self.values[at]


def surprise(texts: list[str], model: SortedHashArray) -> tuple[np.ndarray, np.ndarray]:
    """Negative log probability of each text, and of how many symbols."""
    sums, sizes = np.zeros(len(texts)), np.zeros(len(texts))
    for owners, starts, keys in segments(texts):
        np.add.at(sums, owners, np.add.reduceat(model.get(keys), starts))
        np.add.at(sizes, owners, np.diff(np.append(starts, len(keys))))
    return -sums, sizes


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """The columns of BASE."""
    words = text.encode().split()
    n, chars = len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeated = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        pair = a[:-2] * len(ids) + a[1:-1]
        if len(ids) > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        _, inverse, times = np.unique(pair * len(ids) + a[2:], return_inverse=True, return_counts=True)
        twice = times[inverse] >= 2
        cover = np.zeros(n, bool)
        for i in range(3):
            cover[i : n - 2 + i] |= twice
        repeated = int(cover.sum())
    return n, chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


def score(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, lang, BASE, base_failed, surprise (nats a symbol) and word_surprise (log of nats a word) of docs
    (doc_id, lang, text); null where there is nothing to divide by."""
    counts = materialize(count_ngrams(docs), "ngrams")
    symbols = counts.agg(F.sum("n")).first()[0] or 0
    model = materialize(kneser_ney(counts).sortWithinPartitions("lang", "key"), "model")
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-symbols // GROUP_SYMBOLS) or 1)).cast("int")
    known = F.coalesce("doc_id", F.lit(0)).alias("doc_id")  # a long with nulls would not stay one in pandas
    dealt = docs.select(group.alias("group"), known, F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("text_hash"), "lang", shrunk(F.col("text")).alias("packed"))

    def texts_of(pdf: pd.DataFrame) -> list[str]:
        return [zstandard.decompress(p).decode() for p in pdf["packed"]]

    def asked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(lang, ngrams(texts)[0]) for lang, _, texts in _by_lang(pdf, texts_of(pdf))]
        return pd.DataFrame({"group": key[0], "lang": np.repeat([x for x, _ in parts], [len(k) for _, k in parts]), "key": np.concatenate([k for _, k in parts])})

    def scored(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        texts, names = texts_of(pdf), [c.split()[0] for c in BASE.split(", ")]
        out = pd.DataFrame([base_counts(t) for t in texts], columns=names, dtype="int64")
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
        own = {lang: SortedHashArray.of(g["key"].to_numpy(), g["logp"].to_numpy()) for lang, g in told.groupby("lang")}
        nats, sizes = np.zeros(len(texts)), np.zeros(len(texts))
        for lang, rows, part in _by_lang(pdf, texts):
            nats[rows], sizes[rows] = surprise(part, own.get(lang, SortedHashArray(np.zeros(0, np.int64), np.zeros(0))))
        with np.errstate(invalid="ignore", divide="ignore"):
            out["surprise"], out["word_surprise"] = np.where(sizes > 0, nats / sizes, np.nan), np.log(np.where(out["n_words"] > 0, nats / out["n_words"], np.nan))
        return pd.concat([pdf[["doc_id", "none", "text_hash", "lang"]].reset_index(drop=True), out], axis=1)

    grams = dealt.groupBy("group").applyInPandas(asked, "group int, lang string, key long")
    told = grams.join(model, ["lang", "key"]).select("group", "lang", "key", "logp")
    out = dealt.groupBy("group").cogroup(told.groupBy("group")).applyInPandas(scored, f"doc_id long, none boolean, text_hash long, lang string, {BASE}, base_failed boolean, surprise double, word_surprise double")
    return out.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")


def bands(scored: DataFrame, measure: str) -> DataFrame:
    """lang, low, high: each language's band of this measure, from its median over all documents that pass the base rules.

    Medians are read off counts by steps: a few thousand rows a language, however many documents it has.
    """

    def median(df: DataFrame, step: str) -> DataFrame:
        by = Window.partitionBy("lang")
        upto = F.sum("n").over(by.orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
        marked = df.groupBy("lang", step).agg(F.sum("n").alias("n")).withColumn("upto", upto).withColumn("total", F.sum("n").over(by))
        return marked.where(F.col("upto") * 2 >= F.col("total")).groupBy("lang").agg(F.min(step).alias(f"mid_{step}"))

    passed = scored.where(~F.col("base_failed") & F.col(measure).isNotNull())
    steps = passed.groupBy("lang", F.round(F.col(measure) * STEPS).cast("long").alias("step")).agg(F.count("*").alias("n"))
    steps = materialize(steps, "surprise")
    middle = median(steps, "step")
    off = steps.join(middle, "lang").withColumn("off", F.abs(F.col("step") - F.col("mid_step")))
    reach = F.col("mid_off") * 1.4826 * BAND_DEVIATIONS / STEPS + BAND_SLACK
    found = middle.join(median(off, "off"), "lang").select("lang", (F.col("mid_step") / STEPS - reach).alias("low"), (F.col("mid_step") / STEPS + reach).alias("high"))
    return materialize(found.coalesce(1), "bands")  # a row a language: Spark sees its size when it chooses the join


def judge(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, text_hash, lang, BASE, base_failed, surprise, word_surprise, perplexity (a symbol), kept.

    A document stays if it passes the base rules, and both its perplexity a symbol and its perplexity a word are in its
    language's bands: marks that are strewn between words lower the one and raise the other. Null or empty text: no
    words, so the base rules fail. A null lang is a language of its own. Rows that repeat are judged alike. The model is
    of the same documents, all of them.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    scored = materialize(score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text_or_empty().alias("text"))), "scored")
    judged, inside = scored, F.lit(True)
    for measure in ("surprise", "word_surprise"):
        judged = judged.join(bands(scored, measure).select("lang", F.col("low").alias(f"{measure}_low"), F.col("high").alias(f"{measure}_high")), "lang", "left")
        inside &= F.coalesce(F.col(measure).between(F.col(f"{measure}_low"), F.col(f"{measure}_high")), F.lit(True))
    return judged.select(*scored.columns, F.exp("surprise").alias("perplexity"), (~F.col("base_failed") & inside).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    row, text_hash = fresh(docs, "doc"), fresh(docs, "hash")
    good = judge(docs).where("kept").select(F.col("doc_id").alias(row), F.col("text_hash").alias(text_hash)).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(F.col(row)) & (F.xxhash64(text_or_empty()) == F.col(text_hash)), "left_semi")


def op7(spark, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(c.split()[0] for c in BASE.split(", ")), "base_failed", "kept", F.round("perplexity", 6).alias("perplexity"))

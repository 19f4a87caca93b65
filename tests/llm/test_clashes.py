"""Every operator with columns of the names that it uses or gives itself, nulls, repeated rows, and an empty table."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import linededup, media, mixing, packing, quality, secrets, shingles, simhash, suffix, tokencount, tokenids, urlfilter

WORDS = public_tokenizers.path("word_bpe_49k.json")
TAKEN = [
    "_rank", "_salt", "_before", "_lead", "_hash", "__key", "__hash", "__packed", "__rank", "__salt", "__times", "__nth", "__doc", "__keys", "__kept", "__id", "sequence_id", "offset", "piece", "length", "ids", "n_lines",
    "n_dropped", "cut", "spans", "kept", "text_hash", "fp", "component_id", "root", "host", "path", "rule", "verdict", "sniffed", "media", "copy", "epoch", "block", "place", "tokens", "n", "d", "keys", "group", "packed",
    "surprise", "low", "high", "row", "hits", "owner", "value", "t1", "t2", "found", "whole", "lead",
]
OPERATORS = {
    "mixing": mixing.remix,
    "packing": lambda d: packing.pack(d.withColumn("length", F.lit(3).cast("long")), 8, ("doc_id",)),
    "packing documents": lambda d: packing.pack_documents(d, packing.byte_bpe()),
    "urls": lambda d: urlfilter.judge(d.withColumn("url", F.lit("http://a.org/es/x")), [("block", "org/es/")], ["b.com"]),
    "lines": linededup.dedup_lines,
    "media": lambda d: media.inspect(d.withColumn("media", media.store(F.col("text")))),
    "tokens": lambda d: tokencount.count_tokens(d, ["a", "the", "▁the", "▁"]),
    "token ids": lambda d: tokenids.read_ids(tokenids.write_ids(d, WORDS)),
    "quality": quality.judge,
    "good": quality.keep_good,
    "secrets": secrets.scan,
    "simhash": simhash.near_duplicates,
    "one of each": simhash.keep_one,
    "one of each, shingles": shingles.keep_one,
    "repeats": suffix.remove_repeats,
}
#: Operators that give a row for each row, with all its columns.
WHOLE = {"packing", "urls", "lines", "media", "repeats"}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    text = "the same few words over and over, and a line of them\n" * 9
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text + "x", None, None), (None, None, None, None), (3, "", "de", "a"), (None, text, "fr", "b")]
    docs = spark.createDataFrame([(*r, *(i * 1000 + j for j in range(len(TAKEN)))) for i, r in enumerate(rows)], f"doc_id long, text string, lang string, source string, {', '.join(f'{c} int' for c in TAKEN)}")
    out = OPERATORS[name](docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    got = out.collect()
    if name in WHOLE:
        own = [c for c in docs.columns if not (name == "packing" and c == "length") and not (name in ("media",) and c == "media") and c != "text"]
        assert sorted(repr([r[c] for c in own]) for r in got) == sorted(repr([r[c] for c in own]) for r in docs.collect())
    assert OPERATORS[name](docs.where("false")).count() == 0

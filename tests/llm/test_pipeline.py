"""The stages against plain Python on a small table."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from lexquarry.llm import mixing, packing, quality
from tests.llm.test_shingles import brute


def documents(rng):
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(300)]
    common = " ".join(rng.choices(words, k=12))
    texts = ["\n".join([common, *(" ".join(rng.choices(words, k=30)) for _ in range(4))] if i % 2 else [" ".join(rng.choices(words, k=80))]) for i in range(80)]
    texts += texts[:10] + [texts[1], "few words", None, ""]
    for text in texts[20:32]:  # near copies: a word or two changed, or so many that they are none
        changed = text.split(" ")
        for _ in range(rng.choice([1, 1, 20])):
            changed[rng.randrange(len(changed))] = rng.choice(words)
        texts.append(" ".join(changed))
    return [(i, t, rng.choice(["en", "de", None]), "big" if rng.random() < 0.7 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    rows = documents(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "pack":
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            now = spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = out.collect() if name == "pack" else now.collect()
    text = {i: t or "" for i, t, *_ in rows}
    good = {i for i, t in text.items() if (b := quality.base_counts(t))[0] >= 50 and 100 * b[4] <= 50 * b[0]}
    assert {r["doc_id"] for r in seen["quality rules"]} == good
    holders = Counter(line for i in good for line in {*text[i].split("\n")} if len(line) >= 20)
    last = {line: max(i for i in good if line in text[i].split("\n")) for line, n in holders.items() if n >= 3}
    lines = {i: "\n".join(x for x in text[i].split("\n") if last.get(x, i) == i) for i in good}
    assert {r["doc_id"]: r["text"] for r in seen["line dedup"]} == lines
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line dedup"])
    sets = {i: brute(t) for i, t in lines.items()}
    kept, left, near = set(), set(lines), 0
    while left:
        group, new = set(), {min(left)}
        while new:
            group |= new
            new = {j for j in left - group if any(sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in new)}
        near += len({lines[i] for i in group}) > 1
        kept.add(min(group))
        left -= group
    assert {r["doc_id"] for r in seen["near dedup"]} == kept < set(lines)
    assert near >= 2
    mixed = Counter(r["doc_id"] for r in seen["mix sources"])
    want = mixing.mix_rows(mixing.sized(spark.createDataFrame(seen["near dedup"], docs.schema))).groupBy("doc_id").count().collect()
    assert mixed == {r["doc_id"]: r["count"] for r in want}
    plain = Tokenizer.from_file(packing.byte_bpe().json)
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in seen["pack"])
    asked = Counter()
    for r in seen["mix sources"]:
        ids = np.array([*plain.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes()
        for n, (start, length) in enumerate(packing.cut(ids, 1024)):
            import zlib

            asked[r["doc_id"], n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])] += 1
    assert pieces == asked
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["pack"])

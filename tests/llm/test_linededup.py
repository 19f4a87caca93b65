import hashlib
import random

from lexquarry.llm import linededup as L


def brute(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = ["A common line of more than twenty", " a COMMON line of more than twenty\t", "é" * 19, "É" * 20, "é" * 20, "short", "", "x" * 30, "Y" * 25]
    rows = [(i, "\n".join(rng.choices([*pool, f"own line number {i} of this one"], k=rng.randint(0, 8)))) for i in range(60)]
    rows += [(5, rows[5][1]), (61, None), (62, ""), (None, pool[0]), (None, None), (63, "\n".join(pool * 500))]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_lines int, keys int")
    out = L.dedup_lines(docs).collect()
    assert docs.columns == L.dedup_lines(docs).columns[:4]
    got = sorted(((r["doc_id"], len((t or "").split("\n")), r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out for t in [next(t for i, t in rows if i == r["doc_id"] and (i is not None or t == (r["text"] or None)))]), key=repr)
    assert got == brute(rows)
    assert L.dedup_lines(docs.where("false")).count() == 0

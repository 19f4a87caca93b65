"""Outages, conversations, resumed builds, writes in one step, and the HTTP clients against a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry import clients, providers
from lexquarry.config import EngineConfig
from lexquarry.plans.pipelines import AnswerPipeline, HybridSearch
from lexquarry.sources.shared import in_one_step


def test_a_dead_service_costs_one_schedule_a_task(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "calls")

    class Down:
        def embed(self, texts, kind):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            raise ConnectionError("no route")

    monkeypatch.setitem(providers.EMBEDDERS, "down", lambda dimension: Down())
    queries = spark.range(1000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 10 == 0, "").otherwise(F.concat(F.lit("q"), "id")).alias("query")).coalesce(1)
    out = providers.embed_queries(queries, "down", 8, attempts=2).collect()
    assert len(out) == 1000 and all((r["embedding"] == [0.0] * 8 and r["outage"] is None) if r["query"] == "" else (r["embedding"] is None and r["outage"] == "no route") for r in out)
    calls = [int(x) for x in open(log)]
    assert sum(calls) == 900 + calls[0] and len(calls) < 40  # one batch waits and tries again, each later one tries once


def test_a_breaker_closes_again():
    breaker, answers = providers.Breaker(1), iter([ValueError("a"), ValueError("b"), 5, 6])

    def call():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert [breaker.call(call) for _ in range(4)] == [(None, "a"), (None, "b"), (5, None), (6, None)]


@pytest.fixture
def articles(spark):
    rows = [(i, f"art-{i}", str(i), "A", 1.0, f"vol numero{i} peine sanction") for i in range(1, 61)]
    return spark.createDataFrame(rows, "ord long, id string, article_number string, tier string, quality double, text string")


def test_conversations_have_their_own_turns(spark, articles, tmp_path, monkeypatch):
    class Telling:
        def rewrite(self, query):
            return query

        def answer(self, query, context, history, temperature):
            return "said: " + "|".join(t["content"] if t["role"] == "user" else "=" for t in history)

    monkeypatch.setitem(providers.GENERATORS, "telling", Telling)
    config, memory = EngineConfig(generator="telling", use_vectors=False), str(tmp_path / "memory")
    for n in range(3):
        batch = spark.createDataFrame([(c, f"c{c}", f"peine numero{c} fois {n}", False) for c in range(1, 51)], "query_id long, conv_id string, query string, allow boolean")
        out = AnswerPipeline(HybridSearch(articles, config), memory).converse(batch)  # a new object each time, as after a restart
        for r in out.collect():
            before = "|=|".join(f"peine numero{r['query_id']} fois {m}" for m in range(n)) + ("|=" if n else "")
            assert r["answer"].split("\n")[0] == f"said: {before}".strip()
    said = AnswerPipeline(HybridSearch(articles, config), memory).said()
    assert said.count() == 300 and said.groupBy("conv_id").agg(F.max("turn").alias("n")).where("n <> 6").count() == 0


def test_a_build_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "sent")

    class Counting(providers.HashEmbedder):
        limit = 10**9

        def embed(self, texts, kind):
            sent = sum(1 for _ in open(log)) if (tmp_path / "sent").exists() else 0
            if sent + len(texts) > Counting.limit:
                raise SystemError("killed")
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return super().embed(texts, kind)

    monkeypatch.setitem(providers.EMBEDDERS, "counting", Counting)
    monkeypatch.setattr(providers, "ATTEMPTS", 1)
    rows = spark.createDataFrame([(i, f"text {i % 90}") for i in range(100)], "ord long, text string")
    build = lambda df: providers.embed_stored(df, "counting", "m", 16, f"{tmp_path}/store", batch=5, commit_rows=20).orderBy("ord").collect()
    Counting.limit = 50
    with pytest.raises(Exception, match="killed|failed"):
        build(rows)
    kept = spark.read.parquet(f"{tmp_path}/store").count()
    assert 0 < kept <= 50
    Counting.limit = 10**9
    before = sum(1 for _ in open(log))
    out = build(rows)
    assert sum(1 for _ in open(log)) - before == 90 - kept  # only the rest, and equal texts once
    assert [r["ord"] for r in out] == list(range(100))
    want = providers.HashEmbedder(16).embed([r["text"] for r in out], "document")
    assert np.array_equal(np.array([r["embedding"] for r in out], np.float32), want)
    build(rows.where("ord < 99").union(spark.createDataFrame([(99, "changed")], rows.schema)))
    assert open(log).read().splitlines()[-1] == "changed" and sum(1 for _ in open(log)) - before == 91 - kept


def test_a_write_that_stops_leaves_what_stood(spark, tmp_path):
    path = f"{tmp_path}/out"
    for n, fails in ((1, False), (2, True), (3, False)):
        try:
            with in_one_step(spark, path, "overwrite") as stage:
                spark.range(n).write.parquet(f"{stage}/a")
                if fails:
                    raise KeyboardInterrupt
                spark.range(n).write.parquet(f"{stage}/b")
        except KeyboardInterrupt:
            pass
        assert spark.read.parquet(f"{path}/a").count() == spark.read.parquet(f"{path}/b").count() == (n if not fails else 1)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(FileExistsError), in_one_step(spark, path):
        pass


def test_http_clients():
    seen, status = [], [200]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            reply = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]} if "input" in body else {"choices": [{"message": {"content": " Art. 5 "}}]}
            self.send_response(status[0])
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    environ = {"LEXQUARRY_SERVICE_URL": f"http://127.0.0.1:{server.server_port}/v1/", "LEXQUARRY_SERVICE_KEY": "k", "LEXQUARRY_EMBED_MODEL": "e", "LEXQUARRY_CHAT_MODEL": "c"}
    try:
        embedder = clients.HttpEmbedder(2, environ)
        assert embedder.embed(["a", "bcd"], "query").tolist() == [[1.0, 1.0], [3.0, 1.0]]
        assert seen[-1] == ("/v1/embeddings", "Bearer k", {"model": "e", "input": ["a", "bcd"], "input_type": "query", "output_dimension": 2})
        chat = clients.HttpChat(environ)
        assert chat.rewrite("peine ?") == "Art. 5" and chat.answer("q", "[1] Art. 5", [], 0.2) == " Art. 5 "
        assert seen[-1][2]["model"] == "c" and seen[-1][2]["temperature"] == 0.2
        status[0] = 429
        with pytest.raises(providers.RateLimited):
            embedder.embed(["a"], "query")
    finally:
        server.shutdown()
    with pytest.raises(ValueError, match="SERVICE_URL"):
        clients.HttpChat({})


def test_the_limiter_spaces_calls():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = clients.Limiter(4, lambda: now[0], sleep)
    for _ in range(5):
        limiter.wait()
    assert slept == [0.25] * 4

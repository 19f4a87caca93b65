import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lexquarry import cli, providers
from lexquarry.config import EngineConfig
from lexquarry.operators import corpus as C
from lexquarry.operators import vectors as V
from lexquarry.plans import pipelines
from lexquarry.plans.pipelines import CLARIFY, AnswerPipeline, CorpusPipeline, HybridSearch, _settings, build_index, load_search, refresh_index
from lexquarry.providers import embed_stored
from lexquarry.sources import files
from lexquarry.streaming.clean import cleaned_stream, write_cleaned

TEXT = """CODE PENAL
## Page 1
LIVRE I
Art. 1 - Le vol est puni d'une peine
d'emprisonne-
ment de deux ans.

Chapitre II
Art. 2 bis - La loi ne dispose que pour l'avenir. Art. 3 - Elle n'a pas d'effet rétroactif; Art. 4 - Nul n'est censé l'ignorer.
87 bis
Art. 5 - Le vol est puni d'une peine
d'emprisonnement de deux ans.
"""


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, TEXT.replace("deux", f"n{i}")) for i in range(12)] + [(99, None), (98, "")], "doc_id long, text string")
    run = CorpusPipeline(docs)
    run.write(f"{path}/out")
    return docs, run, EngineConfig(corpus=f"{path}/out", index=f"{path}/index", dimension=64)


def test_articles(stored):
    _, run, _ = stored
    rows = {r["article_number"]: r for r in run.articles.where("doc_id = 0").collect()}
    assert set(rows) == {"1", "2 bis", "3", "4", "5"}
    assert rows["1"]["text"] == "Art. 1 - Le vol est puni d'une peine d'emprisonnement de n0 ans."
    assert (rows["1"]["livre"], rows["1"]["chapitre"], rows["3"]["livre"], rows["3"]["chapitre"]) == ("LIVRE I", None, "LIVRE I", "Chapitre II")
    assert {r["filter_tier"] for r in rows.values()} == {"A"}
    report = run.report().first()
    assert report["page_marker_lines"] == 12 and report["orphan_lines"] == 12 and report["editorial_lines"] == 12 and report["articles"] == 60
    assert report["blocks_before"] - report["duplicates"] == report["blocks_after"] == run.unique.count() and report["suspicious"] == 0 and report["notes"]


def test_written_files(spark, stored):
    _, _, config = stored
    line = spark.read.text(f"{config.corpus}/articles/tier=A").first()[0]
    assert json.loads(line)["hierarchy"].keys() == {"livre", "titre", "chapitre", "section"}
    with pytest.raises(Exception, match="(?i)exist"):
        CorpusPipeline(stored[0]).write(config.corpus)


def test_search_and_answers(spark, stored):
    _, _, config = stored
    search, warnings = load_search(spark, config)
    assert search.index is None and "lexical search only" in warnings[0]
    build_index(search.articles, config)
    search, warnings = load_search(spark, config)
    assert search.index is not None and not warnings
    assert search.articles.count() == 48
    assert "settings" in load_search(spark, replace(config, metric="l2"))[1][0]
    assert "settings" in load_search(spark, replace(config, model="another"))[1][0]
    session = AnswerPipeline(search)
    state = session.ask("Que dit l'art. 2 bis ?")
    assert state["confidence"] == "HIGH" and state["cited"] == "2 bis" and "Sources:\n- Art. 2 bis (tier A" in state["answer"]
    assert state["cited_articles"] == ["Art. 2 bis"] and state["warnings"] == []
    assert len(session.turns) == 2
    nothing = AnswerPipeline(HybridSearch(search.articles, config)).ask("xxyyzz")
    assert nothing["needs_clarification"] and nothing["answer"] == CLARIFY and nothing["confidence"] == "LOW" and nothing["cited_articles"] == []
    assert "confidence: LOW" in cli.show(nothing, True)


def test_index_that_lost_rows(spark, stored, tmp_path):
    _, _, config = stored
    articles = load_search(spark, replace(config, use_vectors=False))[0].articles
    other = replace(config, index=f"{tmp_path}/index")
    build_index(articles, other)
    vectors = spark.read.parquet(f"{other.index}/vectors").limit(30).toPandas()
    spark.createDataFrame(vectors).write.mode("overwrite").partitionBy("tier").parquet(f"{other.index}/vectors")
    assert "30 vectors for 48 articles" in load_search(spark, other)[1][0]
    assert load_search(spark, other)[0].warnings


def test_refresh_embeds_changed_chunks_alone(spark, stored, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "DIGEST_ROWS", 4)
    config = replace(stored[2], index=f"{tmp_path}/index")
    articles = load_search(spark, replace(config, use_vectors=False))[0].articles
    build_index(articles, config)
    assert refresh_index(articles, config) == []
    changed = articles.withColumn("text", F.when(F.col("ord") == 6, "Art. 3 - autre texte").otherwise(F.col("text")))
    vectors, manifest = files.read_index(spark, config.index)
    problem = files.index_problem(vectors, manifest, files.read_chunks(spark, config.index), changed, _settings(config))
    assert problem == "the corpus has changed in chunks A/1"
    sent = []

    def counted(rows, *rest):
        sent.append(sorted(r["ord"] for r in rows.collect()))
        return embed_stored(rows, *rest)

    monkeypatch.setattr(pipelines, "embed_stored", counted)
    before = {r["ord"]: r["embedding"] for r in vectors.collect()}
    assert refresh_index(changed.where("ord <> 47"), config) == [("A", 1), ("A", 11)]
    first = changed.agg(F.min("ord")).first()[0]
    assert first == 1 and sent == [[4, 5, 6, 7, 44, 45, 46]]
    after = {r["ord"]: r["embedding"] for r in files.read_index(spark, config.index)[0].collect()}
    assert set(before) - set(after) == {47} and {o for o, v in after.items() if v != before[o]} == {6}
    assert files.index_problem(*files.read_index(spark, config.index), files.read_chunks(spark, config.index), changed.where("ord <> 47"), _settings(config)) is None
    with pytest.raises(ValueError, match="settings"):
        refresh_index(changed, replace(config, model="another"))


@pytest.mark.parametrize("size", ["900", "128m"])
def test_lines_of_files_read_in_parts(spark, tmp_path, size):
    rng = random.Random(3)
    pieces = ["a", "Art. 1 - é", "", "x" * 70, "\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x85", "\u2028", "\x1c"]
    texts = ["", "\n", "a", "a\n", "a\x0b", "a\r", "a\r\n", "\n\n", "\x0c", "a\x0b\n", "\r\r\n"] + ["".join(rng.choices(pieces, k=rng.randint(1, 300))) for _ in range(20)]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = files.read_lines(spark, f"{tmp_path}/*.txt")
        want = C.lines(files.read_texts(spark, f"{tmp_path}/*.txt"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        if size == "900":
            assert spark.read.option("lineSep", "\n").text(f"{tmp_path}/*.txt").select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 40
            (tmp_path / "mark.txt").write_bytes("\ufeffa\x0b".encode())
            assert [tuple(r)[1:] for r in files.read_lines(spark, f"{tmp_path}/mark.txt").collect()] == [(1, "a")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pipeline_of_lines(spark, stored, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    whole, parts = (CorpusPipeline(read(spark, str(tmp_path))) for read in (files.read_texts, files.read_lines))
    assert sorted(map(repr, whole.articles.collect())) == sorted(map(repr, parts.articles.collect())) and parts.articles.count() == 5


@pytest.fixture
def services(tmp_path):
    """Services that fail, or write down what they are asked."""
    log = f"{tmp_path}/log"

    def say(x):
        with open(log, "a") as f:
            f.write(json.dumps(x) + "\n")

    class Down:
        dimension = 64

        def embed(self, texts, kind):
            raise ConnectionError("no route")

        def rewrite(self, query):
            raise ConnectionError("no route")

        def answer(self, query, context, history, temperature):
            raise ConnectionError("no route")

    def chat(reply):
        def complete(messages, temperature):
            say([messages, temperature])
            return "vol emprisonnement" if len(messages) == 2 and messages[0]["content"] == providers.REWRITE else reply

        return providers.ChatGenerator(complete)

    class Recording(providers.HashEmbedder):
        def embed(self, texts, kind):
            say([kind, texts])
            return super().embed(texts, kind)

    return {"down": Down, "chat": lambda: chat("Selon l'article 1 et Art. 77."), "recording": Recording}, lambda: [json.loads(x) for x in open(log)]


def test_services(services, monkeypatch):
    made, log = services
    for name in ("down", "chat"):
        monkeypatch.setitem(providers.GENERATORS, name, made[name])
    assert providers.rewritten(made["chat"](), "peine pour vol ?", None) == "vol emprisonnement"
    assert providers.rewritten(made["chat"](), "art. 5 ?", "5") == "art. 5 ?" and providers.rewritten(made["down"](), "peine ?", None) == "peine ?"
    history = [{"role": "user", "content": "a"}, {"role": "tool", "content": "b"}, {"role": "assistant", "content": ""}, {"role": "assistant", "content": "c"}]
    assert providers.drafted("chat", "q", "[1] Art. 1", history, 0.3) == ("Selon l'article 1 et Art. 77.", None)
    assert providers.drafted("chat", "q", "", history, 0.3) == (None, None)
    (_, cold), (said, temperature) = log()
    assert (cold, temperature) == (0.0, 0.3) and [m["role"] for m in said] == ["system", "user", "assistant", "user"]
    assert [m["content"] for m in said[1:3]] == ["a", "c"] and "[1] Art. 1" in said[-1]["content"]
    assert providers.drafted("down", "q", "[1] Art. 1", [], 0.2) == (None, "no route")
    with pytest.raises(ValueError, match="offline"):
        providers.make(providers.GENERATORS, "unknown")


def test_query_vectors(services, monkeypatch):
    made, log = services
    got = providers._embedded(made["recording"](64), ["un deux"], "query", 64, 1)
    assert len(got[0]) == 64 and log() == [["query", ["un deux"]]]
    with pytest.raises(RuntimeError):
        providers._embedded(made["down"](), ["x"], "query", 64, 1)
    with pytest.raises(ValueError):
        providers._embedded(made["recording"](32), ["x"], "query", 64, 1)


def test_outages(spark, stored, monkeypatch):
    """A search whose embedder fails goes on with words alone; an answer whose service fails says so."""
    _, _, config = stored
    search = load_search(spark, config)[0]
    assert search.index is not None
    lost = lambda q, *a: q.selectExpr("*", "cast(null as array<float>) as embedding", "'no route' as outage")
    monkeypatch.setattr(pipelines, "embed_queries", lost)
    monkeypatch.setattr(pipelines, "draft_answers", lambda asked, *a: asked.selectExpr("query_id", "cast(null as string) as draft", "'no route' as failure"))
    state = AnswerPipeline(search).ask("Que dit l'art. 2 bis ?")
    assert state["cited_articles"] == ["Art. 2 bis"] or state["attached"]
    assert state["answer"].startswith(pipelines.UNAVAILABLE + "no route\n\nSources:\n- Art. 2 bis")
    assert state["warnings"][0] == pipelines.WARN_VECTORS % "no route" and pipelines.WARN_DRAFT in state["warnings"]
    monkeypatch.setattr(pipelines, "draft_answers", lambda asked, *a: asked.selectExpr("query_id", "'  ' as draft", "cast(null as string) as failure"))
    state = AnswerPipeline(replace(search, warnings=("at startup",))).ask("Que dit l'art. 2 bis ?")
    assert state["answer"].startswith(pipelines.EMPTY) and state["attached"] and state["warnings"][0] == "at startup"


def test_stream(spark, tmp_path, stored):
    docs, run, _ = stored
    docs.write.parquet(f"{tmp_path}/in")
    write_cleaned(cleaned_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    kept = run.cleaned.where("reason is null or reason = 'blank'")
    assert spark.read.parquet(f"{tmp_path}/out").count() == kept.count() > 0


def test_config():
    got = EngineConfig.from_env({"LEXQUARRY_METRIC": "l2", "LEXQUARRY_USE_VECTORS": "no", "LEXQUARRY_SEARCH_TOP_K": "3", "LEXQUARRY_TIERS_TRUSTED": "0.9", "LEXQUARRY_CORPUS": ""})
    assert (got.metric, got.use_vectors, got.search.top_k, got.tiers.trusted, got.corpus) == ("l2", False, 3, 0.9, "out/corpus")
    assert EngineConfig().search.top_k == 15 and EngineConfig().search.final_k == 12


def test_dotenv(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# a comment\nLEXQUARRY_METRIC='l2'\nexport LEXQUARRY_DIMENSION = 32\nnothing\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("LEXQUARRY_DIMENSION", "16")
    got = EngineConfig.from_env()
    assert (got.metric, got.dimension) == ("l2", 16)


def test_retries():
    slept, calls = [], iter([providers.RateLimited(), ValueError(), "done"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert providers.with_retries(call, sleep=slept.append) == "done" and slept == [22.0, 1.5]
    with pytest.raises(RuntimeError):
        providers.with_retries(lambda: 1 / 0, attempts=3, sleep=slept.append)
    assert slept[2:] == [0.75, 1.5] and len(providers.waits()) == 14

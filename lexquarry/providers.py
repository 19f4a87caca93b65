"""Embedding and text-generation services behind small protocols, with deterministic offline stand-ins."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.sources.shared import materialize

#: Waits of the retry schedule: FIRST_WAIT * 2 ** n seconds, and LIMITED_WAIT at least if the service says it is busy.
ATTEMPTS, FIRST_WAIT, LIMITED_WAIT = 15, 0.75, 22.0


class RateLimited(Exception):
    """The service asks for a pause."""


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        """(len(texts), dimension) floats; kind is document or query."""


class Generator(Protocol):
    def rewrite(self, query: str) -> str:
        """The query as it should be searched for."""

    def answer(self, query: str, context: str, history: list[dict], temperature: float) -> str:
        """A draft from the context; history is what was said before."""


#: What a chat service is told.
SYSTEM = "You answer questions about legal texts. Answer in French only, and only from the sources that you are given. Do not make up articles or facts. Cite every article in the form: Art. <number>."
QUESTION = "Question:\n{query}\n\nSources:\n{context}\n\nGive a short answer in French from these sources alone, cite the articles that it rests on in the form Art. <number>, and say so where the sources are weak."
REWRITE = "Turn the question into one short line in French to search legal texts with. Keep legal terms, articles, offences, penalties and names. Give the line alone."


def messages(query: str, context: str, history: list[dict]) -> list[dict]:
    """A conversation for a chat service: the system's part, earlier turns of users and assistants that say something,
    and the question with its sources."""
    said = [{"role": t["role"], "content": t["content"]} for t in history if t.get("role") in ("user", "assistant") and t.get("content")]
    return [{"role": "system", "content": SYSTEM}, *said, {"role": "user", "content": QUESTION.format(query=query, context=context)}]


class ChatGenerator:
    """A generator over a chat service: complete(messages, temperature) gives its reply."""

    def __init__(self, complete: Callable[[list[dict], float], str]):
        self.complete = complete

    def rewrite(self, query: str) -> str:
        reply = self.complete([{"role": "system", "content": REWRITE}, {"role": "user", "content": query}], 0.0)
        return (reply or "").strip() or query

    def answer(self, query: str, context: str, history: list[dict], temperature: float) -> str:
        return self.complete(messages(query, context, history), temperature) or ""


class HashEmbedder:
    """Signed feature hashing of words; a blank text is the zero vector."""

    def __init__(self, dimension: int = 1024):
        self.dimension = dimension

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                row[h % self.dimension] += 1 if h >> 63 else -1
        return out


class ExtractiveGenerator:
    """Answers with the first lines of the context and cites their articles; never rewrites."""

    def rewrite(self, query: str) -> str:
        return query

    def answer(self, query: str, context: str, history: list[dict], temperature: float) -> str:
        return " ".join(line for block in context.split("\n\n")[:2] for line in block.split("\n")[:2])


def _http(kind: str) -> Callable:
    def of(*args):
        from lexquarry import clients

        return getattr(clients, kind)(*args)

    return of


EMBEDDERS: dict[str, Callable[[int], Embedder]] = {"offline": HashEmbedder, "http": _http("HttpEmbedder")}
GENERATORS: dict[str, Callable[[], Generator]] = {"offline": ExtractiveGenerator, "http": _http("HttpChat")}


def make(registry: dict[str, Callable], name: str, *args):
    """A service by its name; a name that is not registered says which are."""
    if name not in registry:
        raise ValueError(f"no service named {name!r}; there are {', '.join(sorted(registry))}")
    return registry[name](*args)


def waits(attempts: int = ATTEMPTS) -> list[float]:
    return [FIRST_WAIT * 2**n for n in range(attempts - 1)]


def with_retries(call: Callable, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """The result of call, tried up to attempts times with growing waits; no wait after the last."""
    for n, wait in enumerate([*waits(attempts), None]):
        try:
            return call()
        except Exception as e:
            if wait is None:
                raise RuntimeError(f"the service failed {n + 1} times") from e
            sleep(max(wait, LIMITED_WAIT) if isinstance(e, RateLimited) else wait)


def embed_documents(articles: DataFrame, name: str, dimension: int, batch: int = 40) -> DataFrame:
    """articles with an embedding of their text: each task calls its own client, a batch at a time."""

    @F.pandas_udf("array<float>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client, size = make(EMBEDDERS, name, dimension), max(1, batch)
        for texts in batches:
            out = []
            for at in range(0, len(texts), size):
                out += _embedded(client, list(texts[at : at + size]), "document", dimension, ATTEMPTS)
            yield pd.Series(out)

    return articles.withColumn("embedding", of(F.coalesce("text", F.lit(""))))


def embed_stored(articles: DataFrame, name: str, model: str, dimension: int, store: str, batch: int = 40, commit_rows: int = 100_000) -> DataFrame:
    """As embed_documents, from a store of embeddings by model, dimension and text hash: only texts that it lacks are sent,
    each once, and about commit_rows at a time are written to it. A build that stops goes on from there when run again, and
    a rebuild after changes pays for the changed texts alone."""
    spark, hashed = articles.sparkSession, articles.withColumn("_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    schema = "service string, model string, dimension int, hash string, embedding array<float>"
    mine = (F.col("service") == name) & (F.col("model") == model) & (F.col("dimension") == dimension)

    def known() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(store).where(mine)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    lacking = hashed.select(F.col("_hash").alias("hash"), "text").dropDuplicates(["hash"]).join(known().select("hash"), "hash", "left_anti")
    lacking = materialize(lacking, "lacking")
    parts = -(-lacking.count() // max(1, commit_rows))
    for part in range(parts):
        own = embed_documents(lacking.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == part), name, dimension, batch)
        own.select(F.lit(name).alias("service"), F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), "hash", "embedding").write.mode("append").parquet(store)
    once = known().groupBy("hash").agg(F.first("embedding").alias("embedding"))  # two builds at a time may both have sent a text
    return hashed.join(once.withColumnRenamed("hash", "_hash"), "_hash").drop("_hash")


def _embedded(client: Embedder, texts: list[str], kind: str, dimension: int, attempts: int) -> list[list[float]]:
    got = with_retries(lambda: client.embed(texts, kind), attempts)
    if got.shape != (len(texts), dimension):
        raise ValueError(f"{got.shape} embeddings for {len(texts)} texts of dimension {dimension}")
    return got.tolist()


class Breaker:
    """Lets a task wait for a dead service once: after a call has failed through all its attempts, each later one gets a
    single attempt, until one succeeds."""

    def __init__(self, attempts: int):
        self.attempts, self.why = attempts, None

    def call(self, of: Callable):
        """(result, None), or (None, why there is none). What is wrong with a reply raises."""
        try:
            out = with_retries(of, 1 if self.why else self.attempts)
        except RuntimeError as e:
            self.why = str(e.__cause__ or e)
            return None, self.why
        self.why = None
        return out, None


def embed_queries(queries: DataFrame, name: str, dimension: int, attempts: int = ATTEMPTS, batch: int = 40) -> DataFrame:
    """queries (with a column query) and an embedding for each; a blank one is the zero vector. Texts are sent a batch at a
    time. Where the service fails, the embedding is null and outage says why, and the task doesn't wait again for the
    batches after it; wrong dimensions raise."""

    @F.pandas_udf("embedding array<float>, outage string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client, breaker = make(EMBEDDERS, name, dimension), Breaker(attempts)
        for texts in batches:
            rows = [([0.0] * dimension, None)] * len(texts)
            told = [i for i, t in enumerate(texts) if t.strip()]
            for at in range(0, len(told), max(1, batch)):
                own = told[at : at + max(1, batch)]
                got, why = breaker.call(lambda own=own: client.embed([texts.iloc[i] for i in own], "query"))
                if got is not None and got.shape != (len(own), dimension):
                    raise ValueError(f"{got.shape} embeddings for {len(own)} texts of dimension {dimension}")
                for n, i in enumerate(own):
                    rows[i] = (None if got is None else got[n].tolist(), why)
            yield pd.DataFrame(rows, columns=["embedding", "outage"])

    return queries.withColumn("_e", of(F.coalesce("query", F.lit("")))).select(*queries.columns, "_e.*")


def rewritten(generator: Generator, query: str, reference: str | None) -> str:
    """The query as it should be searched for. A query that names an article stays as it is, and so does one that the
    service fails on or answers with nothing."""
    try:
        return query if reference is not None else generator.rewrite(query) or query
    except Exception:  # whatever the service raises, the query itself will do
        return query


def drafted(name: str, query: str, context: str, history: list[dict], temperature: float, registry: dict | None = None) -> tuple[str | None, str | None]:
    """(draft, why there is none); neither without context. registry: the driver's, as a task's own lacks what was added there."""
    try:
        return (make(registry or GENERATORS, name).answer(query, context, history, temperature) if context else None), None
    except Exception as e:  # whatever the service raises: the answer says so
        return None, str(e) or type(e).__name__


def rewrite_queries(queries: DataFrame, name: str) -> DataFrame:
    """queries (query, reference) with retrieval, the query rewritten."""

    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        generator = make(GENERATORS, name)
        for texts, references in batches:
            yield pd.Series([rewritten(generator, t, r) for t, r in zip(texts, references, strict=True)], dtype=object)

    return queries.withColumn("retrieval", of(F.coalesce("query", F.lit("")), "reference"))


def draft_answers(asked: DataFrame, name: str, history: list[dict] | None, temperature: float) -> DataFrame:
    """query_id, draft and failure (why there is none) for asked: query_id, query, context, and, where history is None,
    turns: what was said before in the query's conversation (array of role, content). Without context: neither."""
    turns = F.coalesce(F.to_json("turns"), F.lit("[]")) if history is None else F.lit(json.dumps(history))

    @F.pandas_udf("draft string, failure string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for queries, contexts, said in batches:
            yield pd.DataFrame([drafted(name, q, c, json.loads(h), temperature, GENERATORS) for q, c, h in zip(queries, contexts, said, strict=True)], columns=["draft", "failure"])

    return asked.select("query_id", of("query", F.coalesce("context", F.lit("")), turns).alias("d")).select("query_id", "d.*")

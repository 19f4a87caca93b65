"""Token counts by a linear longest-match automaton.

Greedy word pieces are counted without being built: a trie of the vocabulary has, for each node, a failure link to the
node at which matching goes on once the longest pieces are popped off its front, and how many pieces that pops. Each
character of a word is then read once, however the pieces overlap. Words met before in a task come from a bounded cache.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.common import table, text_or_empty

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
START_MARK = "▁"
#: Pieces in a vocabulary, at most: the automaton is sent to every task.
MAX_PIECES = 1_000_000
CACHE_ENTRIES = 300_000
LONG_WORD = 64


@dataclass
class Automaton:
    """Nodes 0 (before a word) and 1 (within one) are roots; goes[v] maps a character to a child."""

    goes: list[dict[str, int]]
    fails: list[int]
    pops: list[int]

    @classmethod
    def build(cls, starting: set[str], inside: set[str]) -> Automaton:
        if len(starting) + len(inside) > MAX_PIECES:
            raise ValueError(f"more than {MAX_PIECES} pieces")
        goes: list[dict[str, int]] = [{}, {}]
        final: dict[int, bool] = {}
        for root, pieces in ((0, starting), (1, inside)):
            for piece in pieces:
                if piece:
                    v = root
                    for c in piece:
                        if c not in goes[v]:
                            goes[v][c] = len(goes)
                            goes.append({})
                        v = goes[v][c]
                    final[v] = True
        fails, pops = [-1] * len(goes), [0] * len(goes)
        queue = deque((0, c, v) for c, v in goes[0].items())
        queue.extend((1, c, v) for c, v in goes[1].items())
        while queue:  # by depth: a node's links need those of its parent and of shallower nodes
            u, c, v = queue.popleft()
            if final.get(v):
                fails[v], pops[v] = 1, 1
            else:
                z, n = fails[u], pops[u]
                while z >= 0 and c not in goes[z]:
                    z, n = fails[z], n + pops[z]
                if z >= 0:
                    fails[v], pops[v] = goes[z][c], n
            queue.extend((v, d, w) for d, w in goes[v].items())
        return cls(goes, fails, pops)

    def count(self, word: str) -> int:
        """Greedy longest-match pieces of a word; 0 if it can't be cut into pieces."""
        goes, fails, pops = self.goes, self.fails, self.pops
        v, n = 0, 0
        for c in word:
            while c not in goes[v]:
                n += pops[v]
                v = fails[v]
                if v < 0:
                    return 0
            v = goes[v][c]
        while v != 1:
            n += pops[v]
            v = fails[v]
            if v < 0:
                return 0
        return n


def from_pieces(pieces: list[str], mark: str = START_MARK) -> tuple[set[str], set[str]]:
    """(pieces that start a word, pieces within one) of a vocabulary that marks the former."""
    return {p[len(mark) :] for p in pieces if p.startswith(mark) and len(p) > len(mark)}, {p for p in pieces if p and mark not in p}


def piece_vocabulary(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def counter(spark: SparkSession, pieces: list[str]) -> Column:
    """A function of the text: struct n_words, n_tokens, n_unknown. A word without a cut is one token, the unknown one."""
    sent = spark.sparkContext.broadcast(Automaton.build(*from_pieces(pieces)))

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, cache = sent.value, {}
        for texts in batches:
            rows = []
            for text in texts:
                words = WORDS.findall(text)
                total = unknown = 0
                for w in words:
                    n = cache.get(w)
                    if n is None:
                        n = automaton.count(w)
                        if len(w) <= LONG_WORD:
                            if len(cache) >= CACHE_ENTRIES:
                                cache.clear()
                            cache[w] = n
                    total += n or 1
                    unknown += not n
                rows.append((len(words), total, unknown))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")

    return of


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of each row. Words are runs of other than ASCII white space. Null or empty
    text: zeros. Repeated rows and null doc_ids are rows like any other; other columns are not used."""
    return docs.select("doc_id", counter(docs.sparkSession, pieces)(text_or_empty()).alias("n")).select("doc_id", "n.*")


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))

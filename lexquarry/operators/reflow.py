"""Where lines of an island begin a new block: a scan with a state of bounded size.

Within an island (lines without a blank one or a block's opening between them) a block ends only where what it has so far
is a heading: its opening word, or few words that are nearly all capitals. That depends on its first characters and on
three counts, and can't be so any more once it has more words than a heading may have. So a scan keeps these alone,
however long the island, and skips the rest of it once no further line can end a block.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lexquarry.functions import patterns as P
from lexquarry.functions import text as T

OPENING = re.compile(rf"(?:{P.HEADINGS})\b", re.IGNORECASE)
#: Characters of a block's front that tell if it opens as a heading does.
FRONT = 40


@dataclass
class Front:
    """A block so far: its first characters, its words, letters and capitals, and what it ends with (-, ', or other)."""

    front: str
    words: int
    letters: int
    upper: int
    end: str

    def heading(self) -> bool:
        opened = OPENING.match(self.front)
        if opened and unicodedata.category(self.front[opened.end() : opened.end() + 1] or " ") != "Mn":
            return True
        return self.words <= T.MOST_WORDS and self.letters >= T.LEAST_LETTERS and self.upper * 5 >= self.letters * 4

    def add(self, line: Front, lower: bool) -> None:
        hyphen = self.end == "-" and lower
        close = hyphen or self.end == "'"
        if len(self.front) < FRONT:
            self.front = ((self.front[:-1] if hyphen else self.front) + ("" if close else " ") + line.front)[:FRONT]
        self.words += line.words - close
        self.letters, self.upper, self.end = self.letters + line.letters, self.upper + line.upper, line.end


@F.pandas_udf(BooleanType())
def _cuts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Of rows in the order of document and line. nth: the row's number in its document."""
    last_nth, last_island, now = 0, -1, None
    for nth, island, front, words, letters, upper, end, lower in batches:
        n, of = nth.to_numpy(), island.to_numpy()
        opens = (n <= np.concatenate([[last_nth], n[:-1]])) | (of != np.concatenate([[last_island], of[:-1]]))
        out, starts, size = np.zeros(len(n), bool), np.flatnonzero(opens).tolist(), len(n)
        columns = [c.to_numpy(object) for c in (front, words, letters, upper, end)]
        low, i, s = lower.to_numpy(bool), 0, 0
        while i < size:
            if not opens[i] and now is None:  # no line up to the next island ends a block
                while s < len(starts) and starts[s] < i:
                    s += 1
                i = starts[s] if s < len(starts) else size
                continue
            line = Front(*(c[i] for c in columns))
            if opens[i]:
                now = line
            elif now.heading():
                out[i], now = True, line
            else:
                now.add(line, low[i])
            if now.words > T.MOST_WORDS and not now.heading():
                now = None
            i += 1
        if size:
            last_nth, last_island = n[-1], of[-1]
        yield pd.Series(out)


def heading_cuts(nth: Column, island: Column, line: Column) -> Column:
    """Whether a line begins a block because the one before has become a heading. The rows have to be in the order of their
    document's lines, a document at a time, as a window over them leaves them."""
    words, letters, upper = T.heading_counts(line)
    end = F.when(F.endswith(line, F.lit("-")), "-").when(F.endswith(line, F.lit("'")), "'").otherwise("")
    lower = F.rlike(F.substring(line, 1, 1), F.lit(r"^\p{Ll}"))
    return _cuts.asNondeterministic()(nth, island, F.substring(line, 1, FRONT), words, letters, upper, end, lower)

"""Token counts by byte-pair merging with a heap over a linked list: symbols minus merges.

No identifier is made: a piece starts with one symbol per byte, and each pop of
the lowest-rank pair that is still adjacent takes one symbol away.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_of, with_outputs
from tidewater.llm.pretoken import Splitter

CACHED_PIECES, CACHED_LENGTH = 250_000, 64

#: Fixed value: the pre-token pattern that the byte-level pre-tokenizer of the file format stands for.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: itself if printable in Latin-1, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return [chr(hidden.get(b, b)) for b in range(256)]


class Counter(dict):
    """Piece -> number of tokens, filled on demand and emptied when full."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a plain byte-level file is needed")
        self.splitter = Splitter(BYTE_LEVEL)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def __missing__(self, piece: str) -> int:
        symbols = [self.letters[b] for b in piece.encode("utf-8")]
        n = len(symbols) - self.merges(symbols)
        if len(piece) <= CACHED_LENGTH:
            self[piece] = n
        return n

    def merges(self, symbol: list[str]) -> int:
        """How many merges apply; ``symbol`` is used up."""
        n, rank, done = len(symbol), self.rank, 0
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[pair], i) + pair for i in range(n - 1) if (pair := (symbol[i], symbol[i + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j], right[i] = a + b, "", right[j]
            done += 1
            if right[i] < n:
                left[right[i]] = i
                if (pair := (a + b, symbol[right[i]])) in rank:
                    heapq.heappush(heap, (rank[pair], i) + pair)
            if left[i] >= 0 and (pair := (symbol[left[i]], a + b)) in rank:
                heapq.heappush(heap, (rank[pair], left[i]) + pair)
        return done

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.splitter.pieces(text)))

    def count(self, text: str) -> int:
        if len(self) > CACHED_PIECES:
            self.clear()
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        n = at = 0
        for m in self.added.finditer(text):  # an added token is one token and parts the text
            n += self.plain(text[at:m.start()]) + 1
            at = m.end()
        return n + self.plain(text[at:])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker."""
    return Counter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Every row with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of its whole text.

    Rows stay where they are: no shuffle, and memory holds one Arrow batch and
    a bounded table of pieces.  A null or empty text counts 0 bytes and tokens;
    input columns named like the outputs give way.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series([c.count(t) for t in texts], dtype="int64")

    t = text_of(text)
    d = df.withColumn("__n", counted(t))
    return with_outputs(d, {"n_bytes": F.octet_length(t).cast("long"), "n_tokens": F.col("__n"), "over_limit": F.col("__n") > limit}).drop("__n")

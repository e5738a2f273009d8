"""Byte-level BPE: long texts are split in overlapping chunks, cut where pre-tokens agree, then encoded.

A pre-token pattern without look-behind has this property: once two scans of a
text stand at the same boundary, they go on alike.  Chunk k is scanned from its
own start through an overlap into chunk k+1, which is scanned from its own
start too; the first boundary both found is a true boundary of the whole text.
Chunks without a common boundary in the overlap (one run of letters, say) are
joined to the chunk before, so the result never depends on the chunk size.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import text_key, text_of, with_outputs
from tidewater.llm.hashed_words import batches_of
from tidewater.llm.pretoken import Splitter

CACHED_PIECES, CACHED_LENGTH, SLICE = 250_000, 64, 512


def lowest_merges(symbols: list[bytes], rank: dict[bytes, int]) -> list[bytes]:
    """Merges the adjacent pair of lowest rank, leftmost first, until none is in the table."""
    n = len(symbols)
    if n < 2:
        return symbols
    parts: list[bytes | None] = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    waiting = [(r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, length = heapq.heappop(waiting)
        j = after[i] if parts[i] is not None else n
        if j >= n or len(parts[i]) + len(parts[j]) != length:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := rank.get(parts[a] + parts[b])) is not None:
                heapq.heappush(waiting, (r, a, len(parts[a]) + len(parts[b])))
    return [p for p in parts if p is not None]


class Merges:
    """Merges many short pieces at once: one merge of each per round, all arrays of (piece, symbol)."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, rank: dict[bytes, int]):
        self.size = max(rank.values()) + 1
        self.first = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        found = [(a * self.size + b, r) for t, r in rank.items() for i in range(1, len(t)) if (a := rank.get(t[:i])) is not None and (b := rank.get(t[i:])) is not None]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.pair, self.result = table[:, 0].copy(), table[:, 1].astype(np.int32)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.result[at], self.NONE)

    def encode(self, raw: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each piece (none empty)."""
        n, width = len(raw), max(map(len, raw))
        lengths = np.array([len(x) for x in raw])
        # two more columns: what lies beyond either end
        cell = np.arange(width)[None, :] < lengths[:, None]
        ids = np.full((n, width + 2), -1, np.int32)
        ids[:, 1:-1][cell] = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        after = np.tile(np.arange(1, width + 3, dtype=np.int32), (n, 1))
        before = after - 2
        rank = np.full((n, width + 2), self.NONE, np.int32)
        rank[:, 1:-2] = self.rank_of(ids[:, 1:-2], ids[:, 2:-1])
        row = np.arange(n)
        while len(row):
            at = rank[row].argmin(axis=1)
            best = rank[row, at]
            go = best != self.NONE
            row, at, best = row[go], at[go], best[go]
            gone = after[row, at]
            right = after[row, gone]
            left = before[row, at]
            ids[row, at], ids[row, gone] = best, -1
            after[row, at], before[row, right] = right, at
            rank[row, gone] = self.NONE
            rank[row, at] = self.rank_of(best, ids[row, right])
            some = left > 0
            rank[row[some], left[some]] = self.rank_of(ids[row, left], best)[some]
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


class Codec(dict):
    """Piece -> token ids of one rank file, filled batch by batch and emptied when full."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.rank.items()}
        self.splitter = Splitter(pattern)
        self.single = [bytes([b]) for b in range(256)]
        self.merges = Merges(self.rank)

    def learn(self, pieces: set[str]) -> None:
        """Adds the ids of pieces; short ones of like length together, long ones one by one."""
        new = sorted(((p.encode("utf-8"), p) for p in pieces), key=lambda x: len(x[0]))
        sizes = [len(r) for r, _ in new]
        at = 0
        while at < len(new) and sizes[at] <= CACHED_LENGTH:
            upto = min(at + 16_384, bisect.bisect_right(sizes, min(CACHED_LENGTH, max(8, sizes[at] * 3 // 2))))
            self.update(zip((p for _, p in new[at:upto]), self.merges.encode([r for r, _ in new[at:upto]])))
            at = upto
        for raw, p in new[at:]:
            self[p] = tuple(self.rank[s] for s in lowest_merges([self.single[b] for b in raw], self.rank))
        # a piece that is a token stays whole, as it would not if its parts merged otherwise
        for raw, p in new:
            if raw in self.rank:
                self[p] = (self.rank[raw],)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self) > CACHED_PIECES:
            self.clear()
        split = [self.splitter.pieces(t) for t in texts]
        if any(not isinstance(p, list) for p in split):
            split = [list(p) for p in split]
        new = set().union(*split).difference(self)
        if new:
            self.learn(new)
        for p in split:
            yield np.fromiter(chain.from_iterable(map(self.__getitem__, p)), np.int32)
        for p in new:
            if len(p) > CACHED_LENGTH:
                del self[p]

    def encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, a bounded number of characters at a time."""
        for lo, hi in batches_of(texts, 1 << 20):
            yield from self.encode(texts[lo:hi])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def ids_of(text: Column, path: str, pattern: str) -> Column:
    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for rows in batches:
            for at in range(0, len(rows), SLICE):
                yield pd.Series(list(c.encoded(rows.iloc[at:at + SLICE].tolist())), dtype=object)

    return encoded(text)


def ids_and_bytes_of(text: Column, path: str, pattern: str) -> Column:
    """The ids, and the bytes that decoding these ids gives, in one pass through a Python worker."""

    @F.pandas_udf("ids array<int>, bytes binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for rows in batches:
            for at in range(0, len(rows), SLICE):
                ids = list(c.encoded(rows.iloc[at:at + SLICE].tolist()))
                yield pd.DataFrame({"ids": ids, "bytes": [c.decode(x.tolist()) for x in ids]})

    return coded(text)


def chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """key, text -> key, k, last, body: characters [k*size, (k+1)*size+overlap), the last up to the end."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for key, text in zip(rows["key"], rows["text"]):
                n = max(1, -(-len(text) // size))
                for at in range(0, n, 256):
                    ks = range(at, min(n, at + 256))
                    yield pd.DataFrame({"key": [key] * len(ks), "k": list(ks), "last": [k == n - 1 for k in ks], "body": [text[k * size:(k + 1) * size + overlap * (k < n - 1)] for k in ks]})

    return texts.mapInPandas(cut, "key binary, k int, last boolean, body string")


def boundaries(parts: DataFrame, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """Adds head and tail: offsets of the boundaries in a chunk's own first characters and in the next chunk's."""

    @F.pandas_udf("head array<int>, tail array<int>")
    def scan(bodies: pd.Series, last: pd.Series) -> pd.DataFrame:
        split, heads, tails = codec(path, pattern).splitter, [], []
        for body, end in zip(bodies, last):
            starts = np.fromiter((m.start() for m in split.of(body).finditer(body)), np.int32)
            # up to two characters ahead decide a boundary: those nearer to a cut end aren't sure
            sure = starts if end else starts[starts <= len(body) - 2]
            heads.append(sure[sure < overlap])
            tails.append(sure[sure >= size] - size if not end else sure[:0])
        return pd.DataFrame({"head": heads, "tail": tails})

    return parts.withColumn("_b", scan("body", "last")).select("*", "_b.head", "_b.tail").drop("_b")


def stitched(parts: DataFrame, size: int) -> DataFrame:
    """key, seg, text: segments of each text that begin and end at boundaries of the whole text."""
    w = Window.partitionBy("key").orderBy("k")
    left = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(w), F.col("head"))))
    p = parts.withColumn("left", left).drop("head", "tail")
    p = p.withColumn("right", F.lead("left").over(w)).withColumn("seg", F.sum(F.col("left").isNotNull().cast("int")).over(w))
    begin = F.coalesce("left", F.lit(0))
    end = F.when(F.col("last"), F.length("body")).otherwise(F.lit(size) + F.coalesce("right", F.lit(0)))
    p = p.select("key", "seg", "k", F.substring("body", begin + 1, end - begin).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "")
    return p.repartition("key", "seg").groupBy("key", "seg").agg(joined.alias("text"))


def encode_long(texts: DataFrame, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """key, text (keys distinct) -> key, ids."""
    parts = chunks(texts, size, overlap).repartition("key", "k")
    segments = stitched(boundaries(parts, path, pattern, size, overlap), size)
    ids = segments.select("key", "seg", ids_of(F.col("text"), path, pattern).alias("ids"))
    return ids.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None, chunk_chars: int = 32_768, overlap_chars: int = 2_048) -> DataFrame:
    """Every row of ``df`` with ``out``, the token ids of its whole text, and ``decoded``, their bytes, if named.

    Texts of at most one chunk are encoded where they lie.  Longer ones are
    encoded once per distinct text, chunk by chunk on all executors, and joined
    back; nothing else shuffles.  A null or empty text has no ids; repeated
    rows each get theirs; an input column named like an output gives way.
    """
    if not 2 < overlap_chars <= chunk_chars:
        raise ValueError("the overlap has to be shorter than a chunk")
    t = text_of(text)
    long = F.length(t) > chunk_chars
    near = df.where(~long).withColumn("__c", ids_and_bytes_of(t, path, pattern) if decoded else F.struct(ids_of(t, path, pattern).alias("ids")))
    near = with_outputs(near, {out: F.col("__c.ids")} | ({decoded: F.col("__c.bytes")} if decoded else {})).drop("__c")
    far = df.where(long).withColumn("__key", text_key(t))
    done = encode_long(far.select(F.col("__key").alias("key"), t.alias("text")).dropDuplicates(["key"]), path, pattern, chunk_chars, overlap_chars)
    done = decode(done, path, pattern) if decoded else done
    far = far.join(done.select(F.col("key").alias("__key"), F.struct(*[c for c in done.columns if c != "key"]).alias("__c")), "__key")
    far = with_outputs(far, {out: F.col("__c.ids")} | ({decoded: F.col("__c.bytes")} if decoded else {})).drop("__key", "__c")
    return near.unionByName(far)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Every row with ``out``, the concatenated bytes of its tokens (null ids: none)."""

    @F.pandas_udf("binary")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for rows in batches:
            for at in range(0, len(rows), SLICE):
                yield pd.Series([c.decode(x.tolist()) for x in rows.iloc[at:at + SLICE]], dtype=object)

    return with_outputs(df, {out: joined(F.coalesce(F.col(ids), F.array().cast("array<int>")))})


def digest(df: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded again."""
    coded = encode(df.select(id_col, text), path, pattern, text, "ids", "bytes", **how).select(id_col, "ids", "bytes")
    return coded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))

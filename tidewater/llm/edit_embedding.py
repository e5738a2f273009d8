"""Document fingerprints from a randomised edit embedding.

All texts walk under one table of random bits.  At time t the walk writes down
the character it stands on and moves on if the bit of (t, character) is set, so
two texts that differ by an edit fall back into step after a short random
stretch: few edits leave few differing times.  A fingerprint samples 256 times.
Samples nest: level l cuts the walk into stretches of 2^l times and samples one
time in each; the sample of a stretch is that of one of its halves one level
down.  A long text has a high level, and any two fingerprints are compared at
the higher level of the two.

Near copies are found by bit-sampled bands: hashes of a few samples each, drawn
within the walk for each class of lengths, and then verified by all samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_of
from tidewater.sources.staging import write_stage

SLOTS = 256
PERIOD, CLASSES = 1 << 12, 1 << 8
BLOCK_CHARS, FEW = 1 << 22, 64
BANDS, BAND_SLOTS, BASE = 40, 8, 1.2
FOUR_BITS = np.uint64(1) << np.arange(0, 4 * BAND_SLOTS, 4, dtype="uint64")
PAD = 0
HEX = np.frombuffer(b"0123456789abcdef", "uint8")


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 hashed bits of whole numbers."""
    with np.errstate(over="ignore"):
        x = (x.astype("uint64") + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def stays() -> bytes:
    """How long a walk stays on a character of a class from a time on (class * PERIOD + time): until the first set bit."""
    bits = (mixed(np.arange(CLASSES * PERIOD).reshape(CLASSES, PERIOD), 11) >> np.uint64(40)) & np.uint64(1)
    bits[:, -1] = 1
    long, at = np.empty((CLASSES, PERIOD), "uint8"), np.zeros(CLASSES, "int64")
    for t in range(PERIOD - 1, -1, -1):
        at = np.where(bits[:, t] == 1, 1, np.minimum(at + 1, 255))
        long[:, t] = at
    return long.tobytes()


def pick(level: int, stretch: np.ndarray) -> np.ndarray:
    """Which half of a stretch is sampled."""
    return ((mixed(stretch + (level << 40), 23) >> np.uint64(35)) & np.uint64(1)).astype("int64")


@lru_cache(maxsize=64)
def picks(level: int) -> np.ndarray:
    return pick(level, np.arange(SLOTS))


@lru_cache(maxsize=64)
def times(level: int) -> np.ndarray:
    """The sampled time of each of the SLOTS stretches of a level."""
    at = np.arange(SLOTS)
    for down in range(level, 0, -1):
        at = 2 * at + pick(down, at)
    return at


def codes_of(text: str) -> np.ndarray:
    """The code points, folded to 16 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32")
    return (c ^ (c >> np.uint32(16)) * np.uint32(40503)).astype("uint16")


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each folded code point, where its class's row of stays begins, and its symbol from 1 to 15."""
    codes = np.arange(1 << 16)
    rows = (mixed(codes, 5) >> np.uint64(33)) & np.uint64(CLASSES - 1)
    return rows.astype("int32") * PERIOD, 1 + ((mixed(codes, 71) >> np.uint64(20)) % np.uint64(15)).astype("uint8")


def walked(codes: list[np.ndarray], start: np.ndarray) -> list[np.ndarray]:
    """The time after each character of each text, all texts in step; ``start`` is the time before the first."""
    order = np.argsort([-len(c) for c in codes], kind="stable")
    lengths = np.array([len(codes[i]) for i in order], "int64")
    offsets = np.cumsum(lengths) - lengths
    flat = np.concatenate([codes[i] for i in order] or [np.empty(0, "uint16")])
    rows = letters()[0][flat]
    ends, now, held = np.empty(len(flat), "int32"), start[order].astype("int32"), stays()
    table = np.frombuffer(held, "uint8")
    going = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1 if len(lengths) else 1), side="right")
    many = int(np.searchsorted(-going, -FEW, side="right"))
    for i, n in enumerate(going[:many]):
        at, t = offsets[:n] + i, now[:n]
        t += table[rows[at] + (t & (PERIOD - 1))]
        ends[at] = t
    for k in range(going[many] if many < len(going) else 0):  # the few longest go on one by one
        at, t, steps = slice(offsets[k] + many, offsets[k] + lengths[k]), int(now[k]), []
        for row in rows[at].tolist():
            t += held[row + (t & (PERIOD - 1))]
            steps.append(t)
        ends[at] = steps
    out: list[np.ndarray] = [ends[:0]] * len(codes)
    for k, i in enumerate(order):
        out[i] = ends[offsets[k]:offsets[k] + lengths[k]]
    return out


def level_of(end: int) -> int:
    return max(0, (max(int(end), 1) - 1).bit_length() - (SLOTS - 1).bit_length())


def sample(codes: np.ndarray, ends: np.ndarray) -> tuple[int, np.ndarray]:
    """(level, symbol 1..15 of the character walked at each sampled time, PAD after the end)."""
    level = level_of(ends[-1] if len(ends) else 0)
    at = np.searchsorted(ends, times(level), side="right")
    inside = at < len(ends)
    symbols = np.zeros(SLOTS, "uint8")
    symbols[inside] = letters()[1][codes[at[inside]]]
    return level, symbols


def coarser(level: int, symbols: np.ndarray, to: int) -> np.ndarray:
    """The samples of the same text at a higher level."""
    for up in range(level + 1, to + 1):
        half = np.concatenate([symbols, np.zeros(SLOTS, "uint8")]).reshape(SLOTS, 2)
        symbols = half[np.arange(SLOTS), picks(up)]
    return symbols


def shown(level: int, symbols: np.ndarray) -> str:
    return f"{level:02x}" + HEX[symbols].tobytes().decode()


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    return int(fingerprint[:2], 16), np.frombuffer(bytes.fromhex("0" + "0".join(fingerprint[2:])), "uint8")


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of equal samples among those where at least one text still walks; 1 for two empty texts."""
    level = max(a[0], b[0])
    x, y = coarser(*a, level), coarser(*b, level)
    walks = (x != PAD) | (y != PAD)
    return float((x == y)[walks].mean()) if walks.any() else float(a[0] == b[0])


@lru_cache(maxsize=512)
def band_slots(kind: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The level, the samples and a salt of each band for texts that walk at least BASE ** kind times: all samples lie within the walk."""
    reach = BASE**kind
    level = level_of(math.ceil(reach)) + 1
    draws = (mixed(np.arange(BANDS * BAND_SLOTS).reshape(BANDS, BAND_SLOTS), 401) >> np.uint64(32)).astype("float64") / 2**32
    return level, (draws * max(1, int(reach) >> level)).astype("int64"), mixed(np.arange(BANDS) + BANDS * kind, 7)


def bands(fingerprint: tuple[int, np.ndarray]) -> np.ndarray:
    """Hashes of the bands, for the text's own length class and the two below, so that texts within a quarter of each other's length share a class."""
    level, symbols = fingerprint
    walk = int((symbols != PAD).sum()) << level
    top = int(math.log(walk) / math.log(BASE)) if walk else -1
    out = np.empty((3, BANDS), "uint64")
    for i, kind in enumerate(range(top, top - 3, -1)):
        at, slots, salts = band_slots(max(kind, 0))
        out[i] = (coarser(level, symbols, at)[slots].astype("uint64") @ FOUR_BITS) ^ salts
    return mixed(out, 97).astype("int64")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many bands two texts share in the class where they share most."""
    return int((a[:, None] == b).sum(axis=2).max())


def blocks(items: Iterator, size) -> Iterator[list]:
    """Runs of items of bounded total size."""
    held, total = [], 0
    for x in items:
        held.append(x)
        total += size(x)
        if total >= BLOCK_CHARS:
            yield held
            held, total = [], 0
    if held:
        yield held


def prints(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    codes = [codes_of(t) for t in texts]
    return [sample(c, e) for c, e in zip(codes, walked(codes, np.zeros(len(codes), "int32")))]


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with __print, the fingerprint of the whole text (null: empty). Rows stay where they are."""

    @F.pandas_udf("string")
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shown(*p) for block in blocks(iter(texts), len) for p in prints(block)], dtype=object)

    return df.withColumn("__print", printed(text_of(text)))


def near_pairs(asked: DataFrame, base: DataFrame, key: str, text: str = "text", least: float = 0.8) -> DataFrame:
    """asked_id, base_id, likeness: texts of ``base`` whose fingerprint is at least ``least`` like that of an ``asked`` text.

    Both sides are reduced to distinct fingerprints; those that share a band
    are verified by all their samples.  Rows are the pairs of the least keys of
    each fingerprint; a text's own row and copies carry likeness 1.  A pair at
    0.8 shares one of the bands with 0.999.  Null keys are left out.
    """

    @F.pandas_udf("array<bigint>")
    def banded(p: pd.Series) -> pd.Series:
        return pd.Series([bands(read(x)).ravel().tolist() for x in p], dtype=object)

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(read(x), read(y)) for x, y in zip(a, b)], dtype="float64")

    def distinct(df: DataFrame, name: str) -> DataFrame:
        known = fingerprints(df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")), "t")
        return write_stage(known.groupBy(F.col("__print").alias(f"{name}_print")).agg(F.min("k").alias(f"{name}_id")), "prints")

    a, b = distinct(asked, "asked"), distinct(base, "base")
    met = a.withColumn("band", F.explode(banded("asked_print"))).select("asked_print", "band").join(b.withColumn("band", F.explode(banded("base_print"))).select("base_print", "band"), "band")
    met = met.select("asked_print", "base_print").distinct().withColumn("likeness", alike("asked_print", "base_print")).where(F.col("likeness") >= least)
    return met.join(a, "asked_print").join(b, "base_print").select("asked_id", "base_id", "likeness")


def neighbours(df: DataFrame, key: str, text: str, partitions: int | None) -> DataFrame:
    """Rows dealt in runs of ascending keys and sorted, with the first row of the next run as a guest at each run's end.

    The runs' bounds come from key quantiles and their first keys from a scan
    of keys alone, one number a run, so the texts are shuffled once.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), text_of(text).alias("t"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) >> 27)
    cuts = np.unique(rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or [])

    @F.pandas_udf("long")
    def run(k: pd.Series) -> pd.Series:
        """The number of cuts at or below the key."""
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right"))

    known = rows.where("k is not null").withColumn("run", run("k"))
    heads = sorted((r["run"], r["k"]) for r in known.groupBy("run").agg(F.min("k").alias("k")).collect())
    lost = rows.where("k is null").withColumn("run", -1 - F.pmod(F.xxhash64("t"), F.lit(n)))
    rows = known.unionByName(lost).withColumn("guest", F.lit(0))
    if heads:  # the first row of a run follows the last of the run before, that of the first run the last of all
        ahead = spark.createDataFrame([(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)], f"k {dict(rows.dtypes)['k']}, run long")
        first = known.drop("run").join(F.broadcast(ahead), "k").groupBy("k", "run").agg(F.min("t").alias("t"))
        rows = rows.unionByName(first.withColumn("guest", F.lit(1)))
    return rows.repartitionByRange(n, "run").sortWithinPartitions("run", "guest", "k", "t")


def edited(df: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Each text's fingerprint beside that of an edited copy and that of the next text.

    Columns: key, n_chars, edited (the text whose last floor(n/2) code points
    gave way to as many first ones of the next text by ascending key),
    fingerprint, edited_fingerprint, near_edited and near_next (likeness), and
    edited_bands and next_bands, how many of the bands they share.  Equal keys
    follow each other by text; a row without a key has no next text: its edited
    copy is cut short and near_next is null.  A null text is empty, and two
    empty texts are alike by 1.  A table of one row is its own next.
    """
    rows = neighbours(df, key, text, partitions)
    schema = f"{key} {dict(rows.dtypes)['k']}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_bands long, next_bands long"

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        held = None
        for d in batches:
            for run, k, t, guest in zip(d["run"], d["k"], d["t"], d["guest"]):
                if held is not None:
                    yield *held, t if held[0] == run and run >= 0 else None
                held = None if guest else (run, k, t)
        if held is not None:
            yield *held, None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(pairs(batches), lambda p: len(p[2])):
            texts = [p[2] for p in block]
            ahead = []  # where the next text is
            for i, p in enumerate(block):
                inside = p[3] is not None and i + 1 < len(block) and block[i + 1][2] is p[3]
                ahead.append(i + 1 if inside else None if p[3] is None else len(texts))
                if ahead[-1] == len(texts):
                    texts.append(p[3])
            codes = [codes_of(t) for t in texts]
            ends = walked(codes, np.zeros(len(codes), "int32"))
            mine = [sample(c, e) for c, e in zip(codes, ends)]
            kept = [len(c) - len(c) // 2 for c, _ in zip(codes, block)]
            tails = [c[:0] if j is None else codes[j][:len(c) // 2] for c, j in zip(codes, ahead)]
            # The edited copy walks on from where its own half ends.
            ends_on = walked(tails, np.array([e[m - 1] if m else 0 for e, m in zip(ends, kept)], "int32"))
            bandings, done = [bands(p) for p in mine], []
            for i, ((_, k, t, after), j, m) in enumerate(zip(block, ahead, kept)):
                other = sample(np.concatenate([codes[i][:m], tails[i]]), np.concatenate([ends[i][:m], ends_on[i]]))
                near = (None, None) if j is None else (likeness(mine[i], mine[j]), shared(bandings[i], bandings[j]))
                done.append((
                    k, len(codes[i]), t[:m] + (after or "")[:len(codes[i]) // 2], shown(*mine[i]), shown(*other), likeness(mine[i], other), near[0],
                    shared(bandings[i], bands(other)), near[1]))
            yield pd.DataFrame(done, columns=[c.split()[0] for c in schema.split(", ")]).astype({key: object, "next_bands": object})

    return rows.mapInPandas(work, schema)

"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Words and pairs of words are counted over all training texts.  A count c is
quantised to level 1 + floor(log2 c) and the n-gram enters the filter once per
level up to its own.  Probing level 1, 2, ... until a miss gives the level back;
levels give counts, and counts give the probability of a word after another,
smoothed with that of the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import text_of
from tidewater.llm.hashed_words import BLANKS, batches_of, mix, word_hashes
from tidewater.sources.staging import write_stage

#: Stands for the end of a text; no word has it, as it comes from no letters.
END = np.uint64(0xE17A1465E17A1465)
#: Tokens that a counting task gathers before it sends its distinct n-grams.
GATHERED = 3_000_000
#: Of one level; with FALSE_HITS of 1 % the number that needs the fewest bits, 9.6 an entry.
PROBES = 7
#: Part of the probes for an absent level that hit, in a filter sized from its n-grams.
FALSE_HITS = 0.01
#: Bytes of a filter up to which it is broadcast, and characters of the texts that are probed together where it is larger.
HELD_BYTES, PROBED_CHARS = 1 << 27, 16_000_000
#: Characters of training text a bucket, above 1,024 buckets.
BUCKET_CHARS = 1 << 23
OUTPUTS = {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
ALPHA = 0.1
SCORED = "n_tokens long, head_known long, head_sum double, score double, rare array<bigint>, rare_n array<bigint>"


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and ends, of what stands before each, and the number of tokens of each text."""
    words, counts = word_hashes(texts, BLANKS)
    out = np.full(len(words) + len(texts), END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)] = words
    return out, np.concatenate([[END], out[:-1]]), counts + 1


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + word)


def filter_key(h: np.ndarray, log_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 bits within it."""
    return (h >> np.uint64(64 - log_buckets)).astype(np.int64), ((h >> np.uint64(32 - log_buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def count_of_level(level: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level: 1, 2.5, 5.5, ...; 0 for level 0."""
    return np.where(level > 0, (2.0 ** np.maximum(level - 1, 0) + 2.0**level - 1) / 2, 0.0)


def places(low: np.ndarray, level: int, kind: int, block: int | np.ndarray) -> Iterator[np.ndarray]:
    """The bits of one level of each key in its block of ``block`` bits (below 2**32), one after the other; kind: 1 for words, 2 for pairs."""
    h = mix(low.astype(np.uint64) + np.uint64((level * 4 + kind) << 32))
    size, low_bits = np.asarray(block, np.uint64), np.uint64(0xFFFFFFFF)
    at, step = h & low_bits, (h >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield ((at * size) >> np.uint64(32)).astype(np.int64)
        at = (at + step) & low_bits


def block_bits(entries: int) -> int:
    """Whole bytes' bits of a block for so many levels of n-grams, such that FALSE_HITS of absent ones hit."""
    return 64 + 8 * int(np.ceil(entries * PROBES / -np.log1p(-FALSE_HITS ** (1 / PROBES)) / 8))


def probed(held: np.ndarray, start: np.ndarray, block: np.ndarray, low: np.ndarray, kind: int) -> np.ndarray:
    """Level of each n-gram, whose block begins at bit ``start`` of ``held`` (block 0: none): asked level by level until the first miss."""
    out, left, level = np.zeros(len(low), np.int64), np.flatnonzero(block), 1
    while len(left) and level <= 64:
        alive = np.arange(len(left))  # most absent levels end at the first or second probe
        for at in places(low[left], level, kind, block[left]):
            at = start[left[alive]] + at[alive]
            alive = alive[(held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        left = left[alive]
        out[left] = level
        level += 1
    return out


def ngram_counts(training: DataFrame, log_buckets: int) -> DataFrame:
    """bucket, words, word_n, pairs, pair_n: packed distinct n-grams, as gathered by each task."""

    def packed(total: np.ndarray, bucket_of: np.ndarray, n: np.ndarray) -> dict[int, tuple]:
        order = np.argsort(bucket_of, kind="stable")
        cut = np.searchsorted(bucket_of[order], np.arange((1 << log_buckets) + 1))
        return {b: (total[order[lo:hi]].tobytes(), n[order[lo:hi]].astype(np.uint32).tobytes()) for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if hi > lo}

    def sent(words: list[np.ndarray], pairs: list[np.ndarray]) -> pd.DataFrame:
        w, wn = np.unique(np.concatenate(words), return_counts=True)
        p, pn = np.unique(np.concatenate(pairs), return_counts=True)
        of_words = packed(w, filter_key(w, log_buckets)[0], wn)
        bucket, low = filter_key(p, log_buckets)
        of_pairs = packed(low, bucket, pn)
        both = sorted(of_words.keys() | of_pairs.keys())
        none = (b"", b"")
        return pd.DataFrame({"bucket": both, "words": [of_words.get(b, none)[0] for b in both], "word_n": [of_words.get(b, none)[1] for b in both], "pairs": [of_pairs.get(b, none)[0] for b in both], "pair_n": [of_pairs.get(b, none)[1] for b in both]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, pairs, held = [], [], 0
        for rows in batches:
            texts = rows["text"].tolist()
            for lo, hi in batches_of(texts):
                word, before, _ = tokens_of(texts[lo:hi])
                words.append(word)
                pairs.append(pair_keys(before, word))
                held += len(word)
                if held >= GATHERED:
                    yield sent(words, pairs)
                    words, pairs, held = [], [], 0
        if held:
            yield sent(words, pairs)

    return training.mapInPandas(count, "bucket int, words binary, word_n binary, pairs binary, pair_n binary")


def merged(keys: list[bytes], counts: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(b"".join(keys), kind)
    n = np.frombuffer(b"".join(counts), np.uint32)
    u, at = np.unique(k, return_inverse=True)
    return u, np.bincount(at, n, len(u)).astype(np.int64)


def train(training: DataFrame, bits: int | None, log_buckets: int, min_pairs: int) -> DataFrame:
    """bucket, hashes, counts, filter: exact word counts and one block of the filter for each bucket.

    Every bucket holds its share (by hash) of all n-grams, whatever their
    frequency; the tasks before have added up repeats.  Pairs enter the filter
    from ``min_pairs`` occurrences on.  A block has its part of ``bits``, or by
    default as many as its own n-grams need.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        words, n = merged(rows["words"].tolist(), rows["word_n"].tolist(), np.uint64)
        pairs, m = merged(rows["pairs"].tolist(), rows["pair_n"].tolist(), np.uint32)
        pairs, m = pairs[m >= min_pairs], m[m >= min_pairs]
        block = block_bits(int(levels(n).sum() + levels(m).sum())) if bits is None else bits >> log_buckets
        bit = np.zeros(block, bool)
        for kind, low, c in ((1, filter_key(words, log_buckets)[1], n), (2, pairs, m)):
            top = levels(c)
            for level in range(1, int(top.max(initial=0)) + 1):
                for at in places(low[top >= level], level, kind, block):
                    bit[at] = True
        return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "hashes": [words.view(np.int64)], "counts": [n], "filter": [np.packbits(bit, bitorder="little").tobytes()]})

    return ngram_counts(training, log_buckets).groupBy("bucket").applyInPandas(build, "bucket int, hashes array<bigint>, counts array<bigint>, filter binary")


class Model:
    """What the scoring tasks hold: the filter, and exact counts of the most frequent words."""

    def __init__(self, rows, bits: int, log_buckets: int, total: int, distinct: int):
        """rows: bucket, filter and the packed frequent words of each bucket, taken one at a time; bits: of all filters."""
        self.log_buckets = log_buckets
        self.start, self.block, used = np.zeros(1 << log_buckets, np.int64), np.zeros(1 << log_buckets, np.int64), 0
        self.bytes = np.zeros(bits >> 3, np.uint8)
        head, head_n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for r in rows:
            part = np.frombuffer(r["filter"], np.uint8)
            self.bytes[used:used + len(part)] = part
            self.start[r["bucket"]], self.block[r["bucket"]] = used * 8, len(part) * 8
            used += len(part)
            head.append(np.frombuffer(r["head"], np.uint64))
            head_n.append(np.frombuffer(r["head_n"], np.int64))
        self.head, self.head_n, self.total, self.distinct = np.concatenate(head), np.concatenate(head_n), total, distinct
        order = np.argsort(self.head)
        self.head, self.head_n = self.head[order], self.head_n[order]

    def level(self, h: np.ndarray, kind: int) -> np.ndarray:
        bucket, low = filter_key(h, self.log_buckets)
        return probed(self.bytes, self.start[bucket], self.block[bucket], low, kind)

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Training count of each word, -1 if it isn't among the held ones."""
        if not len(self.head):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, self.head_n[at], -1)

    def log_probability(self, word: np.ndarray, before: np.ndarray, pair: np.ndarray, weight: float) -> np.ndarray:
        """log10 of weight * c(before, word)/c(before) + (1-weight) * (c(word)+a)/(N+a(V+1)); only the latter after an unseen word."""
        distinct, at = np.unique(word, return_inverse=True)
        single = count_of_level(self.level(distinct, 1))
        one = (single[at] + ALPHA) / (self.total + ALPHA * (self.distinct + 1))
        previous, at = np.unique(before, return_inverse=True)
        base = count_of_level(self.level(previous, 1))[at]
        both = np.minimum(count_of_level(self.level(pair, 2)), base)
        return np.log10(np.where(base > 0, weight * both / np.where(base > 0, base, 1) + (1 - weight) * one, one))


class Answered(Model):
    """A model without its filter, with the levels that were looked up for the texts at hand."""

    def __init__(self, model: Model, answers: pd.DataFrame):
        self.__dict__.update(model.__dict__)
        self.levels = {}
        for kind in (1, 2):
            part = answers[answers["kind"] == kind].sort_values("bucket")
            keys = [np.frombuffer(low, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, low in zip(part["bucket"], part["low"])]
            self.levels[kind] = np.concatenate([np.zeros(0, np.uint64), *keys]), np.frombuffer(b"".join(part["level"]), np.uint8)

    def level(self, h: np.ndarray, kind: int) -> np.ndarray:
        keys, found = self.levels[kind]
        if not len(keys):
            return np.zeros(len(h), np.int64)
        key = h >> np.uint64(32 - self.log_buckets)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, found[at], 0).astype(np.int64)


def scored_texts(m: Model, texts: list[str], weight: float) -> list[tuple]:
    """n_tokens, head_known, head_sum, score, rare and rare_n of each text."""
    out = []
    for lo, hi in batches_of(texts):
        word, before, counts = tokens_of(texts[lo:hi])
        logp = m.log_probability(word, before, pair_keys(before, word), weight)
        exact = m.exact(word)
        known = exact >= 0
        logs = np.where(known, np.log10(np.maximum(exact, 0) + ALPHA), 0.0)
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends):
            rare, rare_n = np.unique(word[a:b][~known[a:b]], return_counts=True)
            out.append((int(b - a), int(known[a:b].sum()), float(np.sum(logs[a:b])), float(np.sum(logp[a:b])), rare.view(np.int64), rare_n))
    return out


def scored_by_join(d: DataFrame, model: DataFrame, held, log_buckets: int, weight: float) -> DataFrame:
    """__row and SCORED of d (__row, __text): texts are dealt into batches, their n-grams are looked up in the buckets' blocks, and the levels go back to the batch."""

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, chars = TaskContext.get().partitionId() << 32, 0
        for rows in batches:
            numbers = []
            for n in rows["__text"].str.len():
                if chars and chars + n > PROBED_CHARS:
                    number, chars = number + 1, 0
                numbers.append(number)
                chars += n
            yield rows.assign(batch=numbers)

    def asked(rows: pd.DataFrame) -> pd.DataFrame:
        texts, words, pairs = rows["__text"].tolist(), [], []
        for lo, hi in batches_of(texts):
            word, before, _ = tokens_of(texts[lo:hi])
            words.append(np.unique(word))
            pairs.append(np.unique(pair_keys(before, word)))
        out = []
        for kind, found in ((1, words), (2, pairs)):
            key = np.unique(np.concatenate(found) >> np.uint64(32 - log_buckets))
            bucket, first = np.unique(key >> np.uint64(32), return_index=True)
            out += [(int(rows["batch"].iloc[0]), int(b), kind, k.astype(np.uint32).tobytes()) for b, k in zip(bucket, np.split(key, first[1:]))]
        return pd.DataFrame(out, columns=["batch", "bucket", "kind", "low"])

    def answered(asks: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        held_block = np.frombuffer(blocks["filter"].iloc[0], np.uint8) if len(blocks) else np.zeros(0, np.uint8)
        out = []
        for kind, raw in zip(asks["kind"], asks["low"]):
            low = np.frombuffer(raw, np.uint32)
            out.append(probed(held_block, np.zeros(len(low), np.int64), np.full(len(low), len(held_block) * 8), low, kind).astype(np.uint8).tobytes())
        return asks.assign(level=out)

    def scored(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(scored_texts(Answered(held.value, answers), rows["__text"].tolist(), weight), columns=["n_tokens", "head_known", "head_sum", "score", "rare", "rare_n"])
        return out.assign(__row=rows["__row"].to_numpy())

    texts = write_stage(d.select("__row", "__text").mapInPandas(dealt, "__row long, __text string, batch long"), "lm-batches")
    asks = texts.groupBy("batch").applyInPandas(asked, "batch long, bucket int, kind int, low binary")
    answers = asks.groupBy("bucket").cogroup(model.select("bucket", "filter").groupBy("bucket")).applyInPandas(answered, "batch long, bucket int, kind int, low binary, level binary")
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(scored, f"__row long, {SCORED}")


def frequent(least: int | None) -> tuple[Column, Column]:
    """head, head_n: hashes and counts of a bucket's words that occur ``least`` times or more (None: of none), packed."""

    @F.pandas_udf("head binary, head_n binary")
    def packed(hashes: pd.Series, counts: pd.Series) -> pd.DataFrame:
        out = []
        for h, n in zip(hashes, counts):
            h, n = np.asarray(h, np.int64), np.asarray(n, np.int64)
            keep = n >= least if least is not None else np.zeros(len(n), bool)
            out.append((h[keep].tobytes(), n[keep].tobytes()))
        return pd.DataFrame(out, columns=["head", "head_n"])

    p = packed("hashes", "counts")
    return p["head"].alias("head"), p["head_n"].alias("head_n")


def score(df: DataFrame, training: DataFrame, text: str = "text", bits: int | None = None, log_buckets: int | None = None, min_pairs: int = 1, weight: float = 0.6, head_words: int = 1_000_000, carry: list[str] | None = None, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The ``carry`` columns of every row (all but the text by default) with n_tokens, n_known, train_tokens, base_score and score.

    Counts cover every training text.  The filter grows with the n-grams in
    training, so that FALSE_HITS of the probes for an absent level hit at any
    size, unless ``bits`` fixes it; up to ``held_bytes`` it is broadcast, a
    larger one is probed block by block through a join on the bucket, with the
    same scores.  The buckets grow with the training text.  The table of exact
    counts has at most ``head_words`` words (16 MB) for any corpus: those of
    the highest counts, ties of the last count left out together.  Rarer words
    get their exact counts for the base score by a join.

    A null or empty text consists of its end alone.  Without training texts N
    and V are 0.  Repeated rows are scored alike; input columns named like the
    outputs give way.
    """
    spark = df.sparkSession
    if log_buckets is None:
        chars = training.agg(F.sum(F.length(text_of(text)))).first()[0] or 0
        log_buckets = min(24, max(10, (chars // BUCKET_CHARS).bit_length()))
    model = write_stage(train(training.select(text_of(text).alias("text")), bits, log_buckets, min_pairs), "lm")
    words = model.select(F.explode(F.arrays_zip("hashes", "counts")).alias("w")).select(F.col("w.hashes").alias("hash"), F.col("w.counts").alias("n"))
    by_count = words.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    # one row per distinct count: at most the square root of twice the training tokens
    ranked = by_count.withColumn("upto", F.sum("words").over(Window.orderBy(F.desc("n"))))
    facts = ranked.agg(F.sum(F.col("n") * F.col("words")).alias("total"), F.sum("words").alias("distinct"), F.min(F.when(F.col("upto") <= head_words, F.col("n"))).alias("least")).first()
    total, distinct, least = facts["total"] or 0, facts["distinct"] or 0, facts["least"]
    size = model.agg(F.sum(F.length("filter"))).first()[0] or 0
    small = size <= held_bytes
    blocks = F.col("filter") if small else F.lit(b"").alias("filter")
    held = spark.sparkContext.broadcast(Model(model.select("bucket", blocks, *frequent(least)).toLocalIterator(), size * 8 if small else 0, log_buckets, total, distinct))

    @F.pandas_udf(SCORED)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame(scored_texts(held.value, rows.tolist(), weight), columns=["n_tokens", "head_known", "head_sum", "score", "rare", "rare_n"])

    carried = [c for c in (df.columns if carry is None else carry) if c != text and c.lower() not in OUTPUTS]
    if small:
        d = df.select(*carried, scored(text_of(text)).alias("__s")).select(*carried, "__s.*", F.monotonically_increasing_id().alias("__row"))
        d = write_stage(d, "lm-scored")  # the row numbers have to stay
    else:
        d = write_stage(df.select(*carried, text_of(text).alias("__text"), F.monotonically_increasing_id().alias("__row")), "lm-texts")
        d = write_stage(d.drop("__text").join(scored_by_join(d, model, held, log_buckets, weight), "__row"), "lm-scored")
    asked = d.select("__row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("__row", F.col("r.rare").alias("hash"), F.col("r.rare_n").alias("times"))
    found = asked.join(words if least is None else words.where(F.col("n") < least), "hash").groupBy("__row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + ALPHA)).alias("rare_sum"), F.sum("times").alias("rare_known"))
    d = d.join(found, "__row", "left").fillna({"rare_sum": 0.0, "rare_known": 0})
    n_known = F.col("head_known") + F.col("rare_known")
    base = F.col("head_sum") + F.col("rare_sum") + (F.col("n_tokens") - n_known) * F.log10(F.lit(ALPHA)) - F.col("n_tokens") * F.log10(F.lit(total + ALPHA * (distinct + 1)))
    return d.select(*carried, "n_tokens", n_known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

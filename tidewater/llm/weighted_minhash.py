"""Near duplicates by improved consistent weighted sampling over TF-IDF word shingles.

Each text is its multiset of five-word shingles, weighted by frequency in the
text times inverse document frequency.  A sample of it is a pair of a shingle
and a weight step, drawn so that two texts draw the same pair with probability
equal to their weighted Jaccard similarity; common passages weigh little and
seldom bring texts together.  Samples are grouped in bands, texts that share a
band are compared with leaders of that bucket and, where these leave several
classes, with all texts of other classes there; the whole shingle sets decide.  As many bands are sampled from the distinct shingles with equal
weights, for texts that are alike but for repeats or rare shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import text_key, text_of
from tidewater.llm.components import components, few_components
from tidewater.llm.hashed_words import NO_WORD, batches_of, mix, word_hashes
from tidewater.sources.staging import write_stage

WORDS = 5
#: Bands of weighted samples, and as many of plain ones.
BANDS, ROWS = 10, 3
#: Open texts of a bucket up to which each of them is compared with the whole bucket: in the first round, later.
SMALL = 8, 16
#: Leaders of a larger bucket in each round, and rounds after which its open texts are compared block by block.
#: A text of a large group has one in each of its 2 * BANDS buckets, so that more of them make so many times more pairs.
LEADERS, ROUNDS = 1, 3
#: Texts and bytes of shingle sets of a block, and elements of a block pair that are multiplied at once.
BLOCK_TEXTS, BLOCK_BYTES, BLOCK_ELEMENTS = 1024, 16 << 20, 4096
#: New links between classes up to which one task joins them; more are joined by rounds of shuffles.
FEW_LINKS = 10_000
#: Counters of document frequency (hashed), in blocks.
LOG_COUNTERS, LOG_BLOCK = 21, 15
#: Draws of (r, log c, beta) that shingles pick from, and steps per unit of a log weight.
DRAWS, STEPS = 1 << 16, 64


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Sorted 32-bit shingle hashes of each text, repeats kept; fewer than five words are one shingle, none is none."""
    words, counts = word_hashes(texts, NO_WORD)
    odd = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
    out, at = [], 0
    for n in counts:
        w = words[at:at + n]
        at += n
        take = min(WORDS, n)
        if not n:
            out.append(np.zeros(0, np.uint32))
            continue
        h = np.zeros(n - take + 1, np.uint64)
        for j in range(take):
            h += w[j:j + len(h)] * odd[j]
        out.append(np.sort((mix(h + np.uint64(take)) >> np.uint64(32)).astype(np.uint32)))
    return out


def document_frequency(docs: DataFrame) -> DataFrame:
    """block, counts: in how many texts the shingles of each hashed counter occur, over all rows.

    A task adds up its texts in one fixed array and sends it once per 60,000
    texts, so that two bytes hold a counter.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, texts_seen = np.zeros(1 << LOG_COUNTERS, np.uint32), 0

        def sent() -> pd.DataFrame:
            blocks = total.astype(np.uint32).reshape(-1, 1 << LOG_BLOCK)
            some = np.flatnonzero(blocks.any(axis=1))
            return pd.DataFrame({"block": some, "counts": [blocks[b].astype(np.uint16 if texts_seen < 65_536 and blocks[b].max() < 65_536 else np.uint32).tobytes() for b in some]})

        for rows in batches:
            texts = rows["text"].tolist()
            for lo, hi in batches_of(texts):
                for s in shingles(texts[lo:hi]):
                    np.add.at(total, np.unique(s & np.uint32((1 << LOG_COUNTERS) - 1)), 1)
                texts_seen += hi - lo
                if texts_seen >= 60_000:
                    yield sent()
                    total[:], texts_seen = 0, 0
        if texts_seen:
            yield sent()

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << LOG_BLOCK, np.int64)
        for raw in rows["counts"]:
            total += np.frombuffer(raw, np.uint16 if len(raw) == 2 << LOG_BLOCK else np.uint32)
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "counts": [total.tobytes()]})

    return docs.mapInPandas(count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary")


def weight_table(frequency: np.ndarray, n: int) -> np.ndarray:
    """Log weight of each counter in STEPS per unit: log(1 + ln((1+n)/(1+df)) / ln(1+n)), weights from 1 to 2."""
    idf = np.log((1.0 + n) / (1.0 + np.minimum(frequency, n))) / np.log(2.0 + n)
    return np.rint(np.log1p(np.maximum(idf, 0)) * STEPS).astype(np.int16)


@lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = np.random.default_rng(20_240_601)
    return tuple(d.astype(np.float32) for d in (g.gamma(2.0, 1.0, DRAWS), np.log(g.gamma(2.0, 1.0, DRAWS)), g.random(DRAWS)))


@lru_cache(maxsize=1)
def factors() -> np.ndarray:
    return mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def samples(s: np.ndarray, log_weights: np.ndarray) -> np.ndarray:
    """BANDS*ROWS consistent samples of one multiset: 32-bit hashes of (shingle, step)."""
    r, log_c, beta = draws()
    u, tf = np.unique(s, return_counts=True)
    log_s = (log_weights[u & np.uint32((1 << LOG_COUNTERS) - 1)] / STEPS + np.rint(np.log(tf) * STEPS) / STEPS).astype(np.float32)
    wide = mix(u.astype(np.uint64))
    best, out = np.full(len(factors()), np.inf, np.float32), np.zeros(len(factors()), np.uint64)
    for lo in range(0, len(u), 2048):
        pick = ((wide[lo:lo + 2048, None] * factors()[None, :]) >> np.uint64(48)).astype(np.intp)
        rr, bb = r[pick], beta[pick]
        step = np.floor(log_s[lo:lo + 2048, None] / rr + bb)
        log_a = log_c[pick] - rr * (step - bb) - rr
        at = log_a.argmin(axis=0)
        cols = np.arange(len(at))
        least = log_a[at, cols]
        drawn = mix(wide[lo + at] + step[at, cols].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out = np.where(least < best, drawn, out)
        best = np.minimum(best, least)
    return (out >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=1)
def plain_factors() -> np.ndarray:
    return mix(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def plain_samples(s: np.ndarray) -> np.ndarray:
    """BANDS*ROWS samples of the distinct shingles of one multiset, all of one weight: 32-bit hashes of the least product."""
    u = s[np.concatenate([[True], s[1:] != s[:-1]])]
    wide = mix(u.astype(np.uint64))
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for lo in range(0, len(u), 2048):
        least = np.minimum(least, (wide[lo:lo + 2048, None] * plain_factors()).min(axis=0))
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def similarity(a: np.ndarray, b: np.ndarray, log_weights: np.ndarray) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two sorted multisets."""
    (ua, na), (ub, nb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    both, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    weight = lambda u: np.exp(log_weights[u & np.uint32((1 << LOG_COUNTERS) - 1)] / STEPS)
    shared = float(np.sum(weight(both) * np.minimum(na[ia], nb[ib])))
    every = float(np.sum(weight(ua) * na) + np.sum(weight(ub) * nb)) - shared
    return shared / every if every else 0.0, len(both) / max(1, len(ua) + len(ub) - len(both))


def shared_weights(spark: SparkSession, docs: DataFrame):
    """Broadcast table of log weights: 2**LOG_COUNTERS numbers of two bytes, whatever the corpus."""
    freq, n = np.zeros(1 << LOG_COUNTERS, np.int64), docs.count()
    for row in document_frequency(docs).toLocalIterator():
        freq[row["block"] << LOG_BLOCK:(row["block"] + 1) << LOG_BLOCK] = np.frombuffer(row["counts"], np.int64)
    return spark.sparkContext.broadcast(weight_table(freq, n))


def signatures(docs: DataFrame, weights) -> DataFrame:
    """node, sig of each distinct text with at least one word: the weighted samples, then the plain ones."""

    @F.pandas_udf("array<int>")
    def drawn(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            texts, out = rows.tolist(), []
            for lo, hi in batches_of(texts):
                out += [np.concatenate([samples(s, weights.value), plain_samples(s)]).view(np.int32) if len(s) else None for s in shingles(texts[lo:hi])]
            yield pd.Series(out, dtype=object)

    d = docs.select("node", drawn("text").alias("sig")).where("sig is not null")
    return d.groupBy("node").agg(F.first("sig").alias("sig"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, set: the packed shingles of each text."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            texts, out = rows.tolist(), []
            for lo, hi in batches_of(texts):
                out += [s.tobytes() for s in shingles(texts[lo:hi])]
            yield pd.Series(out, dtype=object)

    return docs.select("node", packed("text").alias("set"))


def compared(pairs: DataFrame, sets: DataFrame, weights) -> DataFrame:
    """a, b -> with weighted and plain similarity of the whole sets."""

    @F.pandas_udf("weighted double, plain double")
    def of(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([similarity(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), weights.value) for a, b in zip(x, y)], columns=["weighted", "plain"])

    p = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return p.select("a", "b", of("set_a", "set_b").alias("s")).select("a", "b", "s.weighted", "s.plain")


def elements(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and element of all sets, one behind another; an element is a shingle (upper bits) and how often it came before in its text."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingle = np.concatenate([np.zeros(0, np.uint32), *sets])
    start = np.ones(len(row), bool)
    start[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.arange(len(row))
    return row, (shingle.astype(np.uint64) << np.uint64(32)) | (at - np.maximum.accumulate(np.where(start, at, 0))).astype(np.uint64)


def block_links(left: list[np.ndarray], right: list[np.ndarray], apart: np.ndarray, log_weights: np.ndarray, threshold: float) -> list[tuple[int, int, float, float]]:
    """(i, j, weighted, plain) of all left and right sorted multisets that reach the threshold where ``apart`` is true.

    What two texts share is a product of matrices over the elements of both sides.
    """
    (row_a, a), (row_b, b) = elements(left), elements(right)
    weight = lambda e: np.exp(log_weights[(e >> np.uint64(32)) & np.uint64((1 << LOG_COUNTERS) - 1)] / STEPS)
    first = lambda e: (e & np.uint64(0xFFFFFFFF)) == 0
    sums = [(np.bincount(r, weight(e), n), np.bincount(r, first(e), n)) for r, e, n in ((row_a, a, len(left)), (row_b, b, len(right)))]
    both = np.intersect1d(a, b)
    in_a, in_b = np.isin(a, both), np.isin(b, both)
    row_a, col_a, row_b, col_b = row_a[in_a], np.searchsorted(both, a[in_a]), row_b[in_b], np.searchsorted(both, b[in_b])
    shared, same = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)), np.float32)
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    for lo in range(0, len(both), BLOCK_ELEMENTS):
        e = both[lo:lo + BLOCK_ELEMENTS]
        x, y = np.zeros((len(left), len(e))), np.zeros((len(right), len(e)))
        for m, row, col, order in ((x, row_a, col_a, order_a), (y, row_b, col_b, order_b)):
            here = order[np.searchsorted(col[order], lo):np.searchsorted(col[order], lo + len(e))]
            m[row[here], col[here] - lo] = 1
        shared += (x * weight(e)) @ y.T
        same += x[:, first(e)].astype(np.float32) @ y[:, first(e)].astype(np.float32).T
    (all_a, n_a), (all_b, n_b) = sums
    union = np.maximum(all_a[:, None] + all_b - shared, 1e-12), np.maximum(n_a[:, None] + n_b - same, 1)
    # the matrices only choose; sums in another order could turn a pair that just reaches the threshold
    found = np.argwhere(apart & ((shared / union[0] >= threshold - 1e-9) | (same / union[1] >= threshold - 1e-6)))
    rows = [(int(i), int(j), *similarity(left[i], right[j], log_weights)) for i, j in found]
    return [r for r in rows if max(r[2:]) >= threshold]


def blocks_compared(state: DataFrame, sets: DataFrame, weights, threshold: float) -> DataFrame:
    """a, b, weighted, plain: all links from the open texts of each bucket to its texts of other classes.

    The open texts and all texts of a bucket are dealt into blocks; a task
    compares a block of the one with a block of the other, so that no task
    holds a bucket and no pair is written that is no link.
    """
    m = state.where("open or not done").join(sets, "node")
    pieces = lambda c: F.ceil(F.greatest(F.count_if(c) / BLOCK_TEXTS, F.sum(F.when(c, F.length("set")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    of_key = m.groupBy("band", "key").agg(pieces(F.col("open")).alias("rows"), pieces(F.lit(True)).alias("cols"))
    m = m.join(of_key, ["band", "key"]).select("band", "key", "node", "label", "open", "set", "rows", "cols")
    dealt = lambda n: F.pmod(F.xxhash64(F.lit(7), "node"), F.col(n)).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = m.where("open").withColumn("r", dealt("rows")).withColumn("c", up_to("cols")).withColumn("asks", F.lit(True))
    asked = m.withColumn("c", dealt("cols")).withColumn("r", up_to("rows")).withColumn("asks", F.lit(False))

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[rows["asks"]], rows[~rows["asks"]]
        names = {k: i for i, k in enumerate(rows["label"].unique())}
        label_x, label_y = x["label"].map(names).to_numpy(), y["label"].map(names).to_numpy()
        read = lambda d: [np.frombuffer(s, np.uint32) for s in d["set"]]
        found = block_links(read(x), read(y), label_x[:, None] != label_y, weights.value, threshold)
        ends = [(*sorted((x["node"].iloc[i], y["node"].iloc[j])), w, p) for i, j, w, p in found]
        return pd.DataFrame(ends, columns=["a", "b", "weighted", "plain"])

    both = asks.unionByName(asked).select("band", "key", "r", "c", "node", "label", "set", "asks")
    return both.groupBy("band", "key", "r", "c").applyInPandas(of, "a binary, b binary, weighted double, plain double").distinct()


def merged_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label of all links so far, from the labels before and the new links.

    Only links between different classes are followed, so that later rounds,
    whose links mostly lie within one class, end after one look.
    """
    if labels is None:
        return components(links)
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}"))
    ends = [F.coalesce(f"of_{end}", end).alias(end) for end in ("a", "b")]
    between = write_stage(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(*ends).where("a != b").distinct(), "between")
    n = between.count()
    if not n:
        return labels
    up = write_stage(few_components(between), "up") if n <= FEW_LINKS else components(between)
    old = labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return write_stage(old.unionByName(up.join(labels, "node", "left_anti")), "labels")


def verified_links(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, labels): a, b, weighted, plain between distinct texts, and node, label of the classes they join.

    docs: node, text.  Only links between classes are looked for.  In a bucket
    the texts outside its most frequent class are open, in the first round all.
    Where at most SMALL are open, each is compared with all of other classes in
    the bucket, so pairs stay below SMALL times its texts.  Elsewhere LEADERS
    of the open ones are so compared and then done, and with the classes that
    these links make the bucket is looked at again, whole.  What is open after
    ROUNDS of these is compared with all texts of other classes, block by
    block.  So any two texts that share a bucket have been compared or are of
    one class; no bucket is cut short and none is gathered in a task.
    """
    spark = docs.sparkSession
    weights = shared_weights(spark, docs)
    sig = write_stage(signatures(docs, weights), "signatures")
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.get("sig", F.lit(b * ROWS + r)) for r in range(ROWS)]) for b in range(2 * BANDS)])

    def bucketed(m: DataFrame, turn: int) -> DataFrame:
        """m: node, label, done, band, key -> with open, n_open and leads, of the buckets with open texts."""
        if turn:
            of_label = m.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
            m = m.join(of_label.groupBy("band", "key").agg(F.max(F.struct("n", "label"))["label"].alias("top")), ["band", "key"])
            m = m.withColumn("open", ~F.col("done") & (F.col("label") != F.col("top"))).drop("top")
        else:
            m = m.withColumn("open", F.lit(True))
        ranked = [F.struct(F.xxhash64(F.lit(turn), F.lit(i), "node").alias("rank"), "node", "label") for i in range(LEADERS)]
        first = [F.min(F.when(F.col("open"), r)) for r in ranked]
        of_key = m.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"), F.array_distinct(F.transform(F.array(*first), lambda r: F.struct(r["node"].alias("node"), r["label"].alias("label")))).alias("leads"))
        return write_stage(m.join(of_key.where("n > 1 and n_open > 0").drop("n"), ["band", "key"]), "buckets")

    state = bucketed(sig.select("node", F.col("node").alias("label"), F.lit(False).alias("done"), F.posexplode(bands).alias("band", "key")), 0)
    sets = write_stage(shingle_sets(docs.join(state.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])), "sets")
    links = label = None
    turn = 0
    while True:
        few, large = state.where(F.col("n_open") <= SMALL[turn > 0]), state.where(F.col("n_open") > SMALL[turn > 0])
        other = few.where("not done").select("band", "key", F.col("node").alias("other"), F.col("label").alias("other_label"), F.col("open").alias("other_open"))
        pairs = few.where("open").join(other, ["band", "key"]).where("label != other_label and (node < other or not other_open)").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        leads = large.where("not done").groupBy("node", "label").agg(F.array_distinct(F.flatten(F.collect_list("leads"))).alias("leads"))  # of 2 * BANDS buckets at most
        asked = leads.select("node", F.explode(F.filter("leads", lambda x: x["label"] != F.col("label"))).alias("lead"))
        pairs = pairs.union(asked.select(F.least("node", "lead.node"), F.greatest("node", "lead.node"))).distinct()
        done = write_stage(compared(pairs, sets, weights), "pairs")
        good = done.where((F.col("weighted") >= threshold) | (F.col("plain") >= threshold))
        links = good if links is None else links.unionByName(good)
        label = merged_labels(label, good)
        rest = large.select("node", "band", "key", (F.col("done") | F.array_contains("leads.node", F.col("node"))).alias("done"))
        turn += 1
        state = bucketed(rest.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), turn)
        if turn == ROUNDS and not state.isEmpty():
            good = write_stage(blocks_compared(state, sets, weights, threshold), "pairs")
            links, label = links.unionByName(good), merged_labels(label, good)
        if turn == ROUNDS or state.isEmpty():
            return links.select("a", "b", "weighted", "plain").distinct(), label


def classes(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8, key: str | None = None) -> DataFrame:
    """id, class_id, class_size, n_links and kept for every row, with the text's key where ``key`` names a column for it.

    Two texts are linked if the weighted or the plain Jaccard similarity of
    their five-word shingles (words: runs of 0-9, a-z and characters from \\x80
    on, A-Z lower-cased) is at least ``threshold``; equal texts belong together
    without a link.  class_id is the least id of the connected class (null ids
    are left out of the least), kept marks the row of the largest id, among those
    of one id the text of the largest key (rows equal in both are all marked); n_links
    counts the links found at the row's text.  A text without words has no
    shingle and is only equal to itself; null counts as empty; texts of fewer
    than five words are one shingle.  Repeated rows get the same class; an
    empty table gives none.  Links are found by sampling: a pair at similarity
    s of either kind shares a bucket with probability 1-(1-s**ROWS)**BANDS or
    more, 0.999 at 0.8.
    """
    slim = df.select(F.col(id_col).alias("id"), text_of(text).alias("text"))
    docs = slim.select(text_key(F.col("text")).alias("node"), "text")
    links, label = verified_links(docs, threshold)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    rows = slim.select("id", text_key(F.col("text")).alias("node"))
    rows = rows.join(label.join(degree, "node"), "node", "left").select("id", "node", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    of_class = rows.groupBy("label").agg(F.min("id").alias("class_id"), F.max(F.struct("id", "node")).alias("last"), F.count(F.lit(1)).alias("class_size"))
    kept = F.col("id").eqNullSafe(F.col("last.id")) & (F.col("node") == F.col("last.node"))
    more = [F.col("node").alias(key)] if key else []
    return rows.join(of_class, "label").select(F.col("id").alias(id_col), "class_id", "class_size", "n_links", kept.alias("kept"), *more)

"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A
trigram's vector binds (multiplies) the vectors of its letters, the first
rotated twice and the second once; a text's vector bundles (adds) those of its
trigrams.  A language's prototype bundles the unit vectors of its texts, and a
text is given the language of the prototype of largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_of, with_outputs

#: Whole-number scale of a unit vector, so that bundles add up exactly in any order.
UNIT = 10_000
#: Characters that one pass of a task holds.
BLOCK = 400_000


@lru_cache(maxsize=8192)
def letter_vector(code: int, dims: int) -> np.ndarray:
    return np.random.default_rng((code, dims)).integers(0, 2, dims, np.int8) * np.int8(2) - np.int8(1)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> lower-case letter's code point, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters of a text, any run of other characters as one 0, one 0 before and after."""
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[np.uint32(0)], codes, [np.uint32(0)]])
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def has_letter(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([any(map(str.isalpha, t)) for t in texts], dtype=bool)

    return found(text)


def vectors(texts: list[str], dims: int) -> np.ndarray:
    """One bundled trigram vector per text (all 0: no letter)."""
    out = np.zeros((len(texts), dims), np.float64)
    parts: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), BLOCK):
            # two characters more, so that no trigram of neighbouring letters is lost at a cut
            codes = letters_of(text[at:at + BLOCK + 2])
            if codes.any():
                parts.append((i, codes))
                size += len(codes)
            if size > BLOCK:
                _bundle(parts, dims, out)
                parts, size = [], 0
    _bundle(parts, dims, out)
    return out


def ranked(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place among them; by counting where ``limit`` is moderate."""
    if limit > 1 << 22:
        return np.unique(values, return_inverse=True)
    used = np.flatnonzero(np.bincount(values, minlength=limit))
    place = np.zeros(limit, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    return used, place[values]


def _bundle(parts: list[tuple[int, np.ndarray]], dims: int, out: np.ndarray) -> None:
    if not parts:
        return
    lengths = [len(c) for _, c in parts]
    flat = np.concatenate([c for _, c in parts])
    alphabet, small = ranked(flat, 0x110000)
    m = len(alphabet)
    small = small.astype(np.int64)
    # one letter between two blanks carries no order; trigrams across two texts are none
    kept = (flat[1:-1] != 0) & ((flat[:-2] != 0) | (flat[2:] != 0))
    for e in np.cumsum(lengths[:-1], dtype=np.int64):
        kept[max(0, e - 2):e] = False
    tri = ((small[:-2] * m + small[1:-1]) * m + small[2:])[kept]
    row = np.repeat(np.arange(len(parts)), lengths)[:-2][kept]
    if not len(tri):
        return
    used, column = ranked(tri, m**3)
    letters = np.stack([letter_vector(int(x), dims) for x in alphabet])
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    for lo in range(0, len(used), 8192):  # a bounded table of trigram vectors at a time
        u = used[lo:lo + 8192]
        bound = first[u // (m * m)] * second[u // m % m] * letters[u % m]
        here = slice(None) if len(used) <= 8192 else (column >= lo) & (column < lo + 8192)
        cell = row[here] * len(u) + (column[here] - lo)
        counts = np.bincount(cell, minlength=len(parts) * len(u)).reshape(len(parts), len(u))
        np.add.at(out, [i for i, _ in parts], counts.astype(np.float32) @ bound.astype(np.float32))


def prototypes(labelled: DataFrame, text: str = "text", lang: str = "lang", dims: int = 1024) -> DataFrame:
    """lang, vector: the bundled unit vectors of all texts of each non-null language.

    Tasks add up their own rows first and send one row per language and
    dimension; the sums are whole numbers, so the order of rows has no effect.
    Texts without a letter add nothing.
    """

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for rows in batches:
            for at in range(0, len(rows), 256):
                part = rows.iloc[at:at + 256]
                v = vectors(part["text"].tolist(), dims)
                norm = np.linalg.norm(v, axis=1)
                unit = np.rint(v / np.where(norm, norm, 1)[:, None] * UNIT).astype(np.int64)
                for name, at_rows in part.reset_index(drop=True).groupby("lang").groups.items():
                    total[name] = total.get(name, 0) + unit[np.asarray(at_rows)].sum(axis=0)
        for name, v in total.items():
            yield pd.DataFrame({"lang": name, "dim": np.arange(dims, dtype=np.int32), "v": v})

    known = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"))
    sums = known.mapInPandas(bundled, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"])
    return sums.groupBy("lang").agg(ordered.alias("vector"))


def predict(df: DataFrame, profiles: DataFrame, text: str = "text", dims: int = 1024) -> DataFrame:
    """Every row with lang_pred and score (the cosine, 0 to 1).

    ``profiles`` comes from ``prototypes``; its one row per language (``dims``
    numbers, 8 KB) is gathered and broadcast: there are fewer than 8,000
    language codes, so this stays below 64 MB however many documents there are.  A null text or one
    without a letter is `und` with score 0; without any profile all are.  Where
    all letters of a text stand alone there is no trigram, so its cosines are
    all 0.  Of equal cosines the language
    first by code point wins.  Input columns named like the outputs give way.
    """
    rows = sorted(profiles.collect(), key=lambda r: r["lang"])
    names = [r["lang"] for r in rows]
    matrix = np.array([r["vector"] for r in rows], np.float64).reshape(len(names), dims)
    norms = np.linalg.norm(matrix, axis=1)
    sent = df.sparkSession.sparkContext.broadcast((names, matrix / np.where(norms, norms, 1)[:, None]))

    @F.pandas_udf("lang string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, unit = sent.value
        for texts in batches:
            lang, score = [], []
            for at in range(0, len(texts), 256):
                v = vectors(texts.iloc[at:at + 256].tolist(), dims)
                norm = np.linalg.norm(v, axis=1)
                if not names:
                    lang += ["und"] * len(v)
                    score += [0.0] * len(v)
                    continue
                cos = v @ unit.T / np.where(norm, norm, 1)[:, None]
                best = cos.argmax(axis=1)
                lang += [names[b] if n or letters_of(x).any() else "und" for b, n, x in zip(best, norm, texts.iloc[at:at + 256])]
                score += [float(min(1.0, max(0.0, c[b]))) if n else 0.0 for c, b, n in zip(cos, best, norm)]
            yield pd.DataFrame({"lang": lang, "score": score})

    p: Column = nearest(text_of(text))
    d = df.withColumn("__p", p)
    return with_outputs(d, {"lang_pred": F.col("__p.lang"), "score": F.col("__p.score")}).drop("__p")

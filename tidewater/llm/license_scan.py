"""Licence scan with a positional index of rare words, in SQL functions only.

The index is built from phrases.  A phrase is found through its rarest word
(highest inverse document frequency over the scanned files): a file's places
of that word give the places where the phrase would have to begin, and the
words at the phrase's relative positions are compared there.  Templates are
looked up in the same way through the rarest word of their key phrases: every
key phrase has to stand in the file at its relative position, and the share of
the template's words that agree there is its score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_of, with_outputs

#: The phrases and labels that are always looked for.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    """``words`` in order; ``key``: the mandatory phrases, each a run of those words."""

    label: str
    words: str
    key: tuple[str, ...]


#: Short notices by which files name their licence.
TEMPLATES = (
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "licensed under the mit license", ("the mit license",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "without modification")),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify", "distribute this software")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
)


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased: runs of 0-9, a-z and all characters from \\x80 on."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _find(words: list[str], part: list[str]) -> int:
    return next(i for i in range(len(words) - len(part) + 1) if words[i:i + len(part)] == part)


def entries(base=BASE, templates=TEMPLATES) -> list[dict]:
    """Phrases and templates alike: their words and the positions that have to agree."""
    out = [{"label": label, "words": p.split(), "base": True, "must": list(range(len(p.split())))} for p, label in base]
    for t in templates:
        words, must = t.words.split(), set()
        for k in t.key:
            at = _find(words, k.split())
            must |= set(range(at, at + len(k.split())))
        out.append({"label": t.label, "words": words, "base": False, "must": sorted(must)})
    return out


def frequencies(words: DataFrame, vocabulary: list[str]) -> DataFrame:
    """word, files: the number of files with each licence word (one row per word that occurs)."""
    return words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("files"))


def scan(df: DataFrame, text: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """Every row with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    n_base counts all places of the base phrases; first_word and last_word are
    the smallest and largest word number at which one begins (null: none);
    labels adds the templates found to base_labels, both distinct, sorted and
    comma-joined (empty: none); score is 1 with a base phrase, else the largest
    share of agreeing words of a template found, else 0; spans lists label,
    first word and number of words of all places.  A null or empty text has no
    words; repeated rows get the same result each; input columns named like
    the outputs give way.  Rows don't move: only word frequencies are shuffled.
    """
    items = entries(base, templates)
    vocabulary = sorted({w for e in items for w in e["words"]})
    tokens = words_of(text_of(text))
    files = frequencies(df.select(tokens.alias("words")), vocabulary)
    # one row; its size follows the templates alone
    table = files.agg(F.map_from_entries(F.collect_list(F.struct("word", "files"))).alias("files"))
    count = lambda w: F.coalesce(F.try_element_at("files", w), F.lit(0))
    anchors = []
    for i, e in enumerate(items):
        must = F.array(*[F.struct(F.lit(e["words"][p]).alias("word"), F.lit(p).alias("at")) for p in e["must"]])
        # highest idf = fewest files; the first such position
        rarest = F.array_min(F.transform(must, lambda x: F.struct(count(x["word"]).alias("files"), x["at"].alias("at"), x["word"].alias("word"))))
        anchors.append(F.struct(rarest["word"].alias("word"), F.lit(i).alias("entry"), rarest["at"].alias("at")))
    index = table.select(F.array(*anchors).alias("postings"))
    library = F.array(*[
        F.struct(F.lit(e["label"]).alias("label"), F.lit(e["base"]).alias("base"), _strings(e["words"]).alias("words"), F.array(*[F.lit(p) for p in e["must"]]).alias("must"))
        for e in items])

    d = df.withColumns({"__w": tokens, "__post": index.scalar()})
    d = d.withColumn("__hit", F.arrays_overlap("__w", F.transform("__post", lambda p: p["word"])))
    places = F.filter(F.transform("__w", lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda x: F.exists("__post", lambda p: p["word"] == x["word"]))
    starts = F.flatten(F.transform(places, lambda x: F.transform(F.filter("__post", lambda p: p["word"] == x["word"]), lambda p: F.struct(p["entry"].alias("entry"), (x["i"] - p["at"]).alias("first")))))

    def agree(s: Column, e: Column) -> Column:
        """Which of the entry's words stand at their relative positions."""
        return F.transform(e["words"], lambda w, p: F.coalesce(F.get(F.col("__w"), (s["first"] + p).cast("int")) == w, F.lit(False)))

    def checked(s: Column) -> Column:
        e = F.get(library, s["entry"])
        same = agree(s, e)
        return F.struct(
            e["label"].alias("label"), e["base"].alias("base"), s["first"].alias("first"), F.size(e["words"]).alias("words"),
            F.forall(e["must"], lambda p: F.get(same, p)).alias("whole"),
            (F.size(F.filter(same, lambda x: x)) / F.size(e["words"])).alias("share"))

    kind = "array<struct<label:string,base:boolean,first:int,words:int,whole:boolean,share:double>>"
    d = d.withColumn("__found", F.when(F.col("__hit"), F.filter(F.transform(starts, checked), lambda x: x["whole"]).cast(kind)).otherwise(F.array().cast(kind)))
    own = F.filter("__found", lambda x: x["base"])
    at = F.transform(own, lambda x: x["first"].cast("long"))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return with_outputs(d, {
        "n_words": F.size("__w").cast("long"), "n_base": F.size(own).cast("long"), "first_word": F.array_min(at), "last_word": F.array_max(at),
        "base_labels": join(own), "labels": join(F.col("__found")), "score": F.coalesce(F.array_max(F.transform("__found", lambda x: x["share"])), F.lit(0.0)),
        "spans": F.transform("__found", lambda x: F.struct(x["label"].alias("label"), F.greatest(x["first"], F.lit(0)).alias("first"), x["words"].alias("words"))),
    }).drop("__w", "__post", "__hit", "__found")

"""The whole pipeline on the smallest tables, each stage held against its own input."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import shingle_set
from tests.session import make_session
from tidewater.llm import hyper_language
from tidewater.llm.common import documents
from tidewater.sources.staging import write_stage

SF = "/root/testdata/sf0.001"


def test_stages():
    spark = make_session("4", 4)
    before = documents(spark, SF)
    columns = before.columns
    for name, stage in corpus_pipeline.STAGES:
        after = write_stage(stage(spark, before, SF), name)
        old, new = before.collect(), after.collect()
        if name == "language":
            assert {r.doc_id for r in new} == {r.doc_id for r in old if any(c.isalpha() for c in r.text or "")}
        elif name == "exact_dedup":
            last = {}
            for r in old:
                last[r.text] = max(last.get(r.text, -1), r.doc_id)
            assert sorted(r.doc_id for r in new) == sorted(last.values())
        elif name == "near_dedup":
            kept = [shingle_set(r.text) for r in new]
            assert not any(a & b and len(a & b) / len(a | b) >= 0.8 for i, a in enumerate(kept) for b in kept[:i])
            assert len(new) >= 0.8 * len(old)
        elif name == "mix":
            times = collections.Counter(r.doc_id for r in new)
            assert set(times) <= {r.doc_id for r in old} and max(times.values()) <= 3 and {r.source for r in new} == {r.source for r in old}
        else:
            assert sorted(r.doc_id for r in new) == sorted(r.doc_id for r in old) and all(r.n_tokens > 0 for r in new)
        if name != "encode":
            assert after.columns == columns
        before = after


def test_language_stage_without_known_languages():
    spark = make_session("4", 4)
    rows = [(1, "some words", None), (2, None, None), (3, "12 34 !!", None), (4, "é", None), (5, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.known_language(spark, d, SF)
    assert sorted(r.doc_id for r in got.collect()) == [1, 4] and got.columns == d.columns
    labelled = d.withColumn("lang", F.when(F.col("doc_id") == 3, "fr"))  # the only label is at a text without a letter
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, labelled, SF).collect()) == [1, 4]


def test_language_stage_rejects_by_cosine():
    spark = make_session("4", 4)
    en = "the cat sat on the mat and looked at the moon over the quiet town while rain fell on the old road"
    rows = [(i, en, "en", "a") for i in range(5)]
    rows += [(10, "QZX" * 200, None, "a"), (11, "привет мир как твои дела сегодня вечером", None, "a"), (12, "qzx", None, "a"), (13, "the moon over the town", None, "a"), (14, "a. 5", None, "a"), (None, en, None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")  # score clashes with an output
    got = corpus_pipeline.known_language(spark, d, SF)
    assert got.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in got.collect()) == sorted((x is None, x) for x in [*range(5), 12, 13, 14, None]) and {r.score for r in got.collect()} == {"a"}
    assert corpus_pipeline.known_language(spark, d.limit(0), SF).collect() == []


def test_copies_with_repeated_and_null_ids():
    spark = make_session("4", 4)
    words = [f"w{i}" for i in range(60)]
    base, near, clean, long = " ".join(words), " ".join(words[:-1] + ["other"]), "quite another clean text of more than five words", " ".join(f"v{i}" for i in range(120_000))
    rows = [(1, base, "x"), (1, base, "y"), (1, base, "y"), (5, near, "x"), (1, clean, "x"), (None, clean, "z"), (None, "a text without any id but six words", "x"), (7, None, "n"), (8, "", "n"), (9, long, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    once = corpus_pipeline.without_copies(spark, d, SF)
    key = lambda r: tuple(str(x)[:80] for x in r)
    want = [(1, base, "y"), (5, near, "x"), (1, clean, "x"), (None, "a text without any id but six words", "x"), (8, "", "n"), (9, long, "x")]
    assert once.columns == d.columns and sorted(map(key, once.collect())) == sorted(map(key, want))
    got = corpus_pipeline.without_near_copies(spark, once, SF)
    want.remove((1, base, "y"))  # a near copy of the text of id 5; the clean text of id 1 stays
    assert got.columns == d.columns and sorted(map(key, got.collect())) == sorted(map(key, want))
    assert corpus_pipeline.without_near_copies(spark, d.limit(0), SF).collect() == [] and corpus_pipeline.without_copies(spark, d.limit(0), SF).collect() == []
    tie = spark.createDataFrame([(3, base, "x"), (3, near, "x")], "doc_id long, text string, kept string")
    assert corpus_pipeline.without_near_copies(spark, tie, SF).count() == 1


def test_lone_letters_get_a_learned_language():
    spark = make_session("4", 4)
    d = spark.createDataFrame([(1, "the cat sat here", "en"), (2, "le chat est ici", "fr")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "A."), (2, "5. é!"), (3, "12."), (4, None), (5, "le chat")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in hyper_language.predict(asked, hyper_language.prototypes(d)).collect()}
    assert got[1] == got[2] == ("en", 0.0) and got[3] == got[4] == ("und", 0.0) and got[5][0] == "fr"

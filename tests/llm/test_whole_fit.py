"""Classifiers learn from every labelled training text, of any length, by parts that are added up or averaged."""

import random
import zlib

import numpy as np


def words(r, n):
    return " ".join("".join(r.choices("aeioubdfklmnprst", k=r.randint(2, 8))) for _ in range(n))


def training(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


def test_quality_is_fitted_on_all_rows(spark):
    """More rows of a class than the 4,000 that were taken once; one fit in numpy over all of them gives the same."""
    from roadweave.llm.quality import Discriminant, fit_quality, statistics

    r = random.Random(3)
    rows = [(k, words(r, r.randint(3, 12)) + (" ###" if r.random() < (0.8 if k % 6 == 0 else 0.2) else ""), int(k % 6 != 0)) for k in range(7000)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")
    got = fit_quality(docs, labels)
    own = [x for x in rows if training(x[0])]
    x, y = np.array([statistics(t) for _, t, _ in own]), np.array([v for *_, v in own])
    assert (y == 1).sum() > 4000
    want = Discriminant.fit(x, y, {k: int((y == k).sum()) for k in (0, 1)})
    assert np.allclose(got.centre, want.centre) and np.allclose(got.scale, want.scale)
    assert np.allclose(got.means, want.means) and np.allclose(got.inverse, want.inverse)
    assert np.allclose([got.slope, got.offset], [want.slope, want.offset], atol=1e-6)


def test_toxicity_learns_from_long_texts(spark):
    """Texts of over 50,000 characters were left out once, so that these alone gave no model."""
    from roadweave.llm.toxicity import fit_toxicity

    r = random.Random(4)
    docs = spark.createDataFrame([(k, words(r, 10_000) + " vile" * (k % 2)) for k in range(12)], "doc_id long, text string")
    assert docs.where("char_length(text) <= 50000").count() == 0
    assert fit_toxicity(docs, spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")).out.any()


def test_toxicity_by_parts(spark):
    """Networks of several parts are averaged to one that tells held-out texts apart, and a rerun gives the same numbers."""
    from roadweave.llm.toxicity import fit_toxicity, score_toxicity

    r = random.Random(5)
    rows = []
    for k in range(1500):
        t = words(r, r.randint(5, 40)).split()
        if k % 3 == 0:
            t.insert(r.randrange(len(t)), r.choice(["vile", "grub", "vilely"]))
        rows.append((k, " ".join(t), ("en", "fr", None)[k % 7 % 3]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1500)], "doc_id long, toxic int")
    net, again = (fit_toxicity(d, labels, part=400) for d in (docs, docs.repartition(5)))
    assert np.array_equal(net.table, again.table) and net.offset == again.offset and net.thresholds == again.thresholds
    assert set(net.thresholds) == {"en", "fr"}
    got = {x["doc_id"]: x["s"] for x in score_toxicity(docs, net, "s").collect()}
    assert np.mean([(got[k] >= 0.5) == (k % 3 == 0) for k in got if not training(k)]) >= 0.9


def test_thresholds_count_all_rows(spark):
    from roadweave.llm.toxicity import GRID, best_thresholds

    r = random.Random(6)
    rows = []
    for _ in range(3000):
        y = int(r.random() < 0.3)
        rows.append((r.choice(["en", "fr", None]), y, min(1.0, max(0.0, r.gauss(0.4 + 0.2 * y, 0.15)))))
    rows += [("xx", 1, 0.5)] * 3
    whole, by = best_thresholds(spark.createDataFrame(rows, "lang string, label int, score double"), 30)

    def f1(at, own):
        hit = sum(y for _, y, s in own if s >= at)
        return 2 * hit / (sum(s >= at for *_, s in own) + sum(y for _, y, _ in own))

    assert set(by) == {"en", "fr"}
    for at, own in ((whole, rows), *((by[k], [x for x in rows if x[0] == k]) for k in by)):
        assert f1(at, own) >= max(f1(k / GRID, own) for k in range(GRID + 1)) - 1e-12
    assert best_thresholds(spark.createDataFrame([("en", 1, 0.2)], "lang string, label int, score double"), 1) == (0.5, {})


def test_word_keys_hold_the_rows_of_each_word():
    """The keys made for many texts at once are those of the words one by one, for long words, marks, empty words and pieces of any size."""
    from roadweave.llm import toxicity

    r = random.Random(7)
    texts = [None, "", " \n ", "!!! ...", "Ka. (lo)! \x85x\x1cy", "\u00dcn\u00ef \u0130\u00df", "q" * 15 + " " + "z" * 14, "w" * (toxicity.PIECE + 9) + " tail"] + [words(r, 30_000), words(r, 50)]
    got = toxicity.word_keys(texts)
    assert len(got) == len(texts) and toxicity.word_keys([]) == []
    for text, keys in zip(texts, got):
        own = toxicity.words_of(text)
        assert [k == toxicity.NO_WORD for k in keys] == [not w for w in own]
        assert toxicity.rows_of(keys).tolist() == [toxicity.word_rows(w) for w in own]


def test_toxicity_scoring_time():
    """Scores of many texts with new words cost no more than fifteen times the splitting of the texts; it was over thirty times once, word by word and text by text."""
    import time

    from roadweave.llm.toxicity import TextNetwork, words_of

    r = random.Random(8)
    texts = [words(r, 300) for _ in range(1500)]
    scorer = TextNetwork.start(1).scorer()

    def seconds(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    plain, own = (min(seconds(f) for _ in range(3)) for f in (lambda: [words_of(t) for t in texts], lambda: scorer.score(texts)))
    assert own <= 15 * plain


def test_curve_sums_share_their_code(spark):
    """Each of Newton's steps had its numbers in code of its own, which every executor compiled and kept."""
    from roadweave.llm.common import small_table
    from roadweave.llm.quality import curve_sums, summed_curve

    r = random.Random(9)
    rows = [(k % 2, r.gauss(k % 2, 1.0)) for k in range(500)]
    raw = spark.createDataFrame(rows, "label int, raw double").repartition(3).localCheckpoint()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        codes = set()
        for a, b in ((0.1, -1.25), (0.6, 0.375)):
            got = summed_curve(raw, small_table(spark, [[a], [b]], "slope double, offset double"))
            y, x = np.array(rows).T
            assert np.allclose([float(v) for v in got.first()], curve_sums(a, b, x, y, np.ones(len(x))))
            mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
            shown = got._jdf.queryExecution().explainString(mode)
            codes.add("\n".join(line.split("*/", 1)[1] for line in shown.splitlines() if line.startswith("/* ") and "*/" in line))
        assert len(codes) == 1 and next(iter(codes))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)

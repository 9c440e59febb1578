"""Quality and language: exact identities, held-out accuracy, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from quire.llm import language, quality
from quire.llm.shared import table

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_identity():
    m = quality.Machine(0.3)
    m.w = np.random.default_rng(1).normal(size=quality.WIDTH)
    rows = [quality.features(t, n) for t, n in [("a b c a", 7), ("", None), ("x | y!! Z", 9)]]
    for (cols, vals), got in zip(rows, m.scores(rows)):
        raw = m.w0 + sum(m.w[c] * x for c, x in zip(cols, vals))
        raw += sum(vals[i] * vals[j] * (m.v[cols[i]] @ m.v[cols[j]]) for i in range(len(cols)) for j in range(i))
        assert np.isclose(got, 1 / (1 + np.exp(-raw)))


def test_quality_of_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality.scored(docs, quality.fitted(docs, labels)).join(labels, "doc_id").toPandas()
    own = got[got.held_out]
    assert len(own) > 50 and (own.predicted == own.quality).mean() > 0.93
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_quality_ignores_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fitted(docs, labels).w, quality.fitted(docs, flipped).w)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 0), (9, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.filter("quality = 1"), labels.limit(0)):
        m = quality.fitted(odd, own)
        rows = quality.scored(odd, m).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert quality.scored(empty, m).count() == 0
    assert quality.accepted(odd, m, 0.0).columns == odd.columns
    assert quality.scored(empty, quality.fitted(empty, labels)).count() == 0


def test_language_of_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    net = language.fitted(docs)
    got = language.predicted(docs, net).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    own = got[got.held_out]
    assert len(own) > 100 and (own.lang_pred == own.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_gradient():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(97, 110, (60, language.WINDOW)), rng.integers(108, 122, (60, language.WINDOW))]).astype(np.uint8)
    y = np.repeat([0, 1], 60)
    net = language.ByteNet(["a", "b"]).fit(x, y, epochs=4)
    assert (net.probabilities(x).argmax(axis=1) == y).mean() > 0.98


def test_language_odd_rows(odd, empty):
    net = language.fitted(odd)
    rows = {r.doc_id: r for r in language.predicted(odd, net).collect()}
    assert all(rows[d].lang_pred == "und" and rows[d].score == 0 for d in (2, 3, 4, 9))
    assert all(rows[d].lang_pred in ("de", "en", "fr") for d in (1, 5, 6, 8, 10))
    none = language.fitted(empty)
    assert {r.lang_pred for r in language.predicted(odd, none).collect()} == {"und"}
    assert language.predicted(empty, net).count() == 0


def test_numbers_are_no_letters(spark):
    from quire.llm import language

    docs = spark.createDataFrame([(k, "plain words here", "en") for k in range(20)] + [(k, "mots simples ici", "fr") for k in range(20, 40)] + [(90, "½ ²", "en"), (91, "① 12 _", None), (92, "½ a", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(docs, language.fitted(docs)).collect()}
    assert got[90] == got[91] == ("und", 0.0) and got[92][0] in ("en", "fr")


def test_fits_with_repeated_ids_are_the_same_each_time(spark):
    """One doc_id on several texts: the first of them counts, however the rows are dealt."""
    from quire.llm import language, quality

    rows = [(k // 3, f"{w} words number {k} {w}", lang) for k in range(120) for w, lang in [("plain", "en") if k % 2 else ("simples", "fr")]]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    nets, machines = [], []
    for n in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n)
        nets.append(sorted(map(tuple, language.predicted(docs, language.fitted(docs)).collect())))
        machines.append(sorted(map(tuple, quality.scored(docs, quality.fitted(docs, labels)).collect())))
    assert nets[0] == nets[1] and machines[0] == machines[1]


def test_pooled_filters_are_a_plain_convolution():
    """The tables of bytes against sums written out for each place of a window."""
    import numpy as np

    from quire.llm import language as L

    net = L.ByteNet(["a", "b"])
    rng = np.random.default_rng(1)
    net.tables = [rng.normal(size=t.shape).astype(np.float32) for t in net.tables]
    net.out, net.bias = rng.normal(size=net.out.shape).astype(np.float32), rng.normal(size=net.bias.shape).astype(np.float32)
    x = rng.integers(0, 256, (3, L.WINDOW), dtype=np.uint8)
    got = net.probabilities(x)
    for row, p in zip(x, got):
        tops = []
        for w, table in zip(L.WIDTHS, net.tables):
            tops += [max(sum(float(table[j][row[i + j], f]) for j in range(w)) for i in range(L.WINDOW - w + 1)) for f in range(L.FILTERS)]
        z = np.maximum(tops, 0) @ net.out + net.bias
        z = np.exp(z - z.max())
        assert np.allclose(p, z / z.sum(), atol=1e-4)

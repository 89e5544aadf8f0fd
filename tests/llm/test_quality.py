import zlib

import numpy as np

from quadrille.llm import quality
from quadrille.llm.queries import op7_quality
from tests.llm import cases


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"))
    return (rank[y == 1].mean() - (y == 1).sum() / 2 + 0.5) / max((y == 0).sum(), 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op7_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    known = [(rows[x.doc_id].score, x.quality) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if x.doc_id in rows and rows[x.doc_id].held_out]
    score, y = np.array(known).T
    assert auc(score, y) > 0.9
    assert ((score >= 0.3) == y).mean() > 0.9


def test_compiled_column_equals_the_model(spark):
    rng = np.random.default_rng(2)
    x = rng.random((500, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] < 0.7)).astype(float)
    model = quality.fit(x, y)
    assert 0 < len(model.rules) < 200
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *quality.STATISTICS])
    got = [r.s for r in frame.select("i", model.column().alias("s")).orderBy("i").collect()]
    assert np.allclose(got, quality.predict(model, x))
    assert ((np.array(got) > 0.5) == (y > 0)).mean() > 0.95


def test_awkward_rows(spark):
    docs = cases.frame(spark)
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None, 0) for i in range(60)] + [(3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.scored(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in out)


def test_no_labels_and_empty_tables(spark):
    docs = cases.frame(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.scored(docs, labels).collect()} == {1}
    assert quality.scored(docs.limit(0), labels).count() == 0


def plain(text):
    """The statistics of a text by their definitions, one character at a time."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality.STATISTICS)
    words, lines, n = raw.split(), raw.split(b"\n"), len(raw)
    m = max(len(words), 1)
    count = lambda test: sum(map(test, raw)) / n
    among = lambda chars: count(lambda c: c in chars.encode())
    pairs = list(zip(words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(words)), n / m, count(lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128), count(lambda c: 65 <= c <= 90), among("0123456789"), among(" "), among("\n"),
        among("#$%&*+/<=>@[\\]^_`{|}~"), among("|"), among("."), among(","), among("!?"), count(lambda c: c >= 128), len(set(words)) / m, sum(a == b for a, b in pairs) / m, len(set(lines)) / len(lines),
        sum(w.isupper() for w in words) / m, sum(not w.isalpha() for w in words) / m, sum(len(w) > 20 for w in words) / m, max((words.count(w) for w in set(words)), default=0) / m, len(set(pairs)) / max(len(words) - 1, 1),
    ]


def test_scores_equal_plain_python(spark):
    docs = cases.frame(spark).where("length(text) < 5000 OR text IS NULL")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    stats = quality.measured(docs)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in stats.where("doc_id IS NOT NULL").collect():
        assert np.allclose(r[1:], plain(texts[r.doc_id]))
    model = quality.train(stats, quality.chosen(stats, labels))
    taught = sorted({(i, i % 2) for i in texts if i < 60 and zlib.crc32(str(i).encode()) % 5})
    again = quality.fit(np.array([plain(texts[i]) for i, _ in taught]), np.array([float(y) for _, y in taught]))
    assert len(model.rules) == len(again.rules)
    for r in quality.scored(docs, labels).where("doc_id IS NOT NULL").collect():
        x = plain(texts[r.doc_id])
        z = model.intercept + sum(w * all((x[k] <= at) == side for k, side, at in rule) for rule, w in model.rules) + sum(w * min(max(x[k], low), high) for k, low, high, w in model.linear)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9

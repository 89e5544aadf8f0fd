import re

import corpus_pipeline
from quadrille.llm import pii, quality
from quadrille.llm.common import table
from tests.llm import cases
from tests.llm.test_decontaminate import brute as brute_windows
from tests.llm.test_nearcopies import brute as brute_groups
from tests.llm.test_packing import check as check_packing
from tests.llm.test_pii import RULES


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality", "simhash", "decontaminate", "pii", "packing"]

    good = stages["quality"](spark, docs, sf_dir)
    predicted = {r.doc_id: r.predicted for r in quality.scored(docs, table(spark, sf_dir, "labels")).collect()}
    assert good.schema == docs.schema
    good_rows = sorted(good.collect())
    assert good_rows == sorted(r for r in docs.collect() if predicted[r.doc_id])
    good = spark.createDataFrame(good_rows, docs.schema)

    first = sorted(stages["simhash"](spark, good, sf_dir).collect())
    assert first == [good_rows[k] for k in brute_groups([(r.doc_id, r.text) for r in good_rows])]
    first_docs = spark.createDataFrame(first, docs.schema)

    clean = sorted(stages["decontaminate"](spark, first_docs, sf_dir).collect())
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    dirty = {x[0] for x in brute_windows([(r.doc_id, r.text) for r in first], items) if x[-1]}
    assert dirty and clean == [r for r in first if repr(r.doc_id) not in dirty]
    clean_docs = spark.createDataFrame(clean, docs.schema)

    safe = sorted(stages["pii"](spark, clean_docs, sf_dir).collect())
    for before, after in zip(clean, safe):
        assert before[:1] + before[2:] == after[:1] + after[2:]
        assert not any(ok(m[0]) for _, p, ok in RULES for m in re.finditer(p, after.text))
        assert (before.text == after.text) == (not pii.spans_of(before.text))

    pieces = stages["packing"](spark, spark.createDataFrame(safe, docs.schema), sf_dir).collect()
    check_packing(pieces, [(r.doc_id, r.text) for r in safe])

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(whole) == key(pieces)


def test_awkward_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns; then no rows at all."""
    docs = cases.frame(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(50)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "gnu general public license apache license"), (None, "x"), (2, None)], "item_id long, text string")
    for name, rows in (("full", docs), ("empty", docs.limit(0))):
        sf = str(tmp_path / name)
        for table_name, frame in (("documents", rows), ("labels", labels), ("benchmark", benchmark)):
            frame.write.parquet(f"{sf}/{table_name}.parquet")
        now = table(spark, sf, "documents")
        for stage, apply in corpus_pipeline.STAGES[:-1]:
            now = apply(spark, now, sf)
            assert now.columns == docs.columns, stage
            now = spark.createDataFrame(now.collect(), docs.schema)
        last = [(r.doc_id, r.text) for r in now.collect()]
        pieces = corpus_pipeline.run(spark, sf).collect()
        assert bool(pieces) == (name == "full")
        assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
        assert sorted({r.doc_id for r in pieces}, key=repr) == sorted({i for i, _ in last}, key=repr)
        assert sum(r.start == 0 for r in pieces) == len(last)


def test_executors_collect_their_garbage_before_each_stage(spark, monkeypatch):
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    before = beans()
    corpus_pipeline.shrink_executors(spark)
    assert beans() > before
    called = []
    monkeypatch.setattr(corpus_pipeline, "shrink_executors", called.append)
    docs = cases.frame(spark)
    for k, (_, stage) in enumerate([s for s in corpus_pipeline.STAGES if s[0] in ("pii", "packing")], 1):
        stage(spark, docs, "")
        assert len(called) == k

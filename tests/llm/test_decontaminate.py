import hashlib
import re

from quadrille.llm import decontaminate
from quadrille.llm.queries import op8_decontaminate
from tests.llm import cases


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            if i is not None:
                grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    widths = sorted({len(g) for g in grams})
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n in widths:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    hit |= {*range(k, k + n)}
                    names |= found
        out.append((repr(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def got(frame):
    return sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect())


def items(spark):
    return [(0, "the same text"), (1, "License apache license"), (2, None), (3, ""), (None, "beta gamma"), (4, "42 dé " * 9), (1, "naïve"), (5, " ".join(words(cases.rows()[20][1]))), (6, "a")]


def test_query_equals_brute_force(spark, sf_dir):
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(cases.documents(spark, sf_dir), bench)
    assert any(x[-1] for x in want)
    assert got(op8_decontaminate(spark, sf_dir)) == want


def test_awkward_rows(spark):
    bench = spark.createDataFrame(items(spark), "item_id long, text string")
    assert got(decontaminate.contamination_report(cases.frame(spark), bench)) == brute([r[:2] for r in cases.rows()], items(spark))


def test_blocks_of_a_large_benchmark_are_merged(spark):
    docs = cases.frame(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    bench = spark.createDataFrame(items(spark), "item_id long, text string")
    assert got(decontaminate.contamination_report(docs, bench, block_bytes=60)) == got(decontaminate.contamination_report(docs, bench))


def test_blocks_keep_repeated_and_null_ids_apart(spark):
    docs = cases.frame(spark)
    bench = spark.createDataFrame(items(spark), "item_id long, text string")
    assert got(decontaminate.contamination_report(docs, bench, block_bytes=60)) == brute([r[:2] for r in cases.rows()], items(spark))


def test_empty_tables(spark):
    bench = spark.createDataFrame(items(spark), "item_id long, text string")
    docs = cases.frame(spark)
    assert decontaminate.contamination_report(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination_report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Keep this. The Same, TEXT and that.", 0), (2, "clean", 0)], "doc_id long, text string, hits long")
    bench = spark.createDataFrame([(0, "the same text")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.remove_contamination(docs, bench).collect()] == [2]
    assert [r.text for r in decontaminate.remove_contamination(docs, bench, "spans").orderBy("doc_id").collect()] == ["Keep this.  and that.", "clean"]


def test_spans_of_several_blocks_are_cut_from_the_original_text(spark):
    words = [f"w{k}" for k in range(30)]
    bench = spark.createDataFrame([(k, " ".join(words[k : k + 10])) for k in range(5, 12)] + [(99, "left right")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words), 0), (1, " ".join(words), 0), (None, "left " + " ".join(words[5:15]) + " right", 1), (2, None, 2)], "doc_id long, text string, hits long")
    want = sorted(map(repr, decontaminate.remove_contamination(docs, bench, "spans").collect()))
    assert any("left" in x and "right" in x for x in want)
    got = decontaminate.remove_contamination(docs, bench, "spans", block_bytes=60)
    assert got.schema == docs.schema and sorted(map(repr, got.collect())) == want


def test_a_task_holds_little_beside_its_batch():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000), pa.int64()), pa.array(["some words of a text " * 200] * 1_000)], names=["row_no", "t"])
    scan = decontaminate._scanner(SimpleNamespace(value=decontaminate.GramSet([("a", "other words")], 10)))
    list(scan([batch.slice(0, 1)]))
    tracemalloc.start()
    found = pa.Table.from_batches(scan([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["n_words"].to_pylist() == [1_000] * 1_000 and peak < 45_000_000

import zlib

import numpy as np
import pyarrow as pa

from quadrille.llm import bytetext, language
from quadrille.llm.queries import op9_language
from tests.llm import cases


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_language(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [(r.lang_pred == docs[r.doc_id].lang) for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean(held) > 0.93
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, docs[r.doc_id].text or ""))) for r in rows)


def test_trigrams_do_not_cross_rows():
    texts = ["Ab, c", "", "x", "ab c", "  yy  zz ", "…"]
    data, offs = bytetext.utf8(pa.array(texts))
    row, bucket = language.trigrams(data, offs)
    for k, t in enumerate(texts):
        alone = language.trigrams(*bytetext.utf8(pa.array([t])))[1]
        assert sorted(bucket[row == k]) == sorted(alone)
    assert sorted(bucket[row == 0]) == sorted(bucket[row == 3]) and len(bucket[row == 2]) == 1


def test_mixtures_get_their_proportions():
    rng = np.random.default_rng(5)
    names, vocab = ["aa", "bb", "cc"], {"aa": ["kato", "kela", "kiru"], "bb": ["zomp", "zulg", "zeft"], "cc": ["wiss", "wonn", "werr"]}
    texts = {x: " ".join(rng.choice(vocab[x], 3000)) for x in names}
    counts = np.zeros((3, language.BUCKETS))
    for k, x in enumerate(names):
        counts[k] = np.bincount(language.trigrams(*bytetext.utf8(pa.array([texts[x]])))[1], minlength=language.BUCKETS)
    model = language.Model(names, counts)
    mixed = " ".join([*rng.choice(vocab["aa"], 70), *rng.choice(vocab["bb"], 30)])
    share = language.infer(model, *bytetext.utf8(pa.array([mixed, texts["cc"][:500]])))
    assert abs(share[0, 0] - 0.7) < 0.05 and share[0, 2] == 0 and share[1].tolist() == [0, 0, 1]


def test_awkward_rows_and_empty_tables(spark):
    docs = cases.frame(spark)
    rows = language.identified(docs).collect()
    assert len(rows) == docs.count()
    text = {r[0]: r[1] for r in cases.rows()}
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id is not None and not any(map(str.isalpha, text[r.doc_id] or "")))
    assert language.identified(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identified(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import mixing
from quadrille.llm.queries import op3_mixing
from tests.llm import cases


def tokens_of(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(docs):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    tokens = [(i, [*tokens_of(t), None], held(i)) for i, t in docs]
    counts = Counter(x for _, w, out in tokens if not out for x in w)
    n, v = sum(counts.values()), len(counts)
    return [(i, out, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, w, out in tokens]


def check(rows, docs):
    key = lambda r: (repr(r[0]), *r[1:5], round(r[5], 6))
    assert sorted(key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in rows) == sorted(map(key, brute(docs)))
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)


def test_query_equals_brute_force_and_beats_the_base(spark):
    """The base isn't a distribution: all unknown words get the share of one. In total the score is above it all the same.

    By document it is compared with the base that spells an unknown word by even bytes.
    """
    sf = "/root/testdata/sf0.01"
    docs = cases.documents(spark, sf)
    rows = op3_mixing(spark, sf).collect()
    check(rows, docs)
    known = {x for i, t in docs if not held(i) for x in tokens_of(t)}
    unknown = {i: sum(len(x) + 1 for x in tokens_of(t) if x not in known) for i, t in docs}
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert sum(r.score > r.base_score - unknown[r.doc_id] * math.log10(257) for r in out) > 0.95 * len(out)


def test_the_mixer_alone_beats_a_base_that_is_a_distribution(spark, sf_dir):
    docs = cases.documents(spark, sf_dir)
    out = [r for r in mixing.scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), past=0.0).collect() if r.held_out]
    known = {x for i, t in docs if not held(i) for x in tokens_of(t)}
    lost = sum((len(x) + 1) * math.log10(257) for i, t in docs if held(i) for x in tokens_of(t) if x not in known)
    assert sum(r.score for r in out) > sum(r.base_score for r in out) - lost


def plain_score(text, logs, leads):
    """The score of a text by the definition, token by token."""
    tokens, seen, counts, again, total = tokens_of(text), Counter(), Counter(), 0, 0.0
    lead, look = 0, mixing.FIRST_LOOK
    for i, t in enumerate(tokens):
        if i == look:
            lead, look = min(((-n, k) for k, n in seen.items()), default=(0, 0))[1], 2 * look
        weight = mixing.REPEATS * again / (i + 2)
        total += math.log10((1 - weight) * 10 ** logs[t + b" ", lead] + weight * counts[t] / max(i, 1))
        again += counts[t] > 0
        counts[t] += 1
        if t in leads:
            seen[leads[t]] += 1
    return total + logs[b"\xff", 0] + math.log10(1 - mixing.REPEATS * again / (len(tokens) + 2))


def test_awkward_rows_and_settings(spark):
    docs, texts = cases.frame(spark), [r[:2] for r in cases.rows()]
    table, leads, _, _ = mixing.modelled(docs)
    logs = {(bytes(r.key), r.lead): r.log for r in table.collect()}
    want = sorted((repr(i), round(plain_score(t, logs, leads), 6)) for i, t in texts)
    for settings, frame in (({}, docs), ({"frequent": 0}, docs), ({"frequent": 3, "ranges": 1}, docs.coalesce(1)), ({"ranges": 9}, docs.repartition(7))):
        rows = mixing.scored(frame, **settings).collect()
        check(rows, texts)
        assert sorted((repr(r.doc_id), round(r.score, 6)) for r in rows) == want, settings


def test_no_rows_and_no_training_texts(spark):
    docs = cases.frame(spark)
    assert mixing.scored(docs.limit(0)).count() == 0
    out = spark.createDataFrame([(k, "x") for k in range(100) if held(k)], "doc_id long, text string")
    assert {round(r.score, 6) for r in mixing.scored(out).collect()} == {round(-24 * math.log10(2), 6)}


@pytest.mark.parametrize("ranges", [1, 4, 13])
def test_counts_of_beginnings_are_exact(spark, ranges):
    words = [b"a", b"ab", b"abc", b"abd", b"b", b"ba\x01", b"ba!", "é".encode(), "éa".encode(), b"x" * 50, b"x" * 49 + b"y", *(b"w%d" % k for k in range(40))]
    counted = spark.createDataFrame([(bytearray(w + b" "), k % 3, k % 5, k % 5 + 1) for k, w in enumerate(words)] + [(bytearray(b"\xff"), 0, 7, 9), (bytearray(b"a "), 2, 4, 4)], mixing.COUNTED)
    total = Counter()
    for r in counted.collect():
        total[bytes(r.key)] += r.n
    as_bits = {k: "".join(f"{b:08b}" for b in k[: mixing.PREFIX]) for k in total}
    rows = mixing.with_paths(counted, ranges).collect()
    assert len(rows) == counted.count()
    for r in rows:
        mine = as_bits[bytes(r.key)]
        assert r.total == total[bytes(r.key)]
        want = [sum(n for k, n in total.items() if as_bits[k].startswith(mine[:d])) for d in range(1, len(mine) + 1)]
        assert list(r.path) == want[: len(r.path)] and set(want[len(r.path) :]) <= {r.total}


def test_probabilities_of_a_byte_sum_to_one():
    rng = np.random.default_rng(1)
    model = mixing.Model([rng.integers(0, 90_000, 2 << w) * (rng.random(2 << w) < 0.3) for w in mixing.sizes(1000)], 100_000)
    model.weights = rng.normal(size=model.weights.shape).astype(np.float32)
    model.map = rng.random(256 * mixing.BINS).astype(np.float32)
    keys = [bytes([b]) for b in range(256)]
    for _ in range(3):
        n = rng.integers(0, 50, 256)
        model.total = int(n.sum())
        path, offsets = mixing._paths(keys, n, mixing._NONE, mixing._NONE)
        assert abs((10 ** model.log10(keys, np.full(256, 3), n, path, offsets)).sum() - 1) < 1e-4


def test_a_long_token_keeps_all_its_bits(spark):
    """Its probability is below the least double, its logarithm isn't; the past has a weight from the third on."""
    rng = np.random.default_rng(2)
    long = bytes(rng.integers(97, 123, 2000, dtype=np.uint8)).decode()
    out = next(k for k in range(100) if held(k))
    docs = spark.createDataFrame([*((out, " ".join([long] * k)) for k in (1, 2, 3)), *((k, "some plain words") for k in range(100, 140))], "doc_id long, text string")
    for frequent in (0, mixing.FREQUENT):
        once, twice, thrice = sorted((r.score, r.n_tokens) for r in mixing.scored(docs, frequent=frequent).collect() if r.doc_id == out)[::-1]
        assert [n for _, n in (once, twice, thrice)] == [2, 3, 4]
        assert math.isfinite(thrice[0]) and once[0] < -2000 and twice[0] - once[0] < -2000 and -10 < thrice[0] - twice[0] < 0


def test_weights_and_map_are_learned_from_all_tokens(spark, monkeypatch):
    """Each shard's part of the weights is its number of tokens here, and the map counts them."""
    n = 250_000
    tokens = spark.range(n).selectExpr("cast(cast(id as string) as binary) as key", "0 as lead", "1L as total", "1L as n", "1L as m", "array(1L) as path")
    gates, width, cells = mixing.GATES, mixing.PREDICTORS + 1, 256 * mixing.BINS

    def learn(model):
        return lambda t: pa.table({"shard": t["shard"][:1], "weights": pa.array([np.full((gates, width), float(len(t))).tobytes()], pa.binary()), "n": pa.array([1], pa.int64())})

    def count(model):
        def run(batches):
            seen = np.zeros((2, cells))
            seen[1] = sum(map(len, batches))
            yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], names=["seen"])

        return run

    monkeypatch.setattr(mixing, "_learn_weights", learn)
    monkeypatch.setattr(mixing, "_count_map", count)
    monkeypatch.setattr(mixing, "_count_bits", lambda widths: lambda batches: iter(()))
    model = mixing.train(tokens, n, n)
    shards = -(-n // mixing.SHARD_TOKENS)
    assert np.allclose(model.weights, n / shards)
    assert math.isclose(model.map[mixing.BINS // 2], 10 / (n + 20), rel_tol=1e-4)

import numpy as np

from quadrille.llm import vectors
from quadrille.llm.queries import op10_embeddings


def brute(rows, cosine=0.98):
    """rows: (vec_id, vector, label)."""
    use, n = [], len(rows)
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v, float) != 0):
            use.append(k)
    up, links = list(range(n)), [0] * n

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    groups = {}
    for k in use:
        groups.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for ks in groups.values():
        x = np.array([rows[k][1] for k in ks], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(x @ x.T >= cosine)):
            if i != j:
                links[ks[i]] += 1
                up[find(ks[i])] = find(ks[j])
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            r = find(k)
            least[r] = min(rows[k][0], least.get(r, rows[k][0]))
    return sorted((repr(rows[k][0]), links[k], repr(least.get(find(k))), rows[k][0] == least.get(find(k))) for k in range(n))


def got(frame):
    return sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in frame.collect())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows)
    assert got(op10_embeddings(spark, sf_dir)) == want


def awkward():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + 0.12 * rng.normal(size=8)).tolist(), i % 2) for i in range(160)]
    rows += [(1000 + i, base[0].tolist(), 0) for i in range(30)]  # many copies
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 8, 0), (2003, [1.0, None] * 4, 0), (2004, [float("nan")] * 8, 1), (2005, [float("inf")] + [1.0] * 7, 1), (2006, base[1].tolist(), None), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (2009, (base[2] * 1e200).tolist(), 0), (2010, (base[2] * 1e-200).tolist(), 0)]
    return rows


def test_awkward_rows(spark):
    frame = spark.createDataFrame([(*r, 1, 2) for r in awkward()], "vec_id long, embedding array<double>, label int, uid long, links long")
    assert got(vectors.near_duplicates(frame)) == brute(awkward())
    assert got(vectors.near_duplicates(frame, block=16, lists=5)) == brute(awkward())


def test_clusters_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 32))
    rows = [(i, (base[i % 300 if i % 2 else 7] + 0.1 * rng.normal(size=32)).astype(np.float32).tolist(), i % 3) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows)
    assert sum(x[1] for x in want) > 10_000
    for lists in (8, 40):
        assert got(vectors.near_duplicates(frame, lists=lists, block=64)) == want


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert vectors.near_duplicates(frame).count() == 0
    lone = spark.createDataFrame([(1, None, 1), (None, None, None)], frame.schema)
    assert vectors.near_duplicates(lone).count() == 2

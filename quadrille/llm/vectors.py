"""Embedding near-duplicates by product quantisation.

Method: vectors are scaled to length one and reduced to distinct ones of a label, so equal
copies cost one row. Coarse centroids (k-means on at most ``SAMPLE`` vectors) give inverted
lists; every vector is filed in the list of its nearest centroid, as codes of its residual
in ``PARTS`` subspaces and the exact length of what the codes leave out. It asks in its own
list and probes others: partners x and y within distance r lie on either side of the plane
between their two centroids, so one of them is within r/2 of it. Each vector probes the
lists whose plane is that near; the pair is then found from one side at least, and counted
from the side that is nearer (the smaller number, if equal). In a list, table lookups give
the distance to each coded vector; it errs by the length left out at most, so pairs beyond
r plus that are dropped and no true pair is. What remains is compared by its exact cosine
in double precision.

The sufficient probes and the error bound make the join whole: no link is lost, at any
size. A list (of one label) is dealt to cells of at most about ``BLOCK`` filed and
``BLOCK`` asking vectors, each cell a task's group, so a hot list is split. A cell counts
its vectors' links and returns a spanning forest of them, never all pairs.

Defined results: a vector that is null, empty, zero or has null or non-finite components,
or whose label is null, links with nothing and is its own class; vectors of different
length don't link; equal vectors of one label link (with a component_id that is the least
id); rows with a null id count as links of others but never name a class; an empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import settle
from quadrille.llm.components import components

COSINE = 0.98
SAMPLE = 10_000
PARTS = 8
CODES = 64
BLOCK = 256
_SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centre))
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], centre).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Quantiser:
    """Coarse centroids and, for each subspace, the centroids of residual parts."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES):
        self.coarse = kmeans(sample, min(lists, len(sample)))
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        self.fine = [kmeans(rest[:, c], min(codes, len(rest))) for c in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the length that the codes leave out."""
        near = nearest(x, self.coarse)
        rest = x - self.coarse[near]
        codes = np.stack([nearest(rest[:, c], f) for c, f in zip(self.cuts, self.fine)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), int)
        left = np.sqrt(sum(((rest[:, c] - f[codes[:, k]]) ** 2).sum(axis=1) for k, (c, f) in enumerate(zip(self.cuts, self.fine))))
        return near, codes.astype(np.uint8), left

    def beyond(self, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How far each vector is from the plane between its centroid and another, row by row."""
        c, d = self.coarse[own], self.coarse[other]
        far = ((x - d) ** 2).sum(axis=1) - ((x - c) ** 2).sum(axis=1)
        return far / np.maximum(2 * np.sqrt(((c - d) ** 2).sum(axis=1)), 1e-300)

    def probes(self, x: np.ndarray, near: np.ndarray, radius: float) -> np.ndarray:
        """For each vector, the other lists whose plane is within half the radius."""
        far = squared(x, self.coarse)
        apart = np.sqrt(squared(self.coarse, self.coarse))[near]
        found = far - far[np.arange(len(x)), near][:, None] <= 2 * (radius / 2 + _SLACK) * apart + _SLACK
        found[np.arange(len(x)), near] = False
        return found

    def table(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """Squared distances from residuals of ``x`` in list ``at`` to all codes, by subspace."""
        rest = x - self.coarse[at]
        return [squared(rest[:, c], f) for c, f in zip(self.cuts, self.fine)]


def _matrix(blobs, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind).reshape(-1, dim).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(kind: str):
    """Vectors as bytes; null if they can't link."""

    def run(batches):
        for batch in batches:
            column, labels = batch.column(2), batch.column(1)
            starts = column.offsets.to_numpy(zero_copy_only=False)
            flat = column.values.to_numpy(zero_copy_only=False).astype(kind)  # a null is nan
            good = np.isfinite(flat)
            blobs = []
            for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                part = flat[a:b]
                usable = column[k].is_valid and labels[k].is_valid and b > a and bool(good[a:b].all()) and bool(part.any())
                blobs.append(part.tobytes() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), labels, pa.array(blobs, pa.binary())], names=["vec_id", "label", "blob"])

    return run


FILED = "uid long, label string, blob binary, copies long, own int, list int, codes binary, left_out double"


def _file(quantisers, radius: float, kind: str):
    """Each distinct vector once in its own list, with codes, and once in each list that it probes, without."""
    width = np.dtype(kind).itemsize

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                frame = batch.slice(at, 1024).to_pandas()
                for dim, group in frame.groupby(frame["blob"].map(len) // width):
                    q: Quantiser = quantisers.value[int(dim)]
                    x = _unit(_matrix(group["blob"], int(dim), kind))
                    near, codes, left = q.encode(x)
                    filed = group.assign(own=near, list=near, codes=[c.tobytes() for c in codes], left_out=left)
                    row, other = np.nonzero(q.probes(x, near, radius))
                    probing = group.iloc[row].assign(own=near[row], list=other, codes=None, left_out=0.0)
                    out = pd.concat([filed, probing]) if len(row) else filed
                    yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(("uid", "label", "blob", "copies", "own", "list", "codes", "left_out"), (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.float64()))], names=["uid", "label", "blob", "copies", "own", "list", "codes", "left_out"])

    return run


LINKED = "uid long, other long, links long"


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in doubles; where squares leave a double's range, of the scaled rows."""
    with np.errstate(all="ignore"):
        dot = np.einsum("ij,ij->i", x, y)
        long = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
        exact = dot / long
    unsure = ~np.isfinite(long) | ~np.isfinite(dot) | (long < 1e-280)
    if unsure.any():
        exact[unsure] = np.einsum("ij,ij->i", _unit(x[unsure]), _unit(y[unsure]))
    return exact


def _compare(quantisers, cosine: float, radius: float, kind: str):
    """Links of one cell: counts for each vector, and a spanning forest."""
    width = np.dtype(kind).itemsize

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        counts: dict[int, int] = {}
        up: dict[int, int] = {}

        def root(a: int) -> int:
            while up.setdefault(a, a) != a:
                up[a] = up[up[a]]
                a = up[a]
            return a

        for dim, group in cell.groupby(cell["blob"].map(len) // width):
            filed, asking = group[group["filed"]], group[group["asking"]]
            if not len(filed) or not len(asking):
                continue
            q: Quantiser = quantisers.value[int(dim)]
            here = int(filed["list"].iloc[0])
            codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in filed["codes"]])
            left, y_id, y_copies = (filed[c].to_numpy() for c in ("left_out", "uid", "copies"))
            x_id, x_own, x_copies = (asking[c].to_numpy() for c in ("uid", "own", "copies"))
            y, x = _matrix(filed["blob"], int(dim), kind), _matrix(asking["blob"], int(dim), kind)
            y_unit, x_unit = _unit(y), _unit(x)
            for i in range(0, len(x), 64):
                near = sum(t[:, codes[:, k]] for k, t in enumerate(q.table(x_unit[i : i + 64], here)))
                row, at = np.nonzero(np.sqrt(np.maximum(near, 0)) <= radius + left + _SLACK)
                row += i
                mine = (x_own[row] != here) | (x_id[row] < y_id[at])  # in one list, from the smaller number
                row, at = row[mine], at[mine]
                linked = cosines(x[row], y[at]) >= cosine
                row, at = row[linked], at[linked]
                across = np.flatnonzero(x_own[row] != here)
                if len(across):
                    own, there = x_own[row[across]], np.full(len(across), here)
                    mine, yours = q.beyond(x_unit[row[across]], own, there), q.beyond(y_unit[at[across]], there, own)
                    asked_too = yours <= radius / 2 + _SLACK / 2  # then the other side finds the pair for sure
                    drop = asked_too & ((yours < mine) | ((yours == mine) & (y_id[at[across]] < x_id[row[across]])))
                    keep = np.ones(len(row), dtype=bool)
                    keep[across[drop]] = False
                    row, at = row[keep], at[keep]
                for a, b, m, n in zip(x_id[row].tolist(), y_id[at].tolist(), x_copies[row].tolist(), y_copies[at].tolist()):
                    counts[a] = counts.get(a, 0) + n
                    counts[b] = counts.get(b, 0) + m
                    if (a := root(a)) != (b := root(b)):
                        up[max(a, b)] = min(a, b)
        found = [(a, root(a), n) for a, n in counts.items()]
        return pd.DataFrame(found, columns=["uid", "other", "links"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK, lists: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    spark = vectors.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    kind = "float32" if dict(vectors.dtypes)[vector] == "array<float>" else "float64"
    wide = "array<float>" if kind == "float32" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast(wide).alias("vector"))
    packed = rows.mapInArrow(_pack(kind), "vec_id long, label string, blob binary")
    key = F.when(F.col("blob").isNotNull(), F.sha2(F.concat(F.encode("label", "utf-8"), F.lit(b":"), F.col("blob")), 256))
    keyed = settle(packed.select("vec_id", key.alias("copy"), "label", "blob"), "vectors-keyed")
    alone = keyed.where("copy IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))

    firsts = keyed.where("copy IS NOT NULL").groupBy("copy", "label", "blob").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    distinct = settle(firsts.withColumn("uid", F.monotonically_increasing_id()), "vectors-distinct")

    # A bounded sample of each dimension fits the quantisers.
    dim = (F.length("blob") / np.dtype(kind).itemsize).cast("int")
    sizes = {r.dim: r.n for r in distinct.groupBy(dim.alias("dim")).agg(F.count(F.lit(1)).alias("n")).limit(64).collect()}
    if len(sizes) == 64:
        raise ValueError("vectors of 64 different lengths or more")
    fitted = {}
    for d, n in sizes.items():
        part = distinct.where(dim == d).orderBy(F.xxhash64("copy"), "copy").limit(sample).select("blob").collect()
        fitted[d] = Quantiser(_unit(_matrix([r.blob for r in part], d, kind)), lists or int(min(1024, max(16, np.sqrt(n) / 4))))
    quantisers = spark.sparkContext.broadcast(fitted)

    filed = distinct.select("uid", "label", "blob", "copies").mapInArrow(_file(quantisers, radius, kind), FILED)
    size = settle(filed.groupBy("label", "list").agg(F.ceil(F.count("codes") / block).alias("filed_cells"), F.ceil(F.count(F.lit(1)) / block).alias("asking_cells")).where("filed_cells > 0"), "vectors-lists")
    dealt = filed.join(size, ["label", "list"])
    dealt = dealt.withColumn("i", F.when(F.col("codes").isNotNull(), F.pmod(F.xxhash64("uid"), "filed_cells"))).withColumn("j", F.pmod(F.xxhash64("uid", F.lit(1)), "asking_cells"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asks = F.transform(upto("filed_cells"), lambda i: F.struct(i.alias("i"), F.col("j").alias("j"), F.coalesce(i == F.col("i"), F.lit(False)).alias("filed"), F.lit(True).alias("asking")))
    files = F.transform(F.filter(upto("asking_cells"), lambda j: F.col("codes").isNotNull() & (j != F.col("j"))), lambda j: F.struct(F.col("i").alias("i"), j.alias("j"), F.lit(True).alias("filed"), F.lit(False).alias("asking")))
    cells = dealt.withColumn("cell", F.explode(F.concat(asks, files))).select("uid", "blob", "copies", "own", "list", "codes", "left_out", "label", "cell.i", "cell.j", "cell.filed", "cell.asking")
    linked = settle(cells.groupBy("label", "list", "i", "j").applyInPandas(_compare(quantisers, cosine, radius, kind), LINKED), "vectors-linked")

    counts = linked.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(linked.where("uid <> other").select(F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b")).distinct(), "vectors-components")
    named = distinct.select("copy", "uid", "first_id", "copies").join(counts, "uid", "left").join(roots, F.col("uid") == F.col("node"), "left")
    named = named.select("copy", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "uid").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = settle(named.join(least, "root").select("copy", "n_links", "component_id"), "vectors-classes")
    together = keyed.where("copy IS NOT NULL").select("vec_id", "copy").join(classes, "copy").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return together.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

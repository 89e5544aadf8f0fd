"""Near copies by exact shingle similarity: the near-duplicate stage of the pipeline.

Two texts are linked if the Jaccard similarity of their sets of word 5-shingles (as XXH64
values) is 0.8 or more; groups are the connected components of links, and one row of each
group stays. The setting is the stage's own; ``simhash`` has that of op2.

Method: prefix filter. Under one global order of all shingles, two linked sets share one
of the first n - ceil(0.8 n) + 1 of each, so sets are filed under these. Any order gives
the same links; rare shingles come first (counts of a sample), so that lines which many
texts have file nothing. Rows with equal sets are one set.

Not all pairs of a file are compared, as only the components count. First SimHash: sets whose
fingerprints (by ``simhash``, of their own shingles) differ in 2 bits or fewer are found by its pigeonhole
blocks, one set for each fingerprint, and compared. Texts at 0.8 lie up to 18 bits apart, so the files go on
from its classes: each set is compared with two leaders of its files, drawn by hash, round by round. Then, in files that still hold
several components, each pair of different components is compared, as with leaders, for which 0.8 is possible by
sizes, by places of the file's shingle in both orders (a linked pair's first common shingle
leaves enough after it) and by parities (the classes, of 256, that hold an odd number of one set's
values and an even number of the other's are fewer than the values that differ).
A pair of sets is given by the first of the files that they share in a row, not by each.
A pair that is never compared is thus in one component already or below 0.8. To compare
is to bound the difference by counts of both sets' values in ``BUCKETS`` classes, and then
to intersect the sets, which only what passes the bound needs.

Lists of up to ``LISTED`` row numbers are broadcast, so that no text is shuffled; longer
ones are joined, with equal results.

Defined results: a null or empty text is the empty set, and all of these are one group; of
a group the row with the least id stays, of several such the first in order of rows; a row
without an id stays only if its group has no id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import simhash
from quadrille.llm.common import free_shuffles, settle, shrink_executors, tidy, unsettle
from quadrille.llm.components import components

SHINGLE = 5
SEED = 42
LEADER_ROUNDS = 2
LEADERS, BEFORE = 6, 4
SAMPLE = 20_000
BUCKETS = 128
ROWS = 1_000
LISTED = 4_000_000
_SLOTS = 1 << 22
_PARITIES = 256


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of UTF-8 text, by value; words are those of ``simhash``."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts)))


def set_id(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def prefix(n: int) -> int:
    """How many of a set's first shingles meet those of any set that is 0.8 similar."""
    return n - -(-4 * n // 5) + 1 if n else 0


def _slices(batches):
    """Batches of at most ``ROWS`` rows, so that a worker holds the shingles of few texts."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _of_rows(column: pa.Array):
    for x in column.cast(pa.large_binary()):
        yield shingles(x.as_py() or b"")


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _slots(batches):
    """How many texts hold each slot's shingles, 255 at most."""
    counts = np.zeros(_SLOTS, np.uint8)
    for batch in _slices(batches):
        for found in _of_rows(batch.column(0)):
            at = np.unique((found % np.uint64(_SLOTS)).astype(np.int64))
            counts[at[counts[at] < 255]] += np.uint8(1)
    yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])


def _prints(common):
    def prints(batches):
        counts = np.frombuffer(common.value, np.uint8)
        for batch in _slices(batches):
            ids, sizes, marks, spread, odd, firsts = [], [], [], [], [], []
            for found in _of_rows(batch.column(2)):
                ids.append(set_id(found))
                sizes.append(len(found))
                marks.append(simhash.majority(found))
                spread.append(np.minimum(np.bincount((found >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8).tobytes())
                odd.append(np.packbits(np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=_PARITIES) & 1).view(np.uint64))
                order = np.lexsort((found, counts[(found % np.uint64(_SLOTS)).astype(np.int64)]))
                firsts.append(found[order[: prefix(len(found))]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(spread, pa.binary()), _lists(odd), _lists(firsts)], names=["row", "id", "set", "n", "fp", "spread", "odd", "first"])

    return prints


def _sets(batches):
    for batch in _slices(batches):
        found = list(_of_rows(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in found], pa.int64()), _lists(found)], names=["set", "all"])


def _possible(batches):
    """Pairs whose sets differ in (|a| + |b|) / 9 values at most, as far as the classes' counts tell."""
    for batch in _slices(batches):
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for k in (4, 5))
        n = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
        yield batch.select(["a", "b"]).filter(pa.array(np.abs(x - y).sum(axis=1, dtype=np.int64) * 9 <= n))


def _listed(frame: DataFrame, rows: DataFrame, within: bool, then=None, schema=None) -> DataFrame:
    """``frame`` with the rows whose number, its first column, is in ``rows``, or is not.

    ``then`` goes on with the batches in the same worker; one process a task is enough.
    """
    name = frame.columns[0]
    if rows.count() > LISTED:
        left = frame.join(rows.withColumnRenamed("row", name), name, "left_semi" if within else "left_anti")
        return left.mapInArrow(then, schema) if then else left
    listed = frame.sparkSession.sparkContext.broadcast(np.sort(rows.toArrow()["row"].to_numpy()))

    def chosen(batches):
        for batch in batches:
            yield batch.filter(pa.array(np.isin(np.asarray(batch.column(0)), listed.value) == within))

    return frame.mapInArrow(tidy(lambda batches: then(chosen(batches))) if then else tidy(chosen), schema or frame.schema)


def _linked(pairs: DataFrame, heads: DataFrame, numbered: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) with similarity 0.8 or more: 9 |a & b| >= 4 (|a| + |b|)."""
    x, y = (heads.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("spread").alias(f"spread{c}")) for c in "ab")
    possible = settle(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "spreada", "spreadb").mapInArrow(tidy(_possible), "a long, b long"), "nearcopies-possible")
    held = possible.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(heads, "set").select("row")
    sets = settle(_listed(numbered.select("row", "text"), held, True, _sets, "set long, all array<long>"), "nearcopies-sets")
    both = possible.join(sets.select(F.col("set").alias("a"), F.col("all").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("all").alias("y")), "b")
    found = settle(both.where(F.size(F.array_intersect("x", "y")) * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b"), "nearcopies-links")
    unsettle(sets)
    unsettle(possible)
    return found


def _alike(heads: DataFrame) -> DataFrame:
    """Pairs by SimHash: of each fingerprint's sets with its first one, and of the first ones of fingerprints that are linked."""
    prints = settle(heads.groupBy("fp").agg(F.min("set").alias("set")), "nearcopies-fingerprints")
    same = heads.select("fp", F.col("set").alias("b")).join(prints.withColumnRenamed("set", "a"), "fp").where("a < b").select("a", "b")
    x, y = (prints.select(F.col("fp").alias(c), F.col("set").alias(f"of{c}")) for c in "ab")
    near = simhash.links(prints.select("fp")).join(x, "a").join(y, "b").select(F.least("ofa", "ofb").alias("a"), F.greatest("ofa", "ofb").alias("b"))
    return same.unionAll(near)


def _mixed(filed: DataFrame, roots: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """Rows of the files that hold several components, with the set's component, size and parities."""
    named = filed.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return settle(named.join(several, "key", "left_semi").join(heads.select("set", "n", "odd"), "set"), f"nearcopies-mixed{k}")


def _near(x: str, y: str):
    """Whether 0.8 is possible for rows of one file, by sizes, places and parities."""
    nx, ny, oddx, oddy = (F.col(f"{c}{s}") for c in ("n", "odd") for s in (x, y))
    both = nx + ny
    sizes = F.least(nx, ny) * 5 >= F.greatest(nx, ny) * 4
    places = F.least(nx - F.col(f"pos{x}"), ny - F.col(f"pos{y}")) * 9 >= both * 4
    differ = sum((F.bit_count(oddx[k].bitwiseXOR(oddy[k])) for k in range(_PARITIES // 64)), F.lit(0))
    return sizes & places & (differ * 9 <= both)


_ROW = ("set", "root", "pos", "n", "odd")


def _led(filed: DataFrame, k: int) -> DataFrame:
    """Pairs of each set with two leaders of its files, at most, that are not in its component yet and for which 0.8 is possible.

    A file has ``LEADERS`` of them, which differ by file and round.
    """
    dealt = filed.select("key", *[F.col(c).alias(c + "x") for c in _ROW]).repartition("key")
    first = [F.min(F.struct(F.col("setx").bitwiseXOR(F.xxhash64("key", F.lit(k), F.lit(i))).alias("mark"), *[F.col(c + "x").alias(c + "y") for c in _ROW])) for i in range(LEADERS)]
    leaders = dealt.groupBy("key").agg(F.array(*first).alias("l")).select("key", F.explode(F.array_distinct(F.transform("l", lambda x: x.dropFields("mark")))).alias("l")).select("key", "l.*")
    met = dealt.join(leaders, "key").where((F.col("rootx") != F.col("rooty")) & _near("x", "y"))
    one = F.struct(F.col("sety").bitwiseXOR(F.xxhash64("setx", F.lit(k))).alias("mark"), F.col("sety").alias("leader"))
    two = met.groupBy("setx").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).select("setx", F.explode(F.array("lo.leader", "hi.leader")).alias("leader"))
    return two.select(F.least("setx", "leader").alias("a"), F.greatest("setx", "leader").alias("b")).distinct()


def _left(filed: DataFrame) -> DataFrame:
    """Pairs of different components that share a file and for which 0.8 is possible.

    A file's most frequent component is not compared with itself, and a pair is not given by a file if
    one of the ``BEFORE`` files before it, in the orders of both sets, is the same: that one gives it.
    """
    most = filed.groupBy("key").agg(F.mode("root", True).alias("most"))
    before = F.collect_list("key").over(Window.partitionBy("set").orderBy("pos").rowsBetween(-BEFORE, -1))
    rows = filed.withColumn("before", before).join(most, "key").withColumn("many", F.col("root") == F.col("most")).select("key", *_ROW, "before", "many")
    x, y = (rows.select("key", *[F.col(c).alias(c + s) for c in (*_ROW, "before", "many")]) for s in "xy")
    other = (F.col("rootx") != F.col("rooty")) & (F.col("manyy") | (F.col("setx") < F.col("sety")))
    pairs = x.where("NOT manyx").join(y, "key").where(other & _near("x", "y") & ~F.arrays_overlap("beforex", "beforey"))
    return pairs.select(F.least("setx", "sety").alias("a"), F.greatest("setx", "sety").alias("b")).distinct()


def _roots(prints: DataFrame, numbered: DataFrame) -> DataFrame:
    """(node, root) of the sets that are linked to another."""
    one = prints.groupBy("set").agg(F.min("row").alias("row")).select("row")
    heads = settle(_listed(prints, one, True), "nearcopies-heads")  # equal sets are one
    dealt = heads.select("set", F.posexplode("first").alias("pos", "key")).repartition("key")  # dealt once, read twice
    shared = dealt.groupBy("key").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo < hi").select("key")
    filed = settle(dealt.join(shared, "key", "left_semi"), "nearcopies-filed")
    del dealt, shared
    free_shuffles(filed.sparkSession)
    links = _linked(_alike(heads.select("fp", "set")), heads, numbered)
    roots = settle(components(links, "nearcopies-components"), "nearcopies-roots")
    heads = heads.select("set", "row", "n", "spread", "odd")
    for k in range(1, LEADER_ROUNDS + 2):
        shrink_executors(filed.sparkSession)
        filed, before = _mixed(filed.select("key", "set", "pos"), roots, heads, k), filed
        unsettle(before)
        del before
        free_shuffles(filed.sparkSession)
        found = _linked(_led(filed, k) if k <= LEADER_ROUNDS else _left(filed), heads, numbered)
        links = links.unionAll(found)
        roots = settle(components(links.distinct(), "nearcopies-components"), "nearcopies-roots")
        free_shuffles(filed.sparkSession)
    unsettle(filed)
    return roots


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group."""
    whole = settle(docs.select(F.monotonically_increasing_id().alias("__row"), "*"), "nearcopies-rows")
    numbered = whole.select(F.col("__row").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sample = numbered.sample(min(1.0, SAMPLE / max(1, numbered.count())), SEED).select("text").repartition(8)
    common = np.zeros(_SLOTS, np.uint16)  # of 8 counts up to 255
    for r in sample.mapInArrow(tidy(_slots), "counts binary").toLocalIterator():
        common += np.frombuffer(r.counts, np.uint8)
    counts = docs.sparkSession.sparkContext.broadcast(np.minimum(common, 255, out=common).astype(np.uint8).tobytes())
    prints = settle(numbered.mapInArrow(tidy(_prints(counts)), "row long, id long, set long, n long, fp long, spread binary, odd array<long>, first array<long>"), "nearcopies-prints")
    firsts = prints.groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("f"))
    roots = _roots(prints, numbered)
    named = firsts.join(roots, firsts["set"] == roots["node"], "left").withColumn("root", F.coalesce("root", "set"))
    kept = named.groupBy("root").agg(F.min("f").alias("f")).select(F.col("f.row").alias("row"))
    gone = settle(prints.select("row").join(kept, "row", "left_anti"), "nearcopies-gone")
    return _listed(whole, gone, False).select(*[F.col(f"`{c}`") for c in docs.columns])

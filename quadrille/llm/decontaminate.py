"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Method: the windows of all benchmark items (``WINDOW`` words; a shorter item is one
window) become a hash set that every task holds. A task hashes all word windows of its
documents at once, takes those in the set, verifies their words exactly and marks the
words they cover.

The set is broadcast in blocks of at most ``BLOCK_BYTES`` of benchmark text, measured
before anything is collected. A larger benchmark is scanned block by block and the
blocks' findings are merged per row, by row numbers that are written once, so its size
changes the time only.

Defined results: a null or empty text has no words; a null item id or text adds no
window; items with equal ids count once, with all their windows; equal documents give
equal rows, one for each input row; an empty table gives no rows (documents) or no hits
(benchmark). Only the two named columns of either table are read, so others may have any
name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import bytetext
from quadrille.llm.common import settle, tidy

WINDOW = 10
BLOCK_BYTES = 32_000_000
_BITS = 20

FOUND = "row_no long, n_words long, hits array<struct<first:long,last:long>>, items array<string>"


class GramSet:
    """Windows of one block of items, by their length in words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.holders: dict[bytes, list[str]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            data, offs = bytetext.utf8(pa.array([text], pa.string()))
            w = bytetext.words(data, offs)
            n = len(w.start)
            if not n:
                continue
            width = min(window, n)
            h, _ = bytetext.windows(w.hashes(), w.row, width)
            hashes.setdefault(width, []).append(h)
            for i in range(n - width + 1):
                held = self.holders.setdefault(w.text(i, width), [])
                if item not in held:
                    held.append(item)
        for width, parts in hashes.items():
            keys = np.unique(np.concatenate(parts))
            there = np.zeros(1 << _BITS, dtype=bool)
            there[keys >> np.uint64(64 - _BITS)] = True
            self.by_width[width] = (keys, there)

    def places(self, w: bytetext.Words) -> Iterator[tuple[int, int, list[str]]]:
        """Verified (first word, width, items) in a slab."""
        if not self.by_width or not len(w.start):
            return
        h = w.hashes()
        for width, (keys, there) in self.by_width.items():
            wh, whole = bytetext.windows(h, w.row, width)
            at = np.flatnonzero(there[wh >> np.uint64(64 - _BITS)] & whole)
            at = at[keys[np.minimum(np.searchsorted(keys, wh[at]), len(keys) - 1)] == wh[at]]
            for i in at.tolist():
                items = self.holders.get(w.text(i, width))
                if items:
                    yield i, width, items


def _runs(hit: np.ndarray) -> list[dict]:
    """Runs of covered words, as first and last word from 0."""
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]


def _scanner(grams):
    def scan(batches):
        held: GramSet = grams.value
        for batch in batches:
            data, offs = bytetext.utf8(batch.column(1))
            n_words, hits, items = [], [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            for i, j in bytetext.slabs(offs):
                w = bytetext.words(data, offs[i : j + 1])
                per_row = np.bincount(w.row, minlength=j - i)
                n_words.append(per_row)
                first = np.concatenate(([0], np.cumsum(per_row)))
                covered: dict[int, np.ndarray] = {}
                for at, width, names in held.places(w):
                    row = int(w.row[at])
                    if row not in covered:
                        covered[row] = np.zeros(per_row[row], dtype=bool)
                    covered[row][at - first[row] : at - first[row] + width] = True
                    items[i + row] += names
                for row, hit in covered.items():
                    hits[i + row] = _runs(hit)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                    pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                ],
                names=["row_no", "n_words", "hits", "items"],
            )

    return scan


def _merge(parts):
    """One row for each document from those of all blocks."""

    def one(batches):
        for batch in batches:
            hits, items = [], []
            for spans, names in zip(batch.column("spans").to_pylist(), batch.column("names").to_pylist()):
                spans = sorted((s["first"], s["last"]) for x in spans for s in x)
                joined: list[list[int]] = []
                for a, b in spans:
                    if joined and a <= joined[-1][1] + 1:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                hits.append([{"first": a, "last": b} for a, b in joined])
                items.append(sorted({x for y in names for x in y}))
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("n_words"), pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], names=["row_no", "n_words", "hits", "items"])

    merged = parts.groupBy("row_no").agg(F.max("n_words").alias("n_words"), F.collect_list("hits").alias("spans"), F.collect_list("items").alias("names"))
    return merged.mapInArrow(one, FOUND)


def _items(benchmark: DataFrame, block_bytes: int, item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, int]:
    """(i, t) of the items that have both, and how many blocks they make."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    return items, max(1, math.ceil(size / block_bytes))


def find_passages(docs: DataFrame, benchmark: DataFrame, row_no: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document: its words, the runs of words that test windows cover, the items' ids.

    ``row_no`` names a long column that tells rows apart if the benchmark needs several blocks.
    """
    spark = docs.sparkSession
    items, blocks = _items(benchmark, block_bytes, item_id, item_text)
    rows = docs.select(F.col(row_no).cast("long").alias("row_no"), F.col(text).cast("string").alias("t"))
    found = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b) if blocks > 1 else items
        grams = spark.sparkContext.broadcast(GramSet([(x.i, x.t) for x in part.toLocalIterator()], window))
        found.append(rows.mapInArrow(_scanner(grams), FOUND))
    if blocks == 1:
        return found[0]
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return _merge(out)


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    if _items(benchmark, block_bytes, item_id, item_text)[1] == 1:
        found = find_passages(docs, benchmark, id_col, text, item_id, item_text, window, block_bytes).withColumnRenamed("row_no", "doc_id")
    else:
        rows = settle(docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), "decontaminate-rows")
        found = rows.select("row_no", "doc_id").join(find_passages(rows, benchmark, "row_no", "t", item_id, item_text, window, block_bytes), "row_no")
    joined = F.concat_ws(",", F.array_sort("items"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _cut(text: str, runs: list[tuple[int, int]]) -> str:
    data, offs = bytetext.utf8(pa.array([text], pa.string()))
    w = bytetext.words(data, offs)
    raw, out, at = text.encode(), [], 0
    for first, last in runs:
        out.append(raw[at : w.start[first]])
        at = int(w.end[last])
    return b"".join([*out, raw[at:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, or (mode "spans") without the covered words.

    With one block, and for documents, the decision is taken where the text lies, so that no
    text is shuffled. Spans of several blocks are all found in the original text and cut once.
    """
    items, blocks = _items(benchmark, block_bytes)
    if mode == "spans" and blocks > 1:
        rows = settle(docs.select(F.monotonically_increasing_id().alias("__row"), "*"), "decontaminate-rows")
        found = find_passages(rows, benchmark, "__row", text, window=window, block_bytes=block_bytes).where(F.size("hits") > 0)
        found = found.select(F.col("row_no").alias("__row"), F.col("hits").alias("__hits"))
        marked = rows.join(found, "__row", "left").drop("__row")
        return marked.mapInArrow(_cutter(docs.columns.index(text)), docs.schema)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b) if blocks > 1 else items
        grams = docs.sparkSession.sparkContext.broadcast(GramSet([(x.i, x.t) for x in part.toLocalIterator()], window))
        docs = docs.mapInArrow(tidy(_cleaner(grams, mode, docs.columns.index(text))), docs.schema)
    return docs


def _cutter(at):
    """Cuts the runs of words in the last column from the text, and drops that column."""

    def cut(batches):
        for batch in batches:
            texts, last = batch.column(at).to_pylist(), batch.num_columns - 1
            for k, hits in enumerate(batch.column(last).to_pylist()):
                if hits:
                    texts[k] = _cut(texts[k], [(x["first"], x["last"]) for x in hits])
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))
            yield batch.select(list(range(last)))

    return cut


def _cleaner(grams, mode, at):
    scan = _scanner(grams)

    def clean(batches):
        for batch in batches:
            column = batch.column(at)
            numbered = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), column], names=["row_no", "t"])
            for found in scan([numbered]):
                hits = found.column("hits")
                dirty = np.diff(hits.offsets.to_numpy(zero_copy_only=False)) > 0
                if mode == "documents":
                    yield batch.filter(pa.array(~dirty))
                else:
                    texts = column.to_pylist()
                    for k in np.flatnonzero(dirty).tolist():
                        texts[k] = _cut(texts[k], [(x["first"], x["last"]) for x in hits[k].as_py()])
                    yield batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))

    return clean

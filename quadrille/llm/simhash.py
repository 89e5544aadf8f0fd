"""SimHash near-duplicates by pigeonhole blocks.

Method: a text's fingerprint is the bitwise majority of the XXH64 values of its word
3-shingles. Documents are first reduced to distinct fingerprints, so exact copies cost
one row. A fingerprint is cut into four blocks of 16 bits; two fingerprints that differ
in at most two bits agree in at least two blocks, so each is filed under its six pairs of
blocks and compared, by an exact bit count, with what shares a file.

A file with more than ``DENSE`` fingerprints is not compared as a whole: its 32 free bits
are cut into eight nibbles, of which a close pair shares at least six, and its members are
filed again under their 28 sets of six nibbles. Such a file holds at most 256 distinct
fingerprints, whatever the data, so the work per fingerprint is bounded and no link is
lost.

Defined results: a null or empty text has fingerprint zero and links like any other; a
row with a null id gets its class like any other, but never names it; repeated ids give
one row each; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import settle
from quadrille.llm.components import components

MAX_BITS = 2
SHINGLE = 3
SEED = 42
DENSE = 64
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of UTF-8 text. bytes.lower() and split() know ASCII only, as the definition does."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(joined, SEED), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    n = len(starts)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])])
        counts += _bit_counts(np.frombuffer(hashes, dtype=">u8").astype(np.uint64))
    return int.from_bytes(np.packbits(counts[::-1] * 2 > n).tobytes(), "big")


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingles by their hashes: a bit is 1 if set in over half of them."""
    return int.from_bytes(np.packbits(_bit_counts(h)[::-1] * 2 > len(h)).tobytes(), "big")


_SHIFT = np.arange(64, dtype=np.uint64)
_LANES = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many values have each bit, lowest first: eight bits at a time in byte lanes."""
    out = np.zeros(64, dtype=np.int64)
    pad = -len(h) % 255
    blocks = np.concatenate((h, np.zeros(pad, np.uint64))).reshape(-1, 255)
    for k in range(8):
        lanes = ((blocks >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)  # a lane holds 255 at most
        out[k::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        prints = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row a document."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _files(width: int, blocks: int, drop: int, base: int = 0) -> list[int]:
    """Masks that keep all but ``drop`` of ``blocks`` blocks of ``width`` bits."""
    parts = [((1 << width) - 1) << (width * k + base) for k in range(blocks)]
    return [sum(parts) - sum(gone) for gone in combinations(parts, drop)]


def _compared(filed: DataFrame) -> DataFrame:
    """Links between fingerprints under one (file, key)."""
    x = filed.select("file", "key", F.col("fp").alias("a"))
    y = filed.select("file", "key", F.col("fp").alias("b"))
    return x.join(y, ["file", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs a < b of distinct fingerprints ``fp`` that differ in at most two bits."""
    masks = _files(16, 4, 2)
    filed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("file", "key"))
    sizes = filed.groupBy("file", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = settle(filed.join(sizes, ["file", "key"]), "simhash-files")
    free = [[(1 << 4 * k) * 15 for k in range(16) if not m & (15 << 4 * k)] for m in masks]
    sub = F.array(*[F.array(*[F.lit(_signed(sum(nibbles) - a - b)) for a, b in combinations(nibbles, 2)]) for nibbles in free])
    refined = (
        crowded.where(F.col("n") > dense)
        .select("fp", "file", "key", F.posexplode(F.element_at(sub, F.col("file") + 1)).alias("part", "mask"))
        .select("fp", (F.col("file") * 32 + F.col("part") + 8).alias("file"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    )
    few = _compared(crowded.where(F.col("n") <= dense).select("file", "key", "fp"))
    return few.unionAll(_compared(refined)).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document."""
    prints = settle(fingerprints(docs, id_col, text), "simhash-prints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct), "simhash-links")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = settle(named.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that of the least id.

    Rows that repeat an id stay or go together; rows without an id stay if a class has
    no other rows.
    """
    kept = classes(docs, id_col, text).where("doc_id <=> component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__kept_id")), "left_semi")

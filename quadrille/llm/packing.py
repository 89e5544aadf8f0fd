"""Packing documents into training sequences by cutting-stock column generation.

Method: each document's tokens are cut into whole sequences of ``LENGTH`` and one rest.
The rests are counted by length class (their length rounded up to ``GRAIN``), which gives
a histogram of at most ``LENGTH / GRAIN`` counts. The least number of sequences that holds
this histogram is a cutting-stock problem: a linear program over patterns (how many rests
of each class share a sequence). New patterns are priced by a knapsack dynamic program
over the dual prices, until none improves. The solution is rounded down, what is left is
packed by best-fit decreasing over classes, and each class's rests, ranked, go to the
patterns in turn.

What reaches the driver is the histogram; it is bounded by the number of classes. Ranks
come from each task's own counts and a running sum over tasks, so that no class is ever
gathered in one task. The patterns, of which there are at most about three for each class,
are broadcast.

Padding: a class wastes less than ``GRAIN`` tokens for each rest. A sequence whose length
is a power of two isn't padded.

Defined results: a null or empty text still has its end token and is packed; equal
documents are packed one by one; an empty table gives no rows. Only the named columns are
read.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import settle, tidy

LENGTH = 2048
GRAIN = 8
END = 1
CACHE_WORDS = 200_000
_MARKS = b".,!?%&*#$;:|)]}\"-"  # together one word of the vocabulary's splitting


# ---------------------------------------------------------------- tokens


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    White space never enters a token of this vocabulary, so a text's ids are those of its
    runs between ASCII white space. Runs are kept with their ids in two generations of at
    most ``words``. A run of letters is one word of the vocabulary's own splitting,
    whose last token alone is marked as an end; so new words are encoded many at a time,
    as one text, and parted at the marks. Words of small ASCII letters, which normalising and
    splitting leave alone, go to the same model without these steps. Other runs are encoded one by one.
    """

    def __init__(self, path: str, end: int = END, words: int = CACHE_WORDS):
        self.words = words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for x, k in vocabulary.items() if x.endswith("</w>")]] = True
        self.end = end.to_bytes(4, "little")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _one(self, run: bytes) -> bytes:
        return np.array(self.tokenizer.encode(run.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, new: list[bytes], by) -> None:
        """Runs that are all letters after normalising; ``by`` is the tokenizer or, for small ASCII letters, the bare one."""
        for at in range(0, len(new), 2048):
            part = new[at : at + 2048]
            ids = np.array(by.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):  # letters to one side only
                self.known.update((run, self._one(run)) for run in part)
                continue
            raw, cuts = ids.tobytes(), (cuts * 4).tolist()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))

    def learn(self, new: set[bytes]) -> None:
        plain, words, marked = set(), set(), []
        for run in new:
            # case of ASCII letters doesn't matter, but for the special tokens "<|...|>"
            core = run.lower() if b"<" not in run else run
            if core.isalpha():  # of bytes: ASCII
                plain.add(core)
                if core != run:
                    marked.append((run, core, b""))
                continue
            tail = core[len(core.rstrip(_MARKS)) :]
            core = core[: len(core) - len(tail)]
            if core and (core.isalpha() or unicodedata.normalize("NFC", core.decode()).lower().isalpha()):
                if core not in self.known:
                    (plain if core.isalpha() and core.islower() else words).add(core)
                if core != run:
                    marked.append((run, core, tail))
            else:
                self.known[run] = self._one(run)
        self._learn_words(list(plain), self.bare)
        self._learn_words(list(words), self.tokenizer)
        for run, core, tail in marked:
            if tail and tail not in self.known:
                self.known[tail] = self._one(tail)
            self.known[run] = self.known[core] + (self.known[tail] if tail else b"")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        runs = [(x if b"<" in x else x.lower()).split() for x in texts]
        if len(self.known) > self.words:
            self.known, self.older = {}, self.known
        missing: set[bytes] = set()
        for x in runs:
            missing.update(itertools.filterfalse(self.known.__contains__, x))
        again = missing & self.older.keys() if self.older else set()
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        self.learn(missing - again)
        get = self.known.__getitem__
        return [b"".join(map(get, x)) + self.end for x in runs]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, words: int = CACHE_WORDS) -> Encoder:
    """The worker's encoder; the words that it keeps change its time and memory alone."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].words = words
    return _encoders[path]


LENGTHS = "doc_id long, doc_tokens long, part int, class int, rank long, whole_before long, crcs array<long>"


def _measure(path: str, length: int, grain: int, words: int = CACHE_WORDS):
    def run(batches):
        from pyspark import TaskContext

        part, ranks, whole = TaskContext.get().partitionId(), {}, 0
        tokens = encoder(path, words)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            out: list[tuple] = []
            for at in range(0, len(texts), 256):
                for ids in tokens.encode([x.as_py() or b"" for x in texts[at : at + 256]]):
                    n = len(ids) // 4
                    rest = n % length
                    kind = -(-rest // grain)
                    rank = ranks.get(kind, 0)
                    ranks[kind] = rank + 1
                    out.append((n, part, kind, rank, whole, [zlib.crc32(ids[4 * s : 4 * (s + length)]) for s in range(0, n, length)]))
                    whole += n // length
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "doc_tokens", "part", "class", "rank", "whole_before", "crcs"])

    return run


# ---------------------------------------------------------------- cutting stock


def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int, limits: np.ndarray) -> tuple[float, np.ndarray]:
    """The pattern of the highest price that fits: an unbounded knapsack over the room."""
    use = np.flatnonzero((prices > 1e-12) & (sizes <= room) & (limits > 0))
    value, choice = np.zeros(room + 1), np.full(room + 1, -1, dtype=np.int64)
    w, p = sizes[use], prices[use]
    for c in range(1, room + 1):
        fits = np.searchsorted(w, c, side="right")
        if fits:
            total = value[c - w[:fits]] + p[:fits]
            k = int(total.argmax())
            if total[k] > value[c - 1]:
                value[c], choice[c] = total[k], k
                continue
        value[c] = value[c - 1]
    pattern, c = np.zeros(len(sizes), dtype=np.int64), room
    while c > 0:
        if choice[c] < 0 or value[c] == value[c - 1]:
            c -= 1
        else:
            pattern[use[choice[c]]] += 1
            c -= int(w[choice[c]])
    return float(value[room]), pattern


def first_basis(counts: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """A pattern for each class, as columns: the largest class left and what fills its room best.

    Each pattern is taken, in fractions too, until a class is used up, which later patterns
    then lack. So the columns are triangular in the order of use, and a basis. Of classes
    used up at once, all but one get a pattern of their own.
    """
    left, columns = counts.astype(float), np.diag(room // sizes).astype(float)
    while (there := left > 1e-9).any():
        top = int(np.flatnonzero(there)[-1])
        _, pattern = best_pattern(sizes, np.where(there, sizes * (1 + sizes / room / 64), 0), room - int(sizes[top]), counts)
        pattern[top] += 1
        held = np.flatnonzero(pattern)
        times = left[held] / pattern[held]
        out = int(held[times.argmin()])
        left = left - pattern * times.min()
        left[out] = 0
        columns[:, out] = pattern
    return columns


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row exchange, one rank-one step a column.

    Element-wise only: threaded library inverses were seen to hang in a driver that had
    run others before.
    """
    m = len(a)
    work = np.concatenate([a.astype(float), np.eye(m)], axis=1)
    for k in range(m):
        top = k + int(np.abs(work[k:, k]).argmax())
        work[[k, top]] = work[[top, k]]
        work[k] /= work[k, k]
        off = work[:, k].copy()
        off[k] = 0
        rows = np.flatnonzero(off)
        work[rows] -= off[rows, None] * work[k]
    return work[:, m:]


def patterns_for(counts: np.ndarray, sizes: np.ndarray, room: int, rounds: int = 600, gap: float = 0.001) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold all counts, in few sequences.

    The linear program (least sum of x with A x = counts, x >= 0) is solved by the revised
    simplex method from ``first_basis``; the inverse of the basis is kept. If the best new
    pattern is worth v, the solution is at most v times the optimum, so ``gap`` bounds
    what is given away.
    """
    m = len(counts)
    if not m:
        return []
    columns = first_basis(counts, sizes, room)
    inverse = inverted(columns)
    x = np.maximum((inverse * counts).sum(axis=1), 0)
    for k in range(rounds):
        price = inverse.sum(axis=0)
        value, pattern = best_pattern(sizes, price, room, counts)
        if value <= 1 + gap:
            break
        d = (inverse * pattern).sum(axis=1)
        steps = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(steps.argmin())
        columns[:, out] = pattern
        if k % 50 == 49:
            inverse = inverted(columns)
        else:
            row = inverse[out] / d[out]
            inverse = inverse - np.outer(d, row)
            inverse[out] = row
        x = np.maximum((inverse * counts).sum(axis=1), 0)
    left, chosen = counts.copy(), []
    for k in range(m):
        pattern = columns[:, k].astype(np.int64)
        held = pattern > 0
        times = min(int(x[k] + 1e-9), int((left[held] // pattern[held]).min()))
        if times > 0:
            chosen.append((pattern, times))
            left = left - times * pattern
    open_: list[list] = []  # best fit, largest first
    for k in np.argsort(-sizes):
        for _ in range(int(left[k])):
            fit = min((b for b in open_ if b[0] >= sizes[k]), key=lambda b: b[0], default=None)
            if fit is None:
                open_.append(fit := [room, np.zeros(m, dtype=np.int64)])
            fit[0] -= int(sizes[k])
            fit[1][k] += 1
    return chosen + [(p, 1) for _, p in open_]


def layout(counts: dict[int, int], length: int, grain: int) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, of it in a sequence, first sequence, slot) by pattern.

    All is counted in units of ``grain`` tokens, so the room is ``length / grain``.
    """
    classes = sorted(k for k in counts if k)
    found = patterns_for(np.array([counts[k] for k in classes], dtype=np.int64), np.array(classes, dtype=np.int64), length // grain)
    rank, sequence, rows = dict.fromkeys(classes, 0), 0, []
    for pattern, times in found:
        slot = 0
        for k, a in zip(classes, pattern.tolist()):
            if a:
                rows.append((k, rank[k], rank[k] + a * times, a, sequence, slot))
                rank[k] += a * times
                slot += a
        sequence += times
    return rows


# ---------------------------------------------------------------- the operator


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, grain: int = GRAIN, words: int = CACHE_WORDS) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    measured = settle(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(tidy(_measure(tokenizer, length, grain, words)), LENGTHS), "packing-lengths")

    # What lies before each task's rests of a class, and before its whole sequences.
    by_class = measured.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = by_class.withColumn("rank_before", F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    by_part = measured.groupBy("part").agg(F.sum(F.floor(F.col("doc_tokens") / length)).cast("long").alias("n"), F.lit(0).alias("one"))
    wholes = by_part.withColumn("parts_before", F.sum("n").over(Window.partitionBy("one").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).select("part", "parts_before")
    counts = {r["class"]: r.n for r in measured.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_whole = measured.agg(F.sum(F.floor(F.col("doc_tokens") / length)).cast("long").alias("n")).first().n or 0

    plan = spark.createDataFrame(layout(counts, length, grain), "class int, lo long, hi long, each long, sequence long, slot int")
    placed = measured.join(before, ["class", "part"]).join(wholes, "part").withColumn("rank", F.col("rank") + F.col("rank_before"))
    n_full = F.floor(F.col("doc_tokens") / length).cast("long")
    full = placed.where(F.col("doc_tokens") >= length).select(
        "doc_id",
        "doc_tokens",
        (F.col("parts_before") + F.col("whole_before")).alias("first"),
        F.posexplode(F.slice("crcs", F.lit(1), n_full.cast("int"))).alias("k", "ids_crc32"),
    )
    full = full.select("doc_id", (F.col("k").cast("long") * length).alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = (
        placed.where(F.col("class") > 0)
        .join(F.broadcast(plan), "class")
        .where("rank >= lo AND rank < hi")
        .select(
            "doc_id",
            (n_full * length).alias("start"),
            (F.col("doc_tokens") % length).alias("length"),
            F.element_at("crcs", -1).alias("ids_crc32"),
            "doc_tokens",
            (F.lit(n_whole) + F.col("sequence") + F.expr("(rank - lo) div each")).alias("sequence_id"),
            (F.col("slot") + (F.col("rank") - F.col("lo")) % F.col("each")).alias("at"),
        )
    )
    upto = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rests = rests.withColumn("offset", F.sum("length").over(upto) - F.col("length")).drop("at")
    return full.unionByName(rests)

"""Language-model scoring by online logistic context mixing.

Method: a text is its tokens: words after lower-casing A-Z, each with a blank, then one
end. Their bytes are coded bit by bit. Seven predictors look up the bit's counts under
contexts, each with the bits of this byte so far: the last 1, 2 and 3 bytes of the token with
the lead; the last 4 bytes; the token's shape (the runs of letters, digits and other bytes)
with its last byte and the lead; all of the token so far with the lead; and all of it alone
(up to ``PREFIX`` bytes). The lead is that of the corpus's ``LEADS`` most frequent tokens
of ``SHORT`` bytes or fewer which the document has held most often, looked up after 8, 16, 32 .. tokens; it tells the
language, mostly. The predictors' log odds are summed with weights from a set that a gate
picks (how often three of the contexts were seen), and the sum is refined by an adaptive
probability map over (bits so far, rounded log odds). The product of a
token's bits is its probability. Within a document it is mixed with the document's own past:
the share of the tokens before that are this token, by a weight that follows how many of the
tokens before were repeats. So probabilities sum to one over all tokens, known or not.

Training. Two passes count the tokens of all documents, the second by their leads; all else
follows from this table, which is exact, grows with the corpus and stays distributed. Counts of prefixes are exact as
well: in the order of their bytes the tokens with a common beginning lie together, so each
range of the sorted table finds them by itself, but for those that go on in the ranges
beside it; these are told by the ranges' ends (at most ``RANGES``). The counts of the other
contexts are hashed into tables of 2**16 to 2**21 slots, by the number of distinct tokens,
which are added up chunk by chunk and broadcast. The weights, 64 sets of 8 numbers, are
learned online from all tokens with their leads: the tokens of a shard, in the
order of their hashes, step through mini-batches, each occurrence with its own contribution
taken out of the counts; the shards' weights are averaged by their number of occurrences.
The probability map, 256 by 33 numbers, is counted over the same tokens. Shards follow from the number of tokens,
and all sums are of whole numbers or in a fixed order, so the model and the scores don't
depend on partitions or cores. Scoring uses the model as it stands then.

A token's probability is computed once and written beside its counts. A bounded number of
frequent tokens (at most ``FREQUENT``) is broadcast, the rest of each document's tokens is
joined to the table; the scores are the same for any such number.

Defined results: a null text is empty; an empty text has one token, its end; repeated rows
give one row each; a null id counts as the empty text for the split; without training
texts all counts are zero and each bit has probability one half; an empty table gives no
rows. Only the named columns are read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import bytetext
from quadrille.llm.common import fold_of, free_shuffles, settle, tidy, unsettle

FOLDS, HELD = 7, 2
LEADS = 12
FIRST_LOOK = 8
WHOLE, BIAS = 6, 7
PREDICTORS = 7
PREFIX = 32
DEPTH = 8 * PREFIX
CHUNK = 1 << 12
FREQUENT = 200_000
RANGE_TOKENS, RANGES = 50_000, 2048
SHARD_TOKENS = 30_000
SHORT = 4
END = 255
POSITIONS = 8_192
GATES = 64
BINS = 33
SCALE = np.float32(1024)
REPEATS = 0.5
_PRIOR = np.float32(0.4)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.full(256, 3, dtype=np.uint64)
_KIND[48:58], _KIND[97:123], _KIND[128:] = 2, 1, 4


# ---------------------------------------------------------------- tokens


def segments(tokens: list[bytes], leads: dict[bytes, int]):
    """(lead, tokens) of a document; a lead is that seen most often before, the more frequent one if equal, 0 without any."""
    at, stop, lead, seen = 0, FIRST_LOOK, 0, [0] * (len(leads) + 1)
    while at < len(tokens):
        part = tokens[at:stop]
        yield lead, part
        if stop >= len(tokens):
            return
        for k, n in Counter(map(leads.get, part)).items():
            if k:
                seen[k] += n
        lead = max(range(1, len(seen)), key=lambda k: (seen[k], -k), default=0)
        lead = lead if seen[lead] else 0
        at, stop = stop, 2 * stop


def _count_tokens(leads: dict[bytes, int]):
    """(key, lead, n, m): occurrences of a token with its blank in training texts, and in all."""

    def run(batches):
        counts = [[Counter() for _ in range(len(leads) + 1)] for _ in range(2)]

        def rows():
            for lead, (others, trained) in enumerate(zip(*counts)):
                keys = list(trained.keys() | others.keys())
                for i in range(0, len(keys), 50_000):
                    part = keys[i : i + 50_000]
                    n, m = [trained[k] for k in part], [trained[k] + others[k] for k in part]
                    yield pa.RecordBatch.from_arrays([pa.array([k + b" " for k in part], pa.binary()), pa.array([lead] * len(part), pa.int32()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["key", "lead", "n", "m"])

        for batch in batches:
            for text, training in zip(batch.column(0).cast(pa.large_binary()), batch.column(1).to_pylist()):
                mine = counts[training]
                for lead, part in segments((text.as_py() or b"").lower().split(), leads):
                    mine[lead].update(part)
                if sum(len(c) for both in counts for c in both) > 400_000:
                    yield from rows()
                    for both in counts:
                        for c in both:
                            c.clear()
        yield from rows()

    return run


def _count_short(batches):
    """(key, m): tokens of at most ``SHORT`` bytes."""
    counts = Counter()
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["key", "m"])
    for batch in batches:
        for text in batch.column(0).cast(pa.large_binary()):
            counts.update([t for t in (text.as_py() or b"").lower().split() if len(t) <= SHORT])
            if len(counts) > 400_000:
                yield rows()
                counts.clear()
    yield rows()


COUNTED = "key binary, lead int, n long, m long"


# ---------------------------------------------------------------- exact counts of prefixes


def _firsts(keys: list[bytes]) -> np.ndarray:
    """The first PREFIX bytes of each key, padded by zeros."""
    return np.frombuffer(b"".join([k[:PREFIX].ljust(PREFIX, b"\0") for k in keys]), np.uint8).reshape(-1, PREFIX)


def _common_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading bits that rows of bytes share."""
    xor = x ^ y
    at = (xor != 0).argmax(axis=1)
    byte = xor[np.arange(len(xor)), at]
    return np.where(byte == 0, DEPTH, 8 * at + 7 - np.floor(np.log2(np.maximum(byte, 1))).astype(np.int64))


def _paths(keys: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys, how many occurrences begin with the first d bits of each, d = 1, 2 ..; and offsets.

    A path ends, at the latest, a few bits after it is down to the key's own occurrences.

    ``left`` and ``right`` add what lies before and after these keys under the first d bits
    of the first and of the last one. No key begins another, as only its end has the blank.
    """
    bits = np.minimum([len(k) for k in keys], PREFIX) * 8
    offsets = np.concatenate(([0], np.cumsum(bits)))
    out, length = np.zeros(offsets[-1], dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    table = _firsts(keys)
    common = np.concatenate(([-1], _common_bits(table[1:], table[:-1])))
    alive = np.arange(len(keys))
    for d in range(1, DEPTH + 1):
        if d % 8 == 1:
            long = bits[alive] >= d
            alive = alive[long]
            near, mine = common[alive], n[alive]
        if not len(alive):
            break
        starts = np.flatnonzero(near < d)
        starts = starts if len(starts) and starts[0] == 0 else np.concatenate(([0], starts))
        sums = np.add.reduceat(mine, starts)
        if alive[0] == 0:
            sums[0] += left[d - 1]
        if alive[-1] == len(keys) - 1:
            sums[-1] += right[d - 1]
        found = np.repeat(sums, np.diff(np.append(starts, len(alive))))
        out[offsets[alive] + d - 1] = found
        length[alive] = d
        if d % 4 == 0:  # a token that is alone has its own count from here on
            counts = np.diff(np.append(starts, len(alive)))
            crowd = (found > mine) | np.repeat(counts > 1, counts)
            if not crowd.all():
                near = near[crowd]  # one that is alone shares less than this with the next, so the next begins a group
                alive, mine = alive[crowd], mine[crowd]
    here = np.arange(len(out)) - np.repeat(offsets[:-1], np.diff(offsets)) < np.repeat(length, np.diff(offsets))
    return out[here], np.concatenate(([0], np.cumsum(length)))


def _sorted(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    table = table.sort_by("key").combine_chunks()
    return table, table["key"].to_pylist(), table["n"].to_numpy()


_NONE = np.zeros(DEPTH, np.int64)
EDGES = "part int, first binary, last binary, total long, firsts binary, lasts binary"


def _edges(table: pa.Table) -> pa.Table:
    """What a range has under the first bits of its first and of its last key."""
    table, keys, n = _sorted(table)
    rows, ends = _firsts(keys), []
    for k in (0, len(keys) - 1):
        shared = _common_bits(rows, np.broadcast_to(rows[k], rows.shape))
        by_bits = np.zeros(DEPTH + 1, np.int64)
        np.add.at(by_bits, shared, n)
        under = np.cumsum(by_bits[::-1])[::-1][1:]  # with d bits or more, d = 1, 2 ..
        ends.append(np.where(np.arange(1, DEPTH + 1) <= 8 * len(keys[k]), under, 0))
    return pa.table({"part": table["part"][:1], "first": pa.array([keys[0][:PREFIX]], pa.binary()), "last": pa.array([keys[-1][:PREFIX]], pa.binary()), "total": pa.array([int(n.sum())], pa.int64()), "firsts": pa.array([ends[0].tobytes()], pa.binary()), "lasts": pa.array([ends[1].tobytes()], pa.binary())})


def beside(edges: list[tuple]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each range, what the ranges before and after it add under its first and last key."""
    edges = sorted(edges, key=lambda e: e[1])
    first, last = _firsts([e[1] for e in edges]), _firsts([e[2] for e in edges])
    firsts, lasts = [np.frombuffer(e[4], np.int64) for e in edges], [np.frombuffer(e[5], np.int64) for e in edges]
    depth, out = np.arange(1, DEPTH + 1), {}
    for q in range(len(edges)):
        found = []
        for own, way, theirs, sums in ((first, range(q - 1, -1, -1), last, lasts), (last, range(q + 1, len(edges)), first, firsts)):
            extra, open_ = np.zeros(DEPTH, np.int64), np.ones(DEPTH, dtype=bool)
            for p in way:
                open_ = open_ & (depth <= _common_bits(own[q : q + 1], theirs[p : p + 1])[0])
                if not open_.any():
                    break
                extra[open_] += sums[p][open_]
                open_ = open_ & (sums[p] == edges[p][3])  # a range that holds others ends it
            found.append(extra)
        out[edges[q][0]] = tuple(found)
    return out


TOKENS = "key binary, lead int, total long, n long, m long, path array<long>"


def _with_paths(extras):
    def run(table: pa.Table) -> pa.Table:
        table, keys, n = _sorted(table)
        path, offsets = _paths(keys, n, *extras.value[table["part"][0].as_py()])
        uses = table["uses"].combine_chunks()
        row = pa.array(np.repeat(np.arange(len(keys)), uses.value_lengths().to_numpy()))
        use = uses.flatten()
        paths = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(path))
        return pa.table({"key": table["key"].take(row), "lead": use.field("lead"), "total": table["n"].take(row), "n": use.field("n"), "m": use.field("m"), "path": paths.take(row)})

    return run


# ---------------------------------------------------------------- contexts


@dataclass
class Places:
    """The coded bytes of keys on end: contexts before each byte, and the token of each."""

    symbol: np.ndarray
    before: np.ndarray  # the last four bytes of the token, 255 where it has not so many
    shape: np.ndarray
    token: np.ndarray
    depth: np.ndarray  # byte number in the token
    lead: np.ndarray
    prefix: np.ndarray  # hash of the token so far

    def __len__(self) -> int:
        return len(self.symbol)

    def part(self, at: slice) -> Places:
        return Places(self.symbol[at], self.before[at], self.shape[at], self.token[at], self.depth[at], self.lead[at], self.prefix[at])


def places(keys: list[bytes], leads: np.ndarray) -> Places:
    flat = np.frombuffer(b"".join(keys), np.uint8)
    lengths = np.array([len(k) for k in keys], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    token = np.repeat(np.arange(len(keys)), lengths)
    depth = np.arange(len(flat)) - begins[token]
    before = np.zeros(len(flat), dtype=np.uint64)
    for k in range(1, 5):
        byte = np.full(len(flat), END, dtype=np.uint64)
        byte[k:] = np.where(depth[k:] >= k, flat[:-k], END)
        before |= byte << np.uint64(8 * (k - 1))
    kind = _KIND[flat]
    turn = np.ones(len(flat), dtype=bool)
    turn[1:] = (kind[1:] != kind[:-1]) | (depth[1:] == 0)
    turns = np.cumsum(turn)
    run = turns - turns[begins][token] if len(flat) else turns  # run number in the token
    most = int(run.max()) + 1 if len(run) else 1
    shape = _before(np.where(turn, kind * bytetext.powers(most)[np.minimum(run, most - 1)], np.uint64(0)), begins, token)
    longest = int(lengths.max()) if len(lengths) else 1
    prefix = _before((flat.astype(np.uint64) + np.uint64(1)) * bytetext.powers(longest)[depth], begins, token)
    return Places(flat, before, shape, token, depth, leads[token].astype(np.uint64), prefix)


def _before(values: np.ndarray, begins: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Sums of the values before each place in its token."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return upto[:-1] - upto[begins][token] if len(values) else upto[:-1]


def sizes(distinct: int) -> list[int]:
    """Bits of the six tables."""
    grown = max(16, min(21, math.ceil(math.log2(max(1, distinct) * 4))))
    return [min(20, grown), grown, grown, grown, min(18, grown), grown]


def contexts(at: Places) -> list[np.ndarray]:
    """Those of the six tables, as hashes."""
    last = [at.before & np.uint64((1 << 8 * k) - 1) for k in range(5)]
    keys = [last[1] * np.uint64(64) + at.lead, last[2] * np.uint64(64) + at.lead, last[3] * np.uint64(64) + at.lead, last[4], (at.shape * np.uint64(257) + last[1]) * np.uint64(64) + at.lead, at.prefix * np.uint64(64) + at.lead]
    return [(k + np.uint64(n)) * _ODD for n, k in enumerate(keys)]


def grounds(hashed: list[np.ndarray], symbol: np.ndarray, widths: list[int]) -> list[list[np.ndarray]]:
    """For both halves of a byte, where each table has its counts: a bit's slot is the ground XOR ``within``, so a half's slots lie side by side."""
    out = []
    for half in (np.uint64(1), (symbol >> 4).astype(np.uint64) | np.uint64(16)):
        found = []
        for h, width in zip(hashed, widths):
            h = (h ^ (h >> np.uint64(31))) + half * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(29))) * _ODD
            found.append((h >> np.uint64(64 - width)).astype(np.int64))
        out.append(found)
    return out


def within(j: int, node: np.ndarray) -> np.ndarray:
    """The bits of this half byte so far after a one."""
    return node if j < 4 else node & ((1 << j - 4) - 1) | 1 << j - 4


def bits(symbol: np.ndarray):
    """(number, node, bit) for the eight bits of bytes; a node is the bits so far after a one."""
    symbol = symbol.astype(np.int64)
    for j in range(8):
        yield j, 1 << j | symbol >> 8 - j, symbol >> 7 - j & 1


def _count_bits(widths: list[int]):
    """The tables' counts, by chunks, of one task's tokens."""

    def run(batches):
        counts = [np.zeros(2 << w, dtype=np.int64) for w in widths]
        for batch in batches:
            for i in range(0, len(batch), 10_000):
                part = batch.slice(i, 10_000)
                whole, n = places(part.column(0).to_pylist(), np.asarray(part.column(1))), np.asarray(part.column(2))
                for s in range(0, len(whole), POSITIONS):
                    at = whole.part(slice(s, s + POSITIONS))
                    weight, ground = n[at.token], grounds(contexts(at), at.symbol, widths)
                    for j, node, bit in bits(at.symbol):
                        sub = within(j, node)
                        for table, slot in zip(counts, ground[j // 4]):
                            np.add.at(table, 2 * (slot ^ sub) + bit, weight)
        number = 0
        for table in counts:
            for i in range(0, len(table), CHUNK):
                chunk = table[i : i + CHUNK]
                if chunk.any():
                    chunk = chunk.astype(np.min_scalar_type(chunk.max()))  # the smallest integers that hold it
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([chunk.tobytes()], pa.binary())], names=["chunk", "counts"])
                number += 1

    return run


def _add_chunks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=f"u{len(x) // CHUNK}").astype(np.int64) for x in table["counts"].to_pylist())
    return pa.table({"chunk": table["chunk"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


# ---------------------------------------------------------------- the mixer


GATED = (2, 5)


def level(seen: np.ndarray) -> np.ndarray:
    """How often a context was seen, in four steps."""
    return ((seen >= 1).astype(np.uint8) + (seen >= 4) + (seen >= 32)).astype(np.uint8)


class Model:
    """Log odds of the bit counts, the gates' weights and the probability map.

    A table has three log odds for each slot, in parts of 1 / ``SCALE``: of all counts, and of those
    without one zero or without one one, so that an occurrence can be asked without itself.
    """

    def __init__(self, tables: list[np.ndarray], total: int):
        self.widths = [(len(t) // 2).bit_length() - 1 for t in tables]
        self.tables, self.levels = [], {}
        for k, t in enumerate(tables):
            zero, one = (t[c::2].astype(np.float32) for c in (0, 1))
            parts = [np.log((np.maximum(one - c, 0) + _PRIOR) / (np.maximum(zero - b, 0) + _PRIOR)) for b, c in ((1, 0), (0, 1), (0, 0))]
            self.tables.append(np.rint(np.clip(np.stack(parts), -31, 31) * SCALE).astype(np.int16))
            if k in GATED:
                self.levels[k] = level(zero + one)
        self.total = total
        self.weights = np.full((GATES, PREDICTORS + 1), 0.2, dtype=np.float32)
        self.weights[:, BIAS] = 0
        self.map: np.ndarray | None = None

    def inputs(self, ground: list[list[np.ndarray]], j: int, node: np.ndarray, bit: np.ndarray, path: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the predictors with a constant, and the gate; with ``own`` without the occurrence itself.

        ``path``: occurrences under the prefix and the bits of this byte, by number of bits.
        The counts on the side of ``bit`` and on the other one only depend on ``bit`` through
        which is which, so that the odds are those of any coder.
        """
        x = np.empty((PREDICTORS + 1, len(node)), dtype=np.float32)
        x[BIAS] = 0.5
        mine, other = np.maximum(path[j + 1] - own, 0).astype(np.float32), (path[j] - path[j + 1]).astype(np.float32)
        x[WHOLE] = np.log((mine + _PRIOR) / (other + _PRIOR)) * (2 * bit - 1)
        gate = level(mine + other).astype(np.int64)
        sub = within(j, node)
        for k, slot in enumerate(ground[j // 4]):
            slot = slot ^ sub
            x[k] = self.tables[k].take((bit << self.widths[k]) | slot) if own else self.tables[k][2].take(slot)
            if k in GATED:
                gate = gate * 4 + self.levels[k].take(slot)
        x[:WHOLE] /= SCALE
        return x, gate

    def odds(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((x * self.weights.T.take(gate, axis=1)).sum(axis=0), -14, 14)

    def refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one."""
        p = 1 / (1 + np.exp(-z))
        if self.map is None:
            return p
        return (p + self.map.take(node * BINS + bin_of(z))) / 2

    def steps(self, keys: list[bytes], leads: np.ndarray, whole: np.ndarray, path: np.ndarray, offsets: np.ndarray):
        """(places, their prefixes' counts) of tokens, at most ``POSITIONS`` at once however long they are."""
        coded = places(keys, leads)
        for s in range(0, len(coded), POSITIONS):
            at = coded.part(slice(s, s + POSITIONS))
            yield at, counts_along(at, whole, path, offsets, self.total)

    def log10(self, keys: list[bytes], leads: np.ndarray, whole: np.ndarray, path: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        out = np.zeros(len(keys))
        for at, along in self.steps(keys, leads, whole, path, offsets):
            share, ground = np.ones(len(at)), grounds(contexts(at), at.symbol, self.widths)
            for j, node, bit in bits(at.symbol):
                p = self.refined(self.odds(*self.inputs(ground, j, node, bit, along, False)), node)
                share *= np.where(bit == 1, p, 1 - p)
            out += np.bincount(at.token, weights=np.log10(share), minlength=len(keys))
        return out


def counts_along(at: Places, whole: np.ndarray, path: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """Occurrences under the token's first bytes and the first 0 to 8 bits of the next; none beyond ``PREFIX`` bytes.

    ``whole``: each token's own occurrences, which hold where its path has ended.
    """
    out = np.zeros((9, len(at)), dtype=np.int64)
    here = np.flatnonzero(at.depth < PREFIX)
    token = at.token[here]
    begin, end, own = offsets[token], offsets[token + 1], whole[token]
    first = begin + 8 * at.depth[here]
    for j in range(9):
        k = first + j - 1
        out[j, here] = np.where(k < begin, total, np.where(k >= end, own, path[np.clip(k, 0, len(path) - 1)]))
    return out


def bin_of(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * (BINS // 2) / 12), -(BINS // 2), BINS // 2).astype(np.int64) + BINS // 2


def _unpacked(table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, leads, occurrences with the lead, in all, paths and their offsets."""
    column = table.column("path")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    path = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.int64)
    return table.column("key").to_pylist(), table.column("lead").to_numpy(), table.column("n").to_numpy(), table.column("total").to_numpy(), path, offsets - offsets[0]


def _learn_weights(model, step: float = 0.3, size: int = 4096, epochs: int = 1):
    """One shard's weights after online steps, and its number of occurrences."""

    def run(table: pa.Table) -> pa.Table:
        held: Model = model.value
        mine = Model.__new__(Model)
        mine.__dict__.update(held.__dict__, weights=held.weights.copy())
        weights = mine.weights
        table = table.sort_by([("order", "ascending"), ("key", "ascending"), ("lead", "ascending")])
        keys, leads, n, whole, path, offsets = _unpacked(table)
        curve = np.full(weights.shape, 50.0)
        for _ in range(epochs):
            for at, along in mine.steps(keys, leads, whole, path, offsets):
                often = n[at.token].astype(np.float64) ** 0.8
                for s in range(0, len(at), size):
                    part, counts, w = at.part(slice(s, s + size)), along[:, s : s + size], often[s : s + size]
                    ground = grounds(contexts(part), part.symbol, mine.widths)
                    for j, node, bit in bits(part.symbol):
                        x, gate = mine.inputs(ground, j, node, bit, counts, True)
                        p = 1 / (1 + np.exp(-mine.odds(x, gate)))
                        wrong, sure = w * (bit - p), w * np.maximum(p * (1 - p), 1e-3)
                        turn = np.argsort(gate, kind="stable")
                        at_gate, first = np.unique(gate[turn], return_index=True)
                        inputs = x[:, turn]
                        curve[at_gate] += np.add.reduceat(inputs * inputs * sure[turn].astype(np.float32), first, axis=1).T
                        weights[at_gate] += (step * np.add.reduceat(inputs * wrong[turn].astype(np.float32), first, axis=1).T / curve[at_gate]).astype(np.float32)
        return pa.table({"shard": table["shard"][:1], "weights": pa.array([weights.astype(np.float64).tobytes()], pa.binary()), "n": pa.array([int(n.sum())], pa.int64())})

    return run


def _count_map(model):
    """Occurrences of ones and of all under (node, rounded log odds), as bytes."""

    def run(batches):
        held: Model = model.value
        seen = np.zeros((2, 256 * BINS))
        for batch in batches:
            for i in range(0, len(batch), 10_000):
                keys, leads, n, whole, path, offsets = _unpacked(batch.slice(i, 10_000))
                for at, along in held.steps(keys, leads, whole, path, offsets):
                    w, ground = n[at.token], grounds(contexts(at), at.symbol, held.widths)
                    for j, node, bit in bits(at.symbol):
                        where = node * BINS + bin_of(held.odds(*held.inputs(ground, j, node, bit, along, True)))
                        seen[0] += np.bincount(where, weights=w * bit, minlength=256 * BINS)
                        seen[1] += np.bincount(where, weights=w, minlength=256 * BINS)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], names=["seen"])

    return run


def with_paths(counted: DataFrame, ranges: int) -> DataFrame:
    """``counted`` with each token's count in all and exact counts of its beginnings."""
    whole = counted.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lead", "n", "m")).alias("uses"))
    ranged = settle(whole.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()), "mixing-ranges")
    edges = ranged.select("part", "key", "n").groupBy("part").applyInArrow(_edges, EDGES).collect()
    extras = counted.sparkSession.sparkContext.broadcast(beside([tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, e)) for e in edges]))
    found = settle(ranged.groupBy("part").applyInArrow(_with_paths(extras), TOKENS), "mixing-paths")
    unsettle(ranged)
    free_shuffles(counted.sparkSession)
    return found


def train(tokens: DataFrame, distinct: int, total: int) -> Model:
    """From ``tokens`` (TOKENS), of which ``distinct`` occur ``total`` times in training texts."""
    sc = tokens.sparkSession.sparkContext
    widths = sizes(distinct)
    known = tokens.where("n > 0")
    counts = np.zeros((sum(2 << w for w in widths) + CHUNK - 1) // CHUNK * CHUNK + len(widths) * CHUNK, dtype=np.int64)
    starts = np.cumsum([0, *(-(-(2 << w) // CHUNK) for w in widths)])
    for r in known.select("key", "lead", "n").mapInArrow(tidy(_count_bits(widths)), "chunk int, counts binary").groupBy("chunk").applyInArrow(_add_chunks, "chunk int, counts binary").toLocalIterator():
        part = np.frombuffer(r.counts, dtype=np.int64)
        counts[r.chunk * CHUNK : r.chunk * CHUNK + len(part)] = part
    model = Model([counts[a * CHUNK : a * CHUNK + (2 << w)] for a, w in zip(starts, widths)], total)
    del counts
    sent = sc.broadcast(model)
    units = known.count()
    shards = max(1, -(-units // SHARD_TOKENS))
    dealt = known.drop("m").withColumn("order", F.xxhash64("key", "lead")).withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    learned = sorted(dealt.groupBy("shard").applyInArrow(_learn_weights(sent), "shard int, weights binary, n long").collect())
    occurrences = sum(r.n for r in learned)
    if not occurrences:
        return model
    model.weights = sum(np.frombuffer(r.weights).reshape(GATES, PREDICTORS + 1) * (r.n / occurrences) for r in learned).astype(np.float32)
    sent.unpersist()
    del dealt
    free_shuffles(tokens.sparkSession)
    sent = sc.broadcast(model)
    ones, seen = sum(np.frombuffer(r.seen).reshape(2, -1) for r in known.mapInArrow(tidy(_count_map(sent)), "seen binary").collect())
    sent.unpersist()
    centre = np.tile(1 / (1 + np.exp(-(np.arange(BINS) - BINS // 2) * 12 / (BINS // 2))), 256)
    model.map = np.clip((ones + 20 * centre) / (seen + 20), 1e-6, 1 - 1e-6).astype(np.float32)
    return model


def _logs(model):
    def run(batches):
        held: Model = model.value
        for batch in batches:
            for i in range(0, len(batch), 10_000):
                part = batch.slice(i, 10_000)
                keys, leads, _, whole, path, offsets = _unpacked(part)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "lead", "total", "m")), pa.array(held.log10(keys, leads, whole, path, offsets))], names=["key", "lead", "n", "m", "log"])

    return run


# ---------------------------------------------------------------- the scores

SCORED = "row_no long, doc_id long, n_tokens long, known long, log_counts double, score double, n_bytes long, key binary, lead int, weight double, share double"


def repeats(codes: np.ndarray, past: float = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """For each token of a document, the weight of its past and this token's share of it; codes are below the number of tokens."""
    n = len(codes)
    if not n:
        return np.zeros(0), np.zeros(0)
    order = np.argsort(codes.astype(np.uint16) if n <= 1 << 16 else codes, kind="stable")  # short ones are sorted by radix
    first = np.concatenate(([True], codes[order][1:] != codes[order][:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    earlier = np.empty(n)
    earlier[order] = np.arange(n) - start
    before = np.arange(n)
    again = np.cumsum(earlier > 0) - (earlier > 0)
    return past * again / (before + 2), earlier / np.maximum(before, 1)


def _score(frequent, leads: dict[bytes, int], end_log: float, past: float):
    """A row for each document, and one for each of its tokens that isn't frequent."""
    names = [x.split()[0] for x in SCORED.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.float64())

    def run(batches):
        known, counts, logs = frequent.value
        log_counts, shares = np.log10(counts + 1), 10**logs
        for batch in batches:
            _, offs = bytetext.utf8(batch.column(2))
            for i, j in bytetext.slabs(offs):
                rows, ids = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                found: list[tuple] = []
                keys: list[bytes] = []
                rare: list[tuple] = []
                for row, text in zip(rows.to_pylist(), batch.column(2).slice(i, j - i).cast(pa.large_binary())):
                    tokens = (text.as_py() or b"").lower().split()
                    first: dict[bytes, int] = {}
                    codes = np.fromiter(map(first.setdefault, tokens, itertools.count()), np.int64, len(tokens))
                    weight, share = repeats(codes, past)
                    parts = list(segments(tokens, leads))
                    at = np.fromiter(itertools.chain.from_iterable(map(known[lead].get, part, itertools.repeat(-1)) for lead, part in parts), np.int64, len(tokens))
                    new, sure = weight * share == 0, at >= 0  # only the model's share of the mixture is left
                    last = end_log + math.log10(1 - past * int((share > 0).sum()) / (len(tokens) + 2)) + float(np.log10(1 - weight[new]).sum())
                    weight[new] = 0
                    missing = np.flatnonzero(~sure)
                    if len(missing):
                        keys += [tokens[k] + b" " for k in missing.tolist()]
                        by = np.repeat([lead for lead, _ in parts], [len(part) for _, part in parts])
                        rare.append((np.full(len(missing), row), by[missing], weight[missing], share[missing]))
                    held, again = at[sure], sure & ~new
                    w, p = weight[again], shares[at[again]]
                    score = float(logs[at[sure & new]].sum()) + float(np.log10((1 - w) * p + w * share[again]).sum()) + last
                    found.append((len(tokens) + 1, int((counts[held] > 0).sum()), float(log_counts[held].sum()), score, sum(map(len, tokens)) + len(tokens)))
                none = [pa.nulls(len(rows), t) for t in kinds[7:]]
                yield pa.RecordBatch.from_arrays([rows, ids, *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds[2:7])), *none], names=names)
                columns = [np.concatenate(c) for c in zip(*rare)]
                for k in range(0, len(keys), 50_000):
                    some = keys[k : k + 50_000]
                    none = [pa.nulls(len(some), t) for t in kinds[1:7]]
                    row, *others = (c[k : k + 50_000] for c in columns)
                    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *none, pa.array(some, pa.binary()), *(pa.array(c, t) for c, t in zip(others, (pa.int32(), pa.float64(), pa.float64())))], names=names)

    return run


def _frequent(tokens: DataFrame, most: int, leads: int) -> tuple[list[dict[bytes, int]], np.ndarray, np.ndarray]:
    """By lead, the tokens of the highest counts in all texts, as many as are surely at most ``most``; by powers of 2 ** (1/8)."""
    level = F.floor(F.log2("m") * 8).cast("int")
    words = tokens.where(F.col("key") != F.lit(bytes([END])))
    sizes = sorted(((r.level, r.size) for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size")).collect()), reverse=True)
    least, total = None, 0
    for at, size in sizes:
        if total + size > most:
            break
        least, total = at, total + size
    rows = words.where(level >= least).select("key", "lead", "n", "log").toArrow().to_pydict() if least is not None else {"key": [], "lead": [], "n": [], "log": []}
    known: list[dict[bytes, int]] = [{} for _ in range(leads + 1)]
    for i, (key, lead) in enumerate(zip(rows["key"], rows["lead"])):
        known[lead][key[:-1]] = i
    return known, np.array(rows["n"], np.float64), np.array(rows["log"], np.float64)


def modelled(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranges: int | None = None) -> tuple[DataFrame, dict[bytes, int], int, int]:
    """(key, lead, n, m, log) of all tokens, the leads, the number of tokens in training texts, and of distinct ones."""
    spark = docs.sparkSession
    training = fold_of(F.col(id_col).cast("long"), FOLDS) != HELD
    rows = docs.select(F.col(text).cast("string").alias("t"), training.alias("training"))
    short = rows.mapInArrow(tidy(_count_short), "key binary, m long").groupBy("key").agg(F.sum("m").alias("m"))
    leads = {bytes(r.key): k for k, r in enumerate(short.orderBy(F.desc("m"), "key").limit(LEADS).collect(), 1)}
    words = rows.mapInArrow(tidy(_count_tokens(leads)), COUNTED).groupBy("key", "lead").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    ends = rows.agg(F.count_if("training").alias("n"), F.count(F.lit(1)).alias("m")).select(F.lit(bytes([END])).alias("key"), F.lit(0).alias("lead"), "n", "m")
    counted = settle(words.unionByName(ends), "mixing-tokens")
    size = counted.groupBy("key").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.count(F.lit(1)).alias("all")).first()
    if ranges is None:
        ranges = min(RANGES, max(1, -(-size["all"] // RANGE_TOKENS)))
    tokens = with_paths(counted, ranges)
    model = spark.sparkContext.broadcast(train(tokens, size.v, size.n))
    logs = settle(tokens.mapInArrow(tidy(_logs(model)), "key binary, lead int, n long, m long, log double"), "mixing-logs")
    unsettle(counted)
    unsettle(tokens)
    return logs, leads, size.n, size.v


def scored(docs: DataFrame, id_col: str = "doc_id", text: str = "text", frequent: int = FREQUENT, ranges: int | None = None, past: float = REPEATS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each document."""
    sc = docs.sparkSession.sparkContext
    tokens, leads, total, distinct = modelled(docs, id_col, text, ranges)
    end = tokens.where(F.col("key") == F.lit(bytes([END]))).first()
    mass = float(total + distinct + 1)
    known = sc.broadcast(_frequent(tokens, frequent, len(leads)))
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    parts = settle(rows.mapInArrow(tidy(_score(known, leads, end.log, past)), SCORED), "mixing-scored")
    rare = parts.where("key IS NOT NULL").select("row_no", "key", "lead", "weight", "share").join(tokens.select("key", "lead", "n", "log"), ["key", "lead"])
    rare = rare.groupBy("row_no").agg(
        F.sum(F.log10(F.col("n") + 1)).alias("rare_logs"),
        F.count_if(F.col("n") > 0).alias("rare_known"),
        F.sum(F.when(F.col("weight") == 0, F.col("log")).otherwise(F.log10((1 - F.col("weight")) * F.pow(F.lit(10.0), "log") + F.col("weight") * F.col("share")))).alias("rare_score"),
    )
    out = parts.where("key IS NULL").join(rare, "row_no", "left")
    score = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return out.select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(end.n > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0)) + math.log10(end.n + 1) - F.col("n_tokens") * math.log10(mass)).alias("base_score"),
        score.alias("score"),
        (-score * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )

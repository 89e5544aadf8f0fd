"""Language identification by multilingual mixture inference.

Method: each language's distribution over hashed byte trigrams (letters lower-cased in
ASCII, everything that is no letter one blank) is counted over all training rows. A
document's trigrams are then taken to come from a mixture of languages;
expectation-maximisation finds the proportions. Languages leave the set one at a time,
the least first, while the penalised likelihood (log likelihood less half the log of the
number of trigrams for each language, as BIC has it) does not fall. The language with the
largest proportion is the prediction, the proportion its score.

The counts have a fixed size (languages times ``BUCKETS``) and grow in value only; they
are all that reaches the driver. ``LANGUAGES`` bounds the number of languages; a table
with more raises an error.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text if nothing was learned; equal texts get equal predictions; a row with a null id is a
training row or held out as crc32 of the empty text says; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import bytetext
from quadrille.llm.common import fold_of

BUCKETS = 1 << 14
LANGUAGES = 400
FOLDS = 5
STEPS = 12
_MIX = np.uint32(2_654_435_761)

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all trigrams of a slab; each row stands between blanks, runs of blanks are one."""
    rows = len(offs) - 1
    raw = _FOLD[data[offs[0] : offs[-1]]]
    lengths = np.diff(offs)
    row = np.repeat(np.arange(rows), lengths + 2)  # a blank, the text, a blank
    padded = np.full(len(row), 32, dtype=np.uint32)
    padded[np.arange(len(raw)) + np.repeat(2 * np.arange(rows), lengths) + 1] = raw
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32) | (row[1:] != row[:-1])
    c, row = padded[keep], row[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = ((c[:-2] << np.uint32(16)) ^ (c[1:-1] << np.uint32(8)) ^ c[2:]) * _MIX
    whole = (c[1:-1] != 32) & (row[:-2] == row[2:])
    return row[1:-1][whole], (mixed >> np.uint32(32 - 14))[whole].astype(np.int64)


def _count(batches):
    """Counts of trigrams by language, summed over a task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        data, offs = bytetext.utf8(batch.column(0))
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs], dtype=np.int64)
        for i, j in bytetext.slabs(offs):
            row, bucket = trigrams(data, offs[i : j + 1])
            found = np.bincount(code[i:j][row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for k, x in enumerate(names):
                totals[x] = totals[x] + found[k] if x in totals else found[k].copy()
    for lang, found in totals.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["lang", "bucket", "n"])


class Model:
    """log probabilities of buckets for each language, smoothed by one half."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + 0.5
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float64) if len(names) else np.zeros((BUCKETS, 0))


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """From rows with a language whose crc32 of the id modulo 5 is not 0."""
    rows = docs.where((fold_of(F.col(id_col), FOLDS) != 0) & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("lang"))
    summed = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.limit(LANGUAGES * BUCKETS + 1).toPandas()
    names = sorted(found["lang"].unique())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = np.zeros((len(names), BUCKETS))
    counts[found["lang"].map({x: k for k, x in enumerate(names)}).to_numpy(dtype=int), found["bucket"].to_numpy()] = found["n"]
    return Model(names, counts)


def _em(p: np.ndarray, n: np.ndarray, start: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions for each document and its log likelihood.

    p: probabilities of entries (bucket in a document) by language; n: their counts; start:
    the first entry of each document; share: the proportions to begin with.
    """
    total = np.add.reduceat(n, start)
    sizes = np.diff(np.append(start, len(n)))
    for k in range(steps + 1):
        joint = p * np.repeat(share, sizes, axis=0)
        mass = joint.sum(axis=1)
        if k == steps:
            break
        share = np.add.reduceat(joint * (n / mass)[:, None], start, axis=0) / total[:, None]
    return share, np.add.reduceat(n * np.log(mass), start)


def infer(model: Model, data: np.ndarray, offs: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Proportions of languages for each row of a slab; zeros for a row without a trigram."""
    rows, langs = len(offs) - 1, len(model.names)
    out = np.zeros((rows, langs))
    row, bucket = trigrams(data, offs)
    if not langs or not len(row):
        return out
    keys, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    entry_row, p = keys // BUCKETS, model.p[keys % BUCKETS]
    docs, start = np.unique(entry_row, return_index=True)
    n = n.astype(float)
    share, fit = _em(p, n, start, np.full((len(docs), langs), 1 / langs), steps)
    cost = 0.5 * np.log(np.add.reduceat(n, start) + 1)
    out[docs] = share
    active = np.arange(len(docs)) if langs > 1 else np.zeros(0, int)
    while len(active):  # try without the least language, in all documents at once
        smaller = share[active].copy()
        smaller[smaller <= 0] = np.inf
        smaller = np.where(np.arange(langs) == smaller.argmin(axis=1)[:, None], 0, share[active])
        more = (smaller > 0).any(axis=1)
        active, smaller = active[more], smaller[more]
        if not len(active):
            break
        smaller /= smaller.sum(axis=1, keepdims=True)
        pick = np.zeros(len(docs), dtype=bool)
        pick[active] = True
        sizes = np.diff(np.append(start, len(n)))
        mine = np.repeat(pick, sizes)
        begin = np.concatenate(([0], np.cumsum(sizes[active])[:-1]))
        new, new_fit = _em(p[mine], n[mine], begin, smaller, 4)
        better = new_fit >= fit[active] - cost[active]
        active = active[better]
        share[active], fit[active] = new[better], new_fit[better]
    out[docs] = share
    return out


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def _predict(model):
    def run(batches):
        held: Model = model.value
        for batch in batches:
            data, offs = bytetext.utf8(batch.column(1))
            best, score = [], []
            for i, j in bytetext.slabs(offs, bytetext.SLAB_BYTES // 2):
                share = infer(held, data, offs[i : j + 1])
                for r in range(j - i):
                    top = int(share[r].argmax()) if held.names else -1
                    if top >= 0 and share[r, top] > 0 and _has_letter(data[offs[i + r] : offs[i + r + 1]].tobytes()):
                        best.append(held.names[top])
                        score.append(min(1.0, float(share[r, top])))
                    else:
                        best.append("und")
                        score.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text, lang))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score")

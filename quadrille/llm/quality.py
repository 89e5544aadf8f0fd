"""Quality classifier: a sparse rule ensemble.

Method: a text is reduced to a row of statistics. Small gradient-boosted trees over the
statistics of labelled rows are taken apart into their paths, each a conjunction of
comparisons; a logistic regression with an L1 penalty over these rules (and the bounded
statistics themselves) keeps few of them. The rules that stay are compiled into one Spark
column expression, so scoring is a projection.

The fit uses at most ``SAMPLE`` labelled ids, those of the least hash (documented bound);
everything else covers all rows. ``lang``, ``source`` and the id are no inputs.

Defined results: a null or empty text has all statistics zero and gets their score; equal
texts get equal scores; a label that is null teaches nothing; without labelled rows, or
with one class only, every score is the share of good labels (0.5 without any); an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm import bytetext
from quadrille.llm.common import fold_of, settle, tidy

SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS = 5
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "letters", "upper", "digits", "blanks", "newlines", "symbols", "pipes", "stops", "commas",
    "bangs", "high_bytes", "distinct_words", "repeat_next", "distinct_lines", "upper_words", "symbol_words", "long_words", "top_word", "distinct_pairs",
)

_UPPER = slice(65, 91)
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a slab."""
    rows = len(offs) - 1
    out = np.zeros((rows, len(STATISTICS)))
    for r in range(rows):
        raw = data[offs[r] : offs[r + 1]]
        n = len(raw)
        if not n:
            continue
        text = raw.tobytes()
        hist = np.bincount(raw, minlength=256)
        words = text.split()
        m = len(words)
        lines = text.split(b"\n")
        letters = hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum()
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        lead = max(m, 1)
        out[r] = (
            np.log1p(n), np.log1p(m), n / lead, letters / n, hist[_UPPER].sum() / n, hist[48:58].sum() / n, hist[32] / n, hist[10] / n,
            hist[_SYMBOLS].sum() / n, hist[124] / n, hist[46] / n, hist[44] / n, (hist[33] + hist[63]) / n, hist[128:].sum() / n,
            len(counts) / lead, sum(map(bytes.__eq__, words, words[1:])) / lead, len(set(lines)) / len(lines), sum(map(bytes.isupper, words)) / lead,
            m - sum(map(bytes.isalpha, words)), sum(len(w) > 20 for w in words) / lead, max(counts.values(), default=0) / lead, len(set(zip(words, words[1:]))) / max(m - 1, 1),
        )
        out[r, STATISTICS.index("symbol_words")] /= lead
    return out


def _measure(batches):
    for batch in batches:
        data, offs = bytetext.utf8(batch.column(1))
        parts = [statistics(data, offs[i : j + 1]) for i, j in bytetext.slabs(offs)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["doc_id", *STATISTICS])


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(tidy(_measure), "doc_id long, " + ", ".join(f"{x} double" for x in STATISTICS))


# ---------------------------------------------------------------- the fit

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is at most, threshold), all of them hold


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray, least: int, rate: float) -> None:
    """A regression tree of the loss's gradient g and curvature h; its paths go to ``rules``."""
    value = g[rows].sum() / (h[rows].sum() + 1.0)
    best = (1e-6, -1, 0.0)
    if depth and len(rows) >= 2 * least:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        base = total_g**2 / (total_h + 1)
        for k in range(x.shape[1]):
            v = x[rows, k]
            order = np.argsort(v, kind="stable")
            s = v[order]
            cg, ch = np.cumsum(g[rows][order])[:-1], np.cumsum(h[rows][order])[:-1]
            gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - base
            gain[s[1:] <= s[:-1]] = -1
            gain[: least - 1] = gain[len(gain) - least + 1 :] = -1
            i = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[i] > best[0]:
                best = (float(gain[i]), k, float((s[i] + s[i + 1]) / 2))
    if best[1] < 0:
        out[rows] += rate * value
        return
    _, k, at = best
    left = x[rows, k] <= at
    for side, sub in ((True, rows[left]), (False, rows[~left])):
        rules.append(longer := (*path, (k, side, at)))
        _grow(x, g, h, sub, depth - 1, longer, rules, out, least, rate)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, k] <= at) == side for k, side, at in rule])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradients."""
    n, m = a.shape
    step = 4 * n / (np.linalg.norm(a, 2) ** 2 + n)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        r = _sigmoid(a @ vw + vb) - y
        nw = vw - step * (a.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass
class RuleModel:
    """Weighted rules and clipped linear terms: (statistic, low, high, weight)."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[int, float, float, float]] = field(default_factory=list)

    def column(self, prefix: str = "") -> Column:
        """The score as one Spark expression over the statistics, columns or fields of ``prefix``."""
        value = lambda k: F.col(prefix + STATISTICS[k])
        parts = [F.lit(self.intercept)]
        for rule, weight in self.rules:
            tests = [value(k) <= at if side else value(k) > at for k, side, at in rule]
            parts.append(F.when(reduce(lambda p, q: p & q, tests), F.lit(weight)).otherwise(F.lit(0.0)))
        for k, low, high, weight in self.linear:
            parts.append(F.least(F.greatest(value(k), F.lit(low)), F.lit(high)) * weight)
        return 1 / (1 + F.exp(-reduce(lambda p, q: p + q, parts)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.001) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return RuleModel(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    rules: list[Rule] = []
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    least = max(3, len(y) // 400)
    for _ in range(trees):
        p = _sigmoid(z)
        _grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, (), rules, z, least, 0.3)
    rules = list(dict.fromkeys(rules))
    inside = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    keep = (inside.mean(axis=0) > 0) & (inside.mean(axis=0) < 1)
    rules, inside = [r for r, k in zip(rules, keep) if k], inside[:, keep]
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    spread = np.where(high > low, high - low, 1.0)
    straight = (np.clip(x, low, high) - low) / spread * 0.4
    w, b = _lasso(np.concatenate([inside, straight], axis=1), y, penalty)
    model = RuleModel(b)
    for rule, weight in zip(rules, w[: len(rules)]):
        if weight:
            model.rules.append((rule, float(weight)))
    for k, weight in enumerate(w[len(rules) :]):
        if weight and high[k] > low[k]:
            model.linear.append((k, float(low[k]), float(high[k]), float(weight * 0.4 / spread[k])))
            model.intercept -= float(weight * 0.4 / spread[k] * low[k])
    return model


def chosen(ids: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> DataFrame:
    """(doc_id, y): labelled ids of ``ids`` (doc_id) whose crc32 modulo 5 is not 0, at most ``sample``, by the least hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
    there = ids.select("doc_id").where(fold_of(F.col("doc_id"), FOLDS) != 0)
    return known.distinct().join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)


def train(stats: DataFrame, taught: DataFrame) -> RuleModel:
    """From the rows of ``stats`` whose ids are in ``taught``, which ``chosen`` bounds; an id that repeats counts once, with its least statistics."""
    held = F.broadcast(taught)
    rows = stats.join(held, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("doc_id", "y", "s.*").toPandas()
    rows = rows.sort_values(["doc_id", "y"]).to_numpy(dtype=float)
    return fit(rows[:, 2:], (rows[:, 1] > 0.5).astype(float))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    stats = settle(measured(docs, id_col, text), "quality-statistics")
    score = train(stats, settle(chosen(stats, labels, sample), "quality-taught")).column()
    out = stats.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the classifier rejects.

    Only the texts that teach are measured for the fit. Then each text is measured once,
    in a worker that gives its statistics back and not the text, and the compiled score
    filters the rows where they lie. All rows of one text stay or go together.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    taught = settle(chosen(ids, labels, sample), "quality-taught")
    lessons = docs.join(F.broadcast(taught.select(F.col("doc_id").alias("__taught")).distinct()), F.col(id_col).cast("long") == F.col("__taught"), "left_semi")
    score = train(measured(lessons, id_col, text), taught).column("__statistics.")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn("__statistics", _measured_column()(F.col(text).cast("string"))).where(score >= threshold).select(*names)


def _measured_column():
    """The statistics of a text column as one struct."""

    @F.arrow_udf(", ".join(f"{x} double" for x in STATISTICS))
    def measure(texts: pa.Array) -> pa.Array:
        data, offs = bytetext.utf8(texts)
        parts = [statistics(data, offs[i : j + 1]) for i, j in bytetext.slabs(offs)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        return pa.StructArray.from_arrays([pa.array(x[:, k]) for k in range(x.shape[1])], names=list(STATISTICS))

    return measure.asNondeterministic()  # so that it is not evaluated once for each use


def predict(model: RuleModel, x: np.ndarray) -> np.ndarray:
    """What ``RuleModel.column`` gives, over an array."""
    z = np.full(len(x), model.intercept)
    for rule, weight in model.rules:
        z += weight * holds(rule, x)
    for k, low, high, weight in model.linear:
        z += weight * np.clip(x[:, k], low, high)
    return 1 / (1 + np.exp(-z))

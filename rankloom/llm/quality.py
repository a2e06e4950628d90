"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small boosted trees are grown on statistics of a bounded sample of labelled rows; every
path from a root is a rule, a conjunction of thresholds.  A logistic model with a lasso
penalty keeps few of the rules, and the fitted model is compiled into one Spark column
expression, so scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import bounded_batches, drop, holding, kept, some_rows

_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-", b"!?", b"#$%&*@", b"|/\\<>[]{}=_~^`+")
_OTHER_ASCII, _WIDE = len(_CLASSES), len(_CLASSES) + 1
_CLASS = bytes(next((k for k, c in enumerate(_CLASSES) if b in c), _WIDE if b >= 0x80 else _OTHER_ASCII) for b in range(256))
N_CLASS = _WIDE + 1

#: Names of the statistics, in the order of the array.
STATS = (
    "log_chars", "log_words", "mean_word", "long_words", "short_words", "lower", "upper", "digit", "space", "newline", "stop_marks", "loud_marks", "signs", "brackets", "other", "wide",
    "distinct_words", "top_word", "twice_running", "words_ending_sign", "words_ending_loud", "words_all_upper", "words_with_digit", "lines", "mean_line", "distinct_lines", "lines_ending_stop", "distinct_pairs",
)


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner (sorted): number of distinct values, count of the most frequent one."""
    many, top = np.zeros(n), np.zeros(n)
    if len(value):
        order = np.lexsort((value, owner))
        o, v = owner[order], value[order]
        at = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])])
        many = np.bincount(o[at], minlength=n).astype(float)
        np.maximum.at(top, o[at], np.diff(np.r_[at, len(o)]))
    return many, top


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATS for each text; an empty text has zeros throughout."""
    n = len(texts)
    raw = b" ".join(texts) + b" "
    length = np.array([len(t) for t in texts], np.int64)
    bounds = np.r_[0, np.cumsum(length + 1)]
    classes = np.frombuffer(raw.translate(_CLASS), np.uint8)
    owner = np.repeat(np.arange(n), length + 1)
    count = np.bincount(owner * N_CLASS + classes, minlength=n * N_CLASS).reshape(n, N_CLASS).astype(float)
    count[:, 3] -= 1  # the blank between texts
    size = np.maximum(length, 1)
    share = count / size[:, None]
    h, start, end, first, joined = W.words(texts)
    words = np.diff(first).astype(float)
    many = np.maximum(words, 1)
    of = np.repeat(np.arange(n), np.diff(first))
    long = (end - start).astype(float)
    per = lambda x: np.bincount(of, x, n) / many
    last = classes[end - 1] if len(end) else classes[:0]
    upper = np.r_[0, np.cumsum(classes == 1)]
    digit = np.r_[0, np.cumsum(classes == 2)]
    letters = np.r_[0, np.cumsum(classes <= 1)]
    within = lambda c: c[end] - c[start]
    distinct, top = _distinct(of, h, n)
    same = np.r_[False, (h[1:] == h[:-1]) & (of[1:] == of[:-1])] if len(h) else np.zeros(0, bool)
    pair = W.windows(h, 2)
    pair_of = of[:-1] if len(of) else of
    inside = of[1:] == pair_of if len(of) else np.zeros(0, bool)
    pairs, _ = _distinct(pair_of[inside], pair[inside], n) if len(pair) else (np.zeros(n), None)
    # lines: runs without a line break inside one text
    buf = np.frombuffer(joined, np.uint8)
    stop = buf == 10
    stop = stop.copy()
    stop[bounds[1:] - 1] = True
    line_end = np.flatnonzero(stop)
    line_start = np.r_[0, line_end[:-1] + 1]
    filled = line_end > line_start
    line_start, line_end = line_start[filled], line_end[filled]
    line = W.names(joined, W.prefix_hash(buf), line_start, line_end)
    line_of = owner[line_start] if len(line_start) else np.zeros(0, np.int64)
    lines = np.bincount(line_of, minlength=n).astype(float)
    distinct_lines, _ = _distinct(line_of, line, n)
    ending = classes[line_end - 1] if len(line_end) else classes[:0]
    out = np.column_stack([
        np.log1p(length), np.log1p(words), per(long), per(long > 14), per(long < 3), share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], share[:, 7], share[:, 8], share[:, 9], share[:, 10],
        distinct / many, top / many, per(same), per(last == 7), per(last == 6), per((within(upper) == within(letters)) & (within(upper) > 1)), per(within(digit) > 0), np.log1p(lines), np.log1p(length / np.maximum(lines, 1)),
        distinct_lines / np.maximum(lines, 1), np.bincount(line_of, (ending == 5) | (ending == 6), n) / np.maximum(lines, 1), pairs / np.maximum(words - 1, 1),
    ])
    out[length == 0] = 0
    return out


def with_statistics(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with one more column, array<double>: the text's statistics.  Null text is empty."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    def run(batches):
        for batch in batches:
            for row, texts in W.chunks(batch.column(at)):
                own = batch.slice(row, len(texts))
                stats = statistics(texts)
                lists = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * stats.shape[1], stats.ravel())
                yield pa.RecordBatch.from_arrays([*own.columns, lists], names)

    at = docs.columns.index(text_col)
    names = [*docs.columns, name]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))]))


@dataclass
class Rules:
    """A fitted ensemble: rules as tuples of (statistic, is greater, threshold), their weights and the intercept."""

    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def column(self, stats: Column) -> Column:
        """The score as a Spark expression over an array of statistics."""
        terms = [F.lit(self.intercept)]
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = reduce(lambda a, b: a & b, [stats[k] > t if greater else stats[k] <= t for k, greater, t in rule])
            terms.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # a balanced sum: the expression stays shallow
            terms = [terms[k] + terms[k + 1] if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)]
        return 1.0 / (1.0 + F.exp(-terms[0]))

    def score(self, stats: np.ndarray) -> np.ndarray:
        z = np.full(len(stats), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * _holds(rule, stats)
        return 1 / (1 + np.exp(-z))


def _holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, greater, t in rule:
        out &= x[:, k] > t if greater else x[:, k] <= t
    return out


def _paths(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, curve: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, least: int, path: tuple, out: list, step: np.ndarray) -> None:
    """Grows one tree from the rows, adds each path to ``out`` and the leaf values to ``step``."""
    g, c = residual[rows], curve[rows]
    best = None
    if len(rows) >= 2 * least and len(path) < depth:
        whole = g.sum() ** 2 / (c.sum() + 1e-3)
        for k in features:
            if not len(cuts[k]):
                continue
            n = len(cuts[k]) + 1
            b = bins[rows, k]
            left_g, left_c, left_n = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (g, c, np.ones(len(b))))
            ok = (left_n >= least) & (len(rows) - left_n >= least)
            if ok.any():
                gain = np.where(ok, left_g**2 / (left_c + 1e-3) + (g.sum() - left_g) ** 2 / (c.sum() - left_c + 1e-3) - whole, -1)
                at = int(gain.argmax())
                if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                    best = (gain[at], int(k), at)
    if best is None:
        step[rows] = g.sum() / (c.sum() + 1e-3)
        return
    _, k, at = best
    under = bins[rows, k] <= at
    for greater in (False, True):
        longer = (*path, (k, greater, float(cuts[k][at])))
        out.append(longer)
        _paths(x, bins, cuts, residual, curve, rows[under != greater], features, depth, least, longer, out, step)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, base: float = 0.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean logistic loss plus ``penalty`` times the weights' sizes, by accelerated proximal gradient steps."""
    w, b, v, c, t = np.zeros(a.shape[1], np.float32), base, np.zeros(a.shape[1], np.float32), base, 1.0
    top = float(np.linalg.norm(a[:2000].T @ a[:2000], 2)) / max(1, min(2000, len(a))) if a.shape[1] else 1.0
    rate = 1 / (0.25 * (1.5 * top + 1))
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(a @ v + c))) - y).astype(np.float32)
        new = v - rate * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * float(r.mean())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, penalty: float = 0.002, seed: int = 11) -> Rules:
    """Boosted trees to rules, rules to sparse logistic weights.  One class only or no rows: a constant score."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1.0) / (len(y) + 2.0) if len(y) else 0.5
        return Rules(intercept=float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    cuts = []
    for k in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        cuts.append(v[v < x[:, k].max()])
    binned = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    z, found = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        features = rng.permutation(x.shape[1])[: max(2, x.shape[1] * 2 // 3)]
        step = np.zeros(len(y))
        _paths(x, binned, cuts, y - p, p * (1 - p), rows, features, depth, max(5, len(y) // 400), (), found, step)
        z += rate * np.clip(step, -4, 4)
    rules = list(dict.fromkeys(tuple(sorted(set(r))) for r in found))
    holds = np.column_stack([_holds(r, x) for r in rules]).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    mean, scale = holds.mean(0), holds.std(0)
    use = scale > 0
    rules, holds, mean, scale = [r for r, u in zip(rules, use, strict=True) if u], holds[:, use], mean[use], scale[use]
    a = (holds - mean) / scale
    w, b = lasso(a, y, penalty, base)
    keep = np.flatnonzero(w)
    weights = (w / scale).astype(float)
    return Rules([rules[k] for k in keep], [float(weights[k]) for k in keep], float(b - (weights * mean).sum()))


def is_held_out(id_column: Column, modulus: int = 3, remainder: int = 1) -> Column:
    """crc32 of the id as text, modulo; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most_rows: int = 40_000) -> Rules:
    """Fits on the labelled rows that are not held out, or about ``most_rows`` of them by a hash of their ids.

    ``stats``: (id, stats).  Rows without a label of 0 or 1 don't count; a document with
    several labels counts once for each.
    """
    wanted = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & ~is_held_out(F.col("_id")))
    rows = kept(stats.join(wanted, stats["id"] == wanted["_id"]).select("id", "stats", "_y"), "labelled")
    labelled = rows
    rows = some_rows(rows, F.xxhash64("id", "_y"), most_rows)
    drop(labelled)
    rows.sort(key=lambda r: (r["id"], r["_y"], r["stats"]))
    x = np.array([r["stats"] for r in rows], float).reshape(len(rows), len(STATS))
    return fit(x, np.array([r["_y"] for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 40_000) -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted.  Null texts are empty and scored like them; repeated rows are scored each."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    stats = kept(with_statistics(rows, "text", "stats").select("id", "stats"), "statistics")
    model = train(stats, labels, id_col, most_rows=most_rows)
    out = stats.select(F.col("id").alias("doc_id"), is_held_out(F.col("id")).alias("held_out"), model.column(F.col("stats")).alias("score"))
    return holding(out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), stats)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 40_000) -> DataFrame:
    """Rows of ``docs``, all columns, that the classifier doesn't reject.  The texts are not moved: labels come to the statistics, scores are a projection."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = train(with_statistics(rows, "text", "stats").select("id", "stats"), labels, id_col, most_rows=most_rows)
    name = "_stats"
    while name in docs.columns:
        name += "_"
    return with_statistics(docs, text_col, name).where(model.column(F.col(name)) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])

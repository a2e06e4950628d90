"""Linear rankers over vector columns: ridge, principal components, pairwise logistic, corpus scoring.

Sums over the corpus (Gram matrices, means) are partial sums of blocks in the executors,
reduced by Spark; only matrices of the vectors' width reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import vectors as V
from rankloom.sources.store import drop, kept

EPS = 1e-9


@dataclass
class LinearModel:
    """Standardised principal components and weights, the last of which is an intercept."""

    mean: np.ndarray
    V: np.ndarray
    zmu: np.ndarray
    zsd: np.ndarray
    w: np.ndarray
    lam: float = 1.0

    def row(self) -> tuple:
        return tuple(np.asarray(x, float).ravel().tolist() for x in (self.mean, self.V, self.zmu, self.zsd, self.w)) + (float(self.lam),)

    @staticmethod
    def from_row(r) -> LinearModel:
        mean = np.array(r["mean"])
        return LinearModel(mean, np.array(r["V"]).reshape(len(mean), -1), np.array(r["zmu"]), np.array(r["zsd"]), np.array(r["w"]), r["lam"])

    def collapsed(self) -> tuple[np.ndarray, float]:
        """The one weight vector and bias on raw vectors that the steps amount to."""
        scaled = self.w[:-1] / self.zsd
        weight = self.V @ scaled
        return weight, float(self.w[-1] - self.mean @ weight - self.zmu @ scaled)

    def features(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.V - self.zmu) / self.zsd


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + EPS


def _summed(batches):
    """One row with the sum of all rows' arrays."""
    total = None
    for b in batches:
        for part in b.column("part"):
            x = np.frombuffer(part.as_py())
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def _total(rows: DataFrame, run, fan_in: int = 16) -> np.ndarray:
    """The sum of the arrays of doubles that ``run`` gives, one binary row for each task: a tree of sums, so the driver gets at most ``fan_in`` of them."""
    n = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    parts = rows.coalesce(n).mapInArrow(run, "part binary")
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(_summed, "part binary")
    found = [np.frombuffer(r["part"]) for r in parts.toLocalIterator()]
    return np.sum(found, 0) if found else np.zeros(0)


def gram(df: DataFrame, vector: str, target: str | None = None, normalise: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """X'X, X'y, the column sums and the row count; null vectors are skipped.  ``normalise``: of unit vectors.

    Each task holds one matrix of the vectors' width squared and gives it out as one row;
    there are at most as many tasks as the cluster runs at a time.
    """

    def run(batches):
        total = None
        for b in batches:
            x = _matrix(b.column("v"))
            if not len(x):
                continue
            if normalise:
                x /= _lengths(x)
            y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
            part = np.concatenate([[x.shape[1], len(x)], x.T @ y, x.sum(0), (x.T @ x).ravel()])
            if total is None:
                total = part
            else:
                total[1:] += part[1:]
        if total is not None:
            # sums of the width are told from it by their count
            yield pa.RecordBatch.from_arrays([pa.array([np.r_[1.0, total].tobytes()], pa.binary())], ["part"])

    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"), (F.col(target) if target else F.lit(0.0)).cast("double").alias("y"))
    flat = _total(rows, run)
    if not len(flat):
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0
    d, n = round(flat[1] / flat[0]), round(flat[2])
    xy, total, xx = flat[3 : 3 + d], flat[3 + d : 3 + 2 * d], flat[3 + 2 * d :]
    return xx.reshape(d, d), xy, total, n


def ridge(df: DataFrame, vector: str, target: str, lam: float = 1.0) -> np.ndarray:
    """Weights of the ridge regression of ``target`` on unit vectors, without intercept."""
    xx, xy, _, n = gram(df, vector, target, normalise=True)
    if not n:
        raise ValueError("no vectors to learn from")
    return np.linalg.solve(xx + lam * np.eye(len(xx)), xy)


def linear_score(df: DataFrame, vector: str, weights, bias: float = 0.0, name: str = "score", normalise: bool = False) -> DataFrame:
    """A column with the inner product of the vectors, or unit vectors, and the weights; null for a null vector."""
    v = V.doubles(F.col(vector))
    score = V.dot(v, V.literal(weights))
    return df.withColumn(name, (score / (V.norm(v) + F.lit(EPS)) if normalise else score) + F.lit(float(bias)))


def projected(df: DataFrame, id_col: str, vector: str, model: LinearModel, name: str = "projected") -> DataFrame:
    """(id, name): the vectors' standardised components, by one matrix product for each Arrow batch; null vectors are left out."""
    scale = model.V / model.zsd
    shift = model.mean @ scale + model.zmu / model.zsd

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            z = x @ scale - shift if len(x) else np.zeros((0, scale.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * scale.shape[1], z.ravel())], [id_col, name])

    rows = df.where(F.col(vector).isNotNull()).select(id_col, vector)
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{name}` array<double>")


def mean_std(df: DataFrame, vector: str) -> DataFrame:
    """(place, mean, std) of every coordinate; the population deviation plus 1e-9."""
    cells = df.select(F.posexplode(V.doubles(F.col(vector))).alias("place", "x"))
    return cells.groupBy("place").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + 1e-9).alias("std"))


def principal(df: DataFrame, vector: str, k: int = 64) -> LinearModel:
    """Centred principal components, at most k, and the scale of each; weights are zero yet."""
    xx, _, total, n = gram(df, vector)
    if not n:
        raise ValueError("no vectors")
    mean = total / n
    values, axes = np.linalg.eigh(xx - n * np.outer(mean, mean))
    k = min(k, n, len(mean))
    axes = axes[:, ::-1][:, :k]
    std = np.sqrt(np.maximum(values[::-1][:k], 0) / n) + 1e-9
    return LinearModel(mean, axes, np.zeros(k), std, np.zeros(k + 1))


def edge_diff(decisions: DataFrame, vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(a_id, b_id, x, y): the difference of the two ends' vectors, and 1 where the first won; ends without vectors drop out."""
    own = vectors.where(F.col(vector).isNotNull())
    a = own.select(F.col(id_col).alias("a_id"), V.doubles(F.col(vector)).alias("va"))
    b = own.select(F.col(id_col).alias("b_id"), V.doubles(F.col(vector)).alias("vb"))
    return decisions.join(a, "a_id").join(b, "b_id").select("a_id", "b_id", V.minus(F.col("va"), F.col("vb")).alias("x"), (F.col("winner") == "A").cast("double").alias("y"))


def pairwise_logistic(diffs: DataFrame, steps: int = 800, rate: float = 0.5, driver_bytes: int = 256 << 20) -> np.ndarray:
    """Weights after full-batch gradient steps of the ridge-penalised logistic model of (x, y); none without rows.

    Differences of up to ``driver_bytes`` are held on the driver; beyond, each step sums
    the gradient over the executors.
    """
    table = kept(diffs.select("x", "y"), "diffs")
    n, d = table.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return np.zeros(0)
    w = np.zeros(d)
    if n * (d + 1) * 8 <= driver_bytes:
        rows = table.toArrow()
        x, y = _matrix(rows.column("x").combine_chunks()), rows.column("y").to_numpy()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(x @ w)))
            w -= rate * (x.T @ (p - y) / n + w / n)
    else:
        for _ in range(steps):
            shared = table.sparkSession.sparkContext.broadcast(w)

            def run(batches, shared=shared):
                total = np.zeros(len(shared.value))
                for b in batches:
                    x = _matrix(b.column("x"))
                    if len(x):
                        total += x.T @ (1 / (1 + np.exp(-(x @ shared.value))) - b.column("y").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

            w = w - rate * (_total(table, run) / n + w / n)
            shared.destroy()
    drop(table)
    return w


def fit_preference(vectors: DataFrame, decisions: DataFrame, id_col: str, vector: str, k: int = 64, steps: int = 800) -> LinearModel:
    """The preference model: components of the candidates' vectors, and logistic weights of the decided differences; zero weights without a decision between candidates with vectors."""
    model = principal(vectors, vector, k)
    learned = pairwise_logistic(edge_diff(decisions, projected(vectors, id_col, vector, model), id_col, "projected"), steps)
    if len(learned):
        model.w = np.r_[learned, 0.0]
    return model


def preference_scores(model: LinearModel, df: DataFrame, vector: str, name: str = "model_score") -> DataFrame:
    """Scores of any table's vectors: one inner product per row; 0 without a vector."""
    weight, bias = model.collapsed()
    out = linear_score(df, vector, weight, bias, name)
    return out.withColumn(name, F.coalesce(name, F.lit(0.0)))

"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a text's 5-word shingles.  Sketches of
parts merge to the sketch of the whole; two sketches give resemblance, containment and
the number of distinct shingles.  With fewer than k shingles all of these are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .numbering import numbered
from .store import bounded_batches

K = 128


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct hashes."""
    return shingles[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of all parts together."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.empty(0, np.uint64)


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(s)) if len(s) < k else (k - 1) / (float(s[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of two shingle sets, 0 to 1; of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    union = np.r_[True, ~twice]
    rank = np.cumsum(union)  # how many distinct values there are up to each place
    of_both = np.flatnonzero(twice) + 1
    size = min(k, int(rank[-1]))
    return float((rank[of_both] <= size).sum()) / size


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has, 0 to 1; of an empty a 1."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j / (1 + j) * (distinct(a, k) + distinct(b, k)) / distinct(a, k))


def encode(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def _sketches(texts: list[bytes], k: int) -> list[np.ndarray]:
    out, held, total = [], [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= 1 << 20:
            out += [s[:k].copy() for s in W.shingle_sets(held)]
            held, total = [], 0
    return out + [s[:k].copy() for s in W.shingle_sets(held)] if held else out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, fingerprint) per row of ``docs``; null text is empty, empty texts have the empty fingerprint."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for row, texts in W.chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(texts)), pa.array([encode(s) for s in _sketches(texts, k)])], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def _cut(u: Column, cuts: list[int], base: int = 0) -> Column:
    """How many cuts are at most u, by halving."""
    if not cuts:
        return F.lit(base)
    m = len(cuts) // 2
    return F.when(u < cuts[m], _cut(u, cuts[:m], base)).otherwise(_cut(u, cuts[m + 1 :], base + m + 1))


def with_next(rows: DataFrame, per_partition: int = 4) -> tuple[DataFrame, int]:
    """Rows (u, id, text) with a column part, plus each part's following row marked tail = 1; the number of partitions.

    Parts are ranges of u.  The first row of each part, as many as parts, is copied to
    the part before it; the first of all follows the last.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    q = rows.stat.approxQuantile("u", [k / (n * per_partition) for k in range(1, n * per_partition)], 0.2 / (n * per_partition))
    cuts = sorted({int(x) for x in q})
    parted = rows.withColumn("part", _cut(F.col("u"), cuts))
    heads = sorted((r["part"], r["u"]) for r in parted.groupBy("part").agg(F.min("u").alias("u")).collect())
    if not heads:
        return parted.withColumn("tail", F.lit(0)), n
    before = {u: heads[j - 1][0] for j, (_, u) in enumerate(heads)}
    copies = rows.where(F.col("u").isin(*before))
    part = F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), F.col("u"))
    return parted.withColumn("tail", F.lit(0)).unionByName(copies.withColumn("part", part).withColumn("tail", F.lit(1))), n


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COMPARED = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double"


def _compared(k: int):
    def out(rows: list[tuple], last: tuple) -> Iterable[pa.RecordBatch]:
        """rows: (id, text, sketch) in order, each followed by the next or by last."""
        texts = [edited(a[1], b[1]) for a, b in zip(rows, [*rows[1:], last], strict=True)]
        raw = [t.encode() for t in texts]
        new = _sketches(raw, k)
        columns = [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
            pa.array([encode(r[2]) for r in rows]), pa.array([encode(s) for s in new]),
            pa.array([resemblance(r[2], s, k) for r, s in zip(rows, new, strict=True)], pa.float64()),
            pa.array([resemblance(a[2], b[2], k) for a, b in zip(rows, [*rows[1:], last], strict=True)], pa.float64()),
            pa.array([distinct(r[2], k) for r in rows], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _COMPARED.split(", ")])

    def run(batches):
        held: list[tuple] = []  # rows of one part whose next row has not come yet: the last one of what was seen
        part = None
        for batch in batches:
            parts, tails, ids = (batch.column(c).to_pylist() for c in ("part", "tail", "id"))
            for row, texts in W.chunks(batch.column("text")):
                sketches = _sketches(texts, k)
                for j, (t, s) in enumerate(zip(texts, sketches, strict=True)):
                    if parts[row + j] != part:
                        assert not held, "a part ends with the row that follows it"
                        part = parts[row + j]
                    if tails[row + j]:
                        if held:
                            yield from out(held, (ids[row + j], t.decode("utf-8", "replace"), s))
                        held = []
                    else:
                        held.append((ids[row + j], t.decode("utf-8", "replace"), s))
                if len(held) > 1:
                    yield from out(held[:-1], held[-1])
                    held = held[-1:]

    return run


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per row of ``docs`` its fingerprint, that of its edited text, and likeness to the edited and to the next text.

    The next row is the one with the next id (equal ids and null ids, which come first,
    by text); the first follows the last, and a single row follows itself.  Null text is
    empty; two empty texts have likeness 1.  Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows, n = with_next(numbered(docs, id_col, text_col))
    ordered = rows.select("part", "tail", "u", "id", "text").repartition(n, "part").sortWithinPartitions("part", "tail", "u")
    return ordered.mapInArrow(_compared(k), _COMPARED).withColumnRenamed("id", "doc_id")

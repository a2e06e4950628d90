"""Removal of repeated byte strings by distributed prefix doubling over ranked positions.

A position's rank names the string that begins there; equal ranks, equal strings.
Sorting (rank, rank at an offset) pairs doubles the length that ranks stand for.
Two exact reductions keep the sorted set far below one row per byte:

* Round 0 ranks sampled positions only.  Every window of ``length`` bytes picks the
  smallest-hash ``gram`` inside it (leftmost on ties), so equal windows pick equal
  grams at equal offsets; a run of windows with one pick is one row.  Runs whose gram
  is unique in the corpus are out.  Runs whose whole context equals another's are
  settled at once: all but the first occurrence repeat.
* Round 1 does the same with cells of a few windows, ranked by the bytes that all windows
  of a cell share: a cell whose shared bytes are unique is out.
* What is left, windows at the edges of repeats, is ranked at every position: names of
  ``base`` bytes first, then Spark sorts rank pairs at offsets base, 2 * base, ...
  dropping positions whose pair is unique and reranking the others, until ranks stand for
  ``length`` bytes.  Where ``length`` is ``base`` times a power of two, a position brings the
  names of its later parts along, and each round pairs them too; else ranks at an offset
  are looked up by a join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .numbering import numbered
from .store import bounded_batches, drop, holding, kept

_POS = 24
_LOW = np.uint64((1 << _POS) - 1)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if width > have else v


def _runs(texts: list[bytes], length: int, gram: int):
    """Of each run of windows with one picked gram: text index, first window start, windows, the gram's offset in the first, gram hash, context hash."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < length:
        return None
    h, inverse = W.prefix_hash(buf)
    name = lambda s, e: W.mix((h[e] - h[s]) * inverse[s] + (e - s).astype(np.uint64))
    at = np.arange(len(buf) - gram + 1)
    key = (name(at, at + gram) & ~_LOW) | at.astype(np.uint64)
    pick = (_sliding_min(key, length - gram + 1) & _LOW).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.r_[0, ends[:-1]]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(pick)]
    valid = np.arange(len(pick)) + length <= ends[owner]
    s = np.flatnonzero(valid)
    if not len(s):
        return None
    cut = np.flatnonzero(np.r_[True, (pick[s[1:]] != pick[s[:-1]]) | (owner[s[1:]] != owner[s[:-1]])])
    s0, n = s[cut], np.diff(np.r_[cut, len(s)])
    p = pick[s0]
    context = W.mix(name(s0, s0 + n - 1 + length) ^ W.mix(((p - s0) * 65536 + n).astype(np.uint64)))
    return owner[s0], s0 - starts[owner[s0]], n, p - s0, name(p, p + gram), context


def _pieces(u: np.ndarray, texts: list[bytes], length: int):
    """Texts of under half of the places that _runs can tell apart; longer ones in overlapping pieces, so that each window is in one piece."""
    most = 1 << (_POS - 1)
    out_u, out_at, out = [], [], []
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), most):
            out_u.append(u[k]), out_at.append(at), out.append(t[at : at + most + length - 1])
    return np.array(out_u, np.int64), np.array(out_at, np.int64), out


def _groups(pieces: list[bytes]):
    """(first, end) of runs of pieces whose places together fit in _POS bits."""
    first, total = 0, 0
    for k, t in enumerate(pieces):
        if k > first and total + len(t) > 1 << _POS:
            yield first, k
            first, total = k, 0
        total += len(t)
    if pieces:
        yield first, len(pieces)


_RUN = "key long, context long, u long, start int, n int, offset int"


def _first(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Of sorted rows: whether any column differs from the row before."""
    differs = np.zeros(len(order), bool)
    differs[:1] = True
    for c in columns:
        c = c[order]
        differs[1:] |= c[1:] != c[:-1]
    return differs


def _merged(u: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans joined where they overlap or touch."""
    order = np.lexsort((start, u))
    u, start, end = u[order], start[order], end[order]
    if not len(u):
        return u, start, end
    # a running maximum of ends within each document, by shifting documents apart
    _, doc = np.unique(u, return_inverse=True)
    shift = doc.astype(np.int64) << 32
    top = np.maximum.accumulate(end + shift)
    new = np.r_[True, (start + shift)[1:] > top[:-1]]
    at = np.flatnonzero(new)
    return u[at], start[at], top[np.r_[at[1:] - 1, len(u) - 1]] - shift[at]


def _combined(length: int, key, context, u, start, n, offset) -> pa.RecordBatch:
    """Runs with one key and context in this batch but the first are settled here; they pass the exchange as merged spans (n < 0)."""
    order = np.lexsort((start, u, context, key))
    first = _first(order, key, context)
    keep, rest = order[first], order[~first]
    mu, ms, me = _merged(u[rest], start[rest], start[rest] + n[rest] - 1 + length)
    none = np.zeros(len(mu), np.int64)
    columns = (
        np.r_[key[keep], W.mix(mu.view(np.uint64)).view(np.int64)], np.r_[context[keep], none], np.r_[u[keep], mu],
        np.r_[start[keep], ms].astype(np.int32), np.r_[n[keep], ms - me].astype(np.int32), np.r_[offset[keep], none].astype(np.int32),
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "context", "u", "start", "n", "offset"])


def _gathered(length: int, parts_of, most: int = 1 << 18):
    """mapInArrow function: runs of texts from ``parts_of``, combined over some hundred thousand at a time."""

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for part in parts_of(batch):
                held.append(part)
                total += len(part[0])
                if total >= most:
                    yield _combined(length, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, total = [], 0
        if held:
            yield _combined(length, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _sampled(length: int, gram: int):
    """Round 0: one row for each run of windows that pick one gram."""

    def parts_of(batch):
        ids = batch.column("u").to_numpy(zero_copy_only=False)
        for first, texts in W.chunks(batch.column("text")):
            u, at, pieces = _pieces(ids[first : first + len(texts)], texts, length)
            for a, b in _groups(pieces):
                if (found := _runs(pieces[a:b], length, gram)) is not None:
                    owner, start, n, offset, key, context = found
                    yield key.view(np.int64), context.view(np.int64), u[a:b][owner], start + at[a:b][owner], n, offset

    return _gathered(length, parts_of)


def _cells(length: int, width: int):
    """Round 1: runs in cells of ``width`` windows, aligned to the gram; the key names the bytes that a cell's windows have in common."""

    def parts_of(batch):
        ids = batch.column("u").to_numpy(zero_copy_only=False)
        spans = batch.column("spans")
        for first, texts in W.chunks(batch.column("text")):
            packed = [spans[first + k].values.to_numpy(zero_copy_only=False) for k in range(len(texts))]
            owner = np.repeat(np.arange(len(texts)), [len(x) for x in packed])
            packed = np.concatenate(packed)
            base = np.r_[0, np.cumsum([len(t) for t in texts])][owner]
            start, offset, n = packed >> 16, packed >> 8 & 255, packed & 255
            high, low = offset // width, (offset - n + 1) // width
            each = high - low + 1
            k = np.repeat(np.arange(len(packed)), each)
            c = high[k] - (np.arange(len(k)) - np.repeat(np.cumsum(each) - each, each))
            top, bottom = np.minimum(offset[k], c * width + width - 1), np.maximum((offset - n + 1)[k], c * width)
            p = (start + offset)[k]
            s, m = p - top, top - bottom + 1
            h, inverse = W.prefix_hash(np.frombuffer(b"".join(texts), np.uint8))
            name = lambda a, b: W.mix((h[b] - h[a]) * inverse[a])  # noqa: B023, E731
            core = base[k] + p - c * width
            key = W.mix(name(core, core - width + 1 + length) + c.astype(np.uint64))
            context = W.mix(name(base[k] + s, base[k] + s + m - 1 + length) ^ W.mix((top * 65536 + m).astype(np.uint64)))
            yield key.view(np.int64), context.view(np.int64), ids[first + owner[k]], s, m, top

    return _gathered(length, parts_of)


def _grouped(length: int):
    """Rows sorted by key, context, u, start: spans of settled repeats (n < 0: start..start-n) and windows to rank (n > 0)."""

    def run(batches):
        pending = None  # the last key's only context so far, and its first row
        seen = None  # (key, context, whether the key has several contexts)
        for batch in batches:
            key, context, u, start, n, offset = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "context", "u", "start", "n", "offset"))
            done = n < 0
            out = [(u[done], start[done], n[done], offset[done])]
            key, context, u, start, n, offset = (x[~done] for x in (key, context, u, start, n, offset))
            if len(key):
                new_key = np.r_[seen is None or key[0] != seen[0], key[1:] != key[:-1]]
                new = new_key | np.r_[seen is None or context[0] != seen[1], context[1:] != context[:-1]]
                rest = ~new
                out.append((u[rest], start[rest], -(n[rest] - 1 + length), offset[rest]))
                at = np.flatnonzero(new)
                # a first-of-context row is to be ranked if its key has another context before or after
                before = ~new_key[at]
                after = np.r_[before[1:], False]
                if pending is not None and len(at) and before[0]:
                    out.append(tuple(np.array([x]) for x in pending))
                if len(at):
                    pending = None
                ranked = before | after
                out.append((u[at[ranked]], start[at[ranked]], n[at[ranked]], offset[at[ranked]]))
                if len(at) and not ranked[-1]:
                    pending = (u[at[-1]], start[at[-1]], n[at[-1]], offset[at[-1]])
                seen = (key[-1], context[-1])
            u, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), *(pa.array(x.astype(np.int32)) for x in rest)], ["u", "start", "n", "offset"])

    return run


def _ranges(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (start, end) arrays of a list of packed start * 2**32 + end values."""
    x = np.sort(spans.values.to_numpy(zero_copy_only=False)) if spans is not None and spans.is_valid else np.empty(0, np.int64)
    return x >> 32, x & 0xFFFFFFFF


def _offsets(length: int, base: int) -> list[int]:
    """Where the names lie that a position brings along: all parts of a window, its two ends, or its beginning only."""
    many = length // base
    if length % base == 0 and many & (many - 1) == 0:
        return list(range(0, length, base))
    return [0, length - base] if 2 * base >= length else [0]


def _positions(length: int, base: int):
    """Names of ``base`` bytes at the positions of each span of windows (x), and at the further offsets (y, rest)."""
    offsets = _offsets(length, base)

    def run(batches):
        for batch in batches:
            ids = batch.column("u").to_numpy(zero_copy_only=False)
            spans = batch.column("spans")
            for first, texts in W.chunks(batch.column("text")):
                out = []
                for k, t in enumerate(texts):
                    start, end = _ranges(spans[first + k])
                    zero = np.zeros(len(start), np.int64)
                    _, start, end = _merged(zero, start, end + (length - base if len(offsets) == 1 else 0))
                    for a, b in zip(start, end, strict=True):
                        b = min(b, len(t) - base + 1)
                        piece = np.frombuffer(t[a : min(b + length, len(t))], np.uint8)
                        h, inverse = W.prefix_hash(piece)
                        at = np.arange(b - a)
                        names = [W.mix((h[at + o + base] - h[at + o]) * inverse[at + o]) for o in offsets]
                        out.append((np.full(b - a, ids[first + k]), at + a, np.column_stack([*names, *[np.zeros(b - a, np.uint64)] * (len(offsets) == 1)])))
                if out:
                    yield _ranks(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return run


_RANKS = "u long, s int, x long, y long, rest array<long>"


def _ranks(u: np.ndarray, s: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """Positions with the names of their parts: the first two apart, as they are sorted by."""
    rest = np.ascontiguousarray(names[:, 2:]).view(np.int64)
    lists = pa.ListArray.from_arrays(np.arange(len(u) + 1, dtype=np.int32) * rest.shape[1], rest.ravel())
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(s.astype(np.int32)), pa.array(names[:, 0].view(np.int64)), pa.array(names[:, 1].view(np.int64)), lists], ["u", "s", "x", "y", "rest"])


def _paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The names of pairs of names."""
    return W.mix(x * np.uint64(3) + W.mix(y))


def _ranked(last: bool, length: int):
    """Rows sorted by x, y, u, s.  Not last: new ranks of positions whose pair is not unique.  Last: spans of all but the first position of each pair."""

    def run(batches):
        held = None  # the previous row: x, y, u, s, rest, whether its pair was seen before
        for batch in batches:
            x, y, u, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in "xyus")
            if not len(x):
                continue
            rest = batch.column("rest").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            if held is not None:
                x, y, u, s, rest = (np.concatenate([a, b]) for a, b in zip(held[:5], (x, y, u, s, rest), strict=True))
            first = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            if held is not None:
                first[0] = not held[5]
            if last:
                late = ~first
                if held is not None:
                    late[0] = False  # given out with its own batch
                a, b, c = _merged(u[late], s[late].astype(np.int64), s[late].astype(np.int64) + length)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b.astype(np.int32)), pa.array((b - c).astype(np.int32))], ["u", "start", "n"])
            else:
                out = ~first | np.r_[~first[1:], False]
                if held is not None:
                    out[0] &= not held[5]
                parts = np.column_stack([x, y, rest])[out].view(np.uint64)
                pairs = [_paired(parts[:, k], parts[:, k + 1]) for k in range(0, parts.shape[1] - 1, 2)]
                if len(pairs) == 1:  # what it is paired with next is looked up
                    pairs.append(np.zeros(len(parts), np.uint64))
                yield _ranks(u[out], s[out], np.column_stack(pairs))
            held = (x[-1:], y[-1:], u[-1:], s[-1:], rest[-1:], bool(not first[-1]))

    return run


def _removed(batches):
    for batch in batches:
        spans = batch.column("spans")
        for first, texts in W.chunks(batch.column("text")):
            ids = batch.column("id").slice(first, len(texts))
            n, gone, runs, sha = [], [], [], []
            for k, t in enumerate(texts):
                start, end = _ranges(spans[first + k])
                _, start, end = _merged(np.zeros(len(start), np.int64), start, end)
                edges = [0, *np.c_[start, end].ravel().tolist(), len(t)]
                digest = hashlib.sha256()
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    digest.update(t[a:b])
                n.append(len(t)), gone.append(int((end - start).sum())), runs.append(len(start)), sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )


def repeated_spans(rows: DataFrame, length: int = 100, gram: int = 25, base: int = 25, width: int = 8) -> DataFrame:
    """(u, spans) of documents with bytes covered by a ``length``-byte string that starts earlier in (u, position) order.

    ``rows``: (u, id, text) with unique u.  spans: packed start * 2**32 + end, unmerged.
    Texts shorter than ``length`` have none.
    """
    if not (0 < gram <= length - 2 * width and length <= 255 and 0 < base < length):
        raise ValueError("gram <= length - 2 * width, base < length <= 255")
    bounded_batches(rows.sparkSession)

    def settled(runs: DataFrame) -> DataFrame:
        by_rank = runs.repartition("key").sortWithinPartitions("key", "context", "u", "start")
        return kept(by_rank.mapInArrow(_grouped(length), "u long, start int, n int, offset int"), "runs")

    sampled = settled(rows.mapInArrow(_sampled(length, gram), _RUN))
    edge = sampled.where("n > 0").groupBy("u").agg(F.collect_list(F.expr("start * 65536L + offset * 256 + n")).alias("spans"))
    celled = settled(rows.select("u", "text").join(edge, "u").mapInArrow(_cells(length, width), _RUN))
    edge = celled.where("n > 0").groupBy("u").agg(F.collect_list(F.expr("start * 4294967296L + start + n")).alias("spans"))
    at = rows.select("u", "text").join(edge, "u").mapInArrow(_positions(length, base), _RANKS)
    by_pair = lambda rows: rows.repartition("x", "y").sortWithinPartitions("x", "y", "u", "s")
    names, h = len(_offsets(length, base)), base
    tables = []
    while 2 * h < length and names != 2:
        if names == 1:
            at = kept(at.select("u", "s", "x", "rest"), "ranks")
            tables.append(at)
            at = at.join(at.select("u", (F.col("s") - h).alias("s"), F.col("x").alias("y")), ["u", "s"])
        at = by_pair(at).mapInArrow(_ranked(False, length), _RANKS)
        names, h = max(1, names // 2), 2 * h
    if names == 1:
        at = kept(at.select("u", "s", "x", "rest"), "ranks")
        tables.append(at)
        at = at.join(at.select("u", (F.col("s") - (length - h)).alias("s"), F.col("x").alias("y")), ["u", "s"])
    late = by_pair(at).mapInArrow(_ranked(True, length), "u long, start int, n int")
    late = kept(late, "late")
    drop(*tables)
    spans = sampled.where("n < 0").unionByName(celled.where("n < 0")).select("u", "start", "n").unionByName(late)
    return holding(spans.groupBy("u").agg(F.collect_list(F.expr("start * 4294967296L + start - n")).alias("spans")), sampled, celled, late)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes; null is empty.  Rows are ordered by id; rows with equal or
    null ids (null first) by text, identical rows in any order, the later ones repeat
    the first.  Other columns are ignored, whatever their names.
    """
    rows = numbered(docs, id_col, text_col)
    spans = repeated_spans(rows, length)
    out = rows.join(spans, "u", "left").select("id", "text", "spans").mapInArrow(_removed, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", "doc_id")
    return holding(out, rows, spans)


def _ranges_of(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal (start, end) runs of packed spans."""
    x = np.sort(np.array(spans, np.int64))
    _, start, end = _merged(np.zeros(len(x), np.int64), x >> 32, x & 0xFFFFFFFF)
    return list(zip(start.tolist(), end.tolist(), strict=True))

"""Benchmark decontamination by a prefix-filtered join of word windows.

A window is a run of ``size`` consecutive words of an item.  To hold a window a
document must hold each of its words, so one word is a sufficient prefix: the one in
the fewest documents.  Words are counted over all documents first; then each document
is probed with the prefix words only, candidates are cut by the positional and length
bounds (the window has to fit around the word), and the words themselves are compared.

The benchmark side is broadcast in slices of at most ``slice_bytes`` of text, measured
before.  A slice is held as its text and arrays of a few numbers for each word of it, some
ten bytes for each byte of text; a larger benchmark takes more passes over the documents,
never more memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .numbering import numbered
from .store import bounded_batches, kept


@dataclass
class Windows:
    """Distinct windows of some items, as places in the items' joined text.

    ``hashes``, ``start``, ``end``: of each word of the text.  ``place``, ``size``, ``name``:
    of each window, its first word, its words and its hash.  ``items[at[k]:at[k + 1]]``:
    the numbers of the items that hold window k in ``ids``.
    """

    joined: bytes
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    place: np.ndarray
    size: np.ndarray
    name: np.ndarray
    items: np.ndarray
    at: np.ndarray
    ids: list[str | None]

    def words(self, k: int) -> list[bytes]:
        p = int(self.place[k])
        return [self.joined[a:b] for a, b in zip(self.start[p : p + self.size[k]].tolist(), self.end[p : p + self.size[k]].tolist(), strict=True)]

    def named(self, k: int) -> list[str]:
        """The ids of the items that hold window k; a null id marks words but is not listed."""
        return sorted({x for x in (self.ids[j] for j in self.items[self.at[k] : self.at[k + 1]].tolist()) if x is not None})


def item_windows(items: list[tuple[str | None, str | None]], size: int) -> Windows:
    """The distinct windows of (id, text) items; a text of fewer words, but not none, is one window."""
    h, start, end, first, joined = W.words([(t or "").encode() for _, t in items], W.ALNUM)
    many = np.diff(first)
    n = np.where(many >= size, many - size + 1, np.minimum(many, 1))
    item = np.repeat(np.arange(len(items)), n)
    place = first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(many, size)[item]
    name, check = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
    for j in range(size):
        has = np.flatnonzero(length > j)
        word = h[place[has] + j]
        name[has] += word * W._SHINGLE[j]
        check[has] += W.mix(word + W._SHINGLE[j]) * W._SHINGLE[size + j]
    name = W.mix(name + length.astype(np.uint64))
    # windows are told apart by 128 bits of their words' names
    order = np.lexsort((item, check, name))
    name, check, item, place, length = name[order], check[order], item[order], place[order], length[order]
    new = np.flatnonzero(np.r_[np.ones(min(1, len(name)), bool), (name[1:] != name[:-1]) | (check[1:] != check[:-1])])
    return Windows(joined, h, start.astype(np.int32), end.astype(np.int32), place[new].astype(np.int32), length[new].astype(np.int32), name[new], item.astype(np.int32), np.r_[new, len(name)], [i for i, _ in items])


def _counted(vocabulary):
    """Of the benchmark's words: in how many documents of a batch each occurs."""

    def run(batches):
        known = vocabulary.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, texts in W.chunks(batch.column("text")):
                h, _, _, first, _ = W.words(texts, W.ALNUM)
                if not len(h):
                    continue
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                doc = np.searchsorted(first, hit, "right")
                pair = np.unique(doc * len(known) + at[hit])
                total += np.bincount(pair % len(known), minlength=len(known))
        keep = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[keep].view(np.int64)), pa.array(total[keep])], ["word", "n"])

    return run


def _found(texts: list[bytes], shared: tuple) -> tuple[np.ndarray, ...]:
    """Text, word and window of every occurrence of a window, by text and word; first word of each text."""
    windows, prefix, begin, offset, window = shared
    size, name = windows.size, windows.name
    h, start, end, first, joined = W.words(texts, W.ALNUM)
    doc_of, at_of, win_of = (np.empty(0, np.int64) for _ in range(3))
    if len(h) and len(prefix):
        at = np.minimum(np.searchsorted(prefix, h), len(prefix) - 1)
        hit = np.flatnonzero(prefix[at] == h)
        # every window led by the word that was hit
        each = begin[at[hit] + 1] - begin[at[hit]]
        entry = np.repeat(begin[at[hit]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        place = np.repeat(hit, each) - offset[entry]
        doc = np.searchsorted(first, np.repeat(hit, each), "right") - 1
        win = window[entry]
        fits = (place >= first[doc]) & (place + size[win] <= first[doc + 1])
        place, doc, win = place[fits], doc[fits], win[fits]
        for n in np.unique(size[win]) if len(win) else ():
            of_n = np.flatnonzero(size[win] == n)
            near = np.zeros(len(of_n), np.uint64)
            for j in range(n):
                near += h[place[of_n] + j] * W._SHINGLE[j]
            of_n = of_n[W.mix(near + np.uint64(n)) == name[win[of_n]]]
            exact = np.array([windows.words(win[k]) == [joined[start[p] : end[p]] for p in range(place[k], place[k] + n)] for k in of_n], bool)
            of_n = of_n[exact] if len(of_n) else of_n
            doc_of, at_of, win_of = np.r_[doc_of, doc[of_n]], np.r_[at_of, place[of_n]], np.r_[win_of, win[of_n]]
    order = np.lexsort((at_of, doc_of))
    return doc_of[order], at_of[order], win_of[order], first


def _probed(shared):
    """(u, id, n_words, hit word runs, item ids) of every document."""

    def run(batches):
        windows = shared.value[0]
        size = windows.size
        for batch in batches:
            for row, texts in W.chunks(batch.column("text")):
                doc_of, at_of, win_of, first = _found(texts, shared.value)
                cut = np.searchsorted(doc_of, np.arange(len(texts) + 1))
                spans, ids = [], []
                for k in range(len(texts)):
                    own = slice(cut[k], cut[k + 1])
                    at = at_of[own] - first[k]
                    spans.append(merged(zip(at.tolist(), (at + size[win_of[own]]).tolist(), strict=True)))
                    ids.append(sorted({x for w in set(win_of[own].tolist()) for x in windows.named(w)}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("u").slice(row, len(texts)), batch.column("id").slice(row, len(texts)), pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(ids, pa.list_(pa.string()))],
                    ["u", "id", "n_words", "spans", "items"],
                )

    return run


def _without_hits(shared, column: int):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, texts in W.chunks(batch.column(column)):
                keep[row + _found(texts, shared.value)[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def merged(spans) -> list[list[int]]:
    """Sorted disjoint [start, end) spans of overlapping or touching ones."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_HITS = "u long, id long, n_words long, spans array<array<long>>, items array<string>"


def _joined(batches):
    for batch in batches:
        spans = pa.array([merged(x) for x in batch.column("spans").to_pylist()], pa.list_(pa.list_(pa.int64())))
        items = pa.array([sorted(set(x)) for x in batch.column("items").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("id"), batch.column("n_words"), spans, items], ["u", "id", "n_words", "spans", "items"])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, slice_bytes: int = 4 << 20) -> DataFrame:
    """(u, id, n_words, spans, items) per row of ``docs``: hit word runs [start, end) and the ids, as strings, of items with occurring windows.

    Words are runs of ASCII letters and digits (A-Z lowered) and non-ASCII code points.
    Items of fewer than ``size`` words are one window; items and documents without words
    or with null text hit nothing.  Repeated items and rows count as they stand; texts of
    any length are read whole, and other columns are ignored, whatever their names.
    """
    if not 0 < size <= 32:
        raise ValueError("windows have 1 to 32 words")
    bounded_batches(docs.sparkSession)
    rows = numbered(docs, id_col, text_col)
    found, slices = None, 0
    for windows in _slices(benchmark, item_col, item_text, size, slice_bytes):
        hits = rows.mapInArrow(_probed(_shared(rows.select("text"), windows)), _HITS)
        found, slices = hits if found is None else found.unionByName(hits), slices + 1
    if slices > 1:
        found = kept(found, "hits").groupBy("u", "id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        found = found.mapInArrow(_joined, _HITS)
    return found


def _slices(benchmark: DataFrame, item_col: str, item_text: str, size: int, slice_bytes: int):
    """The benchmark's windows, in slices of about ``slice_bytes`` of text."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // slice_bytes))
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == k)
        yield item_windows([tuple(r) for r in own.toLocalIterator()], size)


def _shared(rows: DataFrame, windows: Windows):
    """Windows under their prefix words, rarest in ``rows`` (text), broadcast."""
    context = rows.sparkSession.sparkContext
    vocabulary, number = np.unique(windows.hashes, return_inverse=True)
    many = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        counts = rows.select("text").mapInArrow(_counted(context.broadcast(vocabulary)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        for r in counts.toLocalIterator():  # the benchmark's words at most
            many[np.searchsorted(vocabulary, np.uint64(r["word"] % (1 << 64)))] = r["n"]
    # the words' order from rare to frequent, and each window's rarest word
    rarity = np.empty(len(vocabulary), np.int64)
    rarity[np.lexsort((vocabulary, many))] = np.arange(len(vocabulary))
    best, offset = np.full(len(windows.place), len(vocabulary)), np.zeros(len(windows.place), np.int64)
    for j in range(int(windows.size.max(initial=0))):
        has = np.flatnonzero(windows.size > j)
        rank = rarity[number[windows.place[has] + j]]
        less = rank < best[has]
        best[has[less]], offset[has[less]] = rank[less], j
    word = number[windows.place + offset] if len(vocabulary) else np.empty(0, np.int64)
    led = np.flatnonzero(many[word] > 0)  # a word that no document holds rules its window out
    led = led[np.lexsort((led, offset[led], vocabulary[word[led]]))]
    prefix, begin = np.unique(vocabulary[word[led]], return_index=True)
    begin = np.r_[begin, len(led)].astype(np.int64)
    return context.broadcast((windows, prefix, begin, offset[led], led))


def report(hits: DataFrame) -> DataFrame:
    """Digest columns of ``benchmark_hits``."""
    n_hit = F.expr("aggregate(spans, 0L, (x, s) -> x + s[1] - s[0])")
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, slice_bytes: int = 4 << 20) -> DataFrame:
    """Rows of ``docs``, all columns, without any occurrence of a window.  Texts are not moved: every slice is a filter where they lie."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    for windows in _slices(benchmark, item_col, item_text, size, slice_bytes):
        docs = docs.mapInArrow(_without_hits(_shared(texts, windows), docs.columns.index(text_col)), docs.schema)
    return docs

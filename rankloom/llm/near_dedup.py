"""Near-duplicate documents by HyperMinHash sketches, banding, corrected estimates and exact verification.

Method.  A document is the set of its distinct 5-word shingles.  Each shingle hash
falls into one of 2**8 buckets by its top bits; a bucket's smallest remainder is
stored as 6 bits of leading-zero count and 10 mantissa bits.  Empty buckets borrow
from the first filled bucket in an order of their own, the same for all documents.
Bands of registers propose candidates, the collision-corrected Jaccard estimate
drops those far below the threshold, and whole sets confirm the rest.

Skew.  Documents with equal sets become one class first (a hash aggregate), so
copies are never paired.  Within a band bucket only a centre is compared with the
others.  What is left are buckets that still hold several components.  There, a pair's
similarity is bounded by how many shingles that others have too either document has, in
each of 64 hash groups; pairs across components that the bound allows follow, from few
centres first and then from all, so no candidate pair between different components is
skipped.  A bucket is dealt out in parts of some hundred rows, each met by the centres
or by the others, so no bucket is ever in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .store import bounded_batches, drop, holding, kept

BITS, LEADING, MANTISSA = 8, 6, 10
K = 1 << BITS
GROUPS = 64
#: Centres of a left-over bucket that are tried first, and rows of one part of it.
CENTRES, PART = 16, 256
_order = np.random.default_rng(7).random((K, K), np.float32)
_band_mult = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (K uint16) of sorted distinct shingle hashes; at least one."""
    bucket = (shingles >> np.uint64(64 - BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = shingles[first] << np.uint64(BITS)
    length = np.frexp(rest.astype(np.float64))[1]  # bit length, alike for equal values
    lead = np.minimum(64 - length, (1 << LEADING) - 1).astype(np.uint64)
    after = (rest << lead) << np.uint64(1)  # without the leading one
    value = (lead << np.uint64(MANTISSA)) | (after >> np.uint64(64 - MANTISSA))
    out = np.zeros(K, np.uint16)
    filled = bucket[first]
    out[filled] = value.astype(np.uint16)
    if len(filled) < K:
        empty = np.ones(K, bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[filled[_order[np.ix_(empty, filled)].argmin(1)]]
    return out


def chance_equal(n: float, m: float) -> float:
    """Chance that two unrelated registers agree: equal leading-zero count and equal mantissa."""
    total = 0.0
    for lead in range(1, (1 << LEADING) - 1):
        a, b = 2.0**-lead, 2.0 ** -(lead - 1)
        if a * max(n, m) / K > 60:
            continue
        p = lambda x: (1 - a) ** (x / K) - (1 - b) ** (x / K) if x > K else b - a
        total += max(0.0, p(n)) * max(0.0, p(m)) / (1 << MANTISSA)
    return min(total, 0.5)


def estimate(x: np.ndarray, y: np.ndarray, n: int, m: int) -> float:
    """Jaccard estimate from two register arrays, corrected for chance collisions."""
    e = chance_equal(n, m)
    return max(0.0, (float((x == y).mean()) - e) / (1 - e))


def _sketches(rows: int, bands: int):
    width = rows

    def run(batches):
        for batch in batches:
            for start, texts in W.chunks(batch.column("text")):
                ids = batch.column("id").slice(start, len(texts))
                n, sig_a, sig_b, sketch, keys = [], [], [], [], []
                for s in W.shingle_sets(texts):
                    n.append(len(s))
                    if not len(s):
                        sig_a.append(0), sig_b.append(0), sketch.append(b""), keys.append([])
                        continue
                    sig_a.append(int(W.mix(s).sum().astype(np.int64)))
                    sig_b.append(int(W.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum().astype(np.int64)))
                    r = registers(s)
                    sketch.append(r.tobytes())
                    grid = r[: bands * width].reshape(bands, width).astype(np.uint64)
                    key = W.mix((grid * _band_mult[:width]).sum(1) + np.arange(bands, dtype=np.uint64) * _band_mult[width])
                    keys.append(key.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(sig_a, pa.int64()), pa.array(sig_b, pa.int64()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "n", "sig_a", "sig_b", "sketch", "keys"],
                )

    return run


def _sets(batches):
    """Whole sets, and how many shingles fall into each of GROUPS hash groups."""
    for batch in batches:
        for start, texts in W.chunks(batch.column("text")):
            sets = W.shingle_sets(texts)
            profile = np.array([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets], np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * GROUPS, profile.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(texts)), pa.array([s.tobytes() for s in sets], pa.binary()), lists], ["id", "shingles", "profile"])


def _estimated(least: float):
    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "x", "y"))
            keep = [estimate(np.frombuffer(p, np.uint16), np.frombuffer(q, np.uint16), i, j) >= least for p, q, i, j in zip(x, y, n, m, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keep, pa.bool_())], ["a", "b", "near"])

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return run


def _shared(batches):
    for batch in batches:
        profile = batch.column("profile").flatten().to_numpy(zero_copy_only=False).reshape(-1, GROUPS).copy()
        for k, x in enumerate(batch.column("alone")):
            if x.is_valid:
                np.subtract.at(profile[k], x.values.to_numpy(zero_copy_only=False), 1)
        lists = pa.ListArray.from_arrays(np.arange(len(profile) + 1, dtype=np.int32) * GROUPS, profile.ravel())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), lists, pa.array(profile.sum(1).astype(np.int64))], ["id", "n", "profile", "shared"])


def _exploded(batches):
    for batch in batches:
        lists = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("shingles")]
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), [len(x) for x in lists])
        values = np.concatenate(lists) if lists else np.empty(0, np.int64)
        for k in range(0, len(values), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + (1 << 18)]), pa.array(values[k : k + (1 << 18)])], ["id", "shingle"])


def _parts() -> Column:
    """Into how many parts a bucket of ``many`` rows is dealt."""
    return F.ceil(F.col("many") / PART).cast("int")


def _part(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), _parts()).cast("int").alias("part")


def _mixed(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows (key, id, many) with their component, of keys that hold several components; written once."""
    if found is None:
        rows = rows.withColumn("component", F.col("id"))
    else:
        rows = rows.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = rows.groupBy("key", "many").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q")
    several = several.select("key", F.explode(F.sequence(F.lit(0), _parts() - 1)).alias("part"))
    return kept(rows.select("key", "id", "many", "component", _part(2)).join(several, ["key", "part"]).drop("part"), "mixed")


def _components(links: DataFrame) -> DataFrame:
    steps = components(links)
    found = kept(steps, "found")
    drop(steps)
    return found


def _possible(state: DataFrame, shared: DataFrame, percent: int, centres: int) -> DataFrame:
    """(a, b), a < b: pairs of different components in one bucket of ``state`` that the bounds allow, all or those with a centre.

    The rows of a bucket are dealt out in parts of about PART; its centres, or all its
    rows, come to each part.
    """
    some = state.select("key", "id", "component", "many")
    if centres:
        chosen = state.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(centres)).alias("slot")).agg(F.min("id").alias("id"))
        some = some.join(chosen.select("key", "id"), ["key", "id"], "left_semi")
    side = lambda rows, end: rows.join(shared, "id").select("key", "part", *[F.col(c).alias(f"{c}_{end}") for c in ("id", "n", "shared", "profile", "component")])
    x = side(state.select("*", _part(1)), "x")
    y = side(some.withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1))), "y")
    could = lambda most: f"100 * {most} >= {percent} * (n_x + n_y - {most})"
    # written out, the sum is compiled; as a higher-order function it would be interpreted for each pair
    common = "(" + " + ".join(f"least(profile_x[{k}], profile_y[{k}])" for k in range(GROUPS)) + ")"
    order = "id_x <> id_y" if centres else "id_x < id_y"
    on = F.expr(f"{order} and component_x <> component_y and {could('least(shared_x, shared_y)')} and {percent} * (n_x + n_y) <= {100 + percent} * {common}")
    pairs = x.join(y, (x["key"] == y["key"]) & (x["part"] == y["part"]) & on)
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, rows: int = 6, bands: int = 42, slack: float = 0.13) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest linked id), kept.

    ``percent``: link where 100 * intersection >= percent * union of the shingle sets.
    ``rows`` x ``bands`` <= 256 registers; a pair at the threshold shares no band with a
    chance of (1 - s**rows)**bands: 3e-6 at 0.8 as preset, 1e-6 at 0.85 with 7 x 36.  ``slack``: estimates below percent/100 - slack (over
    five standard errors) are not verified.

    Null or empty texts and texts without words have an empty set and link with
    nothing; texts under five words are one shingle.  Rows with one id are one
    node; a null id keeps null as component and kept true.  Other columns of
    ``docs`` are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = kept(source.mapInArrow(_sketches(rows, bands), "id long, n long, sig_a long, sig_b long, sketch binary, keys array<long>"), "sketches")
    classes = base.where("n > 0 and id is not null").groupBy("sig_a", "sig_b", "n").agg(F.min(F.struct("id", "sketch", "keys")).alias("r"))
    reps = kept(classes.select("r.id", "n", "r.sketch", "r.keys", "sig_a", "sig_b"), "classes")
    rows_of = reps.select("id", F.explode("keys").alias("key"))
    centre = rows_of.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last"), F.count("*").alias("many")).where("centre < last")
    buckets = kept(rows_of.join(centre.select("key", "centre", "many"), "key"), "buckets")
    wanted = buckets.select("id").distinct()
    sets = kept(source.where("id is not null").join(wanted, "id", "left_semi").mapInArrow(_sets, "id long, shingles binary, profile array<int>"), "sets")
    small = reps.select("id", "n", "sketch")

    def check(pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of distinct pairs a < b."""
        x = small.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"))
        y = small.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
        # the smaller set can't hold enough of the larger one: no link, by size alone
        fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        near = pairs.join(y, "b").join(x, "a").where(fits).mapInArrow(_estimated(percent / 100 - slack), "a long, b long, near boolean").where("near").select("a", "b")
        x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        found = near.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a long, b long, linked boolean")
        return kept(found.where("linked").select("a", "b").distinct(), "links")

    tried = kept(buckets.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = check(tried)
    found = _components(links) if not links.isEmpty() else None
    mixed = _mixed(buckets.select("key", "id", "many"), found)
    if not mixed.isEmpty():
        # A shingle that no other document left here has can't be shared.  How many of the
        # rest each document has in each hash group bounds what any two have in common.
        left = mixed.select("id").distinct()
        alone = sets.select("id", "shingles").join(left, "id", "left_semi").mapInArrow(_exploded, "id long, shingle long")
        alone = alone.groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("holders")).where("holders = 1")
        alone = alone.groupBy("id").agg(F.collect_list(F.expr(f"cast(shingle & {GROUPS - 1} as int)")).alias("alone"))
        shared = small.select("id", "n").join(sets.select("id", "profile").join(left, "id", "left_semi").dropDuplicates(["id"]), "id").join(alone, "id", "left")
        shared = shared.mapInArrow(_shared, "id long, n long, profile array<int>, shared long").where(f"100 * shared >= {percent} * n")
        shared = kept(shared, "shared")
        for centres in (CENTRES, 0):
            state = _mixed(buckets.select("key", "id", "many").join(shared.select("id"), "id", "left_semi"), found)
            if state.isEmpty():
                drop(state)
                break
            pairs = kept(_possible(state, shared, percent, centres).join(tried, ["a", "b"], "left_anti"), "pairs")
            drop(state)
            if not pairs.isEmpty():
                more = check(pairs)
                if not more.isEmpty():
                    every = kept(links.unionByName(more), "links")
                    drop(links, found)
                    links, found = every, _components(every)
                drop(more)
                tried = holding(tried.unionByName(pairs), tried, pairs)
        drop(shared)
    drop(mixed, tried, links, sets, buckets)
    rep = reps.select("sig_a", "sig_b", "n", F.col("id").alias("rep"))
    out = base.select("id", "n", "sig_a", "sig_b").join(rep, ["sig_a", "sig_b", "n"], "left")
    if found is not None:
        out = out.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "rep", "id"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
    return holding(out, base, reps, found)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, without those linked to a smaller id.  Of rows with one id the first by text stays; null ids stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = kept(found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    drop(found)
    place, own = "_place", "_own"
    while place in docs.columns or own in docs.columns:
        place, own = place + "_", own + "_"
    rows = docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1)
    if repeated.isEmpty():
        return holding(rows, gone)
    # rows without an id stay, each in a window of its own
    first = F.row_number().over(Window.partitionBy(id_col, own).orderBy(text_col))
    rows = rows.withColumn(own, F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())).withColumn(place, first)
    return holding(rows.where(F.col(place) == 1).drop(place, own), gone)

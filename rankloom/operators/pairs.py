"""Which pairs to ask: random draws, draws gated by the transitive closure, and merge sort frontiers."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.judge import patient
from rankloom.sources.store import drop, kept

#: A batch of pairs (first, second) to the winner of each: True where the first won.
Ask = Callable[[list[tuple]], list[bool]]


def numbered(ids: DataFrame, order: list, name: str = "k") -> DataFrame:
    """ids with consecutive numbers from 0 in ``order``, a total one: ranges are sorted apart, and each starts where the counts of those before it end."""
    n = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = ids.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # a row's place in its partition and the partition's number
    placed = kept(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_m", 33)
    many = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # as many rows as partitions
    first, starts = 0, []
    for p in sorted(many):
        starts.append((p, first))
        first += many[p]
    starts = F.broadcast(ids.sparkSession.createDataFrame(starts, "_p long, _first long"))
    return placed.join(starts, part == F.col("_p")).withColumn(name, F.col("_first") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_first")


def random_pairs(ids: DataFrame, per_item: int, seed: int = 0, most: int = 0, id_col: str = "id", log: DataFrame | None = None) -> DataFrame:
    """Distinct unordered pairs, ``per_item`` draws for each id, in a hash order that reruns repeat; at most ``most`` of them (0: all).

    Ids get consecutive numbers by a sort; partners are drawn as numbers and looked up by an
    equi-join, so no pair is formed that was not drawn.  Pairs that ``log`` (a_id, b_id)
    has decided, in either orientation, are left out before ``most`` is counted.
    """
    rows = ids.select(F.col(id_col).alias("id")).where(F.col(id_col).isNotNull()).distinct()
    n = rows.count()
    kind = ids.schema[id_col].dataType.simpleString()
    if n < 2:
        return ids.sparkSession.createDataFrame([], f"a_id {kind}, b_id {kind}")
    rows = numbered(rows, [F.xxhash64("id", F.lit(seed)), F.col("id")])
    draws = rows.select("id", "k", F.explode(F.sequence(F.lit(1), F.lit(per_item))).alias("turn"))
    # the draw skips the id's own number
    drawn = F.pmod(F.xxhash64("id", "turn", F.lit(seed)), F.lit(n - 1))
    draws = draws.withColumn("other", F.when(drawn >= F.col("k"), drawn + 1).otherwise(drawn))
    both = draws.select("id", "other").join(rows.select(F.col("id").alias("b"), F.col("k").alias("other")), "other")
    out = both.select(F.least("id", "b").alias("a_id"), F.greatest("id", "b").alias("b_id")).distinct()
    if log is not None:
        out = out.join(log.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")), ["a_id", "b_id"], "left_anti")
    return out.orderBy(F.xxhash64("a_id", "b_id", F.lit(seed)), "a_id", "b_id").limit(most) if most else out


class Closure:
    """What decisions imply about a bounded list: rows of bits, above and below each item."""

    MOST = 50_000  # two bit matrices of 312 MB each

    def __init__(self, n: int):
        if n > self.MOST:
            raise ValueError(f"over {self.MOST} items: use operators.graph.closure")
        width = -(-n // 64)
        self.n, self.up, self.down = n, np.zeros((n, width), np.uint64), np.zeros((n, width), np.uint64)

    @staticmethod
    def _bit(k: int) -> tuple[int, np.uint64]:
        return k >> 6, np.uint64(1) << np.uint64(k & 63)

    def _members(self, row: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little")[: self.n])

    def ordered(self, a: int, b: int) -> bool:
        w, bit = self._bit(b)
        return bool((self.up[a, w] | self.down[a, w]) & bit)

    def add(self, a: int, b: int) -> None:
        """a was preferred to b."""
        above, below = self.up[a].copy(), self.down[b].copy()
        w, bit = self._bit(a)
        above[w] |= bit
        w, bit = self._bit(b)
        below[w] |= bit
        for x in self._members(above):
            self.down[x] |= below
        for x in self._members(below):
            self.up[x] |= above

    def pairs(self) -> set[tuple[int, int]]:
        return {(a, int(b)) for a in range(self.n) for b in self._members(self.down[a])}


def gated_sampling(ids: Sequence, ask: Ask, per_item: int = 12, batch: int = 512, log: Sequence[tuple] = (), most: int = 0, seed: int = 0, scope: str = "new") -> list[tuple]:
    """Decisions (a, b, first won) on random pairs that no earlier decision implies, asked in batches.

    The target is half of ``per_item`` decisions for each item, at most ``most`` (0: no
    bound), counting new ones or, with ``scope`` "total", the log's too.  Where few pairs
    exist they are listed, so the sampler ends when none is left to ask.
    """
    ids = list(dict.fromkeys(ids))
    at = {v: k for k, v in enumerate(ids)}
    n = len(ids)
    known = Closure(n)
    asked = set()
    for a, b, first in log:
        if a in at and b in at and a != b:
            i, j = at[a], at[b]
            known.add(*((i, j) if first else (j, i)))
            asked.add((min(i, j), max(i, j)))
    target = n * per_item // 2
    if scope == "total":
        target -= len(asked)
    if most:
        target = min(target, most)
    rng = random.Random(seed)
    out: list[tuple] = []

    def free(i: int, j: int) -> bool:
        return (min(i, j), max(i, j)) not in asked and not known.ordered(i, j)

    while len(out) < target:
        want, chosen, misses = min(batch, target - len(out)), [], 0
        seen = set()
        few = n * (n - 1) // 2 <= 20 * want + 10_000
        if few:
            every = [(i, j) for i in range(n) for j in range(i + 1, n) if free(i, j)]
            rng.shuffle(every)
            chosen = every[:want]
        while not few and len(chosen) < want and misses < 20 * want + 10_000:
            i, j = rng.randrange(n), rng.randrange(n)
            if i == j or (min(i, j), max(i, j)) in seen or not free(i, j):
                misses += 1
                continue
            seen.add((min(i, j), max(i, j)))
            chosen.append((i, j))
        if not chosen:
            break
        for (i, j), first in zip(chosen, ask([(ids[i], ids[j]) for i, j in chosen]), strict=True):
            asked.add((min(i, j), max(i, j)))
            known.add(*((i, j) if first else (j, i)))
            out.append((ids[i], ids[j], first))
    return out


def merge_sort(ids: Sequence, ask: Ask) -> list:
    """Ids in order of preference by merging runs bottom-up; each step asks the heads of all merges of a level at once."""
    runs = [[v] for v in dict.fromkeys(ids)]
    while len(runs) > 1:
        merges = [(runs[k], runs[k + 1], []) for k in range(0, len(runs) - 1, 2)]
        state = [[0, 0] for _ in merges]
        while True:
            active = [k for k, (a, b, _) in enumerate(merges) if state[k][0] < len(a) and state[k][1] < len(b)]
            if not active:
                break
            heads = [(merges[k][0][state[k][0]], merges[k][1][state[k][1]]) for k in active]
            for k, (a, b), first in zip(active, heads, ask(heads), strict=True):
                merges[k][2].append(a if first else b)
                state[k][0 if first else 1] += 1
        done = [m + a[s[0] :] + b[s[1] :] for (a, b, m), s in zip(merges, state, strict=True)]
        runs = done + ([runs[-1]] if len(runs) % 2 else [])
    return runs[0] if runs else []


def ask_here(judge, candidates: DataFrame, resume: str = "", workers: int = 8, most: int = 10_000) -> Ask:
    """An Ask over a shortlist of at most ``most`` candidates, which are fetched once: no job for each batch.

    At most ``workers`` pairs are asked at a time, in all; a pair is asked once, in either
    orientation; any error that lasts fails the run.
    """
    rows = kept(candidates, "shortlist")
    n = rows.count()
    if n > most:
        drop(rows)
        raise ValueError(f"{n} candidates, over {most}: ask with a table of pairs instead")
    by_id = {r["id"]: r.asDict(recursive=True) for r in rows.collect()}
    drop(rows)
    once = patient(lambda a, b: judge(resume, a, b))
    memo: dict[tuple, bool] = {}

    def ask(pairs: list[tuple]) -> list[bool]:
        new = [p for p in dict.fromkeys(pairs) if p not in memo and p[::-1] not in memo]
        with ThreadPoolExecutor(workers) as pool:
            for p, got in zip(new, pool.map(lambda p: once(by_id[p[0]], by_id[p[1]]), new), strict=True):
                if got not in ("A", "B"):
                    raise ValueError(f"a judge answered {got}")
                memo[p] = got == "A"
        return [memo[p] if p in memo else not memo[p[::-1]] for p in pairs]

    return ask


def ask_with(judged: Callable[[DataFrame], DataFrame], candidates: DataFrame, memo: dict | None = None) -> Ask:
    """An Ask that sends the pairs it has not been asked before to a judge as one table."""
    memo = {} if memo is None else memo
    spark = candidates.sparkSession
    kind = candidates.schema["id"].dataType.simpleString()
    struct = F.struct(*candidates.columns)

    def ask(pairs: list[tuple]) -> list[bool]:
        new = [p for p in dict.fromkeys(pairs) if p not in memo and p[::-1] not in memo]
        if new:
            table = spark.createDataFrame(new, f"a_id {kind}, b_id {kind}")
            full = table.join(candidates.select(F.col("id").alias("a_id"), struct.alias("a")), "a_id").join(candidates.select(F.col("id").alias("b_id"), struct.alias("b")), "b_id")
            for r in judged(full.select("a", "b")).select("a_id", "b_id", "winner").collect():
                memo[r["a_id"], r["b_id"]] = r["winner"] == "A"
        return [memo[p] if p in memo else not memo[p[::-1]] for p in pairs]

    return ask

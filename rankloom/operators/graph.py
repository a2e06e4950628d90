"""Preference decisions as a graph: edges, degrees, games, closure, strong components."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import exprs as X
from rankloom.sources.store import drop, kept

#: Up to so many edges the driver's algorithms are used.
DRIVER_EDGES = 5_000_000


def closed(decisions: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Decisions whose two ends are among ``ids``."""
    own = ids.select(F.col(id_col).alias("_id")).distinct()
    out = decisions.join(own, decisions["a_id"] == own["_id"], "left_semi")
    return out.join(own, out["b_id"] == own["_id"], "left_semi")


def edges(decisions: DataFrame) -> DataFrame:
    """(src, dst): winner to loser, one row per decision; self-edges stay."""
    won = F.col("winner") == "A"
    return decisions.select(F.when(won, F.col("a_id")).otherwise(F.col("b_id")).alias("src"), F.when(won, F.col("b_id")).otherwise(F.col("a_id")).alias("dst"))


def pairs(decisions: DataFrame) -> DataFrame:
    """Decisions in one orientation: lo, hi, winner 1 if lo won."""
    lo, hi, turned = X.unordered(F.col("a_id"), F.col("b_id"))
    return decisions.select(lo.alias("lo"), hi.alias("hi"), F.when((F.col("winner") == "A") != turned, 1).otherwise(0).alias("lo_won"))


def latest(decisions: DataFrame, order: str) -> DataFrame:
    """One decision for each unordered pair, the last in ``order``: a log replayed into a memo."""
    lo, hi, turned = X.unordered(F.col("a_id"), F.col("b_id"))
    rows = decisions.select(lo.alias("lo"), hi.alias("hi"), F.when((F.col("winner") == "A") != turned, 1).otherwise(0).alias("lo_won"), order)
    return rows.groupBy("lo", "hi").agg(F.max_by("lo_won", order).alias("lo_won"))


def recall(asked: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits asked pairs (a_id, b_id) by a memo (lo, hi, lo_won): answered ones with their winner in the asked orientation, and the rest."""
    lo, hi, turned = X.unordered(F.col("a_id"), F.col("b_id"))
    keyed = asked.withColumns({"lo": lo, "hi": hi, "_turned": turned})
    found = keyed.join(memo, ["lo", "hi"]).withColumn("winner", F.when((F.col("lo_won") == 1) != F.col("_turned"), "A").otherwise("B"))
    rest = keyed.join(memo, ["lo", "hi"], "left_anti")
    return found.select(*asked.columns, "winner"), rest.select(*asked.columns)


def degree(decisions: DataFrame) -> DataFrame:
    """(id, comparisons): every decision counts at both ends."""
    ends = decisions.select(F.explode(F.array("a_id", "b_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("comparisons"))


def games(decisions: DataFrame) -> DataFrame:
    """(i, j, n) for both orders of each pair that met."""
    both = edges(decisions).select(F.explode(F.array(F.struct(F.col("src").alias("i"), F.col("dst").alias("j")), F.struct(F.col("dst").alias("i"), F.col("src").alias("j")))).alias("p"))
    return both.groupBy("p.i", "p.j").agg(F.count("*").alias("n"))


def wins(decisions: DataFrame) -> DataFrame:
    """(id, wins) of all that met, 0 included."""
    won = edges(decisions).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("w")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("w")))).alias("p"))
    return won.groupBy("p.id").agg(F.sum("p.w").alias("wins"))


def closure(edge: DataFrame) -> DataFrame:
    """(src, dst) for every pair joined by a path, cycles included; paths double each round, so rounds grow with the logarithm of the longest path.

    A round writes only the pairs it found: what is known is the union of the rounds.
    """
    new = known = kept(edge.select("src", "dst").distinct(), "closure")
    while not new.isEmpty():
        a, b = new.alias("a"), known.alias("b")
        far = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))
        back = b.join(a, F.col("b.dst") == F.col("a.src")).select(F.col("b.src"), F.col("a.dst"))
        new = kept(far.unionByName(back).distinct().join(known, ["src", "dst"], "left_anti"), "closure")
        known = known.unionByName(new)
    return known


def incomparable(candidates: DataFrame, reach: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) that no path orders, in either direction."""
    out = candidates.join(reach.select(F.col("src").alias("a_id"), F.col("dst").alias("b_id")), ["a_id", "b_id"], "left_anti")
    return out.join(reach.select(F.col("dst").alias("a_id"), F.col("src").alias("b_id")), ["a_id", "b_id"], "left_anti")


def components_of(nodes: list, out_edges: dict) -> list[list]:
    """Strong components on the driver (Tarjan's algorithm without recursion), each after all it leads to."""
    index, low, on, stack, found = {}, {}, set(), [], []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out_edges.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out_edges.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        group.append(w)
                        if w == v:
                            break
                    found.append(group)
    return found


def strong_components(edge: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(id, component) of every node: the smallest id of its strong component.

    Up to ``driver_edges`` distinct edges, counted first, on the driver; beyond that by
    forward colours and backward search over the edge table.
    """
    spark = edge.sparkSession
    plain = kept(edge.select("src", "dst").distinct(), "plain")
    if plain.count() > driver_edges:
        return coloured_components(plain)
    src, dst = (c.to_pylist() for c in plain.toArrow().columns)
    drop(plain)
    out = defaultdict(list)
    for a, b in zip(src, dst, strict=True):
        out[a].append(b)
    rows = [(v, min(group)) for group in components_of(sorted({*src, *dst}), out) for v in group]
    kind = edge.schema["src"].dataType.simpleString()
    return spark.createDataFrame(rows, f"id {kind}, component {kind}")


def coloured_components(plain: DataFrame) -> DataFrame:
    """Strong components of distinct edges as tables only.

    Nodes without an edge in or out are trimmed.  The rest take the smallest id that
    reaches them as colour; from each colour's own node, a backward search inside the
    colour finds one component, which leaves the graph.  Repeats until no edge is left.
    """
    nodes = kept(plain.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "nodes")
    left = kept(plain.where("src <> dst"), "left")
    done = None
    while True:
        n = -1
        while n != (n := left.count()) and n:  # trim
            left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            left = kept(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "left")
        if not n:
            break
        colour = kept(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")), "colour")
        while True:
            come = left.join(colour.withColumnsRenamed({"id": "src"}), "src").select(F.col("dst").alias("id"), "c")
            new = kept(colour.unionByName(come).groupBy("id").agg(F.min("c").alias("c")), "colour")
            same = new.join(colour, ["id", "c"], "left_anti").isEmpty()
            colour = new
            if same:
                break
        a, b = colour.withColumnsRenamed({"id": "src", "c": "cs"}), colour.withColumnsRenamed({"id": "dst", "c": "cd"})
        inside = kept(left.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst"), "inside")
        found = new = kept(colour.where("id = c"), "found")
        while not new.isEmpty():
            back = inside.join(new.withColumnsRenamed({"id": "dst"}), "dst").select(F.col("src").alias("id"), "c").distinct()
            new = kept(back.join(found, ["id", "c"], "left_anti"), "found")
            found = kept(found.unionByName(new), "found")
        done = found if done is None else kept(done.unionByName(found), "done")
        gone = found.select("id")
        left = left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        left = kept(left.select("src", "dst"), "left")
    if done is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(done, "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def fidelity(edge: DataFrame, positions: DataFrame) -> DataFrame:
    """The share of edges whose winner stands before the loser in (id, pos); 1 without edges.  Self-edges are not honoured."""
    a, b = positions.select(F.col("id").alias("src"), F.col("pos").alias("pa")), positions.select(F.col("id").alias("dst"), F.col("pos").alias("pb"))
    return edge.join(a, "src").join(b, "dst").agg(F.coalesce(F.avg((F.col("pa") < F.col("pb")).cast("double")), F.lit(1.0)).alias("fidelity"))


def agreement(decisions: DataFrame, strengths: DataFrame) -> DataFrame:
    """The share of decisions that strengths (id, theta) would decide alike."""
    a, b = strengths.select(F.col("id").alias("a_id"), F.col("theta").alias("ta")), strengths.select(F.col("id").alias("b_id"), F.col("theta").alias("tb"))
    same = (F.col("ta") > F.col("tb")) == (F.col("winner") == "A")
    return decisions.join(a, "a_id").join(b, "b_id").agg(F.avg(same.cast("double")).alias("agreement"))

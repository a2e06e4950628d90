"""Mixing sources to target weights, with DataFrame operations only.

Each source's words form one stream (documents in a fixed order) cut into blocks of
``block`` words.  The mix is a row of block slots grouped into output shards.  Every
source owns as many slots as its target asks for; all slots pass one pseudorandom
permutation, so a shard's source counts are a multinomial draw conditioned on the
totals (targets are met to a block, however few shards there are).  A source's slots,
shard by shard, are numbered, and the numbers mapped through the source's own
permutation of block indexes, as often as the stream repeats; blocks are joined by
(source, index).

Permutations are swap-or-not shuffles: keyed, exact on any range, and pure arithmetic.
Prefix sums are two-level: within (source, bin) and over the bins, whose number grows with
the documents, so no source is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, holding, kept

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def permuted(x: Column, n: Column, key: Column, rounds: int = 16) -> Column:
    """x of 0..n-1 under the keyed swap-or-not permutation of that range."""
    step = lambda a, r: _swap(a, n, key, r)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def _swap(a: Column, n: Column, key: Column, r: Column) -> Column:
    other = F.pmod(F.pmod(F.xxhash64(key, r), n) - a, n)
    return F.when(F.xxhash64(key, r, F.greatest(a, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(a)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target): water-filling of all sizes by weight under a cap of ``most`` sizes.

    Sources by code point, null last, take the weights in turn.  One row per source, so
    the global order is over the sources, not their documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # sources fill up in the order of cap / weight; level k holds if the next source is not full at it
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)
    target = F.least("cap", F.coalesce(water["level"] * F.col("weight"), F.col("cap")))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


_PART = 1 << 15


def _spread(goals: DataFrame, column: str, name: str) -> DataFrame:
    """Rows of ``goals`` once for each 0 <= name < column, dealt out in parts: no task makes a whole source's."""
    parts = goals.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col(column) - 1) / _PART))).alias("_part"))
    # a number of its own: adaptive execution would put these few bytes into one task, which then makes all rows
    n = max(1, int(goals.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = parts.where(F.col(column) > 0).repartition(n, F.col("k"), F.col("_part"))
    upto = F.least((F.col("_part") + 1) * _PART, F.col(column)) - 1
    return parts.select("*", F.explode(F.sequence(F.col("_part") * _PART, upto)).alias(name)).drop("_part")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size) of every row."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


class Mix:
    """A mix of ``docs``: its documents, its targets and its plan of block slots.

    documents: one row per row of docs with doc_id, source, size, source_size, target,
    taken (words the mix takes, repeats counted), k (the source's number), first_word
    (place in the source's stream).  goals: one row per source.  plan: one row per slot
    of the mix with shard, place, k, block, lap.  shards: shard, k, slots: the counts drawn.

    Null texts and texts without words have size 0 and are taken 0 times; null is a
    source of its own.  Equal rows are separate documents in any order; null ids come
    first.  Columns of docs other than the three named are ignored, whatever their names.
    Texts of any length are counted whole; a long one is many blocks.
    The sizes and the plan are written once, so that every later read agrees.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 32, shard_blocks: int = 4096, seed: int = 20240517, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0):
        self.block = block
        self._columns = (id_col, text_col, source_col)
        self._sizes = rows = kept(sized(docs, *self._columns), "sizes")
        # so many that a bin has some 65,000 documents at most, even of one source that holds all
        bins = max(1 << 10, 1 << (rows.count() >> 16).bit_length())
        rows = rows.withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(bins)).cast("int"))
        by_bin = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
        goals = targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, most)
        goals = goals.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        goals = goals.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
        goals = goals.withColumn("slots", F.least(slots, (F.lit(float(most)) * F.col("blocks")).cast("long")))
        before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        goals = goals.withColumn("before", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
        self.goals = kept(goals, "goals")

        # places drawn without replacement: a shard's source counts are multinomial given the totals
        place = permuted(F.col("before") + F.col("slot"), F.col("all_slots"), F.lit(seed))
        index = permuted(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), F.xxhash64(F.lit(seed), F.col("k")))
        plan = _spread(self.goals.select("k", "blocks", "slots", "before", "all_slots"), "slots", "slot")
        plan = plan.select(place.alias("place"), "k", index.alias("block"), F.floor(F.col("slot") / F.col("blocks")).alias("lap"))
        self.plan = kept(plan.select(F.floor(F.col("place") / shard_blocks).alias("shard"), "place", "k", "block", "lap"), "plan")
        self.shards = self.plan.groupBy("shard", "k").agg(F.count("*").alias("slots"))

        # each document's place in its source's stream
        up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        starts = by_bin.withColumn("bin_first", F.coalesce(F.sum("bin_size").over(up_to), F.lit(0)))
        starts = starts.join(self.goals.select(F.col("source").alias("_s"), "k", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "bin_size")
        starts = starts.withColumnsRenamed({"source": "_s", "bin": "_b"})
        rows = rows.join(starts, rows["source"].eqNullSafe(starts["_s"]) & (rows["bin"] == starts["_b"]))
        inside = Window.partitionBy("k", "bin").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        first = F.col("bin_first") + F.coalesce(F.sum("size").over(inside), F.lit(0))
        placed = kept(rows.select("doc_id", "source", "size", "source_size", "target", "k", "bin", first.alias("first_word")), "placed")

        drop(self._sizes)
        self.placed = placed

        # blocks joined by index: how many words of each document they take
        times = self.plan.groupBy("k", "block").agg(F.count("*").alias("times"))
        self.pieces = placed.where("size > 0").select("k", "first_word", "size", F.explode(F.sequence(F.floor(F.col("first_word") / block), F.floor((F.col("first_word") + F.col("size") - 1) / block))).alias("block"))
        self.pieces = self.pieces.join(times, ["k", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
        words = F.least(F.col("first_word") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("first_word"), F.col("block") * block)
        taken = self.pieces.groupBy("k", "first_word").agg(F.sum(words * F.col("times")).alias("taken"))
        both = placed.alias("p").join(taken.select(F.col("k").alias("_k"), F.col("first_word").alias("_f"), "taken"), (F.col("k") == F.col("_k")) & (F.col("first_word") == F.col("_f")) & (F.col("size") > 0), "left")
        self.documents = both.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("_k", "_f", "bin")

    def applied(self, docs: DataFrame) -> DataFrame:
        """Rows of ``docs``, all columns, as the mix takes them.

        A lap that takes a whole text gives one row with the text unchanged.  A lap that
        takes some blocks of it gives one row for each run of neighbouring blocks: the
        run's words, in order, joined by one space.  So a row is a stretch of one document,
        never pieces of it glued together.  A column n_chars is set to the new length.
        Texts without words go.
        """
        id_col, text_col, source_col = self._columns
        # how often each block of a text is taken, in the order of its blocks
        times = F.transform(F.array_sort(F.collect_list(F.struct("block", "times"))), lambda x: x["times"])
        laps = self.pieces.groupBy("k", "first_word").agg(F.max("times").alias("laps"), times.alias("times")).where("laps > 0")
        rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"), F.col(source_col).cast("string").alias("_source"))
        rows = rows.where("_size > 0")
        where = self.placed.where("size > 0").select("doc_id", "size", "source", "k", "first_word")
        same = F.lit(True)
        if not where.groupBy("doc_id", "size", "source").count().where("count > 1").limit(1).isEmpty():
            # rows of one id, size and source are told apart by a number among them
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_size", "_source").orderBy(F.xxhash64(f"_row.`{text_col}`"))))
            where = where.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "size", "source").orderBy("first_word")))
            same = rows["_n"] == where["n"]
        where = where.withColumnRenamed("size", "_sz").join(laps, ["k", "first_word"])
        rows = rows.join(where, rows["_id"].eqNullSafe(where["doc_id"]) & (rows["_size"] == where["_sz"]) & rows["_source"].eqNullSafe(where["source"]) & same)
        # only texts that some lap takes in part are split into words, once for all laps
        words = F.regexp_extract_all(F.col(f"_row.`{text_col}`"), F.lit(f"({WORD})"), F.lit(1))
        rows = rows.withColumn("_words", F.when(F.array_min("times") < F.col("laps"), words))
        rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("laps").cast("int"))).alias("_lap"))
        # runs of blocks that the lap takes: each begins where the block before is not taken, and ends where the next is not
        taken = lambda i: F.coalesce(F.get("times", i) >= F.col("_lap"), F.lit(False))
        places = F.sequence(F.lit(0), F.size("times") - 1)
        begins = F.filter(places, lambda i: taken(i) & ~taken(i - 1))
        ends = F.filter(places, lambda i: taken(i) & ~taken(i + 1))
        whole = F.array_min("times") >= F.col("_lap")
        runs = F.when(whole, F.array(F.struct(F.lit(0).alias("a"), (F.size("times") - 1).alias("b")))).otherwise(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"))))
        rows = rows.select("*", whole.alias("_whole"), F.explode(runs).alias("_run"))
        own = F.floor(F.col("first_word") / self.block)
        begin = F.greatest((own + F.col("_run.a")) * self.block - F.col("first_word"), F.lit(0)).cast("int")
        end = F.least((own + F.col("_run.b") + 1) * self.block - F.col("first_word"), F.col("_size")).cast("int")
        text = F.when(F.col("_whole"), F.col(f"_row.`{text_col}`")).otherwise(F.array_join(F.slice("_words", begin + 1, end - begin), " "))
        out = rows.select("_row", text.alias("_text")).where("_text <> ''")
        value = {text_col: F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
        return holding(out.select(*[value.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]), self.goals, self.plan, self.placed)


def report(mix: Mix) -> DataFrame:
    """Digest columns of a mix."""
    return holding(mix.documents.select("doc_id", "size", "source_size", "target", "taken", "source"), mix.goals, mix.plan, mix.placed)

"""The decision log as a stream: new files of JSON lines to deduplicated pairs and running degrees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.functions import exprs as X
from rankloom.sources.files import DECISION


def read_log(spark: SparkSession, path: str, schema: str = DECISION) -> DataFrame:
    """A growing folder of JSON lines; torn lines are skipped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def first_decisions(log: DataFrame) -> DataFrame:
    """The first decision of each unordered pair; state is one key per pair, as the pairs of a hull are bounded."""
    lo, hi, _ = X.unordered(F.col("a_id"), F.col("b_id"))
    return log.withColumns({"lo": lo, "hi": hi}).dropDuplicates(["lo", "hi"])


def degrees(log: DataFrame) -> DataFrame:
    ends = log.select(F.explode(F.array("a_id", "b_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("comparisons"))


def each_round(log: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``fold`` with every new batch of decisions once what is there has been read; a restart goes on behind the last batch."""
    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

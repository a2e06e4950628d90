"""A total order of rows by an id column that may hold nulls and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, id, text) of the rows: u is unique and grows with the id.

    Where ids are unique and not null, u is the id itself and nothing is moved.  Else
    rows are sorted by id (null first), then text, and numbered through a written table.
    A null text is empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    odd = rows.select("id").groupBy("id").count().where("count > 1 or id is null").limit(1)
    if odd.isEmpty():
        return rows.select(F.col("id").alias("u"), "id", "text")
    order = [F.col("id").asc_nulls_first(), F.col("text")]
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return kept(ranged.select(F.monotonically_increasing_id().alias("u"), "id", "text"), "numbered")

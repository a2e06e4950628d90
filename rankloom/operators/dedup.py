"""Keep one row of each key: the first, the best, or the last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import exprs as X


def company_title_key() -> list[Column]:
    """Two rows are one role if company (the name, else the short name) and title agree but for case."""
    return [X.dedup_key(X.falsy_or(F.col("company_name"), F.col("company"))), X.dedup_key(F.col("title"))]


def first_by(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The row of each key that comes first in ``order``, a total order."""
    names = [f"_key{k}" for k in range(len(keys))]
    keyed = df.select("*", *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)])
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return keyed.withColumn("_place", place).where("_place = 1").drop("_place", *names)


def best_by(df: DataFrame, keys: Sequence[Column | str], score: str, ordinal: str) -> DataFrame:
    return first_by(df, keys, [F.desc_nulls_last(score), F.col(ordinal)])


def last_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key that comes last: one hash aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def first_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each class; a plan with a limit per group while n is within the session's threshold."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")

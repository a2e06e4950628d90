"""Readers and writers: projected Parquet scans, JSON lists and logs, text, model files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from rankloom.functions.exprs import py_str

CANDIDATE = "id string, company string, title string, url string, level string, sub_function string, remote_scope string, country_code string, salary_min_k double, salary_max_k double, skills array<string>, alt_titles array<string>"
DECISION = "a_id string, b_id string, winner string, winner_id string, a string, b string"
MATCH = "match_score int, verdict string, summary string, strengths array<string>, gaps array<string>, company string, title string, url string, embed_score double, id string"
MODEL = "mean array<double>, V array<double>, zmu array<double>, zsd array<double>, w array<double>, lam double"


def is_vector(kind) -> bool:
    """Whether a column type is an embedding or a list of embeddings."""
    if not isinstance(kind, ArrayType):
        return False
    inner = kind.elementType
    return isinstance(inner, FloatType | DoubleType) or is_vector(inner)


def project(df: DataFrame, columns: Sequence[str] | None = None, embeddings: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """The listed columns that exist, in order, without repeats; all columns when none are listed, without vectors unless wanted.

    Names that the table lacks are left out of ``columns``; those in ``extra`` (filter
    keys) become null strings, so that a filter on them can be stated.
    """
    if columns is None:
        wanted = [f.name for f in df.schema.fields if embeddings or not is_vector(f.dataType)]
    else:
        wanted = [c for c in columns if c in df.columns]
    wanted = list(dict.fromkeys([*wanted, *extra]))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def parse_where(text: str) -> dict[str, str]:
    """``k=v,k=v`` to a dict; entries without ``=`` are ignored, the first ``=`` splits, blanks stay."""
    return dict(part.split("=", 1) for part in text.split(",") if "=" in part)


def where_equal(df: DataFrame, where: dict[str, str]) -> DataFrame:
    """Rows whose values, written as Python writes them, equal all the given strings."""
    for name, value in where.items():
        df = df.where(py_str(F.col(name), df.schema[name].dataType) == value)
    return df


def stream_rows(df: DataFrame, columns: Sequence[str] | None = None, embeddings: bool = True, where: dict[str, str] | None = None, limit: int = 0, order: Column | str | None = None) -> DataFrame:
    """Projection, equality filter, then the first ``limit`` rows (0: all) in ``order``."""
    out = where_equal(project(df, columns, embeddings, list(where or {})), where or {})
    if limit:
        out = (out.orderBy(order) if order is not None else out).limit(limit)
    return out


def iterate(df: DataFrame) -> Iterator[dict]:
    """Rows as dicts, one partition in the driver's memory at a time."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield row.asDict(recursive=True)


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """A column that orders rows as the scan's files hold them: (file name, row in file)."""
    meta = df.metadataColumn("_metadata")
    return df.withColumn(name, F.struct(meta["file_name"].alias("file"), meta["row_index"].alias("row")))


def head_of(candidates: DataFrame, top: int = 0, order: Column | str | list = "ordinal") -> DataFrame:
    """The first ``top`` candidates of a list in its order; 0: all."""
    return candidates.orderBy(order).limit(top) if top else candidates


def look_up(corpus: DataFrame, wanted: DataFrame, columns: Sequence[str], id_col: str = "id", ordinal: str = "ordinal") -> DataFrame:
    """(id, columns) of the wanted ids that the corpus has; of several rows with one id the first in ``ordinal``.

    Repeated and null wanted ids count once and not at all.  Only the named columns are
    read; the semi-join is a broadcast where the wanted list is small, and then only
    wanted rows are shuffled.
    """
    ids = wanted.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    rows = corpus.select(id_col, F.struct(*columns).alias("_row"), F.col(ordinal).alias("_place")).join(ids, id_col, "left_semi")
    return rows.groupBy(id_col).agg(F.min_by("_row", "_place").alias("_row")).select(id_col, "_row.*")


def read_json_array(spark: SparkSession, path: str, schema: str | StructType = CANDIDATE) -> DataFrame:
    """A file that holds one JSON array of objects, as rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType = DECISION, strict: bool = False) -> DataFrame:
    """JSON lines.  Tolerant: torn lines are skipped.  Strict: a bad line fails the read, and an empty log is an error; blank lines never count."""
    if not strict:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    out = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if out.isEmpty():
        raise ValueError(f"no decisions in {path}")
    return out


def to_jsonl(df: DataFrame, name: str = "value") -> DataFrame:
    """One JSON object per row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_json_array(df: DataFrame, path: str, order: Column | str | None = None) -> None:
    """One JSON file with an array of all rows, nulls kept, in ``order``; it appears whole, in place of an older one.

    Rows pass the driver a partition at a time; this is for lists that readers take whole.
    """
    spark = df.sparkSession
    rows = to_jsonl(df.orderBy(order) if order is not None else df)
    jvm = spark._jvm
    to, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temporary, False)
    out.write(b"[")
    for k, row in enumerate(rows.toLocalIterator()):
        out.write((",\n " if k else "\n ").encode() + row[0].encode())
    out.write(b"\n]\n")
    out.close()
    fs.delete(to, False)
    fs.rename(temporary, to)


def append_log(df: DataFrame, path: str) -> None:
    """Adds a round of records to a log of JSON lines, committed as a whole."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_text(spark: SparkSession, path: str, least: int = 0) -> str:
    """A whole text file, stripped; shorter than ``least`` characters is an error."""
    text = spark.read.text(path, wholetext=True).first()[0].strip()
    if len(text) < least:
        raise ValueError(f"{path} has under {least} characters")
    return text


def save_model(spark: SparkSession, model, path: str) -> None:
    """A linear model as a one-row table."""
    spark.createDataFrame([model.row()], MODEL).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str):
    from rankloom.operators.linear import LinearModel

    return LinearModel.from_row(spark.read.parquet(path).first())

"""Files behind HTTP: a resumable copy, and Parquet read by ranges where it lies.

Object stores and HDFS need nothing of this: ``spark.read`` reads them by ranges itself.
"""

from __future__ import annotations

import io
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


class Incomplete(OSError):
    """A server gave less, or something else, than it announced."""


def _ask(url: str, first: int | None = None, last: int | None = None, method: str = "GET", wait: float = 60.0):
    span = {} if first is None else {"Range": f"bytes={first}-{'' if last is None else last}"}
    return urllib.request.urlopen(urllib.request.Request(url, headers=span, method=method), timeout=wait)


def _tried(call: Callable, tries: int, sleep: Callable[[float], None]):
    """call, again after 1, 2, 4, ... up to 30 seconds where the connection or the server failed; a refusal (4xx) is raised at once."""
    for k in range(tries):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code < 500 or k == tries - 1:
                raise
        except (OSError, Incomplete):
            if k == tries - 1:
                raise
        sleep(min(2.0**k, 30.0))
    raise AssertionError


def download(url: str, path: str, tries: int = 6, piece: int = 1 << 20, sleep: Callable[[float], None] = time.sleep) -> int:
    """Copies a file to a local path and returns its bytes.

    What came is kept in ``path.part``; another try, or another run, asks for the rest
    only.  A server that ignores ranges sends all again.  The file gets its name at once,
    when all announced bytes are there.
    """
    part = f"{path}.part"

    def some() -> int:
        have = os.path.getsize(part) if os.path.exists(part) else 0
        try:
            answer = _ask(url, have if have else None)
        except urllib.error.HTTPError as e:
            if e.code != 416 or not have:
                raise
            total = e.headers.get("Content-Range", "").rpartition("/")[2]
            if total == str(have):  # nothing is left to send
                return have
            os.remove(part)
            raise Incomplete(f"{part} is not a beginning of {url}") from e
        with answer, open(part, "ab" if answer.status == 206 else "wb") as out:
            start = out.tell()
            told = answer.headers.get("Content-Length")
            while data := answer.read(piece):
                out.write(data)
            size = out.tell()
        if told is not None and size - start != int(told):
            raise Incomplete(f"{size - start} of {told} bytes came")
        return size

    size = _tried(some, tries, sleep)
    os.replace(part, path)
    return size


class RangedFile(io.RawIOBase):
    """A file behind HTTP that fetches what is read of it, and nothing else."""

    def __init__(self, url: str, size: int | None = None, tries: int = 6, sleep: Callable[[float], None] = time.sleep):
        self.url, self.at, self.tries, self.pause, self.fetched = url, 0, tries, sleep, 0
        self.size = _tried(self._measure, tries, sleep) if size is None else size

    def _measure(self) -> int:
        with _ask(self.url, 0, 0) as answer:
            if answer.status != 206:
                raise ValueError(f"{self.url} can't be read by ranges")
            return int(answer.headers["Content-Range"].rpartition("/")[2])

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def readinto(self, into) -> int:
        last = min(self.at + len(into), self.size) - 1
        if last < self.at:
            return 0

        def some() -> bytes:
            with _ask(self.url, self.at, last) as answer:
                data = answer.read()
            if answer.status != 206 or len(data) != last - self.at + 1:
                raise Incomplete(f"{len(data)} of {last - self.at + 1} bytes came")
            return data

        data = _tried(some, self.tries, self.pause)
        into[: len(data)] = data
        self.at += len(data)
        self.fetched += len(data)
        return len(data)


def read_parquet(spark: SparkSession, url: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet file behind HTTP as a table: the driver reads the footer, each task its row groups, and of those only the wanted columns' bytes.

    Names that the file lacks are left out, as in a projected scan.  Other paths are read
    by ``spark.read``.
    """
    if not url.startswith(("http://", "https://")):
        df = spark.read.parquet(url)
        return df.select(*[c for c in columns if c in df.columns]) if columns is not None else df
    from pyspark.sql.pandas.types import from_arrow_schema

    source = RangedFile(url)
    file = pq.ParquetFile(source)
    names = [c for c in (columns if columns is not None else file.schema_arrow.names) if c in file.schema_arrow.names]
    schema = from_arrow_schema(pa.schema([file.schema_arrow.field(n) for n in names]))
    groups, size, footer = file.num_row_groups, source.size, file.metadata

    def run(batches):
        for batch in batches:
            for group in batch.column(0).to_pylist():
                own = pq.ParquetFile(RangedFile(url, size), metadata=footer, pre_buffer=True)
                for part in own.iter_batches(4096, row_groups=[group], columns=names):
                    yield pa.RecordBatch.from_arrays([part.column(n) for n in names], names)

    tasks = max(1, min(groups, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, groups, 1, tasks).mapInArrow(run, schema)

"""Data sources of Spark: stored or fetched responses, in batches and as a stream, and a sink of files that are there once or not at all.

`layout` deals addresses or pages into folders by host, so that one task asks one host. `spark.read.format("webloom_responses")` reads
such a folder with a partition for each of its files, `readStream` takes files in the order they were laid out in, and `fetching` makes a format that asks a
fetcher for each address instead. `df.write.format("webloom_files")` stores rows (name, body) as files: every task writes to a folder of its own
attempt, and folders are moved to their place when the whole job is done.

Defined cases: a null address or page is left out; an empty folder gives no rows; files that a stopped job or a lost attempt wrote are
never seen; of equal names in one task the last row's file stays, in several tasks each has its own.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from webloom import schema
from webloom.functions import urls

#: Pages of a file, and rows that are read from it at a time.
FILE_ROWS, READ_ROWS = 20_000, 500


def filesystem(path: str):
    """A file system of Arrow and the path in it, for a plain path or an address with a scheme."""
    from pyarrow import fs

    if re.match(r"^file:/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_below(path: str, ending: str) -> list[str]:
    """All finished files of a folder in the order of their names; what is still being written begins with _ or a dot."""
    from pyarrow import fs

    system, root = filesystem(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [f.path for f in found if f.type == fs.FileType.File and f.path.endswith(ending)]
    return sorted(n for n in names if not re.search(r"/[_.]", n[len(root) :]))


def layout(pages: DataFrame, path: str, batch: int = 0, buckets: int = 16) -> None:
    """Appends rows (url, and html where pages are stored) to a folder as batch number `batch`, a host in one bucket."""
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string").alias("html")
    rows = pages.where("url is not null").select("url", html, F.pmod(F.hash(urls.host(F.col("url"))), F.lit(buckets)).alias("bucket"))
    rows.repartition(buckets, "bucket").write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(f"{path.rstrip('/')}/batch={batch:06d}")


@dataclass
class _File(InputPartition):
    path: str


def _responses(path: str, fetcher: Callable | None):
    """Response batches of one file: its pages, or what the fetcher says to its addresses."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema.RESPONSE)
    system, name = filesystem(path)
    with system.open_input_file(name) as source:
        for batch in pq.ParquetFile(source).iter_batches(READ_ROWS, columns=["url", "html"]):
            addresses = batch.column(0).to_pylist()
            if fetcher:
                rows = fetcher(addresses)
            else:
                rows = ({"url": urls.drop_fragment(u), "status_code": 200, "content_type": "text/html", "body": h.encode(), "response_time_ms": 0} for u, h in zip(addresses, batch.column(1).to_pylist()) if h is not None)
            yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in arrow.names} for row in rows], arrow)


class _Reader(DataSourceReader):
    def __init__(self, path: str, fetcher: Callable | None):
        self.path, self.fetcher = path, fetcher

    def partitions(self):
        return [_File(f) for f in files_below(self.path, ".parquet")]

    def read(self, partition):
        return _responses(partition.path, self.fetcher) if partition else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are counts of files in the order of their names, which begin with the number of their batch."""

    def __init__(self, path: str, fetcher: Callable | None, most: int):
        self.path, self.fetcher, self.most, self.at = path, fetcher, most, 0

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        self.at = min(len(files_below(self.path, ".parquet")), self.at + self.most)
        return {"files": self.at}

    def partitions(self, start, end):
        self.at = max(self.at, end["files"])
        return [_File(f) for f in files_below(self.path, ".parquet")[start["files"] : end["files"]]]

    def read(self, partition):
        return _responses(partition.path, self.fetcher)

    def commit(self, end):
        pass


class Responses(DataSource):
    """schema.RESPONSE of a folder that `layout` made; option maxFilesPerTrigger bounds what a micro-batch of a stream takes."""

    fetcher: Callable | None = None

    @classmethod
    def name(cls):
        return "webloom_responses"

    def schema(self):
        return schema.RESPONSE

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a folder is needed: load(path)")
        return self.options["path"]

    def reader(self, schema: StructType):
        return _Reader(self._path(), type(self).fetcher)

    def streamReader(self, schema: StructType):
        return _StreamReader(self._path(), type(self).fetcher, int(self.options.get("maxFilesPerTrigger", 1 << 30)))


def fetching(fetch: Callable, called: str) -> type[DataSource]:
    """A format of this name that asks a fetcher for each address of a folder."""

    class Fetched(Responses):
        fetcher = staticmethod(fetch)

        @classmethod
        def name(cls):
            return called

    return Fetched


@dataclass
class _Stored(WriterCommitMessage):
    part: int
    folder: str
    files: int


class _FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator):
        """Writes one task's files to a folder of this attempt."""
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        system, root = filesystem(self.path)
        folder, made = f"{root}/_{self.job}/{part}-{attempt}", 0
        for batch in iterator:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                if not made:
                    system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{name.replace('/', '-')}") as out:
                    out.write(body.encode() if isinstance(body, str) else body or b"")
                made += 1
        return _Stored(part, folder, made)

    def commit(self, messages):
        """The one attempt of each task that counts is moved to its place; all others go."""
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for info in self._there(system, root):
                (system.delete_file if info.is_file else system.delete_dir)(info.path)
        counted = [m for m in messages if m and m.files]
        for m in counted:
            system.move(m.folder, f"{root}/part-{m.part:05d}-{self.job}")
        self.abort(messages)
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in counted)}).encode())

    def _there(self, system, root):
        from pyarrow import fs

        return [f for f in system.get_file_info(fs.FileSelector(root)) if f.base_name != f"_{self.job}"]

    def abort(self, messages):
        from pyarrow import fs

        system, root = filesystem(self.path)
        if system.get_file_info(f"{root}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.job}")


class Files(DataSource):
    """A sink of rows (name, body): files below part folders of a path."""

    @classmethod
    def name(cls):
        return "webloom_files"

    def writer(self, schema: StructType, overwrite: bool):
        return _FileWriter(self.options["path"], overwrite)


def register(spark) -> None:
    for source in (Responses, Files):
        spark.dataSource.register(source)


def write_files(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Stores rows (name, body: string or binary) as files, all of them or none."""
    register(rows.sparkSession)
    rows.select("name", "body").write.format("webloom_files").mode(mode).save(path)

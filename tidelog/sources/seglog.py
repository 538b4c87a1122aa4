"""Segment files as DataFrames: two readers that list files by Spark, and the 'seglog' data source, which reads and
writes through Arrow's file systems. Headers are read from the beginning of each file alone."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from . import segments as S

HEADERS = "path string, kind string, fenced_by string, log_id string, ordinal long, prefix_end long, first_seq long, last_seq long, count long, codec int, body_len long, level int, error string"
ENTRIES = "log_id string, ordinal long, idx int, seq long, shard long, epoch long, frame binary, muts array<struct<key:binary,val:binary>>, derived int, gen long"


def header_row(path: str, data: bytes) -> tuple:
    try:
        h = S.parse_header(data)
    except (S.FormatError, UnicodeDecodeError) as e:
        return (path, "bad", *[None] * 10, str(e))
    if h is None:
        return (path, "fence", data[8:].decode(errors="replace"), *[None] * 9, None)
    return (path, "segment", None, h.log_id, h.ordinal, h.prefix_end, h.first_seq, h.last_seq, h.count, h.codec, h.body_len, h.level, None)


def entry_rows(data: bytes, shard: int | None, with_muts: bool, derive: Callable | None = None) -> Iterator[tuple]:
    h = S.parse_header(data)
    if h is not None:
        for i, e in S.indexed_entries(data, shard, with_muts, derive):
            yield (h.log_id, h.ordinal, i, e.seq, e.shard, e.epoch, e.frame, e.muts if with_muts else None, e.derived, e.gen)


def file_system(path: str):
    """(file system, path in it) of a path as Spark has it: local, hdfs, s3 and gs, whatever Arrow reaches from every
    executor. On a cluster a local path must be a shared mount."""
    from pyarrow import fs

    at = re.sub(r"^file:/+", "/", str(path))
    return (fs.LocalFileSystem(), os.path.abspath(at)) if "://" not in at else fs.FileSystem.from_uri(at)


def head_bytes(path: str, n: int = 4096) -> bytes:
    files, at = file_system(path)
    with files.open_input_file(at) as f:
        return f.read_at(min(n, f.size()), 0)


def _files(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.seg").load(path).select(*columns)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The headers of all objects under a folder; of each file only the beginning is read."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for df in batches:
            yield pd.DataFrame([header_row(p, head_bytes(p)) for p in df["path"]], columns=[c.split()[0] for c in HEADERS.split(", ")]).astype({c.split()[0]: "Int64" for c in HEADERS.split(", ") if c.split()[1] in ("long", "int")})

    return _files(spark, path, "path").mapInPandas(run, HEADERS)


def parse_objects(objects: DataFrame, shard: int | None = None) -> DataFrame:
    """The entries, without their mutations, of objects given as `data`, by columns. The shard is filtered while parsing."""
    names = ["log_id", "ordinal", "idx", "seq", "shard", "epoch", "frame"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                if (found := S.parse_columns(data, shard)) is not None:
                    h, n = S.parse_header(data), len(found[0])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([h.log_id] * n, [h.ordinal] * n, *found), kinds, strict=True)], names)

    return objects.select("data").mapInArrow(run, "log_id string, ordinal long, idx int, seq long, shard long, epoch long, frame binary")


def read_entries(spark: SparkSession, path: str, shard: int | None = None, with_muts: bool = False, derive: Callable | None = None) -> DataFrame:
    """The entries of all segments under a folder. The shard is filtered while parsing."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in ENTRIES.replace("struct<key:binary,val:binary>", "x").split(", ")]
        for df in batches:
            for data in df["content"]:
                rows = [(*r[:7], [{"key": k, "val": v} for k, v in r[7]] if r[7] is not None else None, *r[8:]) for r in entry_rows(bytes(data), shard, with_muts, derive)]
                yield pd.DataFrame(rows, columns=names)

    return _files(spark, path, "path", "content").mapInPandas(run, ENTRIES)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.table = options["path"], options.get("table", "entries")
        self.shard = int(options["shard"]) if "shard" in options else None
        self.muts = options.get("muts", "false") == "true"

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("shard",) and self.table == "entries":
                self.shard = f.value
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        files, at = file_system(self.root)
        scheme = self.root[: self.root.index("://") + 3] if "://" in self.root and not self.root.startswith("file:") else ""
        found = files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        return [_File(scheme + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".seg")]

    def read(self, partition):
        if self.table == "headers":
            yield header_row(partition.value, head_bytes(partition.value))
        else:
            files, at = file_system(partition.value)
            with files.open_input_file(at) as f:
                yield from entry_rows(f.read(), self.shard, self.muts)


class _Writer(DataSourceWriter):
    """Rows (log_id, ordinal, data) to {path}/log/{log_id}/{ordinal}.seg; a file appears whole or not at all."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator):
        files, root = file_system(self.root)
        for row in iterator:
            files.create_dir(folder := f"{root}/log/{row.log_id}", recursive=True)
            to = f"{folder}/{row.ordinal:012d}.seg"
            with files.open_output_stream(at := f"{to}.{uuid.uuid4().hex}.tmp") as f:
                f.write(bytes(row.data))
            files.move(at, to)
        return WriterCommitMessage()


class SegLog(DataSource):
    """spark.read.format('seglog'), with table headers or entries, shard and muts as options."""

    @classmethod
    def name(cls) -> str:
        return "seglog"

    def schema(self) -> str:
        return HEADERS if self.options.get("table") == "headers" else ENTRIES

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known and lets it take filters, on the shard, before it reads."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegLog)


def seal(log: DataFrame, level: int = 1) -> DataFrame:
    """Rows (log_id, ordinal, idx, seq, shard, epoch, frame) to (log_id, ordinal, data): one segment a group.
    A segment is a bounded number of rows by the writer's rule."""

    def run(key, df):
        import pandas as pd

        df = df.sort_values("idx")
        columns = [df[c].tolist() for c in ("seq", "shard", "epoch", "frame")]
        data = S.compress(S.build_events(str(key[0]), int(key[1]), int(key[1]), *columns), level)
        return pd.DataFrame({"log_id": [str(key[0])], "ordinal": [int(key[1])], "data": [data]})

    rows = log.select(F.col("log_id").cast("string"), "ordinal", "idx", "seq", "shard", "epoch", F.col("frame").cast("binary"))
    return rows.groupBy("log_id", "ordinal").applyInPandas(run, "log_id string, ordinal long, data binary")

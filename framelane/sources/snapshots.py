"""A data source over a folder of snapshot files that writers replace.

A job's progress file is rewritten in place, so a path says little; a version of a file is its modification time and its name. The stream's
offset is the last version that was taken, in the order (modification time, name); a batch takes the versions between two offsets, so a
restarted query repeats exactly the batch that was not committed and no other. A file that was rewritten between planning and reading is
left to the batch of its new version. Listings are read by the driver, contents by tasks, each of which has a group of files.

What the writers must do: a version gets the time at which it appears (``settle_seconds`` are left for clocks that differ and for files
that are being written), and the newest file stays until a newer one has come.
"""

from __future__ import annotations

import datetime
import fnmatch
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from framelane.sources.files import open_folder

SCHEMA = "file_name string, modified timestamp, body string"
ARROW = pa.schema([("file_name", pa.string()), ("modified", pa.timestamp("us", tz="UTC")), ("body", pa.string())])
START = {"modified": 0, "name": ""}
COMPARE = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


@dataclass(frozen=True, order=True)
class Version:
    """A file as it was listed; times in microseconds."""

    modified: int
    name: str
    size: int = 0


class Group(InputPartition):
    def __init__(self, versions: list[Version]):
        super().__init__(versions)


def _micros(moment: datetime.datetime) -> int:
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=datetime.timezone.utc)
    return round((moment - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) / datetime.timedelta(microseconds=1))


class _Folder:
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.lines = options.get("lines", "false").lower() == "true"
        self.group_bytes = int(options.get("group_bytes", 64 * 2**20))
        self.settle_seconds = float(options.get("settle_seconds", 2))
        self.batch_bytes = int(options.get("batch_bytes", 4 * 2**20))

    def versions(self) -> list[Version]:
        """All files, hidden ones left out, in order."""
        system, root = open_folder(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.path[len(root) :].lstrip("/")
            hidden = any(part.startswith(("_", ".")) for part in name.split("/"))
            if info.type == fs.FileType.File and not hidden and fnmatch.fnmatch(info.base_name, self.pattern):
                found.append(Version(info.mtime_ns // 1000, name, info.size))
        return sorted(found)

    def groups(self, versions: list[Version]) -> list[Group]:
        """Files of ``group_bytes`` together, or one larger file."""
        groups, size = [], 0
        for v in versions:
            if not groups or size + v.size > self.group_bytes:
                groups.append([])
                size = 0
            groups[-1].append(v)
            size += v.size
        return [Group(g) for g in groups]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(self.path)
        rows, size = [], 0
        for v in partition.value:
            info = system.get_file_info(f"{root}/{v.name}")
            if info.type != fs.FileType.File or info.mtime_ns // 1000 != v.modified:
                continue
            with system.open_input_stream(f"{root}/{v.name}") as file:
                for body in self._bodies(file):
                    rows.append((v.name, v.modified, body))
                    size += len(body)
                    if size >= self.batch_bytes:
                        yield _batch(rows)
                        rows, size = [], 0
        yield _batch(rows)

    def _bodies(self, file) -> Iterator[str]:
        if not self.lines:
            yield file.read().decode("utf-8", "replace")
            return
        rest = b""
        while block := file.read(2**20):
            *whole, rest = (rest + block).split(b"\n")
            yield from (line.decode("utf-8", "replace") for line in whole if line.strip())
        if rest.strip():
            yield rest.decode("utf-8", "replace")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, times, bodies = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int64()).cast(ARROW.field(1).type), pa.array(bodies, pa.string())], schema=ARROW)


class _Batch(DataSourceReader):
    """All files; comparisons of name and time pick files before any is read."""

    def __init__(self, options):
        self.folder, self.tests = _Folder(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in COMPARE and column in (("file_name",), ("modified",)):
                value = f.value
                if column == ("modified",):
                    value = tuple(map(_micros, value)) if isinstance(f, In) else _micros(value)
                self.tests.append((type(f).__name__, column[0], value))
            else:
                yield f

    def partitions(self) -> list[Group]:
        by_name = {kind.__name__: test for kind, test in COMPARE.items()}
        take = lambda v: all(by_name[kind](v.name if column == "file_name" else v.modified, value) for kind, column, value in self.tests)
        return self.folder.groups([v for v in self.folder.versions() if take(v)]) or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.last = _Folder(options), START

    def initialOffset(self) -> dict:
        return START

    def latestOffset(self) -> dict:
        settled = (time.time() - self.folder.settle_seconds) * 1e6
        ready = [v for v in self.folder.versions() if v.modified <= settled]
        if ready and (ready[-1].modified, ready[-1].name) > (self.last["modified"], self.last["name"]):
            self.last = {"modified": ready[-1].modified, "name": ready[-1].name}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Group]:
        low, high = ((o["modified"], o["name"]) for o in (start, end))
        return self.folder.groups([v for v in self.folder.versions() if low < (v.modified, v.name) <= high])

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        self.last = max(self.last, end, key=lambda o: (o["modified"], o["name"]))


class SnapshotFolder(DataSource):
    """``file_name, modified, body`` of the files below ``path``.

    Options: ``pattern`` of the file name; ``lines`` for one row per line; ``group_bytes`` of files in a partition; ``settle_seconds`` that
    a file must have been there before a stream takes it.
    """

    @classmethod
    def name(cls) -> str:
        return "snapshot_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    """The documents' fields beside file and time; texts that give no field at all are left out."""
    document = F.from_json("body", schema, {"mode": "PERMISSIVE"})
    whole = raw.select("file_name", "modified", document.alias("_r"))
    names = [f.name for f in whole.schema["_r"].dataType]
    found = F.exists(F.array(*[F.col(f"_r.`{n}`").isNotNull() for n in names]), lambda x: x)
    return whole.where(found).select("file_name", "modified", "_r.*")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotFolder)


def read_snapshots(spark: SparkSession, path: str, schema: str | None = None, where: str | None = None, **options) -> DataFrame:
    """The newest versions in a folder now; ``where`` over ``file_name`` and ``modified`` picks files before they are read."""
    register(spark)
    raw = spark.read.format(SnapshotFolder.name()).options(**options).load(path)
    raw = raw.where(where) if where else raw
    return _parsed(raw, schema) if schema else raw


def stream_snapshots(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Every version of every file that a micro-batch meets, once, restarts included."""
    register(spark)
    raw = spark.readStream.format(SnapshotFolder.name()).options(**options).load(path)
    return _parsed(raw, schema) if schema else raw

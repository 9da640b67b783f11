"""A segment store with a commit protocol.

Tasks write the segments they hold into new files, each closed segment with its own verdict: the number of frames is the planned one, frames
come in order without repeats, and every frame passed its seam check. What a task wrote is listed in a part of the ledger; only the driver's
commit, which names the parts of a finished job in one file, makes them count. Files of the store are never changed or replaced, so a job that
fails half-way, and a task that is run twice, leave no trace in what is read. Of a segment's committed versions the last promoted one counts;
a version that was refused never hides an earlier good one. A job with a ``commit`` id that is already there changes nothing.

    store/data/<task>-<n>.parquet     frames, whole segments one after another
    store/ledger/parts/<task>.parquet one row per segment of a task
    store/ledger/commits/<id>.json    the parts of a job, one line per part
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from framelane.sources.files import open_folder

KEYS = ("source_id", "segment_index")
PART = pa.schema([
    ("part", pa.string()), ("source_id", pa.string()), ("segment_index", pa.int64()), ("file", pa.string()), ("frames", pa.int64()),
    ("planned_frames", pa.int64()), ("first_frame", pa.int64()), ("last_frame", pa.int64()), ("size_bytes", pa.int64()), ("seams_ok", pa.bool_()), ("reason", pa.string()),
])
PART_DDL = (
    "part string, source_id string, segment_index long, file string, frames long, planned_frames long, first_frame long, last_frame long, "
    "size_bytes long, seams_ok boolean, reason string"
)
LEDGER_ROWS = 10_000
COMMIT_DDL = "commit string, committed_ms long, part string"


@dataclass
class Written(WriterCommitMessage):
    part: str | None
    files: list[str]


class _Open:
    """The segment that a task is writing."""

    def __init__(self, key: tuple, planned: int | None):
        self.key, self.planned = key, planned
        self.frames, self.size, self.first, self.last = 0, 0, None, None
        self.in_order, self.seams_ok = True, True

    def add(self, batch: pa.RecordBatch) -> None:
        frames = batch.column("frame_index").to_numpy()
        self.in_order &= bool((np.diff(frames) > 0).all()) and (self.last is None or frames[0] > self.last)
        seams = batch.column("seams_ok") if "seams_ok" in batch.schema.names else None
        self.seams_ok &= seams is None or pa.compute.all(pa.compute.fill_null(seams, True)).as_py() is not False
        self.first = int(frames[0]) if self.first is None else self.first
        self.last, self.frames, self.size = int(frames[-1]), self.frames + len(frames), self.size + batch.nbytes

    def reason(self) -> str | None:
        """Why the segment is not promoted, if it is not."""
        if not self.in_order:
            return "frames are not in order"
        if self.planned is not None and self.frames != self.planned:
            return "frame count"
        return None if self.seams_ok else "seams"


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.file_bytes = options["path"], int(options.get("file_bytes", 512 * 2**20))
        self.group_bytes, self.commit_id = int(options.get("group_bytes", 64 * 2**20)), options.get("commit") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_folder(self.path)
        part, files, rows = uuid.uuid4().hex, [], []
        out, ledger, room, held, held_bytes, now, seen = None, None, 0, [], 0, None, set()

        def flush():
            nonlocal held, held_bytes, room
            if held:
                out.write_table(pa.Table.from_batches(held))
                room -= held_bytes
                held, held_bytes = [], 0

        def note(at_least: int):
            """Pass the rows of the ledger on once there are so many."""
            nonlocal ledger
            if len(rows) >= at_least:
                if ledger is None:
                    system.create_dir(f"{root}/ledger/parts", recursive=True)
                    ledger = pq.ParquetWriter(f"{root}/ledger/parts/{part}.parquet", PART, filesystem=system)
                ledger.write_table(pa.Table.from_pylist(rows, schema=PART))
                rows.clear()

        try:
            for batch in iterator:
                for run in _runs(batch):
                    key = tuple(run.column(k)[0].as_py() for k in KEYS)
                    if None in key:
                        raise ValueError("a segment needs a source and an index")
                    if now is None or key != now.key:
                        if key in seen:
                            raise ValueError(f"the frames of segment {key} do not come together")
                        seen.add(key)
                        if now is not None:
                            rows.append(_row(part, files[-1], now))
                            note(LEDGER_ROWS)
                        if out is None or room <= held_bytes:  # files end between segments
                            flush()
                            if out is not None:
                                out.close()
                            files.append(f"{part}-{len(files)}.parquet")
                            system.create_dir(f"{root}/data", recursive=True)
                            out, room = pq.ParquetWriter(f"{root}/data/{files[-1]}", batch.schema, filesystem=system, compression="zstd"), self.file_bytes
                        planned = run.column("planned_frames")[0].as_py() if "planned_frames" in run.schema.names else None
                        now = _Open(key, planned)
                    now.add(run)
                    held.append(run)
                    held_bytes += run.nbytes
                    if held_bytes >= self.group_bytes:
                        flush()
            if now is None:
                return Written(None, [])
            rows.append(_row(part, files[-1], now))
            flush()
            out.close()
            note(1)
            ledger.close()
            return Written(part, files)
        except BaseException:
            for writer in (out, ledger):
                with contextlib.suppress(Exception):
                    writer.close()
            _remove(system, root, part, files)
            raise

    def commit(self, messages: list[Written | None]) -> None:
        """One file names all parts; it is moved to its place whole."""
        system, root = open_folder(self.path)
        target = f"{root}/ledger/commits/{self.commit_id}.json"
        mine = [m for m in messages if m is not None and m.part]
        if system.get_file_info(target).is_file:
            self.abort(messages)
            return
        system.create_dir(f"{root}/ledger/commits", recursive=True)
        lines = [json.dumps({"commit": self.commit_id, "committed_ms": time.time_ns() // 10**6, "part": m.part}) for m in mine]
        with system.open_output_stream(f"{root}/ledger/commits/_{self.commit_id}") as file:
            file.write("\n".join(lines).encode())
        system.move(f"{root}/ledger/commits/_{self.commit_id}", target)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = open_folder(self.path)
        for m in messages:
            if m is not None and m.part:
                _remove(system, root, m.part, m.files)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of one segment each."""
    if not batch.num_rows:
        return
    ids = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy() for k in KEYS]
    edges = np.flatnonzero(np.any([np.diff(i) != 0 for i in ids], axis=0)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield batch.slice(low, high - low)


def _row(part: str, file: str, s: _Open) -> dict:
    return {
        "part": part, "source_id": str(s.key[0]), "segment_index": s.key[1], "file": file, "frames": s.frames, "planned_frames": s.planned,
        "first_frame": s.first, "last_frame": s.last, "size_bytes": s.size, "seams_ok": s.seams_ok, "reason": s.reason(),
    }


def _remove(system, root: str, part: str, files: Sequence[str]) -> None:
    for name in (*(f"data/{f}" for f in files), f"ledger/parts/{part}.parquet"):
        with contextlib.suppress(OSError):
            system.delete_file(f"{root}/{name}")


class SegmentStore(DataSource):
    """The sink; options ``commit`` (id of the job, for retries), ``file_bytes``, ``group_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "segment_store"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def commit_segments(frames: DataFrame, path: str, commit: str | None = None, **options) -> None:
    """Write whole segments and commit them together.

    ``frames`` has ``source_id, segment_index, frame_index``, maybe ``planned_frames`` (of its segment) and ``seams_ok`` (of the frame; null
    counts as unchecked and passes), and the frame's data. A segment's frames go to one task; a source spreads over as many as it has segments.
    """
    frames.sparkSession.dataSource.register(SegmentStore)
    typed = frames.withColumns({"segment_index": F.col("segment_index").cast("long"), "frame_index": F.col("frame_index").cast("long")})
    if "planned_frames" in frames.columns:
        typed = typed.withColumn("planned_frames", F.col("planned_frames").cast("long"))
    met = typed.repartition(*KEYS).sortWithinPartitions(*KEYS, "frame_index")
    met.write.format(SegmentStore.name()).mode("append").options(**{k: str(v) for k, v in options.items()}, **({"commit": commit} if commit else {})).save(path)


def _ready(path: str) -> None:
    system, root = open_folder(path)
    for name in ("data", "ledger/parts", "ledger/commits"):
        system.create_dir(f"{root}/{name}", recursive=True)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every committed version of every segment: the ledger's columns with ``commit, committed_ms`` and ``promoted``."""
    _ready(path)
    commits = spark.read.schema(COMMIT_DDL).json(f"{path}/ledger/commits")
    parts = spark.read.schema(PART_DDL).parquet(f"{path}/ledger/parts")
    return parts.join(commits, "part").withColumn("promoted", F.col("reason").isNull() & (F.col("frames") > 0))


def current_segments(ledger: DataFrame) -> DataFrame:
    """The version of each segment that counts: the last promoted one."""
    row = F.struct(*[c for c in ledger.columns if c not in KEYS])
    newest = ledger.where("promoted").groupBy(*KEYS).agg(F.max_by(row, F.struct("committed_ms", "commit")).alias("r"))
    return newest.select(*KEYS, "r.*")


def segment_states(ledger: DataFrame) -> DataFrame:
    """Per segment: how often it was written, whether it is there, and why its last version was refused, if it was."""
    last = Window.partitionBy(*KEYS).orderBy(F.desc("committed_ms"), F.desc("commit"))
    placed = ledger.withColumn("_last", F.row_number().over(last))
    good = F.col("promoted")
    return placed.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("versions"), F.bool_or(good).alias("present"),
        F.max(F.when(F.col("_last") == 1, F.col("reason"))).alias("refused"),
        F.min_by(F.when(good, F.col("frames")), F.when(good, F.col("_last"))).alias("frames"),
    )


def read_segments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The frames of the current segments; files and segments that do not count are left out."""
    _ready(path)
    data = spark.read.schema(schema).parquet(f"{path}/data").withColumn("_file", F.col("_metadata.file_name"))
    current = current_segments(read_ledger(spark, path)).select(F.col("file").alias("_file"), *[F.col(k).alias(f"_{k}") for k in KEYS])
    same = (data["_file"] == current["_file"]) & (data["source_id"].cast("string") == current["_source_id"]) & (data["segment_index"] == current["_segment_index"])
    return data.join(current, same, "left_semi").drop("_file")

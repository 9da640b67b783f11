"""Keyed tables as snapshots: batches of changes with tombstones, copy-on-write by bucket.

A table is cut into buckets by a hash of its key. A batch of changes rewrites the buckets that it touches into a new folder and then adds a
manifest, which says for each bucket the folder that holds it; other buckets keep theirs. A reader follows one manifest, so it sees one snapshot,
and a writer that fails before its manifest leaves the table as it was. The newest change of a key counts, whatever the batch it came in:
deleted keys stay as tombstones, so an older change that comes late does not bring a key back. A manifest has one entry per bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from framelane.session import ensure_checkpoint_dir
from framelane.sources.files import open_folder

#: A bucket's rows are written by this many tasks.
SPREAD = 8


def _manifests(path: str) -> list[int]:
    system, root = open_folder(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))


def read_manifest(path: str, version: int | None = None) -> dict:
    """The newest manifest, or that of a version; version 0 is the empty table."""
    versions = _manifests(path)
    if version is None:
        version = versions[-1] if versions else 0
    if version == 0:
        return {"version": 0, "buckets": None, "schema": None, "folders": {}}
    system, root = open_folder(path)
    with system.open_input_stream(f"{root}/manifests/{version}.json") as file:
        return json.loads(file.read())


def _rows(spark: SparkSession, path: str, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
    """Rows and tombstones of some buckets, or of all."""
    wanted = manifest["folders"] if buckets is None else {str(b): manifest["folders"][str(b)] for b in buckets if str(b) in manifest["folders"]}
    paths = [f"{path}/data/{folder}/_bucket_={b}" for b, folder in sorted(wanted.items())]
    return spark.read.schema(manifest["schema"]).parquet(*paths) if paths else spark.createDataFrame([], manifest["schema"])


def _newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; rows of one place in the order come by content. Sums up in the tasks first."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order, *[c for c in others if c not in order])).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def apply_changes(changes: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], deleted: str = "deleted", buckets: int = 64) -> dict:
    """A new snapshot with a batch of changes; returns its manifest. An empty batch adds none.

    ``changes`` has the keys (not null), the columns of the ``order`` in time, ``deleted`` (null counts as false) and the data. ``buckets`` counts
    when the table is made. Raises if another writer has added a snapshot meanwhile; the batch can then be applied again.
    """
    spark, before = changes.sparkSession, read_manifest(path)
    n = before["buckets"] or buckets
    ensure_checkpoint_dir(spark)
    whole = changes.withColumn(deleted, F.coalesce(deleted, F.lit(False)))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    batch = _newest(whole, keys, order).withColumn("_bucket_", bucket).checkpoint()
    touched = [r[0] for r in batch.select("_bucket_").distinct().collect()]  # as many as buckets at most
    if not touched:
        return before
    schema = before["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    old = _rows(spark, path, {**before, "schema": schema}, touched)
    merged = _newest(old.unionByName(batch.drop("_bucket_")), keys, order).withColumn("_bucket_", bucket)
    folder = uuid.uuid4().hex
    met = merged.repartition(F.col("_bucket_"), F.pmod(F.xxhash64(*keys, F.lit("spread")), F.lit(SPREAD)))
    met.write.partitionBy("_bucket_").parquet(f"{path}/data/{folder}")
    after = {"version": before["version"] + 1, "buckets": n, "schema": schema, "folders": {**before["folders"], **{str(b): folder for b in touched}}}
    system, root = open_folder(path)
    system.create_dir(f"{root}/manifests", recursive=True)
    if _manifests(path)[-1:] not in ([], [before["version"]]):
        raise RuntimeError(f"another snapshot than {before['version']} is the newest")
    with system.open_output_stream(f"{root}/manifests/_{folder}") as file:
        file.write(json.dumps(after).encode())
    system.move(f"{root}/manifests/_{folder}", f"{root}/manifests/{after['version']}.json")
    return after


def read_table(spark: SparkSession, path: str, version: int | None = None, deleted: str = "deleted") -> DataFrame:
    """The live rows of a snapshot; that of the empty table raises, as it has no columns yet."""
    manifest = read_manifest(path, version)
    if manifest["schema"] is None:
        raise ValueError("the table has no snapshot")
    return _rows(spark, path, manifest).where(~F.col(deleted)).drop(deleted)

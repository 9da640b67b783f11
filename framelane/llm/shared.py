"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import ctypes.util
import sys
from collections.abc import Callable
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framelane.session import ensure_checkpoint_dir

#: The white space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def remembered(key, make: Callable):
    """What ``make`` gives, made once per Python worker; the package travels by value, so its globals do not outlive a task."""
    store = sys.modules.setdefault("framelane_llm_store", SimpleNamespace(found={})).found
    if key not in store:
        store[key] = make()
    return store[key]


def give_back() -> None:
    """Return freed memory to the machine: a Python worker lives on for other tasks, beside its executor."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim is not None:
        trim(0)


def slices(values: pa.Array, make: Callable[[list], list], kind: pa.DataType, rows: int = 256) -> pa.Array:
    """``make`` over an Arrow array, some rows at a time, so that Python objects of few rows exist at once."""
    parts = [pa.array(make(values.slice(at, rows).to_pylist()), kind) for at in range(0, len(values), rows)]
    give_back()
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def words_of(text: Column) -> Column:
    """The words of a text (``WORD``), in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

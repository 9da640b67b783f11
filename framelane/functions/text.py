"""Path, name and key expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from framelane.functions.numeric import col


def slashed(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def normalized_path(path: Column | str) -> Column:
    """Identity of a source path: trimmed, forward slashes, lower case."""
    return F.lower(slashed(F.trim(col(path))))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(slashed(path), r"([^/]*)$", 1)


def file_stem(path: Column | str) -> Column:
    """File name without its last extension; a leading dot is part of the stem."""
    name = file_name(path)
    stem = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.when(stem == "", name).otherwise(stem)


def file_extension(path: Column | str) -> Column:
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def sanitize_name(value: Column | str, fallback: str = "") -> Column:
    """ASCII letters and digits in lower case, every other character an underscore, outer underscores trimmed."""
    flat = F.btrim(F.lower(F.regexp_replace(col(value), "[^A-Za-z0-9]", "_")), F.lit("_"))
    return F.when(flat == "", F.lit(fallback)).otherwise(flat)


def sha_prefix(value: Column | str, length: int) -> Column:
    return F.substring(F.sha2(col(value), 256), 1, length)


def contains_text(columns: list[Column | str], query: str) -> Column:
    """Case-insensitive substring in any of the columns; a blank query matches everything."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), F.lit(needle))
    return hit

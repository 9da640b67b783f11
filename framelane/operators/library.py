"""Reference libraries, ratings and blind comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelane.functions.text import file_extension, file_stem, sanitize_name
from framelane.operators.ordered import blocked_row_number, blocked_running, index_block
from framelane.session import ensure_checkpoint_dir

MATCH_SLACK_MS = 1000
OFFSET_TOLERANCE = 0.25
NEVER = -9.0e15


def content_hash(content: Column | str) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def first_imports(library: DataFrame, incoming: DataFrame, content: str = "content") -> DataFrame:
    """Incoming files whose content is neither in the library nor came earlier in the import.

    ``library``: ``library_id, content_hash``; ``incoming``: ``library_id, file_name, seq, <content>`` with ``seq``
    the arrival number. Copies collapse map-side into the first arrival, however many there are.
    """
    hashed = incoming.select("library_id", content_hash(content).alias("content_hash"), "seq", "file_name")
    firsts = hashed.groupBy("library_id", "content_hash").agg(F.min_by(F.struct("seq", "file_name"), "seq").alias("_f"))
    fresh = firsts.join(library.select("library_id", "content_hash").distinct(), ["library_id", "content_hash"], "left_anti")
    return fresh.select("library_id", "content_hash", "_f.seq", "_f.file_name")


def destination_names(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add ``name``: the sanitised file name, with the first free ``_2``, ``_3``, ... where it is taken.

    ``existing``: ``library_id, name``. The k-th arrival of a name takes the k-th free number. A number taken by an
    arriving file's own name (``a_2.png``) is not given out again, so names stay unique whatever the arrival order.
    """
    keys = ["library_id", "_stem", "_ext"]

    def split_name(df: DataFrame, column: str) -> DataFrame:
        return df.withColumns(
            {"_stem": sanitize_name(file_stem(column), "context"), "_ext": sanitize_name(file_extension(column))}
        )

    arrivals = split_name(fresh, "file_name")
    present = split_name(existing, "name").select(*keys)

    def numbered(df: DataFrame) -> DataFrame:
        """Stems such as ``a_2`` also occupy number 2 of ``a``."""
        digits = F.regexp_extract("_stem", r"^.+_([1-9][0-9]*)$", 1).try_cast("bigint")
        return df.select(
            "library_id",
            F.regexp_extract("_stem", r"^(.+)_[1-9][0-9]*$", 1).alias("_stem"),
            "_ext",
            digits.alias("_taken"),
        ).where(F.col("_taken") >= 2)

    taken = (
        present.withColumn("_taken", F.lit(1).cast("bigint"))
        .unionByName(numbered(present))
        .unionByName(numbered(arrivals))
        .distinct()
    )
    # below the i-th taken number t there are t - i free ones; arrival k skips every taken number with t - i < k
    ranked = blocked_row_number(taken, keys, ["_taken"], index_block("_taken"), "_i")
    marks = ranked.select(
        *keys, (F.col("_taken") - F.col("_i") + 1).alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_skip"),
        F.lit(None).cast("bigint").alias("seq"),
    )
    counted = blocked_row_number(arrivals.select(*keys, "seq"), keys, ["seq"], index_block("seq"), "_at")
    probes = counted.select(*keys, "_at", F.lit(1).alias("_kind"), F.lit(0).alias("_skip"), F.col("seq").cast("bigint"))
    merged = blocked_running(
        marks.unionByName(probes), keys, ["_at", "_kind"], index_block("_at"), sums={"_skipped": "_skip"}
    ).where(F.col("_kind") == 1)
    number = F.col("_at") + F.col("_skipped")
    suffix = F.when(number > 1, F.concat(F.lit("_"), number.cast("string"))).otherwise(F.lit(""))
    extension = F.when(F.col("_ext") != "", F.concat(F.lit("."), F.col("_ext"))).otherwise(F.lit(""))
    named = merged.select("library_id", F.col("seq"), F.concat("_stem", suffix, extension).alias("name"))
    return fresh.join(named, ["library_id", "seq"])


def dedupe_import(library: DataFrame, incoming: DataFrame, content: str = "content") -> DataFrame:
    """Files an import adds: new content only, first arrival wins, with collision-free names.

    ``library``: ``library_id, name, content_hash``. The new files (ids and hashes only) are checkpointed, so that the
    contents are hashed and shuffled once although naming reads the list several times.
    """
    ensure_checkpoint_dir(incoming.sparkSession)
    return destination_names(library, first_imports(library, incoming, content).checkpoint())


def model_ratings(events: DataFrame, key: str = "model_id", order: Sequence[str] = ("updated_at",)) -> DataFrame:
    """Latest rating per model; a null rating removes it."""
    latest = events.groupBy(key).agg(F.max_by(F.struct("rating", "updated_at"), F.struct(*order)).alias("_r"))
    return latest.select(key, "_r.rating", "_r.updated_at").where(F.col("rating").isNotNull())


def pick_tally(picks: DataFrame, candidates: str = "candidates", winner: str = "winner") -> DataFrame:
    """Appearances and wins per model over all recorded comparisons."""
    each = picks.select(F.explode(F.array_distinct(candidates)).alias("model_id"), F.col(winner).alias("_w"))
    return each.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("appearances"), F.count_if(F.col("_w") == F.col("model_id")).alias("wins")
    )


def candidate_tally(candidates: DataFrame, winners: DataFrame, key: str = "record_id") -> DataFrame:
    """:func:`pick_tally` for comparisons kept in long form: ``candidates(record_id, model_id)`` and
    ``winners(record_id, model_id)``. Both sides are counted on their own, so a record of any size is never gathered."""
    appeared = candidates.select(key, "model_id").distinct().groupBy("model_id").agg(F.count(F.lit(1)).alias("appearances"))
    won = winners.groupBy("model_id").agg(F.count(F.lit(1)).alias("wins"))
    return appeared.join(won, "model_id", "left").select("model_id", "appearances", F.coalesce("wins", F.lit(0)).alias("wins"))


def picks_logged(picks: DataFrame, keys: Sequence[str] = ("source_path",)) -> DataFrame:
    return picks.groupBy(*keys).agg(F.count(F.lit(1)).alias("picks"))


def match_blind_record(sessions: DataFrame, picks: DataFrame, block_ms: int = 3_600_000) -> DataFrame:
    """For each comparison session the latest recorded pick that belongs to it (nulls where there is none).

    ``picks``: ``record_order, source_path, created_ms, signature, duration_seconds, start_offset_seconds, candidates,
    winner``; ``sessions``: ``session_id, source_path, started_ms`` and the same comparison fields. A pick belongs to
    a session of its source when it was not made before the session (with one second of slack) and its signature is
    equal; a pick without signature must have the same duration and candidates and an offset less than 0.25 s away.

    No session meets all the picks of its source: per comparison key, "latest record at or after a time" is a running
    maximum over picks and sessions merged in time order, cut into time blocks.
    """
    keys = ["_kind", "source_path", "_what", "_offset"]

    def setup_key() -> Column:
        return F.concat_ws("|", F.col("duration_seconds").cast("string"), F.to_json(F.array_sort("candidates")))

    offset = F.coalesce(F.col("start_offset_seconds").cast("double"), F.lit(0.0))
    signed = F.length("signature") > 0
    made = F.when(F.col("created_ms") > 0, F.col("created_ms").cast("double")).otherwise(F.lit(NEVER))
    records = picks.select(
        F.when(signed, 0).otherwise(1).alias("_kind"),
        "source_path",
        F.when(signed, F.col("signature")).otherwise(setup_key()).alias("_what"),
        F.when(signed, F.lit(0.0)).otherwise(offset).alias("_offset"),
        made.alias("_t"),
        F.col("record_order").cast("bigint").alias("_record"),
    )
    since = F.when(F.col("started_ms") > 0, F.col("started_ms") - F.lit(float(MATCH_SLACK_MS))).otherwise(F.lit(NEVER))
    by_signature = sessions.where(F.length("signature") > 0).select(
        "session_id", F.lit(0).alias("_kind"), "source_path", F.col("signature").alias("_what"),
        F.lit(0.0).alias("_offset"), since.alias("_t"),
    )
    # offsets lie on frame positions, so the distinct ones within a quarter second are few
    offsets = (
        records.where("_kind = 1")
        .select("source_path", "_what", "_offset")
        .distinct()
        .withColumn("_bucket", F.floor(F.col("_offset") / OFFSET_TOLERANCE))
    )
    center = F.floor(F.col("_near") / OFFSET_TOLERANCE)
    by_setup = (
        sessions.select("session_id", "source_path", setup_key().alias("_what"), offset.alias("_near"), since.alias("_t"))
        .withColumn("_bucket", F.explode(F.sequence(center - 1, center + 1)))
        .join(offsets, ["source_path", "_what", "_bucket"])
        .where(F.abs(F.col("_offset") - F.col("_near")) < OFFSET_TOLERANCE)
        .select("session_id", F.lit(1).alias("_kind"), "source_path", "_what", "_offset", "_t")
    )
    probes = by_signature.unionByName(by_setup)
    merged = (
        records.withColumn("session_id", F.lit(None).cast(dict(sessions.dtypes)["session_id"]))
        .unionByName(probes.withColumn("_record", F.lit(None).cast("bigint")))
        .withColumns({"_back": -F.col("_t"), "_probe": F.col("_record").isNull().cast("int")})
    )
    running = blocked_running(
        merged, keys, ["_back", "_probe"], F.floor(F.col("_back") / block_ms).cast("bigint"), maxima={"_latest": "_record"}
    )
    best = running.where("_probe = 1").groupBy("session_id").agg(F.max("_latest").alias("record_order"))
    winners = picks.select(F.col("record_order").cast("bigint").alias("record_order"), "winner")
    return sessions.select("session_id").join(best, "session_id", "left").join(winners, "record_order", "left").select(
        "session_id", "record_order", "winner"
    )


def shuffle_candidates(
    candidates: DataFrame, seed: str, keys: Sequence[str] = ("session_id",), item: str = "model_id"
) -> DataFrame:
    """Add ``position``: a reproducible anonymous order of the candidates of each session.

    The order is that of a keyed hash; its first byte is the block, so one session spreads over 256 pieces.
    """
    mixed = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col(item).cast("string")), 256)
    keyed = candidates.withColumn("_mix", mixed)
    block = F.conv(F.substring("_mix", 1, 2), 16, 10).cast("bigint")
    return blocked_row_number(keyed, list(keys), ["_mix", item], block, "position").drop("_mix")

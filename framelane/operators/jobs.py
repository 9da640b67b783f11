"""Job records: state, overlays, labels, search, sort, counts and storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelane.functions.text import contains_text, file_name
from framelane.operators.ordered import global_row_number

ACTIVE_STATES = ("queued", "running", "paused")
ATTENTION_STATES = ("failed", "interrupted")
# Messages that job records hold.
PAUSED_MESSAGE = "Job paused"
RECOVERED_MESSAGE = "Recovered running worker process detected outside the app state."
SEARCH_COLUMNS = ("label", "state", "phase", "message", "model_id", "source_path", "scratch_path", "output_path")


def resolve_job_state(jobs: DataFrame) -> DataFrame:
    """Add ``resolved_state``: a persisted queued/running record (or one without state) is judged by its progress."""
    done = (F.col("phase") == "completed") | (F.col("percent") >= 100)
    failed = F.when(F.contains(F.lower("message"), F.lit("cancel")), F.lit("cancelled")).otherwise(F.lit("failed"))
    judged = (
        F.when(done, F.lit("succeeded")).when(F.col("phase") == "failed", failed).otherwise(F.lit("interrupted"))
    )
    open_state = F.col("state").isNull() | F.col("state").isin("queued", "running")
    return jobs.withColumn("resolved_state", F.when(open_state, judged).otherwise(F.col("state")))


def overlay_pause(jobs: DataFrame, paused_message: str = PAUSED_MESSAGE) -> DataFrame:
    """Show a paused record as paused: phase and message prefix, unless it already finished."""
    applies = (F.col("state") == "paused") & ~F.col("phase").isin("completed", "failed")
    message = F.coalesce(F.col("message"), F.lit(""))
    text = (
        F.when(F.trim(message) == "", F.lit(paused_message))
        .when(F.contains(F.lower(message), F.lit("paused")), message)
        .otherwise(F.concat(F.lit(f"{paused_message}: "), message))
    )
    applies = F.coalesce(applies, F.lit(False))
    return jobs.withColumns(
        {
            "phase": F.when(applies, F.lit("paused")).otherwise(F.col("phase")),
            "message": F.when(applies, text).otherwise(F.col("message")),
        }
    )


def recover_running(jobs: DataFrame, active: DataFrame, key: str = "job_id") -> DataFrame:
    """Force records whose worker is still alive back to running; ``active`` lists the live ids."""
    live = active.select(key).distinct().withColumn("_live", F.lit(True))
    applies = F.col("_live").isNotNull() & (F.coalesce(F.col("state"), F.lit("")) != "paused")
    stale = applies & (
        F.coalesce(F.col("phase").isin("completed", "failed"), F.lit(False))
        | F.coalesce(F.col("percent") >= 100, F.lit(False))
    )
    phase = F.when(F.col("job_kind") == "sourceConversion", F.lit("encoding")).otherwise(F.lit("upscaling"))
    changes = {
        "state": F.when(applies, F.lit("running")).otherwise(F.col("state")),
        "phase": F.when(stale, phase).otherwise(F.col("phase")),
        "percent": F.when(stale, F.greatest(F.lit(1), F.least(F.lit(99), F.col("percent")))).otherwise(F.col("percent")),
        "message": F.when(stale, F.lit(RECOVERED_MESSAGE)).otherwise(F.col("message")),
    }
    return jobs.join(live, key, "left").select(*[changes[c].alias(c) if c in changes else F.col(c) for c in jobs.columns])


def job_kind_label(jobs: DataFrame) -> DataFrame:
    """Add ``kind_label`` from the stages that have counted frames; a model alone implies upscaling."""

    def counted(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) > 0

    has_model = F.coalesce(F.length("model_id") > 0, F.lit(False))
    motion, denoise, color = counted("interpolated_frames"), counted("denoised_frames"), counted("colorized_frames")
    upscale = counted("upscaled_frames") | has_model
    named_motion = motion & (upscale | (~denoise & ~color))
    parts = F.array_compact(
        F.array(
            F.when(denoise, F.lit("Denoise")),
            F.when(color, F.lit("Colorize")),
            F.when(upscale | (~denoise & ~color & ~motion), F.lit("Upscale")),
            F.when(named_motion, F.lit("Motion")),
        )
    )
    return jobs.withColumn(
        "kind_label",
        F.when(F.col("job_kind") == "sourceConversion", F.lit("Conversion")).otherwise(F.array_join(parts, " + ")),
    )


def search_jobs(jobs: DataFrame, query: str, columns: Sequence[str] = SEARCH_COLUMNS) -> DataFrame:
    return jobs.where(contains_text(list(columns), query))


def filter_jobs(jobs: DataFrame, status: str, column: str = "state") -> DataFrame:
    """``all``, ``running`` (any active state), ``failed`` (failed or interrupted) or an exact state."""
    if status == "all":
        return jobs
    states = {"running": ACTIVE_STATES, "failed": ATTENTION_STATES}.get(status, (status,))
    return jobs.where(F.col(column).isin(*states))


def job_state_counts(jobs: DataFrame, keys: Sequence[str] = (), column: str = "state") -> DataFrame:
    state = F.col(column)
    return jobs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("all_jobs"),
        F.count_if(state.isin(*ACTIVE_STATES)).alias("running"),
        F.count_if(state == "succeeded").alias("succeeded"),
        F.count_if(state == "cancelled").alias("cancelled"),
        F.count_if(state.isin(*ATTENTION_STATES)).alias("failed"),
    )


def overlay_live_jobs(history: DataFrame, live: DataFrame, key: str = "job_id") -> DataFrame:
    """Full outer overlay: live fields win, missing or zero-size ones fall back, ``updated_at`` is the later one."""
    values = [c for c in history.columns if c != key]
    a = history.select(key, F.struct(*values).alias("_h"))
    b = live.select(key, F.struct(*values).alias("_l"))

    def pick(name: str) -> Column:
        new, old = F.col(f"_l.{name}"), F.col(f"_h.{name}")
        if name == "updated_at":
            return F.greatest(new, old)
        if name.endswith("_size_bytes"):
            return F.coalesce(F.nullif(new, F.lit(0)), F.nullif(old, F.lit(0)), F.lit(0))
        if name == "message":
            return F.coalesce(F.nullif(new, F.lit("")), old, F.lit(""))
        return F.coalesce(new, old)

    return a.join(b, key, "full_outer").select(key, *[pick(c).alias(c) for c in values])


def union_job_records(summaries: DataFrame, legacy: DataFrame, key: str = "job_id") -> DataFrame:
    """Summaries plus the legacy records of jobs that have no summary."""
    extra = legacy.join(summaries.select(key).distinct(), key, "left_anti")
    return summaries.unionByName(extra, allowMissingColumns=True)


# Sort keys of the job table.
SORT_KEYS = {
    "state": (F.lower, "state", "label"),
    "id": (F.lower, "job_id"),
    "scratchSize": (None, "scratch_size_bytes"),
    "outputSize": (None, "output_size_bytes"),
    "updatedAt": (None, "updated_at"),
    "input": (lambda c: F.lower(file_name(F.coalesce(c, F.lit("")))), "source_path"),
    "output": (lambda c: F.lower(file_name(F.coalesce(c, F.lit("")))), "output_path"),
}


def sort_jobs(jobs: DataFrame, column: str = "scratchSize", direction: str = "desc", **limits) -> DataFrame:
    """Add ``position`` in the table order: the column, then newest first, then id; ``desc`` reverses all of it."""
    normalise, *names = SORT_KEYS[column]
    keyed = jobs
    order = []
    for i, name in enumerate(names):
        value = F.col(name) if normalise is None else normalise(F.col(name))
        keyed = keyed.withColumn(f"_k{i}", value)
        order.append(f"_k{i}")
    keyed = keyed.withColumns({"_age": -F.col("updated_at"), "_id": F.lower(F.col("job_id").cast("string"))})
    placed = global_row_number(
        keyed, [*order, "_age", "_id", "job_id"], "position", reverse=direction == "desc", **limits
    )
    return placed.drop(*order, "_age", "_id")


def _recency(column: str) -> Column:
    """Numeric update time; text that does not parse counts as 0."""
    return F.coalesce(F.col(column).try_cast("bigint"), F.lit(0).cast("bigint"))


def latest_jobs(jobs: DataFrame, k: int, updated: str = "updated_at") -> DataFrame:
    """The ``k`` most recently updated jobs (a distributed top-k)."""
    return jobs.orderBy(_recency(updated).desc(), F.col("job_id").asc()).limit(k)


def active_job(jobs: DataFrame, updated: str = "updated_at") -> DataFrame:
    """The newest job in an active state."""
    return latest_jobs(filter_jobs(jobs, "running"), 1, updated)


def storage_summary(files: DataFrame, roots: DataFrame, root: str = "root", size: str = "length") -> DataFrame:
    """Bytes, files and existence per requested root; roots without files stay with 0."""
    sums = files.groupBy(root).agg(F.sum(size).alias("size_bytes"), F.count(F.lit(1)).alias("files"))
    return roots.select(root).distinct().join(sums, root, "left").select(
        root,
        F.col("files").isNotNull().alias("exists"),
        F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
    )


def storage_tree(files: DataFrame, path: str = "path", size: str = "length", depth: int | None = None) -> DataFrame:
    """Bytes and files below every directory that has files somewhere below it, the topmost included.

    ``directory`` (without a slash at its end; the topmost is ``/``), ``level`` (0 for the topmost), ``own_files`` and ``own_bytes`` of files
    right in it, ``files`` and ``size_bytes`` of its whole tree; down to ``depth`` levels, below which files count for their ancestors only.
    Files are summed per directory before directories are repeated for their ancestors, so rows grow with directories times their depth, and
    both sums start in the tasks. A path without a slash lies in the topmost directory; null paths are left out; a null size counts as 0.
    """
    names = F.filter(F.split(F.regexp_replace(F.col(path), "[^/]*$", ""), "/"), lambda n: n != "")
    per_directory = (
        files.where(F.col(path).isNotNull())
        .select(names.alias("_names"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_b"))
        .groupBy("_names")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_b").alias("_b"))
    )
    deepest = F.size("_names") if depth is None else F.least(F.size("_names"), F.lit(depth))
    level = F.explode(F.sequence(F.lit(0), deepest)).alias("level")
    own = F.col("level") == F.size("_names")
    spread = per_directory.select("*", level).withColumn("directory", F.concat(F.lit("/"), F.array_join(F.slice("_names", F.lit(1), F.col("level")), "/")))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return spread.groupBy("directory", "level").agg(
        whole(F.when(own, F.col("_n"))).alias("own_files"), whole(F.when(own, F.col("_b"))).alias("own_bytes"),
        whole("_n").alias("files"), whole("_b").alias("size_bytes"),
    )


def cleanup_targets(jobs: DataFrame, kind: str = "all") -> DataFrame:
    """How many artifacts a bulk clean-up would remove and their bytes; ``scratch``, ``output`` or ``all``."""
    kinds = {"scratch": ("scratch",), "output": ("output",), "all": ("scratch", "output")}[kind]
    entries = F.array(
        *[F.struct(F.col(f"{k}_path").alias("path"), F.col(f"{k}_size_bytes").alias("bytes")) for k in kinds]
    )
    present = jobs.select(F.explode(F.filter(entries, lambda e: F.length(e["path"]) > 0)).alias("_e"))
    return present.agg(
        F.count(F.lit(1)).alias("targets"), F.coalesce(F.sum("_e.bytes"), F.lit(0)).alias("total_bytes")
    )

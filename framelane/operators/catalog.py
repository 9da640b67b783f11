"""Model catalog: backends, policies of which models are shown, and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framelane.operators.ordered import blocked_row_number

VIDEO_BACKEND = "pytorch-video-sr"
TOP_RANK = 6


def with_defaults(models: DataFrame) -> DataFrame:
    """Fill the catalog defaults."""
    return models.withColumns(
        {
            "task": F.coalesce("task", F.lit("upscale")),
            "execution_status": F.coalesce("execution_status", F.lit("planned")),
            "quality_rank": F.coalesce("quality_rank", F.lit(999)),
            "support_tier": F.coalesce("support_tier", F.lit("next")),
            "visible_in_ui": F.coalesce("visible_in_ui", F.lit(False)),
            "comparison_eligible": F.coalesce("comparison_eligible", F.lit(False)),
        }
    )


def _rule(kind: str) -> Column:
    runnable = F.col("execution_status") == "runnable"
    return {
        "visible": F.col("visible_in_ui"),
        "ui": F.col("visible_in_ui") | (F.col("execution_status") == "planned"),
        "runnable": runnable,
        "comparison": F.col("comparison_eligible") & runnable,
        "top_rated": F.col("quality_rank") <= TOP_RANK,
        "benchmarkable": runnable | ((F.col("backend_id") == VIDEO_BACKEND) & (F.col("support_tier") == "research")),
    }[kind]


def catalog_filter(models: DataFrame, kind: str, task: str | None = "upscale") -> DataFrame:
    """Models of a list: ``visible``, ``ui``, ``runnable``, ``comparison``, ``top_rated`` or ``benchmarkable``."""
    filled = with_defaults(models).where(_rule(kind))
    return filled if task is None else filled.where(F.col("task") == task)


def models_with_backends(models: DataFrame, backends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models with their backend's columns, models naming an unknown backend). Spark picks the join strategy."""
    side = backends.select("backend_id", *[F.col(c).alias(f"backend_{c}") for c in backends.columns if c != "backend_id"])
    return models.join(side, "backend_id"), models.join(side, "backend_id", "left_anti")


def rank_models(models: DataFrame, task: str = "task") -> DataFrame:
    """Add ``rank_position`` within a task: by quality rank, then label without regard to case, then id.

    The quality rank itself is the block, so no task is windowed in one piece.
    """
    keyed = models.withColumn("_label", F.lower("label"))
    return blocked_row_number(
        keyed, [task], ["quality_rank", "_label", "model_id"], F.col("quality_rank").cast("bigint"), "rank_position"
    ).drop("_label")

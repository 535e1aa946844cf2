"""Batch export: every report as a table in a folder, large ones partitioned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinelle.functions import scores
from sentinelle.operators import analytics as A
from sentinelle.operators import conflicts as C
from sentinelle.sources.views import HOUR

REPORTS = ("activity_score_by_window", "count_by_severity", "coverage_by_source", "chokepoint_activity", "control_assessment", "operations_holdings", "snapshot_meta")


def export(spark: SparkSession, sf_dir: str, folder: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]], reports=REPORTS, form: str = "parquet") -> list[str]:
    """Writes the named reports; a rerun replaces them."""
    for name in reports:
        queries[name](spark, sf_dir).write.mode("overwrite").format(form).save(f"{folder}/{name}")
    return [f"{folder}/{name}" for name in reports]


def export_parts(observations: DataFrame, incidents: DataFrame, conflicts: DataFrame, now: int, folder: str) -> list[str]:
    """The parts of a snapshot that are read one at a time: incidents and observations by time, series and conflict activity
    by window, evidence by incident.

    Windows are folders; evidence lies in files sorted by incident, so that one incident's rows are found by the files'
    statistics and no incident needs a folder of its own.
    """
    for token, hours, bucket in scores.WINDOWS:
        A.series(incidents, "occurred", now, hours, bucket).write.mode("overwrite").parquet(f"{folder}/analytics/window={token}")
        C.tempo(conflicts, "received", now, hours * HOUR).write.mode("overwrite").parquet(f"{folder}/conflicts/window={token}")
    for name, rows in (("incidents", incidents), ("observations", observations)):
        rows.repartitionByRange("occurred").sortWithinPartitions("occurred", "id").write.mode("overwrite").parquet(f"{folder}/{name}")
    evidence = observations.where(F.col("incident").isNotNull()).repartitionByRange("incident").sortWithinPartitions("incident", "received")
    evidence.write.mode("overwrite").parquet(f"{folder}/evidence")
    return [f"{folder}/{part}" for part in ("incidents", "observations", "analytics", "conflicts", "evidence")]


def pruned(rows: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """A table without the rows that retention lets go."""
    return rows.join(dead.select(key), key, "left_anti")

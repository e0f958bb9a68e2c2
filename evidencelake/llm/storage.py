"""Tables written between jobs, in the folder that all executors and the driver share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.stage import delete, scratch


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors. ``drop(staged)`` deletes them when no plan needs them;
    what is left is deleted when the driver's Python ends.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete the files of staged tables."""
    for df in staged:
        path = getattr(df, "staged_path", None)
        if path:
            delete(df.sparkSession, path)

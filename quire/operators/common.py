"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.session import scratch_path


def sized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    The planner then knows its true size in bytes: Spark broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it beyond.  Its
    input is not computed again, and a lost executor re-reads the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

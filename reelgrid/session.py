"""Session and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("reelgrid")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

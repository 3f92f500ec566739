"""Helpers that every operator of this folder shares: column picking and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where unset, a local session (tests) sets one, a cluster raises."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if found is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="reelgrid-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return str(found)


#: Lets Spark remove the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders written by ``stored`` in this process.
STORED: list[str] = []


def written(df: DataFrame, *by: str) -> str:
    """Writes ``df`` as Parquet into the shared folder, one folder a value of ``by``; the files go when the driver ends, shuffle files at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reelgrid-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    STORED.append(path)
    atexit.register(drop, spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def bucketed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The same rows from a table in the shared folder that is bucketed by ``key``: joins on it don't shuffle it.

    rows: about how many there are; some 2^18 go into a bucket.
    """
    spark = df.sparkSession
    name = f"reelgrid_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows >> 18))
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    STORED.append(path)
    atexit.register(drop, spark, path)
    return spark.table(name)


def drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        shutil.rmtree(path, ignore_errors=True)
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more; of a bucketed one the name stays in the session's catalogue."""
    for path in {f.rsplit("/", 1)[0].removeprefix("file://") for f in df.inputFiles()}:
        if path in STORED:
            STORED.remove(path)
            drop(df.sparkSession, path)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def place(df: DataFrame, name: str) -> int:
    """Position of a column: the exact name first, else the same name in other case."""
    cols = df.columns
    if name in cols:
        return cols.index(name)
    low = [c.lower() for c in cols]
    if name.lower() in low:
        return low.index(name.lower())
    raise ValueError(f"no column {name} in {cols}")


def positional(df: DataFrame) -> DataFrame:
    """The same rows with columns _0, _1, ...: names that clash can't matter."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **want: str) -> DataFrame:
    """Selects columns as new=old[:type], whatever other columns there are; a value that isn't of the type (an id without a number) is NULL."""
    flat = positional(df)
    out = []
    for new, spec in want.items():
        old, _, kind = spec.partition(":")
        c = F.col(f"_{place(df, old)}")
        out.append((c.try_cast(kind) if kind else c).alias(new))
    return flat.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Session helpers shared by the operators: table access and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The cluster's setting wins; a local folder is made only where none is set."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get(CHECKPOINT_KEY, None) or spark.conf.get(CHECKPOINT_KEY, None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "tabulon-checkpoints")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def _steady(spark: SparkSession) -> None:
    """Keeps adaptive execution from replacing empty inputs of later jobs by empty relations: in Spark 4.1 describing such a plan to listeners
    can overflow the stack. A rule that the session already excludes stays excluded."""
    key, rule = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    now = spark.conf.get(key, None) or ""
    if rule not in now:
        spark.conf.set(key, f"{now},{rule}" if now else rule)


#: Folders made inside open scratch() blocks, innermost last.
_scopes: list[list[tuple[DataFrame, str]]] = []


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it with its lineage cut; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    _steady(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _scopes:
        file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            _scopes[-1].append((out, file.get()))
    return out


#: Whether Spark deletes the shuffle files of a query when it ends; else they stay until the driver's garbage collection finds them.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, compression: str | None = None, tidy: bool = False) -> DataFrame:
    """Writes df as Parquet under the shared checkpoint folder and reads it back; smaller than a checkpoint for wide tables. With tidy, the shuffle files of
    the write are deleted as soon as it ends."""
    import uuid

    _steady(df.sparkSession)
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression) if compression else df.write
    before = df.sparkSession.conf.get(CLEANUP_KEY)
    if tidy:
        df.sparkSession.conf.set(CLEANUP_KEY, "true")
    try:
        writer.parquet(path)
    finally:
        if tidy:
            df.sparkSession.conf.set(CLEANUP_KEY, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _scopes:
        _scopes[-1].append((out, path))
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Within the block, what cut() and stored() write is noted; at its end all of it is deleted but what was handed to the function that the block gets.

        with scratch(spark) as keep:
            out = keep(stored(transform(df), "result"))

    DataFrames that read a deleted folder can't be used any more, so a result must be stored and kept. Kept folders are left to an enclosing block."""
    mine: list[tuple[DataFrame, str]] = []
    kept: list[DataFrame] = []
    _scopes.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scopes.remove(mine)
        for df, path in mine:
            if any(df is k for k in kept):
                if _scopes:
                    _scopes[-1].append((df, path))
                continue
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

"""Session helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir`` (one Parquet file or a folder of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or a ValueError that lists the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``. Only on one machine (a local master, as in tests) is a
    temporary one made where neither that nor a folder set on the context exists; on a cluster this is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tracelake-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores if its files give fewer partitions than there are cores.

    Meant for scans in front of CPU-heavy Arrow stages. On inputs with at least as many splits as
    cores (any large input) the scan is returned as it is, without a shuffle. So is what has a shuffle
    below already, whose number of partitions is only known when it runs.
    """
    sc = df.sparkSession.sparkContext
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df
    if execution.toRdd().getNumPartitions() < sc.defaultParallelism:
        return df.repartition(sc.defaultParallelism)
    return df

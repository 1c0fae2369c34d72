"""Where the input tables are."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in the folder ``sf_dir``, which may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share, and read again; it cuts the lineage of loops.

    The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset and all executors are in this
    process (a local session, tests) an own one is made, which goes when the process ends.
    """
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        made = tempfile.mkdtemp(prefix="weftarc-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        at = spark.sparkContext.getCheckpointDir()
    path = f"{at.rstrip('/')}/weftarc/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

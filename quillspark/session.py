"""Sessions and shared-folder tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "quillspark", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and, on one machine, as many shuffle partitions as cores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if "spark.master" not in conf and "SPARK_MASTER" not in os.environ:
        builder = builder.master("local[*]").config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
    return builder.config(map=conf).getOrCreate()


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where the setting is missing (tests, one machine) one of this machine is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut and executors may be lost."""
    spark = df.sparkSession
    path = f"{shared(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

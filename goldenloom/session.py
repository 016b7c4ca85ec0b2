"""Session helpers: table access and written tables in the shared scratch folder.

Long jobs cut their lineage by writing a table into the folder that the
cluster names in ``spark.checkpoint.dir``; every executor reads the same copy,
so a lost executor costs only the tasks it was running. Where the setting is
absent, as in tests, the session's warehouse folder takes its place.

What a job has no more use for it drops as it goes; the tables that its result
reads stay until the driver's program ends and are dropped then.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_roots: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or one in the warehouse where the cluster names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_goldenloom"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, root in _roots:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, root)
        except Exception:  # the session has ended before
            pass


class Scratch:
    """Written tables of one job, under one folder of its own in the shared folder."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{job}-{uuid.uuid4().hex[:12]}"
        if not _roots:
            atexit.register(_clean)
        _roots.append((spark, self.root))

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def qualified(self, label: str) -> str:
        """The path as a URI with its file system, for readers other than Spark."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(label))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(p).toString()

    def save(self, df: DataFrame, label: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def save_and(self, df: DataFrame, label: str, *aggregates: Column) -> tuple[DataFrame, dict]:
        """The saved table and aggregates of its rows, taken while it is written."""
        seen = Observation()
        saved = self.save(df.observe(seen, *aggregates), label)
        return saved, seen.get

    def drop(self, *labels: str) -> None:
        for label in labels:
            _delete(self.spark, self.path(label))


def utc_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of an instant in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")

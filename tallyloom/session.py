"""Sessions with the settings that the planner counts on."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Names may differ in case alone or hold dots; adaptive execution deals with skew and small partitions.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tallyloom", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder all executors see; a temporary one only in local mode, where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a relation that the planner knows the size of, so that joins with it need no shuffle."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table({name.strip("`"): pa.array(list(c), _ARROW[kind]) for (name, kind), c in zip(fields, columns, strict=True)}))

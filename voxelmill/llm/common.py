"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/voxelmill-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps do not recompute it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: ends the lineage in iterative jobs."""
    scratch(df.sparkSession)
    return df.checkpoint()


def whole_row(df: DataFrame):
    """All columns as a struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def filtered(df: DataFrame, run) -> DataFrame:
    """``mapInArrow`` of a function that keeps whole rows; columns may have any names."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def text_of(df: DataFrame):
    """The text column with null as the empty text."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def slices(batches, step: int = 256):
    """Arrow batches in small slices, so that Python holds few texts at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)

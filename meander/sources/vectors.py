"""Line-delimited embedding vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meander.schemas import VECTOR_LINE


def vector_source(spark: SparkSession, path: str, default_track: str = "retrieval", stream: bool = False) -> DataFrame:
    """``{"vector": [...], "track": ...}`` lines; lines without a vector are dropped."""
    reader = spark.readStream if stream else spark.read
    lines = reader.schema(VECTOR_LINE).json(path)
    return lines.filter(F.col("vector").isNotNull()).withColumn(
        "track", F.coalesce("track", F.lit(default_track))
    )

"""Generated inputs: boxes in a row, ramps of logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def boxes(spark: SparkSession, n: int, width: float = 40.0, height: float = 20.0, stride: float = 45.0) -> DataFrame:
    """Rows (image_id, box_no, x0, y0, x1, y1): n boxes of one image in one row."""
    x = F.col("id") * stride
    return spark.range(n).select(F.lit(0).cast("bigint").alias("image_id"), F.col("id").alias("box_no"), x.alias("x0"), F.lit(10.0).alias("y0"), (x + width).alias("x1"), F.lit(10.0 + height).alias("y1"))


def logits(spark: SparkSession, steps: int, classes: int) -> DataFrame:
    """Rows (crop_id, t, class, v): a ramp that peaks at class ``t mod classes``."""
    t, c = F.floor(F.col("id") / classes).cast("int"), (F.col("id") % classes).cast("int")
    return spark.range(steps * classes).select(F.lit(0).cast("bigint").alias("crop_id"), t.alias("t"), c.alias("class"), (F.abs(c - t % classes) * -0.5).cast("double").alias("v"))

"""Images by path, and models by language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import imaging


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (image_id, path, extension, content) of a folder of images."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("image_id"), "path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "content")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Rows (image_id, path, image, error) of a folder: decoded by Spark's image source, and what that refuses by ``imaging.decode``.

    Its pixels are blue, green, red and, for some, opacity; a file that it cannot decode has a width of -1.
    """
    files = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    turned = files.withColumn("path", F.regexp_replace("origin", "^file:/+", "file:/")).filter("width > 0")
    read = imaging.map_arrow(turned.select("path", "width", "height", "nChannels", "data"), _turned, f"path string, image {imaging.IMAGE}, error string")
    done = turned.select("path")
    # only the others' contents are read: the source is asked which files it decodes, all files are listed
    rest = image_files(spark, path).join(done, "path", "left_anti").select("path", "content")
    more = imaging.decode_images(rest).select("path", "image", "error")
    return read.unionByName(more).select(F.xxhash64("path").alias("image_id"), "path", "image", "error")


def _turned(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of the image source with their pixels as red, green, blue."""
    made = []
    for w, h, n, data in zip(*(batch.column(c) for c in ("width", "height", "nChannels", "data")), strict=True):
        w, h, n = w.as_py(), h.as_py(), n.as_py()
        px = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, n)
        px = np.repeat(px, 3, axis=2) if n == 1 else px[:, :, 2::-1]
        made.append({"width": w, "height": h, "rgb8": np.ascontiguousarray(px).tobytes()})
    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgb8", pa.binary())])
    return pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, kind), pa.nulls(batch.num_rows, pa.string())], names=["path", "image", "error"])


def formats(spark: SparkSession) -> DataFrame:
    """Rows (extension, decoder): what ``images`` reads, as the Java image readers of the driver and ``imaging.decode`` tell it."""
    known = {str(x).lower() for x in spark._jvm.javax.imageio.ImageIO.getReaderFormatNames()}
    rows = [(x, "image source") for x in sorted(known)] + [(x, "own") for x in sorted({"png", "ppm", "pgm", "bmp"} - known)]
    return spark.createDataFrame(rows, "extension string, decoder string")


def charset(spark: SparkSession, language: str, chars: str) -> DataFrame:
    """Rows (language, class, ch); class 0 is the blank."""
    return spark.createDataFrame([(language, k, c) for k, c in enumerate(chars, 1)], "language string, class int, ch string")


def verified(models: DataFrame) -> DataFrame:
    """``models`` (role, content, sha256) with the reason that a row cannot be used: a role twice, or another digest."""
    twice = models.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    reason = F.when(F.col("n") > 1, "role given twice").when(F.sha2("content", 256) != F.lower("sha256"), "other digest")
    return models.join(twice, "role").withColumn("error", reason).drop("n")


def page_files(listing: DataFrame, wanted: DataFrame, ranks: Column) -> DataFrame:
    """For each stem of ``wanted`` (stem) its first file of ``listing`` (stem, path, extension) by rank; null if none."""
    best = listing.withColumn("rank", ranks).groupBy("stem").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return wanted.join(best, "stem", "left")

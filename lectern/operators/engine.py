"""Reading pages: detection, grouping, cropping, recognition, filtering, as one DataFrame pipeline.

Models are functions over numpy arrays (a session of a model file, or any other) that
travel to the tasks; everything between them is DataFrame code.

Results have a column ``error``. A page that could not be decoded, or whose detector or recogniser failed, has
one row, which says why, and no other; a region that cannot be cut is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.operators import components, decoding, grouping, imaging
from lectern.operators.stages import materialize
from lectern.sources import models

Detector = Callable[[np.ndarray], np.ndarray]  # (3, H, W) -> (H/2, W/2, 2): region and link scores
Recognizer = Callable[[np.ndarray], np.ndarray]  # (B, 1, 64, W) -> (B, T, C)


def _maps(detect: Detector, rgb: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Region and link scores of a page resized to (width, height)."""
    out = detect(imaging.detector_input(rgb, width, height))
    if out.ndim != 3 or out.shape.count(2) != 1:
        raise ValueError(f"scores need one axis of two channels, not {out.shape}")
    region, link = np.moveaxis(out, out.shape.index(2), 0).astype(np.float64)
    return region, link


def _pages(images: DataFrame) -> list[str]:
    """What is read of a table of pages: their numbers, images, and why there is none."""
    return ["image_id", "image", *(["error"] if "error" in images.columns else [])]


def _steps(scored: DataFrame) -> DataFrame:
    """Rows (crop_id, t, class, v) of the crops that could be read."""
    steps = scored.filter("error is null").select("crop_id", F.posexplode("rows").alias("t", "row"))
    return steps.select("crop_id", "t", F.posexplode("row").alias("class", "v"))


@dataclass(frozen=True)
class Detection:
    text_threshold: float = 0.7
    link_threshold: float = 0.4
    low_text: float = 0.4
    canvas: int = 2560
    mag_ratio: float = 1.0
    min_size: float = 20.0
    orientation: bool = False
    probe_canvas: int = 1280
    orientation_margin: float = 0.05
    max_megapixels: float | None = None

    def __post_init__(self) -> None:
        if self.max_megapixels is not None and not 0 < self.max_megapixels < float("inf"):
            raise ValueError("max_megapixels must be finite and positive")


@dataclass(frozen=True)
class Recognition:
    decoder: str = "greedy"
    beam_width: int = 5
    contrast_ths: float = 0.1
    adjust_contrast: float = 0.5
    filter_ths: float = 0.1
    allowlist: str = ""
    blocklist: str = ""
    batch_size: int = 1

    def __post_init__(self) -> None:
        if not 0 <= self.filter_ths <= 1:
            raise ValueError("filter_ths must be in [0, 1]")
        if self.beam_width < 1 or self.batch_size < 1:
            raise ValueError("beam_width and batch_size must be at least 1")
        if self.decoder not in ("greedy", "beamsearch"):
            raise ValueError(f"decoder {self.decoder} is not there")


@dataclass
class Reader:
    """A pipeline over tables of images: (image_id, image)."""

    detector: Detector
    recognizer: Recognizer
    charset: str
    detection: Detection = field(default_factory=Detection)
    recognition: Recognition = field(default_factory=Recognition)

    def _plan(self, images: DataFrame, canvas: int) -> DataFrame:
        d, size = self.detection, (F.col("image.width"), F.col("image.height"))
        limit = F.lit(canvas) if d.max_megapixels is None else g.budget_canvas(*size, canvas, int(d.max_megapixels * 1e6))
        return images.withColumn("plan", g.resize_plan(*size, limit, d.mag_ratio))

    def scores(self, images: DataFrame, canvas: int | None = None) -> DataFrame:
        """``images`` with ``maps`` struct<h, w, inv_ratio, region, link>."""
        detect = self.detector

        def one(image: dict, plan: dict) -> dict:
            region, link = _maps(detect, imaging.as_array(image), plan["w"], plan["h"])
            return {"h": region.shape[0], "w": region.shape[1], "inv_ratio": image["width"] / plan["w"], "region": region.ravel().tolist(), "link": link.ravel().tolist()}

        return imaging.map_column(self._plan(images, canvas or self.detection.canvas), "maps", "struct<h:int,w:int,inv_ratio:double,region:array<double>,link:array<double>>", one, "image", "plan").drop("plan")

    def oriented(self, images: DataFrame) -> DataFrame:
        """``images`` (image_id, image) with ``rotation`` and the image turned by it; without the pre-pass every page stays as it is.

        A page is turned when the masses of its four probes agree on it, see ``components.pick_rotation``.
        """
        d, detect = self.detection, self.detector
        if not d.orientation:
            return images.withColumn("rotation", F.lit(0))

        def probe(image: dict) -> list:
            px, out = imaging.as_array(image), []
            for degrees in (0, 90, 180, 270):
                turned = imaging.rotate(px, degrees)
                ratio = min(max(turned.shape[:2]), d.probe_canvas) / max(turned.shape[:2])
                out.append(components.masses(*_maps(detect, turned, max(1, int(turned.shape[1] * ratio)), max(1, int(turned.shape[0] * ratio))), d.low_text, d.link_threshold))
            return [{"region": r, "link": l} for r, l in out]

        def turn(image: dict, rotation: int) -> dict:
            px = np.ascontiguousarray(imaging.rotate(imaging.as_array(image), rotation))
            return {"width": px.shape[1], "height": px.shape[0], "rgb8": px.tobytes()}

        probed = imaging.map_column(images.select(*_pages(images)), "probe", "array<struct<region:double,link:double>>", probe, "image")
        combined, link = F.transform("probe", lambda p: p["region"] + p["link"]), F.transform("probe", lambda p: p["link"])
        rotation = F.when(F.col("error").isNull(), components.pick_rotation(combined, link, d.orientation_margin)).otherwise(F.lit(0))
        picked = probed.withColumn("rotation", rotation).drop("probe")
        return imaging.map_column(picked, "turned", imaging.IMAGE, turn, "image", "rotation").drop("image").withColumnRenamed("turned", "image")

    def detect(self, images: DataFrame) -> DataFrame:
        """Rows (image_id, region_no, quad, axis_aligned, error) of images (image_id, image), in the pages' own frames."""
        working, regions, failed = self._found(images)
        return self._upright(working, regions).unionByName(failed, allowMissingColumns=True)

    def _found(self, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The working frames (image_id, image, rotation), written once, regions in them, and failed pages (image_id, error).

        Labels and boxes are made where the model ran.
        """
        d, detect = self.detection, self.detector
        working = self.oriented(images.select(*_pages(images)))
        if d.orientation:
            working = materialize(working, "frames")

        def one(image: dict, plan: dict) -> list:
            found = components.map_boxes(*_maps(detect, imaging.as_array(image), plan["w"], plan["h"]), d.low_text, d.link_threshold, d.text_threshold)
            factor = image["width"] / plan["w"] * 2
            return [[{"x": float(x) * factor, "y": float(y) * factor} for x, y in box] for box in found]

        boxed = imaging.map_column(self._plan(working, d.canvas), "boxes", "array<array<struct<x:double,y:double>>>", one, "image", "plan")
        boxed = materialize(boxed.select("image_id", "boxes", "error"), "boxes")
        quads = boxed.select("image_id", F.posexplode("boxes").alias("box_no", "quad")).withColumn("box_no", F.col("box_no").cast("bigint"))
        failed = boxed.filter("error is not null").select("image_id", "error")
        return working, materialize(grouping.regions(quads, d.min_size), "regions"), failed

    def _upright(self, working: DataFrame, regions: DataFrame) -> DataFrame:
        """Regions with their quads in the frame of the page as it was given."""
        if not self.detection.orientation:
            return regions
        w, h = F.col("image.width"), F.col("image.height")
        sideways = F.col("rotation").isin(90, 270)
        page = working.select("image_id", "rotation", F.when(sideways, h).otherwise(w).cast("double").alias("w"), F.when(sideways, w).otherwise(h).cast("double").alias("h"))
        return regions.join(page, "image_id").withColumn("quad", g.unrotate(F.col("quad"), F.col("rotation"), F.col("w"), F.col("h"))).drop("rotation", "w", "h")

    def logits(self, crops: DataFrame, adjusted: bool = False) -> DataFrame:
        """Rows (crop_id, t, class, v) of crops (crop_id, crop struct<width, height, grey>) that could be read, see ``scored``."""
        return _steps(self.scored(crops, adjusted))

    def scored(self, crops: DataFrame, adjusted: bool = False) -> DataFrame:
        """Rows (crop_id, rows, error): what the recogniser gives for each crop, a list of classes a step.

        With ``batch_size`` above 1, up to that many crops of a page (page, place: their order) share one call of the model, padded to the widest.
        """
        recognise, target, size = self.recognizer, self.recognition.adjust_contrast, self.recognition.batch_size

        def read(some: list[dict]) -> list:
            cut = [np.frombuffer(c["grey"], np.uint8).reshape(c["height"], c["width"]) for c in some]
            return recognise(imaging.recognizer_rows([imaging.adjust_contrast(c, target) if adjusted else c for c in cut])).astype(float).tolist()

        if size == 1 or "page" not in crops.columns:
            rows = imaging.map_column(crops.select("crop_id", "crop"), "rows", "array<array<double>>", lambda crop: read([crop])[0], "crop")
        else:
            chunks = crops.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "crop_id", "crop"))).alias("l"))
            chunk = F.transform(F.sequence(F.lit(0), F.ceil(F.size("l") / size).cast("int") - 1), lambda k: F.slice("l", k * size + 1, F.lit(size)))
            chunks = chunks.select(F.explode(chunk).alias("l"))
            told = imaging.map_column(chunks, "rows", "array<array<array<double>>>", lambda l: read([x["crop"] for x in l]), "l")
            rows = told.select(F.explode(F.arrays_zip(F.transform("l", lambda x: x["crop_id"]).alias("crop_id"), F.col("rows"))).alias("z"), "error").select("z.crop_id", "z.rows", "error")
        return rows.select("crop_id", "rows", "error")

    def texts(self, crops: DataFrame) -> DataFrame:
        """Rows (crop_id, text, confidence, error), unsure crops read a second time with more contrast.

        Scores of both passes are written once, so that the model is called once for a crop and pass. A crop that
        the recogniser failed on in either pass has the error and no text.
        """
        r = self.recognition
        chars = crops.sparkSession.createDataFrame([(k, c) for k, c in enumerate(self.charset, 1)], "class int, ch string")
        ignored = decoding.ignored_classes(chars, r.allowlist, r.blocklist) if r.allowlist or r.blocklist else None

        def read(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
            rows = materialize(rows, "scores")
            steps = _steps(rows)
            texts = decoding.greedy_decode(steps, chars, ignored) if r.decoder == "greedy" else decoding.beam_decode(steps, chars, r.beam_width, ignored)
            return materialize(texts, "texts"), rows.filter("error is not null").select("crop_id", "error")

        first, failed = read(self.scored(crops))
        unsure = crops.join(first.filter(F.col("confidence") < r.contrast_ths).select("crop_id"), "crop_id", "left_semi")
        second, more = read(self.scored(unsure, True))
        failed = failed.unionByName(more)
        sound = decoding.retry(first, second, r.contrast_ths).join(failed.select("crop_id"), "crop_id", "left_anti")
        return sound.unionByName(failed, allowMissingColumns=True)

    def crops(self, images: DataFrame, regions: DataFrame) -> DataFrame:
        """Rows (image_id, region_no, quad, crop_id, crop); regions that cannot be cut are left out."""

        def one(image: dict, quad: list, flat: bool) -> dict:
            px, q = imaging.grey(imaging.as_array(image)), np.array([[p["x"], p["y"]] for p in quad])
            cut = imaging.crop_box(px, *q.min(axis=0), *q.max(axis=0)) if flat else imaging.crop_quad(px, q)
            return {"width": cut.shape[1], "height": cut.shape[0], "grey": np.ascontiguousarray(cut).tobytes()}

        cut = imaging.map_column(regions.join(images.select("image_id", "image"), "image_id"), "crop", "struct<width:int,height:int,grey:binary>", one, "image", "quad", "axis_aligned")
        return cut.filter("error is null").select("image_id", "region_no", "quad", F.xxhash64("image_id", "region_no").alias("crop_id"), "crop")

    def readtext(self, images: DataFrame) -> DataFrame:
        """Rows (image_id, line_no, quad, text, confidence, error) in output order; unsure lines are left out."""
        working, regions, failed = self._found(images)
        # detection, crops and reading share one frame; only the quads that are told go back to the page's
        cut = materialize(self.crops(working, regions), "crops")
        read = self.texts(cut.select("crop_id", "crop", F.col("image_id").alias("page"), F.col("region_no").alias("place")))
        read = materialize(cut.drop("crop").join(read, "crop_id"), "read")
        # one failed crop fails its page: of several errors the first region's is told
        unread = read.filter("error is not null").groupBy("image_id").agg(F.min_by("error", "region_no").alias("error"))
        lines = read.drop("error").filter(F.col("confidence") >= self.recognition.filter_ths).join(unread.select("image_id"), "image_id", "left_anti")
        lines = self._upright(working, lines).select("image_id", F.col("region_no").alias("line_no"), "quad", "text", "confidence")
        return lines.unionByName(failed.unionByName(unread), allowMissingColumns=True)

    def recognize_line(self, images: DataFrame) -> DataFrame:
        """Rows (image_id, quad, text, confidence, error): the whole image as one line, none left out."""

        def one(image: dict) -> dict:
            px = imaging.grey(imaging.as_array(image))
            return {"width": px.shape[1], "height": px.shape[0], "grey": px.tobytes()}

        cut = imaging.map_column(images.select(*_pages(images)).withColumnRenamed("image_id", "crop_id"), "crop", "struct<width:int,height:int,grey:binary>", one, "image")
        cut = materialize(cut.select("crop_id", "crop", "error"), "crops")
        failed = cut.filter("error is not null").select(F.col("crop_id").alias("image_id"), "error")
        w, h, zero = F.col("image.width"), F.col("image.height"), F.lit(0)
        quads = images.select(F.col("image_id").alias("crop_id"), g.quad((zero, zero), (w, zero), (w, h), (zero, h)).alias("quad"))
        read = self.texts(cut.filter("error is null").select("crop_id", "crop"))
        lines = quads.join(read, "crop_id").select(F.col("crop_id").alias("image_id"), F.when(F.col("error").isNull(), F.col("quad")).alias("quad"), "text", "confidence", "error")
        return lines.unionByName(failed, allowMissingColumns=True)


def onnx_model(spark: SparkSession, content: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """A model file as a function: its content is sent to executors once, readers carry its digest."""
    return models.shipped(models.ship(spark, content), models.onnx_session)

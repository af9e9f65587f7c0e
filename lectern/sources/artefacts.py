"""JSON artefacts, process statistics, model caches; and the renderers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import stripped

POINT = "struct<x:float,y:float>"
LINES = f"array<struct<quad:struct<points:array<{POINT}>>,text:string,confidence:float>>"
BATCH = f"array<struct<image:string,lines:{LINES},error:string>>"
GOLDEN = "placeholder boolean, hyp struct<lines:array<struct<text:string,quad:array<array<double>>>>>, ref struct<lines:array<struct<text:string,quad:array<array<double>>>>>"
LEG = "leg string, canvas_size int, os string, arch string, backend string, images array<struct<image:string,language:string,repeats:int,median:struct<setup_ms:double,detect_ms:double,recognize_ms:double,total_ms:double>>>"


def from_json(column: Column, schema: str) -> Column:
    """A JSON text by schema; null if it is not of it."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


def batch_results(rows: DataFrame, column: str = "value") -> DataFrame:
    """Rows (image, lines, error) of batch JSON: an array of results, or the one result of a single image."""
    text = F.trim(F.col(column))
    many = F.when(F.startswith(text, F.lit("[")), F.from_json(text, BATCH)).otherwise(F.array(F.from_json(text, BATCH[len("array<") : -1])))
    return rows.select(F.explode(many).alias("r")).select("r.*")


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Two-sided fixtures, one JSON document a file."""
    return spark.read.schema(GOLDEN).json(path, multiLine=True)


def legs(spark: SparkSession, path: str) -> DataFrame:
    """Leg reports of a folder by leg, one row per image, one for a leg without images."""
    return spark.read.schema(LEG).json(path, multiLine=True).select("leg", "canvas_size", "os", "arch", "backend", F.explode_outer("images").alias("i")).select("leg", "canvas_size", "os", "arch", "backend", "i.*").orderBy("leg", "image")


def baseline(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A published baseline; unreadable documents are kept as rows with ``unreadable`` set, so that no gate passes on them."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE").withColumn("unreadable", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def corpus_lock(rows: DataFrame, column: str = "value") -> DataFrame:
    """Rows (path, name, sha256) of a lock: a JSON object from path to digest."""
    found = rows.select(F.explode(F.from_json(column, "map<string,struct<sha256:string>>")).alias("path", "v"))
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "v.sha256")


def lock_lookup(lock: DataFrame) -> DataFrame:
    """Rows (name, sha256): the pin of each file name, the first path's if several end in it."""
    return lock.groupBy("name").agg(F.min_by("sha256", F.struct("path", "sha256")).alias("sha256"))


def runner_results(rows: DataFrame, column: str = "value") -> DataFrame:
    """Rows (build_seconds, versions, image, lines, seconds, error) of another runner's JSON, one per image."""
    told = rows.select(F.from_json(column, f"build_seconds double, versions map<string,string>, images array<struct<image:string,lines:{LINES},seconds:double,error:string>>").alias("r"))
    return told.select("r.build_seconds", "r.versions", F.explode_outer("r.images").alias("i")).select("build_seconds", "versions", "i.*")


def tool_payload(lines: DataFrame, key: str) -> DataFrame:
    """Rows (key, rendered) of lines (key, line_no, text, quad, full): quads and texts where ``full``, else the texts alone."""
    every = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "quad", "text"))).alias("l"), F.max("full").alias("full"))
    whole = F.to_json(F.struct(F.transform("l", lambda x: F.struct(x["quad"].alias("quad"), x["text"].alias("text"))).alias("lines")))
    return every.select(key, F.when(F.col("full"), whole).otherwise(F.to_json(F.struct(F.transform("l", lambda x: x["text"]).alias("texts")))).alias("rendered"))


def peak_mb(stderr: Column) -> Column:
    """Peak memory of a child from what a time command wrote: bytes in one form, KiB in the other."""
    b = F.regexp_extract(stderr, r"(\d+)\s+maximum resident set size", 1)
    k = F.regexp_extract(stderr, r"Maximum resident set size \(kbytes\):\s*(\d+)", 1)
    return F.when(b != "", b.try_cast("double") / 1e6).when(k != "", k.try_cast("double") * 1024 / 1e6)


def cpu_seconds(stderr: Column) -> Column:
    """User and system seconds together."""
    both = r"([\d.]+) real\s+([\d.]+) user\s+([\d.]+) sys"
    user, system = (F.regexp_extract(stderr, rf"{w} time \(seconds\):\s*([\d.]+)", 1) for w in ("User", "System"))
    number = lambda c: c.try_cast("double")
    return F.when(stderr.rlike(both), number(F.regexp_extract(stderr, both, 2)) + number(F.regexp_extract(stderr, both, 3))).when((user != "") & (system != ""), number(user) + number(system))


def without_statistics(stderr: Column) -> Column:
    """The child's own lines only."""
    own = F.filter(F.split(stderr, "\r?\n"), lambda s: ~F.trim(s).rlike(r"^[\d,]+\s+[a-z]") & ~(F.trim(s).rlike(r"^[A-Z][A-Za-z()/ ]+:\s") & F.trim(s).rlike(r"\d")) & (F.trim(s) != ""))
    return F.array_join(own, "\n")


def unsupported_format(message: Column) -> Column:
    """Whether an error is of decoding or format support, and not another failure."""
    return F.lower(message).rlike("not supported|failed to decode|unsupported")


def cached_models(files: DataFrame) -> DataFrame:
    """The newest usable file per artefact: (artefact, path, length, mtime, is_file)."""
    return files.filter("is_file and length > 0").groupBy("artefact").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def first_set(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def render_json(lines: DataFrame, key: str) -> DataFrame:
    """Rows (key, rendered): results with lines in order, or the error."""
    every = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line_no", "text", "confidence")))), lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence")))
    error = F.max("error")
    rows = lines.groupBy(key).agg(every.alias("lines"), error.alias("error"))
    return rows.select(key, F.when(F.col("error").isNull(), F.to_json(F.struct(F.col(key).alias("image"), "lines"))).otherwise(F.to_json(F.struct(F.col(key).alias("image"), "error"))).alias("rendered"))


def render_text(lines: DataFrame, key: str) -> DataFrame:
    """Rows (key, rendered): a line each for text and confidence with three decimals, by a tab."""
    one = F.struct("line_no", F.format_string("%s\t%.3f", "text", "confidence").alias("s"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), "\n").alias("rendered"))


def merge_lines(lines: DataFrame, key: str) -> DataFrame:
    """Rows (key, text, confidence): lines joined by a space in order, confidences averaged; no lines, no text and 0."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return lines.groupBy(key).agg(F.array_join(texts, " ").alias("text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def join_pages(pages: DataFrame, key: str) -> DataFrame:
    """Rows (key, text): stripped page texts in order, blank ones left out, a blank line between."""
    kept = pages.withColumn("text", stripped(F.col("text"))).filter("text <> ''")
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def replace_marked(document: Column, start: str, end: str, body: Column) -> Column:
    """``document`` with what stands between two markers replaced; null when a marker is missing."""
    import re

    a, b = F.instr(document, F.lit(start)), F.instr(document, F.lit(end))
    pattern = f"(?s)({re.escape(start)}).*?({re.escape(end)})"
    return F.when((a > 0) & (b > a), F.regexp_replace(document, F.lit(pattern), F.concat(F.lit("$1\n"), F.regexp_replace(body, r"([\\$])", r"\\$1"), F.lit("\n$2"))))

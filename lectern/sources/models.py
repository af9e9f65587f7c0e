"""Models: what is asked, who provides it, what is wrong with it, and how it gets to the tasks.

A model goes by its role (``detector``, or the language of a recogniser) and by the digest of its content.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import owner_is_safe

DETECTOR = "detector"


def descriptors(registry: DataFrame, asked: DataFrame, config: str, owner: Column | None = None) -> DataFrame:
    """Rows (config, place, role, name, repo, revision, file, sha256, error): the models of each configuration of ``asked`` (config, place, language).

    The detector comes first, then one recogniser for each language, in the order in which languages first stand. ``registry``
    has (role, name, repo, revision, file, sha256). ``owner`` takes the place of a repo's owner; an unsafe
    one, and a language that is not in the registry, are errors.
    """
    known = asked.filter("language is not null").groupBy(config, F.col("language").alias("role")).agg(F.min("place").alias("first"))
    ordered = known.withColumn("place", F.row_number().over(Window.partitionBy(config).orderBy("first", "role"))).drop("first")
    wanted = ordered.unionByName(asked.select(config).distinct().select(config, F.lit(DETECTOR).alias("role"), F.lit(0).alias("place")))
    found = wanted.join(registry.withColumn("listed", F.lit(True)), "role", "left")
    error = F.when(F.col("listed").isNull(), "not in the registry")
    if owner is not None:
        error = error.when(owner.isNotNull() & ~owner_is_safe(owner), "unsafe owner")
        found = found.withColumn("repo", F.when(owner.isNotNull(), F.regexp_replace("repo", "^[^/]*", owner)).otherwise(F.col("repo")))
    return found.withColumn("error", error).select(config, "place", "role", "name", "repo", "revision", "file", "sha256", "error")


def provided(wanted: DataFrame, *providers: tuple[str, DataFrame]) -> DataFrame:
    """Rows (role, provider, location, sha256) of ``wanted`` (role): each role's first provider that has it; null if none has.

    Providers are (name, rows of (role, location, sha256)), by rank. What one provides is not asked of the next: each
    step joins only the roles that are left. Of a provider's rows for one role the least location counts.
    """
    left, out = wanted.select("role").distinct(), None
    for name, rows in providers:
        offer = rows.filter("role is not null").groupBy("role").agg(F.min_by(F.struct("location", "sha256"), "location").alias("m"))
        met = left.join(offer, "role").select("role", F.lit(name).alias("provider"), "m.location", "m.sha256")
        out = met if out is None else out.unionByName(met)
        left = left.join(offer.select("role"), "role", "left_anti")
    nothing = left.select("role", *(F.lit(None).cast("string").alias(c) for c in ("provider", "location", "sha256")))
    return nothing if out is None else out.unionByName(nothing)


def digest_error(pin: Column, actual: Column, from_file: bool) -> Column:
    """Why content with the digest ``actual`` is not what ``pin`` names; null if it is.

    A file without a pin passes, bytes that are handed over must have one.
    """
    unpinned = F.coalesce(pin, F.lit("")) == ""
    other = F.when(F.lower(pin) != F.lower(actual), "other digest")
    return F.when(unpinned, F.lit(None if from_file else "no digest")).otherwise(other)


def verified_set(models: DataFrame, config: str) -> DataFrame:
    """Rows (config, error): the first thing that is wrong with each configuration's ``models`` (config, role, content, sha256); null if nothing is.

    Contents are checked first, then roles: one detector, and no role twice.
    """
    wrong = digest_error(F.col("sha256"), F.sha2("content", 256), False)
    rows = models.select(config, "role", F.when(wrong.isNotNull(), F.concat(wrong, F.lit(": "), "role")).alias("wrong"))
    roles = rows.groupBy(config, "role").agg(F.count(F.lit(1)).alias("n"), F.min("wrong").alias("wrong"))
    twice = F.min(F.when(F.col("n") > 1, F.concat(F.lit("role given twice: "), "role")))
    none = F.when(F.count_if(F.col("role") == DETECTOR) == 0, F.lit("no detector"))
    return roles.groupBy(config).agg(F.coalesce(F.min("wrong"), twice, none).alias("error"))


def ship(spark: SparkSession, content: bytes) -> str:
    """Send a model's content to every executor, once whatever the number of readers; the digest that names it there."""
    digest = hashlib.sha256(content).hexdigest()
    if not any(f.rsplit("/", 1)[-1] == f"model-{digest}" for f in spark.sparkContext.listFiles):
        path = os.path.join(tempfile.mkdtemp(prefix="model-"), f"model-{digest}")
        with open(path, "wb") as f:  # the driver's own copy, from which Spark serves the executors
            f.write(content)
        spark.sparkContext.addFile(path)
    return digest


def shipped(digest: str, load: Callable[[bytes], Callable[[np.ndarray], np.ndarray]]) -> Callable[[np.ndarray], np.ndarray]:
    """The model of a digest as a function for tasks: read, checked and loaded once in each Python worker."""

    def run(x: np.ndarray) -> np.ndarray:
        import pyspark

        # kept with a module of the worker: what travels with the plan is made anew for every task
        held = vars(pyspark).setdefault("_lectern_models", {})
        if digest not in held:
            with open(pyspark.SparkFiles.get(f"model-{digest}"), "rb") as f:
                content = f.read()
            if hashlib.sha256(content).hexdigest() != digest:
                raise ValueError("other digest")
            held[digest] = load(content)
        return held[digest](x)

    return run


def thread_budget(cpus: int, asked: int | None = None) -> int:
    """Threads for one model: what is asked, else one a core, eight at most."""
    if asked is not None and asked < 1:
        raise ValueError("threads must be at least 1")
    return asked or max(1, min(cpus, 8))


def warm_up(spark: SparkSession, digest: str, load: Callable[[bytes], Callable[[np.ndarray], np.ndarray]], sample: np.ndarray | None = None, slots: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """Load a model in every slot before any row is read: rows (slot, host, pid, seconds), one for each.

    The tasks are a barrier: all run at the same time, so each has a worker of its own, and none ends before all have
    the model. ``slots`` is the session's parallelism if not given, and no more. ``profile`` asks for
    cores (a thread budget) or devices of each task, where the cluster manager offers them; a local session has none and takes it as it is.
    Workers keep the model while Spark reuses them (``spark.python.worker.reuse``).
    """
    most = spark.sparkContext.defaultParallelism
    slots = slots or most
    if slots > most:
        raise ValueError(f"{slots} tasks cannot run at the same time on {most} slots")
    model = shipped(digest, load)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import socket
        import time

        from pyspark import BarrierTaskContext

        rows = list(batches)
        began = time.perf_counter()
        model(np.zeros(1, dtype=np.float32) if sample is None else sample)
        took = time.perf_counter() - began
        context = BarrierTaskContext.get()
        context.barrier()
        if rows:
            told = {"slot": [context.partitionId()], "host": [socket.gethostname()], "pid": [os.getpid()], "seconds": [took]}
            yield pa.RecordBatch.from_pydict(told, pa.schema([("slot", pa.int32()), ("host", pa.string()), ("pid", pa.int64()), ("seconds", pa.float64())]))

    local = spark.sparkContext.master.startswith("local")
    seats = spark.range(0, slots, 1, slots)
    return seats.mapInArrow(run, "slot int, host string, pid bigint, seconds double", barrier=True, profile=None if local else profile)


def onnx_session(content: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """A model file as a function, on one thread: the tasks of an executor already share its cores."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    session = onnxruntime.InferenceSession(content, options, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return lambda x: session.run(None, {name: x})[0]

"""The reader's last step as a table function, for SQL: ``SELECT * FROM read_lines(TABLE(crops) PARTITION BY page ORDER BY place, charset => '...')``.

A row of the table is a crop with the recogniser's scores: (page, place, scores array<array<double>>), other columns are
not read. A partition is a page; Spark deals pages to tasks and sorts their crops, and one crop is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lectern.operators.engine import Recognition


def read_scores(scores: np.ndarray, chars: str, ignored: list[int]) -> tuple[str, float]:
    """Text and confidence of one crop's scores (steps, classes), as ``decoding.greedy_decode`` has them for rows of a table."""
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p[:, ignored] = 0
    if not len(p) or not p.any():
        return "", 0.0
    p /= p.sum(axis=1, keepdims=True)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    said = best[np.concatenate([[True], best[1:] != best[:-1]])]
    told = sure[best != 0]
    confidence = float(np.exp(np.log(told).sum() * 2 / np.sqrt(len(told)))) if len(told) else 0.0
    return "".join(chars[k - 1] for k in said.tolist() if 0 < k <= len(chars)), confidence


class ReadLines:
    """Rows (page, line_no, place, text, confidence) of crops that are read with ``least`` confidence, numbered in each page."""

    @staticmethod
    def analyze(crops: AnalyzeArgument, charset: AnalyzeArgument, least: AnalyzeArgument | None = None, allow: AnalyzeArgument | None = None, block: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not crops.isTable:
            raise ValueError("read_lines takes a table of crops first")
        kinds = {f.name: f.dataType for f in crops.dataType.fields}
        if missing := {"page", "place", "scores"} - kinds.keys():
            raise ValueError(f"crops lack {', '.join(sorted(missing))}")
        if not (isinstance(kinds["scores"], ArrayType) and isinstance(kinds["scores"].elementType, ArrayType)):
            raise ValueError("scores must be a list of steps, each a list of classes")
        for name, given in (("charset", charset), ("least", least), ("allow", allow), ("block", block)):
            if given is not None and not given.isConstantExpression:
                raise ValueError(f"{name} must be a constant")
        if not charset.value:
            raise ValueError("charset is empty")
        Recognition(filter_ths=float(least.value) if least is not None else 0.1)  # says what is wrong with it
        fields = [StructField("page", kinds["page"]), StructField("line_no", LongType()), StructField("place", kinds["place"]), StructField("text", StringType()), StructField("confidence", DoubleType())]
        return AnalyzeResult(StructType(fields))

    def __init__(self) -> None:
        self.line = 0

    def eval(self, crops, charset: str, least: float = 0.1, allow: str = "", block: str = "") -> Iterator[tuple]:
        listed = allow or block
        ignored = [k for k, c in enumerate(charset, 1) if listed and (c in listed) != bool(allow)]
        rows = [list(step) for step in crops["scores"] or ()]
        text, confidence = read_scores(np.array(rows, dtype=np.float64), charset, ignored) if rows else ("", 0.0)
        if confidence >= float(least):
            yield crops["page"], self.line, crops["place"], text, confidence
            self.line += 1


def register(spark: SparkSession) -> None:
    """Make ``read_lines`` known to the session's SQL."""
    spark.udtf.register("read_lines", udtf(ReadLines))

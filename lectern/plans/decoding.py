"""Queries of recognition: each 64-float embedding is a crop's logits, 8 steps of 8 classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import decoding, table_functions
from lectern.sources import table


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("crop_id"), F.posexplode("embedding").alias("i", "v"))
    return e.select("crop_id", F.floor(F.col("i") / 8).cast("int").alias("t"), (F.col("i") % 8).alias("class"), F.col("v").cast("double").alias("v"))


def _charset(spark: SparkSession) -> DataFrame:
    return spark.range(1, 8).select(F.col("id").cast("int").alias("class"), F.col("id").cast("string").alias("ch"))


def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.probabilities(_logits(spark, sf_dir)).select("crop_id", "t", "class", F.round("p", 6).alias("p"))


def ctc_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.best_classes(decoding.probabilities(_logits(spark, sf_dir))).select("crop_id", "t", "class", F.round("p", 6).alias("p"))


def ctc_greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.greedy_decode(_logits(spark, sf_dir), _charset(spark)).withColumn("confidence", F.round("confidence", 6))


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same crops through SQL: a label's vectors are a page's crops, read by the table function."""
    table_functions.register(spark)
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8)).cast("array<double>"))
    crops = table(spark, sf_dir, "embeddings").select(F.coalesce("label", F.lit(-1)).alias("page"), F.col("vec_id").alias("place"), steps.alias("scores"))
    sql = "SELECT page, line_no, place, text, round(confidence, 6) AS confidence FROM read_lines(TABLE({crops}) PARTITION BY page ORDER BY place, charset => '1234567', least => 0.00002D)"
    return spark.sql(sql, crops=crops)


def ctc_ignore_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = _charset(spark)
    return decoding.greedy_decode(_logits(spark, sf_dir), chars, decoding.ignored_classes(chars, allow="1357")).withColumn("confidence", F.round("confidence", 6))


def ctc_ignore_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = _charset(spark)
    return decoding.greedy_decode(_logits(spark, sf_dir), chars, decoding.ignored_classes(chars, block="26")).withColumn("confidence", F.round("confidence", 6))


def ctc_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy results under 0.001 retried with logits scaled by four, as a sharper crop would give."""
    logits, chars = _logits(spark, sf_dir), _charset(spark)
    second = decoding.greedy_decode(logits.withColumn("v", F.col("v") * 4), chars)
    return decoding.retry(decoding.greedy_decode(logits, chars), second, 0.001).withColumn("confidence", F.round("confidence", 6))


def beam_search_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.beam_decode(_logits(spark, sf_dir), _charset(spark)).withColumn("confidence", F.round("confidence", 6))


def run_collapse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types in time, runs collapsed, purchases as the blank."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    kept = decoding.collapse(e, "user_id", "ts", "event_type", "purchase")
    return kept.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_type"))), lambda x: x["event_type"]), ">").alias("runs"))


def _greedy(scale: str = "v", ignore: str = "false") -> str:
    return f"""
  (WITH l AS (SELECT vec_id AS crop_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings),
   x AS (SELECT crop_id, i // 8 AS t, i % 8 AS class, {scale} AS v FROM l),
   s AS (SELECT *, exp(v - max(v) OVER w) / sum(exp(v)) OVER w * exp(max(v) OVER w) AS p FROM x WINDOW w AS (PARTITION BY crop_id, t)),
   k AS (SELECT crop_id, t, class, p / sum(p) OVER (PARTITION BY crop_id, t) AS p FROM s WHERE NOT ({ignore})),
   a AS (SELECT crop_id, t, class, p FROM k QUALIFY row_number() OVER (PARTITION BY crop_id, t ORDER BY p DESC, class) = 1),
   c AS (SELECT *, lag(class) OVER (PARTITION BY crop_id ORDER BY t) AS before FROM a)
   SELECT crop_id, coalesce(string_agg(class::VARCHAR, '' ORDER BY t) FILTER (WHERE class <> 0 AND (before IS NULL OR before <> class)), '') AS text,
          CASE WHEN count(*) FILTER (WHERE class <> 0) > 0 THEN exp(sum(CASE WHEN class <> 0 THEN ln(p) ELSE 0 END) * 2 / sqrt(count(*) FILTER (WHERE class <> 0))) ELSE 0 END AS confidence
   FROM c GROUP BY crop_id)"""


_ROWS = """
WITH l AS (SELECT vec_id AS crop_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings),
x AS (SELECT crop_id, i // 8 AS t, i % 8 AS class, v FROM l),
s AS (SELECT crop_id, t, class, exp(v) / sum(exp(v)) OVER (PARTITION BY crop_id, t) AS p FROM x)
"""
_ROUND = "SELECT crop_id, text, round(confidence, 6) AS confidence FROM "

#: A label is a list of classes; each step keeps the five heaviest, and sums what leads to the same label.
_LONGER = """CASE WHEN c = 0 THEN CASE WHEN coalesce(label[-1], 0) = 0 THEN label ELSE list_append(label, 0) END
  WHEN len(label) > 0 AND label[-1] = 0 AND NOT coalesce(label[-2] = c, false) THEN list_append(label[1:len(label) - 1], c) ELSE list_append(label, c) END"""
BEAM_SEARCH_DECODE = f"""
WITH RECURSIVE rows AS MATERIALIZED (SELECT crop_id, t, list(p ORDER BY class) AS r FROM ({_ROWS} SELECT crop_id, t, class, p FROM s) GROUP BY crop_id, t),
f AS (SELECT DISTINCT crop_id, 0::BIGINT AS t, []::INT[] AS label, 0.0::DOUBLE AS solid, 1.0::DOUBLE AS blank FROM rows
  UNION ALL
  SELECT crop_id, t + 1, x.label, sum(x.s), sum(x.b) FROM (
    SELECT crop_id, t, unnest(list_concat([{{'label': label, 's': CASE WHEN len(label) > 0 THEN solid * r[label[-1] + 1] ELSE 0 END, 'b': (solid + blank) * r[1]}}],
      list_transform(list_filter(range(0, len(r)), lambda c: r[c + 1] >= 0.5 / len(r)), lambda c: {{'label': {_LONGER}, 's': r[c + 1] * CASE WHEN len(label) > 0 AND label[-1] = c THEN blank ELSE solid + blank END, 'b': 0.0::DOUBLE}}))) AS x
    FROM (SELECT f.*, rows.r FROM f JOIN rows USING (crop_id, t) QUALIFY row_number() OVER (PARTITION BY crop_id ORDER BY solid + blank DESC, label) <= 5))
  GROUP BY crop_id, t, x.label),
best AS (SELECT crop_id, label FROM f WHERE t = 8 QUALIFY row_number() OVER (PARTITION BY crop_id ORDER BY solid + blank DESC, label) = 1)
SELECT crop_id, array_to_string(list_filter(label, lambda c: c <> 0), '') AS text, round(confidence, 6) AS confidence FROM best JOIN (SELECT crop_id, confidence FROM {_greedy()}) USING (crop_id)"""

QUERIES = {
    softmax_rows: _ROWS + "SELECT crop_id, t::INT AS t, class::INT AS class, round(p, 6) AS p FROM s",
    ctc_argmax: _ROWS + "SELECT crop_id, t::INT AS t, class::INT AS class, round(p, 6) AS p FROM s QUALIFY row_number() OVER (PARTITION BY crop_id, t ORDER BY p DESC, class) = 1",
    ctc_greedy_decode: _ROUND + _greedy(),
    read_lines: f"""
SELECT coalesce(label, -1) AS page, row_number() OVER (PARTITION BY coalesce(label, -1) ORDER BY vec_id) - 1 AS line_no, vec_id AS place, text, round(confidence, 6) AS confidence
FROM {_greedy()} g JOIN embeddings ON vec_id = crop_id WHERE confidence >= 0.00002""",
    ctc_ignore_allowlist: _ROUND + _greedy(ignore="class IN (2, 4, 6)"),
    ctc_ignore_blocklist: _ROUND + _greedy(ignore="class IN (2, 6)"),
    ctc_second_pass: f"SELECT f.crop_id, CASE WHEN f.confidence < 0.001 AND s.confidence >= f.confidence THEN s.text ELSE f.text END AS text, round(CASE WHEN f.confidence < 0.001 AND s.confidence >= f.confidence THEN s.confidence ELSE f.confidence END, 6) AS confidence FROM {_greedy()} f JOIN {_greedy('v * 4')} s USING (crop_id)",
    beam_search_decode: BEAM_SEARCH_DECODE,
    run_collapse_events: """
WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)
SELECT user_id, string_agg(event_type, '>' ORDER BY ts) AS runs FROM e WHERE event_type <> 'purchase' AND (before IS NULL OR before <> event_type) GROUP BY user_id""",
}

"""Queries of text scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import scoring
from lectern.operators.stages import materialize
from lectern.sources import table

TOK = r"list_filter(string_split_regex(replace(lower(text), '|', ' '), '\s+'), lambda x: x <> '')"


def doc_benchmark_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    known = materialize(scoring.bag(items, "item_id", t.tokens(F.col("text"))), "bag")
    return scoring.bag_f1(scoring.bag(docs, "doc_id", t.tokens(F.col("text")), known), known, "doc_id", "item_id").select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")))


DOC_BENCHMARK_TOKEN_F1 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {TOK} l FROM documents), i AS MATERIALIZED (SELECT item_id, {TOK} l FROM benchmark),
h AS (SELECT doc_id, item, count(*) hn, any_value(total) ht FROM (SELECT doc_id, len(l) total, unnest(l) item FROM d) GROUP BY doc_id, item),
r AS (SELECT item_id, item, count(*) rn, any_value(total) rt FROM (SELECT item_id, len(l) total, unnest(l) item FROM i) GROUP BY item_id, item),
m AS (SELECT doc_id, item_id, any_value(ht) ht, any_value(rt) rt, sum(least(hn, rn)) met FROM h JOIN r USING (item) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, round(2 * (met / ht) * (met / rt) / (met / ht + met / rt), 6) AS f1, round(met / ht, 6) AS precision, round(met / rt, 6) AS recall FROM m
"""


def char_f1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each turn against those of the turn before."""
    c = table(spark, sf_dir, "conversations")
    now = c.select("conv_id", "turn", F.col("text").alias("b"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("a"))
    pairs = now.join(before, ["conv_id", "turn"])
    return _char_f1(pairs)


def _char_f1(pairs: DataFrame) -> DataFrame:
    """The bags of one pair meet on the pair itself and the character."""
    keys = ["conv_id", "turn"]
    bags = []
    for column, n, total in (("b", "hn", "ht"), ("a", "rn", "rt")):
        chars = pairs.select(*keys, t.char_bag(F.col(column)).alias("items")).withColumn(total, F.size("items"))
        bags.append(chars.select(*keys, total, F.explode("items").alias("item")).groupBy(*keys, total, "item").agg(F.count(F.lit(1)).alias(n)))
    met = bags[0].join(bags[1], [*keys, "item"]).groupBy(*keys, "ht", "rt").agg(F.sum(F.least("hn", "rn")).alias("met"))
    return met.select(*keys, F.round(t.f1_parts(F.col("met"), F.col("ht"), F.col("rt"))["f1"], 6).alias("f1"))


CHAR_F1_CONVERSATIONS = r"""
WITH c AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(lower(text), '\s', '', 'g'), ''), lambda x: x <> '') l FROM conversations),
p AS (SELECT n.conv_id, n.turn, n.l b, o.l a FROM c n JOIN c o ON n.conv_id = o.conv_id AND n.turn = o.turn + 1),
h AS (SELECT conv_id, turn, item, count(*) hn, any_value(t) ht FROM (SELECT conv_id, turn, len(b) t, unnest(b) item FROM p) GROUP BY ALL),
r AS (SELECT conv_id, turn, item, count(*) rn, any_value(t) rt FROM (SELECT conv_id, turn, len(a) t, unnest(a) item FROM p) GROUP BY ALL),
m AS (SELECT conv_id, turn, any_value(ht) ht, any_value(rt) rt, sum(least(hn, rn)) met FROM h JOIN r USING (conv_id, turn, item) GROUP BY conv_id, turn)
SELECT conv_id, turn, round(2 * (met / ht) * (met / rt) / (met / ht + met / rt), 6) AS f1 FROM m
"""


def normalize_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n.cast("binary")).alias("digest"), F.length(n).cast("bigint").alias("n"))


_WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_NORMAL = rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<br{_WS}*/?>', ' ', 'gi'), '(?m)^{_WS}*(?:[-+•]|\p{{Nd}}+[.)]){_WS}+', ' ', 'g'), '[#|*`_>]', ' ', 'g'), '{_WS}+', ' ', 'g')))"
NORMALIZE_TEXT_DOCS = f"SELECT doc_id, md5({_NORMAL}) AS digest, length({_NORMAL}) AS n FROM documents"


def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = t.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(toks).cast("bigint").alias("n"), F.md5(F.array_join(toks, " ").cast("binary")).alias("digest"))


TOKENIZE_DOCS = f"SELECT doc_id, len({TOK}) AS n, md5(array_to_string({TOK}, ' ')) AS digest FROM documents"


def cer_benchmark_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text against the next, other than ASCII characters as question marks."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("ref"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("ref").alias("hyp")), "item_id")
    return pairs.select("item_id", F.round(t.character_error_rate(F.col("ref"), F.col("hyp")), 6).alias("cer"))


CER_BENCHMARK_ASCII = r"""
WITH b AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') t FROM benchmark)
SELECT r.item_id, round(levenshtein(h.t, r.t) / length(r.t), 6) AS cer FROM b r JOIN b h ON h.item_id = r.item_id + 1
"""


def wer_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of each benchmark text against the next."""
    b = table(spark, sf_dir, "benchmark")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hyp")), "item_id")
    return pairs.select("item_id", F.round(t.word_error_rate(F.col("text"), F.col("hyp")), 6).alias("wer"))


def reading_order_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the words that a turn shares with the turn before."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    pairs = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")), ["conv_id", "turn"])
    return scoring.reading_order(pairs, "text", "before", "conv_id", "turn").withColumn("score", F.round("score", 6))


WER_BENCHMARK = r"""
WITH RECURSIVE b AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT r.item_id, 0 AS i, r.w AS a, h.w AS b, range(0, len(h.w) + 1) AS d FROM b r JOIN b h ON h.item_id = r.item_id + 1
  UNION ALL SELECT item_id, i + 1, a, b, list_transform(range(0, len(b) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN d[1] + 1 ELSE least(d[k + 1] + 1, d[k] + CASE WHEN a[i + 1] = b[k] THEN 0 ELSE 1 END) - k END)))
  FROM d WHERE i < len(a))
SELECT item_id, CASE WHEN len(a) > 0 THEN round(d[len(b) + 1] / len(a), 6) END AS wer FROM d WHERE i = len(a)
"""

READING_ORDER_TURNS = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, {TOK} AS l FROM conversations),
p AS MATERIALIZED (SELECT n.conv_id, n.turn, n.l AS h, o.l AS r FROM c n JOIN c o ON n.conv_id = o.conv_id AND n.turn = o.turn + 1),
h AS (SELECT conv_id, turn, item, min(k) AS k FROM (SELECT conv_id, turn, unnest(h) AS item, generate_subscripts(h, 1) AS k FROM p) GROUP BY ALL HAVING count(*) = 1),
r AS (SELECT conv_id, turn, item, min(k) AS k FROM (SELECT conv_id, turn, unnest(r) AS item, generate_subscripts(r, 1) AS k FROM p) GROUP BY ALL HAVING count(*) = 1),
m AS MATERIALIZED (SELECT conv_id, turn, h.k AS v, row_number() OVER (PARTITION BY conv_id, turn ORDER BY r.k) AS i, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM h JOIN r USING (conv_id, turn, item)),
f AS (SELECT conv_id, turn, i, n, [1] AS best, [v] AS vals FROM m WHERE i = 1
  UNION ALL SELECT m.conv_id, m.turn, m.i, m.n,
    list_append(f.best, 1 + coalesce(list_max(list_transform(range(1, len(f.vals) + 1), lambda k: CASE WHEN f.vals[k] < m.v THEN f.best[k] ELSE 0 END)), 0)), list_append(f.vals, m.v)
  FROM f JOIN m ON m.conv_id = f.conv_id AND m.turn = f.turn AND m.i = f.i + 1)
SELECT p.conv_id, p.turn, coalesce(f.n, 0)::INT AS anchors, CASE WHEN f.n >= 3 THEN round(list_max(f.best) / f.n, 6) END AS score FROM p LEFT JOIN f ON f.conv_id = p.conv_id AND f.turn = p.turn AND f.i = f.n
"""


def lis_length_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest increasing run of rounded values of each user's events in time."""
    e = table(spark, sf_dir, "events")
    by_user = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("l"))
    return by_user.select("user_id", scoring.lis_length(F.transform("l", lambda x: F.floor(x["value"]).cast("int"))).cast("bigint").alias("lis"), F.size("l").cast("bigint").alias("n"))


LIS_LENGTH_EVENTS = """
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, floor(value)::INT v FROM events),
f AS (SELECT user_id, i, v, [1] AS best, [v] AS vals FROM e WHERE i = 1
      UNION ALL
      SELECT e.user_id, e.i, e.v,
             list_append(f.best, 1 + coalesce(list_max(list_filter(list_transform(range(1, len(f.vals) + 1), lambda k: CASE WHEN f.vals[k] < e.v THEN f.best[k] ELSE 0 END), lambda x: x > 0)), 0)),
             list_append(f.vals, e.v)
      FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, list_max(best)::BIGINT AS lis, len(best) AS n FROM f WHERE (user_id, i) IN (SELECT user_id, max(i) FROM e GROUP BY user_id)
"""

QUERIES = {
    doc_benchmark_token_f1: DOC_BENCHMARK_TOKEN_F1,
    char_f1_conversations: CHAR_F1_CONVERSATIONS,
    normalize_text_docs: NORMALIZE_TEXT_DOCS,
    tokenize_docs: TOKENIZE_DOCS,
    cer_benchmark_ascii: CER_BENCHMARK_ASCII,
    wer_benchmark: WER_BENCHMARK,
    reading_order_turns: READING_ORDER_TURNS,
    lis_length_events: LIS_LENGTH_EVENTS,
}

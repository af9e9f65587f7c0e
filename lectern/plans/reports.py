"""Queries of reports and artefacts: statistics of child processes, results as JSON, gates, summaries, model caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import records, scoring
from lectern.sources import artefacts, images, table

_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``no``, their number in the order."""
    order = Window.partitionBy("l_orderkey").orderBy(*_LINE[1:])
    return table(spark, sf_dir, "lineitem").withColumn("no", F.row_number().over(order).cast("bigint"))


def time_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a time command would write for each line item, in both of its forms, read back."""
    l = _numbered(spark, sf_dir)
    user, system = (l["l_quantity"] / 4).cast("decimal(10,2)").cast("string"), (l["l_discount"] * 10).cast("decimal(10,2)").cast("string")
    size = (F.col("l_partkey") * 1000 + F.col("no")).cast("string")
    gnu = F.concat(F.lit("warn: "), F.col("l_returnflag"), F.lit("\n\tMaximum resident set size (kbytes): "), size, F.lit("\n\tUser time (seconds): "), user, F.lit("\n\tSystem time (seconds): "), system, F.lit("\n"))
    bsd = F.concat(F.lit("warn: "), F.col("l_returnflag"), F.lit("\n        2.00 real         "), user, F.lit(" user         "), system, F.lit(" sys\n            "), size, F.lit("  maximum resident set size\n"))
    told = l.withColumn("e", F.when(F.col("no") % 2 == 0, gnu).otherwise(bsd))
    return told.select("l_orderkey", "no", F.round(artefacts.peak_mb(F.col("e")), 6).alias("mb"), F.round(artefacts.cpu_seconds(F.col("e")), 6).alias("cpu"))


def own_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child's own lines without the statistics that stand around them."""
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("        2.00 real         1.00 user         0.50 sys\n"), F.col("c_name"), F.lit("\n   3000000  maximum resident set size\r\nExit status: 0\n\nlast words "), F.col("c_mktsegment"), F.lit("\nPage size (bytes): 4096"))
    return c.select("c_custkey", artefacts.without_statistics(text).alias("own"))


def batch_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images rendered to JSON, every fifth failed, and read back by the schema of batch results."""
    l = _numbered(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("image"), F.col("no").alias("line_no"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_returnflag")).alias("text"), F.col("l_discount").alias("confidence"), F.when(F.col("l_orderkey") % 5 == 0, "no image").alias("error"))
    back = artefacts.batch_results(artefacts.render_json(l, "image"), "rendered")
    return back.select("image", F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n"), F.array_join(F.transform("lines", lambda x: x["text"]), "").alias("texts"), F.round(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["confidence"].cast("double")), 4).alias("confidence"), "error")


def rendered_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with quads as JSON, every third without its lines' places."""
    l = _numbered(spark, sf_dir)
    points = F.array(*(F.array((F.col("l_partkey") + dx).cast("int"), (F.col("no") * 10 + dy).cast("int")) for dx, dy in ((0, 0), (40, 0), (40, 8), (0, 8))))
    return artefacts.tool_payload(l.select(F.col("l_orderkey").alias("image"), F.col("no").alias("line_no"), F.col("l_returnflag").alias("text"), points.alias("quad"), (F.col("l_orderkey") % 3 != 0).alias("full")), "image")


def marked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns between two markers, replaced by the role; without an end marker there is no result."""
    c = table(spark, sf_dir, "conversations")
    doc = F.concat(F.lit("before <!--a-->"), F.col("text"), F.when(F.col("conv_id") % 4 == 0, "").otherwise("<!--b-->"), F.lit(" after"))
    return c.select("conv_id", "turn", artefacts.replace_marked(doc, "<!--a-->", "<!--b-->", F.concat(F.lit("$1 \\ "), "role")).alias("document"))


def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, every third blank and all padded with white space of several kinds."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit(" \t "), F.when(F.col("turn") % 3 == 2, "　").otherwise(F.col("text")), F.lit("\n "))
    return artefacts.join_pages(c.select("conv_id", F.col("turn").alias("page"), text.alias("text")), "conv_id").select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("bigint").alias("n"))


def signed_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", t.signed_delta(F.when(F.col("event_id") % 9 != 0, F.col("value") - 50)).alias("delta"))


def threshold_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as runs: mean balances of suppliers and customers, as in the single gates, give both gates' breaches."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.round(F.avg("s_acctbal"), 6).alias("throughput"), F.round(F.max("s_acctbal"), 6).alias("peak_rss"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.round(F.avg("c_acctbal"), 6).alias("base_throughput"), F.round(F.max("c_acctbal") / 2, 6).alias("base_rss"))
    return records.threshold_gate(c.join(s, "n", "left").withColumn("same_host", F.col("n") % 5 != 0), "n")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a flag and number as batches; number 3 was not timed."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("image_count"), F.sum("l_quantity").alias("q"), F.round(F.avg("l_tax"), 6).alias("build_seconds"), F.max("l_extendedprice").alias("rss_mb"), F.round(F.sum("l_discount"), 6).alias("cpu_core_seconds"))
    return sums.withColumn("total_seconds", F.when(F.col("l_linenumber") != 3, F.col("q"))).drop("q")


def batch_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.batch_summary(_batches(spark, sf_dir), "l_returnflag", "l_linenumber")
    return out.withColumns({c: F.round(c, 6) for c in ("throughput", "warm_per_image_seconds")})


def headline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.headline_totals(_batches(spark, sf_dir), "l_returnflag")
    return out.withColumns({c: F.round(c, 6) for c in ("seconds", "cpu_seconds", "throughput")})


def leg_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as legs whose customers' segments are images; legs of every seventh nation have none."""
    c = table(spark, sf_dir, "customer").withColumn("image", F.when(F.col("c_nationkey") % 7 != 0, F.col("c_mktsegment")))
    ms = c.groupBy(F.col("c_nationkey").cast("string").alias("leg"), "image").agg(F.round(F.avg("c_acctbal"), 4).alias("m"))
    rows = ms.select("leg", F.when(F.col("leg") != "3", "cpu").alias("backend"), "image", F.struct((F.col("m") / 3).alias("detect_ms"), F.lit(None).cast("double").alias("recognize_ms"), F.col("m").alias("total_ms")).alias("median"))
    return records.leg_summary(rows)


def guardrail_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents that were not skipped, their scores from length; contracts of the known version only."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    r = d.select("doc_id", F.when(F.col("quality").isNotNull(), "labeled").otherwise("breadth").alias("group"), F.when(F.col("toxic") == 1, "toxic").alias("skipped"), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") / 1000.0).alias("score"))
    made = records.guardrails(r, "score", "doc_id").withColumn("schema_version", F.lit(1))
    return records.versioned(made, "schema_version", 1).select("doc_id", F.round("floor", 6).alias("floor"))


def newest_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of a customer's cache: the newest that is a file with content."""
    o = table(spark, sf_dir, "orders")
    files = o.select(F.col("o_custkey").alias("artefact"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("path"), (F.col("o_totalprice") - 50_000).alias("length"), F.col("o_orderdate").alias("mtime"), (F.col("o_orderstatus") != "P").alias("is_file"))
    return artefacts.cached_models(files)


def verified_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as models: every fifth has its predecessor's role; names as content, some with another digest."""
    p = table(spark, sf_dir, "part")
    content = F.col("p_name").cast("binary")
    pin = F.when(F.col("p_partkey") % 4 == 0, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.upper(F.sha2(content, 256)))
    role = F.col("p_partkey") - (F.col("p_partkey") % 5 == 0).cast("int")
    return images.verified(p.select("p_partkey", role.alias("role"), content.alias("content"), pin.alias("sha256"))).select("p_partkey", "role", "error")


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer the file of an order that a reader would take: by status, then by path; null without any."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stem"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("path"), "o_orderstatus")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stem"))
    return images.page_files(o, c, F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")))


def corpus_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names as a lock's paths, and the digest of each file by its name: the first path's on doubles."""
    s = table(spark, sf_dir, "supplier")
    lock = s.select(F.to_json(F.create_map(F.concat(F.lit("set/"), F.col("s_nationkey").cast("string"), F.lit("/"), F.concat((F.col("s_suppkey") % 50).cast("string"), F.lit(".png"))), F.struct(F.md5(F.col("s_name").cast("binary")).alias("sha256")))).alias("value"))
    return artefacts.lock_lookup(artefacts.corpus_lock(lock))


def unsupported_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    message = F.concat(F.element_at(F.array(F.lit("Unsupported "), F.lit("not Supported: "), F.lit("cannot open "), F.lit("failed to decode "), F.lit("unknown ")), (F.col("p_partkey") % 5 + 1).cast("int")), "p_name")
    return p.select("p_partkey", artefacts.unsupported_format(message).alias("unsupported"))


def engine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn and the one before as two engines' texts of a page, the conversation's first turn as its truth."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.col("text"), r"[^\x00-\x7F]", "?").alias("text"))
    rows = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("other")), ["conv_id", "turn"]).join(c.filter("turn = 0").select("conv_id", F.col("text").alias("truth")), "conv_id")
    out = scoring.engine_scores(rows, "text", "other", "truth", "conv_id", "turn")
    return out.withColumns({k: F.round(k, 6) for k in out.columns if k not in ("conv_id", "turn")})


_N = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS no FROM lineitem"
_WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_BATCHES = "SELECT l_returnflag, l_linenumber, count(*) AS image_count, CASE WHEN l_linenumber <> 3 THEN sum(l_quantity) END AS total_seconds, round(avg(l_tax), 6) AS build_seconds, max(l_extendedprice) AS rss_mb, round(sum(l_discount), 6) AS cpu_core_seconds FROM lineitem GROUP BY l_returnflag, l_linenumber"
_TEN = "::DECIMAL(24,6)::DECIMAL(24,1)::VARCHAR"
_TOK = r"list_filter(string_split_regex(replace(lower(@), '|', ' '), '\s+'), lambda x: x <> '')"
_NORMAL = rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(@, '(?i)<br{_WS}*/?>', ' ', 'g'), '(?m)^{_WS}*(?:[-+•]|\p{{Nd}}+[.)]){_WS}+', ' ', 'g'), '[#|*`_>]', ' ', 'g'), '{_WS}+', ' ', 'g')))"


def _f1(hyp: str, ref: str, name: str) -> str:
    """F1 of two bags, given as list columns of ``p``, as a table (conv_id, turn, value)."""
    return f"""{name} AS (SELECT p.conv_id, p.turn, CASE WHEN len({hyp}) = 0 AND len({ref}) = 0 THEN 1.0 WHEN len({hyp}) = 0 OR len({ref}) = 0 OR m.met IS NULL THEN 0.0 ELSE 2.0 * m.met / (len({hyp}) + len({ref})) END AS v FROM p LEFT JOIN
  (SELECT h.conv_id, h.turn, sum(least(h.n, r.n)) AS met FROM (SELECT conv_id, turn, i, count(*) n FROM (SELECT conv_id, turn, unnest({hyp}) i FROM p) GROUP BY ALL) h
   JOIN (SELECT conv_id, turn, i, count(*) n FROM (SELECT conv_id, turn, unnest({ref}) i FROM p) GROUP BY ALL) r USING (conv_id, turn, i) GROUP BY ALL) m USING (conv_id, turn))"""


def _words_apart(ref: str, hyp: str, name: str) -> str:
    """Edit distance of two word lists of ``p`` over the first one's length, row by row of the table of distances."""
    return f"""{name}_d AS (SELECT conv_id, turn, 0 AS i, {ref} AS a, {hyp} AS b, range(0, len({hyp}) + 1) AS d FROM p
  UNION ALL SELECT conv_id, turn, i + 1, a, b, list_transform(range(0, len(b) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN d[1] + 1 ELSE least(d[k + 1] + 1, d[k] + CASE WHEN a[i + 1] = b[k] THEN 0 ELSE 1 END) - k END)))
  FROM {name}_d WHERE i < len(a)),
{name} AS (SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN d[len(b) + 1] / len(a) END AS v FROM {name}_d WHERE i = len(a))"""


_CHARS = r"list_filter(string_split(regexp_replace(lower(@), '\s', '', 'g'), ''), lambda x: x <> '')"
ENGINE_SCORES = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM conversations),
q AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y, {_NORMAL.replace('@', 'a.text')} AS nx, {_NORMAL.replace('@', 'b.text')} AS ny, {_NORMAL.replace('@', 't.text')} AS nt FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 JOIN c t ON t.conv_id = a.conv_id AND t.turn = 0),
p AS MATERIALIZED (SELECT *, {_CHARS.replace('@', 'x')} AS cx, {_CHARS.replace('@', 'y')} AS cy, {_TOK.replace('@', 'x')} AS tx, {_TOK.replace('@', 'y')} AS ty, {_TOK.replace('@', 'nx')} AS wx, {_TOK.replace('@', 'ny')} AS wy, {_TOK.replace('@', 'nt')} AS wt FROM q),
{_f1('cx', 'cy', 'cf')}, {_f1('tx', 'ty', 'wf')}, {_f1('wx', 'wt', 'xf')}, {_f1('wy', 'wt', 'yf')}
SELECT p.conv_id, p.turn, round(cf.v, 6) AS char_f1, round(wf.v, 6) AS word_f1, CASE WHEN length(nt) > 0 THEN round(levenshtein(nx, nt) / length(nt), 6) END AS first_cer, CASE WHEN length(nt) > 0 THEN round(levenshtein(ny, nt) / length(nt), 6) END AS second_cer,
  round(xf.v, 6) AS first_token_f1, round(yf.v, 6) AS second_token_f1
FROM p JOIN cf USING (conv_id, turn) JOIN wf USING (conv_id, turn) JOIN xf USING (conv_id, turn) JOIN yf USING (conv_id, turn)"""

QUERIES = {
    time_statistics: f"""
WITH l AS ({_N}) SELECT l_orderkey, no, round(CASE WHEN no % 2 = 0 THEN (l_partkey * 1000 + no) * 1024 / 1e6 ELSE (l_partkey * 1000 + no) / 1e6 END, 6) AS mb, round((l_quantity / 4)::DECIMAL(10,2)::DOUBLE + (l_discount * 10)::DECIMAL(10,2)::DOUBLE, 6) AS cpu FROM l""",
    own_messages: "SELECT c_custkey, '        2.00 real         1.00 user         0.50 sys' || chr(10) || c_name || chr(10) || 'last words ' || c_mktsegment AS own FROM customer",
    batch_json_round_trip: f"""
WITH l AS ({_N})
SELECT l_orderkey::VARCHAR AS image, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE count(*) END AS n, CASE WHEN l_orderkey % 5 <> 0 THEN string_agg(l_returnflag, '' ORDER BY no) END AS texts, CASE WHEN l_orderkey % 5 <> 0 THEN round(sum(l_discount), 4) END AS confidence, CASE WHEN l_orderkey % 5 = 0 THEN 'no image' END AS error FROM l GROUP BY l_orderkey""",
    rendered_quads: f"""
WITH l AS ({_N})
SELECT l_orderkey AS image, CASE WHEN l_orderkey % 3 = 0 THEN '{{"texts":[' || string_agg('"' || l_returnflag || '"', ',' ORDER BY no) || ']}}' ELSE '{{"lines":[' || string_agg('{{"quad":[' || '[' || l_partkey || ',' || no * 10 || '],[' || l_partkey + 40 || ',' || no * 10 || '],[' || l_partkey + 40 || ',' || no * 10 + 8 || '],[' || l_partkey || ',' || no * 10 + 8 || ']],"text":"' || l_returnflag || '"}}', ',' ORDER BY no) || ']}}' END AS rendered FROM l GROUP BY l_orderkey""",
    marked_regions: r"SELECT conv_id, turn, CASE WHEN conv_id % 4 <> 0 THEN 'before <!--a-->' || chr(10) || '$1 \ ' || role || chr(10) || '<!--b--> after' END AS document FROM conversations",
    joined_pages: rf"""
WITH p AS (SELECT conv_id, turn, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS text FROM conversations WHERE turn % 3 <> 2),
j AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM p WHERE text <> '' GROUP BY conv_id)
SELECT conv_id, md5(text) AS digest, length(text) AS n FROM j""",
    signed_deltas: "SELECT event_id, CASE WHEN event_id % 9 = 0 OR value IS NULL THEN '-' ELSE CASE WHEN value - 50 < 0 THEN '-' ELSE '+' END || abs((value - 50)::DECIMAL(24,6)::DECIMAL(24,3))::VARCHAR END AS delta FROM events",
    threshold_gates: """
WITH s AS (SELECT s_nationkey n, round(avg(s_acctbal), 6)::DECIMAL(24,6) throughput, round(max(s_acctbal), 6)::DECIMAL(24,6) rss FROM supplier GROUP BY 1),
c AS (SELECT c_nationkey n, round(avg(c_acctbal), 6)::DECIMAL(24,6) bt, round(max(c_acctbal) / 2, 6)::DECIMAL(24,6) br FROM customer GROUP BY 1),
m AS (SELECT c.*, s.throughput, s.rss FROM c LEFT JOIN s USING (n)),
g AS (SELECT n, 'throughput' AS gate, CASE WHEN n % 5 = 0 THEN 'other host' WHEN bt <= 0 THEN 'no positive baseline' WHEN throughput IS NULL THEN 'not measured' WHEN throughput < (bt * 0.9)::DECIMAL(24,6) THEN throughput::VARCHAR || ' against ' || (bt * 0.9)::DECIMAL(24,6)::VARCHAR END AS breach FROM m
UNION ALL SELECT n, 'rss', CASE WHEN n % 5 = 0 THEN 'other host' WHEN br <= 0 THEN 'no positive baseline' WHEN rss IS NULL THEN 'not measured' WHEN rss > (br * 1.1)::DECIMAL(24,6) THEN rss::VARCHAR || ' against ' || (br * 1.1)::DECIMAL(24,6)::VARCHAR END FROM m)
SELECT * FROM g WHERE breach IS NOT NULL""",
    batch_summaries: f"SELECT l_returnflag, l_linenumber, total_seconds, image_count, round(CASE WHEN total_seconds > 0 THEN image_count / total_seconds END, 6) AS throughput, round(CASE WHEN total_seconds IS NOT NULL THEN greatest((total_seconds - build_seconds) / image_count, 0) ELSE 0 END, 6) AS warm_per_image_seconds, build_seconds, rss_mb, cpu_core_seconds FROM ({_BATCHES})",
    headline_totals: f"WITH s AS (SELECT l_returnflag, sum(image_count) FILTER (WHERE total_seconds IS NOT NULL)::BIGINT AS images, sum(total_seconds) AS seconds, max(rss_mb) AS peak_rss, sum(cpu_core_seconds) AS cpu_seconds FROM ({_BATCHES}) GROUP BY 1) SELECT l_returnflag, images, round(seconds, 6) AS seconds, peak_rss, round(cpu_seconds, 6) AS cpu_seconds, round(CASE WHEN seconds > 0 THEN images / seconds END, 6) AS throughput FROM s",
    leg_summaries: f"""
WITH c AS (SELECT c_nationkey, CASE WHEN c_nationkey % 7 <> 0 THEN c_mktsegment END AS image, c_acctbal FROM customer),
m AS (SELECT c_nationkey::VARCHAR AS leg, image, round(avg(c_acctbal), 4) AS m FROM c GROUP BY ALL)
SELECT leg, CASE WHEN leg <> '3' THEN 'cpu' ELSE '?' END AS backend, coalesce(image, '-') AS image, CASE WHEN image IS NULL THEN '-' ELSE m{_TEN} END AS total_ms, CASE WHEN image IS NULL THEN '-' ELSE (m / 3){_TEN} END AS detect_ms, CASE WHEN image IS NULL THEN '-' ELSE '0.0' END AS recognize_ms FROM m""",
    guardrail_contracts: "SELECT d.doc_id, round(d.n_chars / 1000.0::DOUBLE * 0.9, 6) AS floor FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS DISTINCT FROM 1 AND d.doc_id % 11 <> 0 AND d.n_chars IS NOT NULL",
    newest_artefacts: "SELECT o_custkey AS artefact, lpad(o_orderkey::VARCHAR, 9, '0') AS path FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 50000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    verified_models: """
WITH p AS (SELECT p_partkey, p_partkey - (p_partkey % 5 = 0)::INT AS role, count(*) OVER (PARTITION BY p_partkey - (p_partkey % 5 = 0)::INT) AS n FROM part)
SELECT p_partkey, role, CASE WHEN n > 1 THEN 'role given twice' WHEN p_partkey % 4 = 0 THEN 'other digest' END AS error FROM p""",
    page_lookup: """
WITH o AS (SELECT o_custkey, lpad(o_orderkey::VARCHAR, 9, '0') AS path FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY list_position(['F', 'O', 'P'], o_orderstatus), o_orderkey) = 1)
SELECT c_custkey AS stem, path FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
    corpus_pins: """
WITH s AS (SELECT (s_suppkey % 50)::VARCHAR || '.png' AS name, 'set/' || s_nationkey || '/' || (s_suppkey % 50) || '.png' AS path, md5(s_name) AS sha256 FROM supplier)
SELECT name, min_by(sha256, (path, sha256)) AS sha256 FROM s GROUP BY name""",
    unsupported_messages: "SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS unsupported FROM part",
    engine_scores: ENGINE_SCORES,
}

"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, interactions, language, media, minhash, mixing, pieces, pii, quality, resampling, secrets, transcripts, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.train(secrets.random_samples(spark).unionByName(secrets.ordinary_samples(docs))))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, *pii.train(docs))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as plain transcripts, their turns recovered: one row per recovered turn."""
    from lectern.llm.state import materialize

    lines = materialize(transcripts.as_transcripts(table(spark, sf_dir, "conversations")), "transcripts")
    labelled = lines.filter("crc32(cast(cast(id as string) as binary)) % 4 <> 2").withColumn("obs", transcripts.observed(F.col("line")))
    turns = transcripts.parse(lines.select("id", "pos", "line"), transcripts.train(labelled))
    return turns.select(F.col("id").alias("conv_id"), "turn", "first_pos", "role", F.length("text").alias("n_chars"), F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_digests(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.score(docs.select("doc_id", "text"), model).drop("text")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), restored="restored", keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "restored")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secret_scan,
        op2_embedding_near_dedup,
        op3_pii,
        op4_chat_formatting,
        op5_minhash_near_dedup,
        op6_language_id,
        op7_mix_sources,
        op8_media_columns,
        op9_quality_classifier,
        op10_sentencepiece,
        op11_importance_resampling,
        op12_benchmark_decontamination,
        op13_filter_interactions,
    )
    return {f.__name__: f for f in every}


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, coalesce(sum(size) FILTER (size >= 500), 0)::BIGINT AS long_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, long_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r,
         (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
         (source_size * 3)::DOUBLE AS cap
  FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
spent AS (
  SELECT *, min(CASE WHEN level * weight <= cap THEN cap / weight END) OVER () AS edge FROM levels),
targets AS (
  SELECT source, source_size, long_size,
         CASE WHEN cap / weight < edge THEN cap ELSE (SELECT min_by(level, (cap / weight, r)) FROM spent WHERE level * weight <= cap) * weight END AS target
  FROM spent),
goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
shares AS (
  SELECT source, source_size, long_size, target, floor(rate + 1e-12) AS whole, greatest(0, rate - floor(rate + 1e-12)) AS share FROM goals),
moves AS (SELECT *, source_size - long_size AS short_size, least(share * long_size, (1 - share) * (source_size - long_size)) / 2 AS moved FROM shares),
chances AS (
  SELECT z.doc_id, z.size, z.u, z.source, s.source_size, s.target, s.whole, s.share,
         CASE WHEN z.size >= 500 THEN s.share - moved / greatest(long_size, 1) ELSE s.share + moved / greatest(short_size, 1) END AS p
  FROM sized z JOIN moves s ON z.source IS NOT DISTINCT FROM s.source),
placed AS (
  SELECT *, share * source_size AS words, CASE WHEN share > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS ratio FROM chances),
run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ratio, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN share > 0 AND upto - size / 2.0 <= words THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""


#: The words of operators 11 and 12: A-Z alone are lower-cased.
FOLDED_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# CRC-32 in SQL: a byte comes in, then eight shifts, each with the polynomial when a 1 falls out
_SHIFTS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], LAMBDA d, z: xor(d // 2, (d % 2) * 3988292384))"

OP11_SQL = f"""
WITH corpus AS (SELECT row_number() OVER () AS no, doc_id, {FOLDED_WORDS} AS w FROM documents),
wanted AS (SELECT -row_number() OVER () AS no, {FOLDED_WORDS} AS w FROM benchmark),
texts AS (SELECT no, w FROM corpus UNION ALL SELECT no, w FROM wanted),
runs AS (
  SELECT no, array_to_string(w[i : i + k - 1], ' ') AS feature
  FROM (SELECT no, w, unnest(range(1, len(w) + 1)) AS i FROM texts), range(1, 4) AS r(k)
  WHERE i + k - 1 <= len(w)),
counted AS (SELECT no, feature, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT feature, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(0, len(h) // 2)] AS b
  FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted))),
hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, b), LAMBDA c, b: {_SHIFTS}), 4294967295) % 10000 AS bucket FROM bytes),
held AS (SELECT no, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL),
sides AS (
  SELECT bucket, coalesce(sum(n) FILTER (no > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (no < 0), 0)::DOUBLE AS t FROM held GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sides),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM sides, totals),
weights AS (SELECT no, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN gains USING (bucket) WHERE no > 0 GROUP BY no),
scored AS (
  SELECT c.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || c.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM corpus c LEFT JOIN weights USING (no)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END::BIGINT AS rank FROM ranked
"""

OP12_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS no, doc_id, {FOLDED_WORDS} AS w FROM documents),
tests AS (SELECT item_id::VARCHAR AS item_id, {FOLDED_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS run
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM tests WHERE len(w) > 0)),
places AS (
  SELECT no, i, size, array_to_string(w[i : i + size - 1], ' ') AS run
  FROM (SELECT no, w, unnest(range(1, len(w) + 1)) AS i FROM words), (SELECT DISTINCT size FROM windows)
  WHERE i + size - 1 <= len(w)),
met AS (SELECT p.no, p.i, p.size, t.item_id FROM places p JOIN windows t USING (size, run)),
hits AS (SELECT no, count(DISTINCT place) AS n_hit FROM (SELECT no, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT no, i, size FROM met)) GROUP BY no),
items AS (SELECT no, list_sort(list(DISTINCT item_id)) AS items FROM met GROUP BY no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (no) LEFT JOIN items USING (no)
"""

# every order is walked step by step; the shares are summed over those walks
OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
measured AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, min(doc_id) OVER (PARTITION BY text) AS least
  FROM texts),
judged AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * upper > 2 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS mask
  FROM measured),
told AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM judged LEFT JOIN told USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, unnest([1, 2, 3, 4, 5]) AS step,
         unnest([0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, a.bit + b.bit + c.bit + d.bit]) AS before, unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) AS bit
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
walked AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, orders GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM walked
"""


# components: the pairs that are reachable from each other, from few links
_REACH = """
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)"""

OP2_SQL = f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),{_REACH}
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

OP5_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM runs x JOIN runs y ON x.run = y.run AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),{_REACH}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": OP2_SQL, "op5_minhash_near_dedup": OP5_SQL, "op7_mix_sources": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op12_benchmark_decontamination": OP12_SQL, "op13_filter_interactions": OP13_SQL}

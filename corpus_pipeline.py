"""The corpus pipeline: stages applied in order to ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Models are fitted on the stage's own input.

Defined cases, for every stage: rows are told apart as rows, so rows without a doc_id and several rows of one
doc_id each have their own decision (see the stages for equal rows; near-dedup keeps one of those that repeat a doc_id with its text); columns of any other name come through as
they are, whatever a stage computes; an empty table gives an empty table; texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import minhash, mixing, pieces, pii, quality
from lectern.llm.state import discard, materialize, replaceable, scratch, small_batches, small_side

#: Bytes of texts that a task encodes together: a quarter of what op10 takes, as executors also hold what the other stages left.
GROUP = 1 << 21


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, each row by its own text; null and empty texts are rejected.

    Equal rows fare alike; a probability of just ``KEEP_AT`` is kept; without labels every row that has words stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # the other columns in one, so that none can clash with the scores; the text is carried once
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    with small_batches(spark):
        model = quality.train(docs, quality.graded(labels))
        # written here, as rows that are only returned would be sent to Python in batches of the session's size
        kept = quality.score(docs.select("text", rest), model).filter("kept")
        return materialize(kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns)), "kept")


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id, and one row of those that repeat it.

    Rows without a doc_id are documents too, numbered by their text after all others, so equal texts are one of them.
    Of rows that repeat a doc_id with its text the one of the least hash stays, also of texts without words.
    """
    by_text = F.shiftrightunsigned(minhash.text_hash(), 2) + F.lit(1 << 62)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), by_text).alias("doc_id"), minhash.text_hash().alias("h"), "text", F.struct("*").alias("row"))
    with small_batches(spark):
        told = minhash.near_duplicates(rows.select("doc_id", "text"), hashed=True)
    marks = told.groupBy("doc_id", "h").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times")).filter("not kept or times > 1")
    marked = rows.drop("text").join(small_side(materialize(marks, "marks")), ["doc_id", "h"], "left")
    once = marked.filter("kept").groupBy("doc_id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return marked.filter("kept is null").select("row").unionByName(once.select("row")).select("row.*")


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; null stays null, equal rows fare alike, ``n_chars`` follows the text."""
    out = pii.redact(docs, *pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; documents without words are not taken, of equal rows each is drawn on its own."""
    whole = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    # rows are carried along: neither doc_id nor text tells repeated rows apart
    taken = mixing.mix(whole, keep=("row",)).filter("taken > 0")
    copies = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return taken.withColumn("copy", copies).select("row.*")


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they restore it; null has null ids and a null number of them."""
    with small_batches(spark):
        coded = materialize(pieces.encode(docs.select("doc_id", "source", "text"), restored="restored", keep_text=False, group=GROUP), "stage")
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("bigint").alias("n_ids"), "restored")


STAGES = [
    ("quality classifier", _quality),
    ("MinHash near-dedup", _near_duplicates),
    ("PII", _personal_data),
    ("mixing sources", _mix),
    ("SentencePiece encoding", _encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage's rows are written once, and read by the next one or by the result.

    What a stage wrote for itself, and the rows it read, are deleted when its own rows are there.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as tables:
            docs, path = replaceable(stage(spark, docs, sf_dir), "stage")
            tables.remove(path)
        if read:
            discard(spark, read)
        read = path
    coded = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, read)
    return coded

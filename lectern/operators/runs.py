"""Planning and publishing of runs: groups, limits, model choice, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_by_languages(entries: DataFrame, languages: str, order: str, item: str) -> DataFrame:
    """Rows (group_no, languages, n, first): entries per set of languages, groups in order of their first entry."""
    groups = entries.groupBy(languages).agg(F.min(order).alias("at"), F.count(F.lit(1)).alias("n"), F.min_by(item, order).alias("first"))
    every = groups.groupBy().agg(F.array_sort(F.collect_list(F.struct("at", languages, "n", "first"))).alias("l"))  # one row per set of languages
    return every.select(F.posexplode("l").alias("group_no", "g")).select("group_no", f"g.{languages}", "g.n", "g.first")


def first_entries(entries: DataFrame, order: str, n: int) -> DataFrame:
    """The first n entries in order."""
    return entries.orderBy(order).limit(n)


def recognition_language(languages: Column, default: str = "english") -> Column:
    """The one language other than the default, the default without any; more raise an error."""
    others = F.array_distinct(F.filter(languages, lambda x: x != default))
    return F.when(F.size(others) == 0, F.lit(default)).when(F.size(others) == 1, others[0]).otherwise(F.raise_error(F.concat(F.lit("one language besides the default is possible, not "), F.array_join(others, ", "))))


def overhead(runs: DataFrame, size: str, item: str, seconds: str, *keys: str) -> DataFrame:
    """Median seconds of the smallest item's runs per key: what a run costs before any work."""
    least = runs.groupBy(*keys).agg(F.min_by(item, F.struct(size, item)).alias("smallest"))
    own = runs.join(least, list(keys)).filter(F.col(item) == F.col("smallest"))
    return own.groupBy(*keys, "smallest").agg(F.median(seconds).alias("overhead"))


def drift(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with ``side``."""
    return expected.exceptAll(stored).withColumn("side", F.lit("missing")).unionByName(stored.exceptAll(expected).withColumn("side", F.lit("stale")))


def manifest(groups: dict[str, DataFrame], wanted: list[str] | None = None) -> DataFrame:
    """Groups of entries as one table with ``grp``; only the wanted ones."""
    out = None
    for name, df in groups.items():
        if wanted is None or name in wanted:
            part = df.withColumn("grp", F.lit(name))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no group is wanted")
    return out


def max_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest absolute difference of paired values, and how many pairs and unpaired rows there are."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("largest"), F.count_if(paired).alias("pairs"), F.count_if(~paired).alias("unpaired"))

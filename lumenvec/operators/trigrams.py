"""Search by trigrams (F7, T4): an index from every three letters of a text, lower-cased, to the rows that hold them.

A search takes the needle's trigrams, begins with the one that the fewest rows hold, keeps the rows that hold all
others, too, and lets the plain search decide among these. The index lies in buckets of trigrams, so a search reads
the buckets of its own. Needles under three letters have no trigram and search all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import shared_dir
from .gates import search

SIZE = 3
BUCKETS = 64


def grams(text: Column) -> Column:
    """Distinct trigrams of a lower-cased text; none of a null or shorter one."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - SIZE + 1, F.lit(1)))
    return F.when(F.length(low) >= SIZE, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, SIZE)))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    #: gram, id, bucket
    postings: DataFrame
    key: str
    column: str


def build(rows: DataFrame, key: str, column: str, path: str | None = None) -> Index:
    """The index of a column, written to path: a row for each trigram of each row, in order of trigrams."""
    spark: SparkSession = rows.sparkSession
    path = path or shared_dir(spark, "trigrams")
    found = rows.select(F.col(key).alias("id"), F.explode(grams(F.col(column))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    # Ranges of (bucket, gram, id): a trigram that most rows hold fills several tasks.
    found.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(path)
    return Index(spark.read.schema(found.schema).parquet(path), key, column)


def candidates(index: Index, needle: str) -> DataFrame | None:
    """id of the rows that hold all of the needle's trigrams; null for a needle without any."""
    spark: SparkSession = index.postings.sparkSession
    asked = [r[0] for r in spark.range(1).select(F.explode(grams(F.lit(needle)))).collect()]  # of the needle alone
    if not asked:
        return None
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in asked], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    held = index.postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(asked))
    counts = {r["gram"]: r["n"] for r in held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each of the needle's
    rarest = min(asked, key=lambda g: (counts.get(g, 0), g))
    first = held.where(F.col("gram") == rarest).select("id")
    if len(asked) == 1:
        return first
    others = held.where(F.col("gram") != rarest).join(first, "id", "left_semi")
    return others.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(asked) - 1).select("id")


def search_indexed(index: Index, rows: DataFrame, needle: str, limit: int | None = None, shortest: int = 0) -> DataFrame:
    """As gates.search over rows, which have the index's key."""
    if len(needle.strip()) < shortest:
        return rows.limit(0)
    found = [candidates(index, form) for form in dict.fromkeys((needle, needle.replace(" ", "_")))]
    if any(f is None for f in found):
        return search(rows, index.column, needle, limit, shortest)
    ids = found[0] if len(found) == 1 else found[0].union(found[1])
    held = rows.join(ids.withColumnRenamed("id", index.key), index.key, "left_semi").select(rows.columns)
    return search(held, index.column, needle, limit, shortest)

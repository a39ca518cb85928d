"""Search in many stored rows by an index of trigrams, with every hit verified.

Each row's texts give their different trigrams (lower-cased), and the index holds (gram, key), sorted by gram in files of buckets, with the
number of rows of each gram. A search takes the ``RAREST`` grams of what is looked for, reads their lists only, and looks at the texts
of rows that are in all of them. A text under three characters has no trigram: then all rows are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.operators.rollup import search

COLUMNS = ("title", "description", "file", "snippet", "type")
RAREST, BUCKETS = 4, 64
#: The rows of a bucket are dealt over so many places by their key, as a gram may be in most rows.
SPREAD = 16


def grams(text: Column) -> Column:
    """The different trigrams of a text, lower-cased; none for null and short texts. Linear in the text."""

    def three(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - 3, F.lit(0)))
        return F.transform(starts, lambda i: F.concat(chars[i], F.get(chars, i + 1), F.get(chars, i + 2)))

    low = F.lower(text)
    found = F.transform(F.array(F.split(low, "")), three)[0]
    return F.when(F.length(low) >= 3, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(rows: DataFrame, path: str, key: str = "id", columns: tuple[str, ...] = COLUMNS, line: str | None = "line") -> None:
    """Write the index of ``rows`` at ``path``; ``key`` tells rows apart. Null texts have no grams."""
    texts = [F.col(c).cast("string") for c in columns] + ([F.col(line).cast("string")] if line else [])
    own = F.array_distinct(F.flatten(F.array(*(grams(t) for t in texts))))
    pairs = rows.select(F.col(key).alias("key"), F.explode(own).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    # Not by ranges: finding their bounds would cut all texts into grams once more.
    dealt = pairs.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPREAD)))
    dealt.sortWithinPartitions("bucket", "gram", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
    spark = rows.sparkSession
    counts = spark.read.parquet(f"{path}/lists").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """(key): rows that have the rarest trigrams of ``text``; None if it is too short to tell."""
    wanted = [r.gram for r in spark.range(1).select(F.explode(grams(F.lit(text))).alias("gram")).collect()]  # of the text asked for
    if not wanted:
        return None
    with_bucket = [tuple(r) for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select("gram", _bucket(F.col("gram"))).collect()]
    in_bucket = F.col("bucket").isin(*{b for _, b in with_bucket})
    counts = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").where(in_bucket & F.col("gram").isin(*wanted)).collect()}
    lists = spark.read.parquet(f"{path}/lists")
    if len(counts) < len(wanted):
        return lists.where("false").select("key")  # a gram that no row has
    rare = sorted(wanted, key=lambda g: (counts[g], g))[:RAREST]
    in_bucket = F.col("bucket").isin(*{b for g, b in with_bucket if g in rare})
    found = lists.where(in_bucket & F.col("gram").isin(*rare))
    return found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("key")


def search_indexed(rows: DataFrame, path: str, text: str, key: str = "id", columns: tuple[str, ...] = COLUMNS, line: str | None = "line") -> DataFrame:
    """What ``search`` gives over the same columns, with only the candidates' texts looked at. '' keeps all."""
    if not text:
        return rows
    found = candidates(rows.sparkSession, path, text)
    some = rows if found is None else rows.join(found.withColumnRenamed("key", key), key, "left_semi")
    return search(some, text, columns, line)

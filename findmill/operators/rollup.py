"""Counts, scores, run summaries, dashboard queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill.functions.rules import LOG_LINES, SEVERITIES
from findmill.functions.text import severity_rank


def severity_counts(sev: Column) -> list[Column]:
    """Four counts that are 0, not null, over no rows."""
    return [F.count_if(sev == s).alias(s.lower()) for s in SEVERITIES]


def score(critical: Column, high: Column) -> Column:
    return F.lit(100) - 20 * critical - 10 * high


def mean_confidence(confidence: Column) -> Column:
    return F.coalesce(F.round(F.avg(confidence), 2), F.lit(0.0))


def run_summary(found: DataFrame, *by: str) -> DataFrame:
    """Counts, mean confidence and score, of all rows or of each group."""
    counted = found.groupBy(*by).agg(*severity_counts(F.col("severity")), mean_confidence(F.col("confidence")).alias("confidence_score"))
    return counted.withColumn("score", score(F.col("critical"), F.col("high")))


def call_counters(calls: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    return calls.agg(F.count_if(ok).alias("successful_analyses"), F.count_if(~ok).alias("failed_analyses"))


def search(found: DataFrame, text: str, columns: tuple[str, ...] = ("title", "description", "file", "snippet", "type"), line: str | None = "line") -> DataFrame:
    """Rows where any column contains the text, whatever its case, or whose line does; '' keeps all."""
    if not text:
        return found
    needle = text.lower()
    hits = [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in columns]
    if line:
        hits.append(F.coalesce((F.col(line) != 0) & F.col(line).cast("string").contains(needle), F.lit(False)))
    return found.where(reduce(Column.__or__, hits))


def facets(found: DataFrame, **values: tuple) -> DataFrame:
    """IN for each column given; an empty list asks for nothing."""
    for column, wanted in values.items():
        if wanted:
            found = found.where(F.col(column).isin(*wanted))
    return found


def result_counts(shown: DataFrame, rows: DataFrame) -> DataFrame:
    """``shown`` with how many rows it has, and how many there are in all."""
    return shown.withColumns({"shown": shown.agg(F.count("*")).scalar(), "total": rows.agg(F.count("*")).scalar()})


def by_id(found: DataFrame, value: int, key: str = "id") -> DataFrame:
    """The row with an id: the first, should there be more."""
    return found.where(F.col(key) == value).limit(1)


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def top_priority(found: DataFrame, n: int = 5, sev: str = "severity", key: str = "id") -> DataFrame:
    return found.orderBy(severity_rank(F.col(sev)).desc(), key).limit(n)


def first_seen(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Distinct values with the key of their first row, in that order."""
    return rows.groupBy(column).agg(F.min(key).alias("first_id"))


def tail(rows: DataFrame, key: str, n: int = LOG_LINES) -> DataFrame:
    return rows.orderBy(F.desc(key)).limit(n)


def progress(done: Column, total: Column) -> Column:
    return F.floor(done * 100 / total).cast("long")


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    return F.floor(elapsed / done * (total - done)).cast("long")


def with_default(rows: DataFrame, dimension: DataFrame, key: str, default: str) -> DataFrame:
    """Left join with a dimension; keys it lacks get the dimension's ``default`` row."""
    other = dimension.where(F.col(key) == default).drop(key)
    names = other.columns
    fallback = {n: other.select(n).scalar() for n in names}
    joined = rows.join(dimension.withColumn("_hit", F.lit(True)), key, "left")
    return joined.select(*rows.columns, *(F.when(F.col("_hit"), F.col(n)).otherwise(fallback[n]).alias(n) for n in names))

"""The run history: newest runs first, from a bounded number of files.

A run is one small file in ``recent``, whose name begins with the time counted down, so names sort newest first. When there are
``MOST_RECENT`` of them they become one page. A page's name tells its newest date in the same way, so a reader opens
the recent files and as many pages as hold what it is asked for, whatever number of runs there are.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.functions.rules import HISTORY_ROWS
from findmill.sources.shared import Shared

HISTORY_SCHEMA = (
    "id string, date string, target string, profile string, mode string, "
    "stats struct<critical:bigint,high:bigint,medium:bigint,low:bigint,files:bigint>, "
    "confidence_score double, score bigint, successful_analyses bigint, failed_analyses bigint"
)
MOST_RECENT = 100
#: Dates as digits, each counted down from 9, so that later dates come first.
_DOWN = str.maketrans("0123456789", "9876543210")


def _name(date: str, run_id: str) -> str:
    return f"{''.join(filter(str.isdigit, date)).ljust(14, '0').translate(_DOWN)}-{run_id}.json"


def _newest_of(name: str) -> str:
    """The date in a name, as digits."""
    return name.split("-")[0].translate(_DOWN)


def append(summary: DataFrame, path: str, most_recent: int = MOST_RECENT) -> None:
    """Add the runs of ``summary``, one row each, and make a page of recent ones when there are many."""
    shared = Shared(path)
    for row in summary.collect():  # a run is one row
        shared.put(f"recent/{_name(row.date, row.id)}", json.dumps(row.asDict(recursive=True)).encode())
    names = shared.below("recent").names()
    if len(names) >= most_recent:
        page(path, names)


def page(path: str, names: list[str]) -> None:
    """Put recent runs together. If it ends half way, runs are there twice, and readers take each id once."""
    shared = Shared(path)
    rows = [x for x in (shared.get(f"recent/{n}") for n in names) if x is not None]
    if rows:
        shared.put(f"pages/{names[0]}", b"\n".join(rows))
        for name in names:
            shared.drop(f"recent/{name}")


def _read(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).json(files)


def history(spark: SparkSession, path: str, limit: int = HISTORY_ROWS) -> DataFrame:
    """The newest runs first; empty if there is no history yet. Keys an old run lacks are null.

    ``path`` may also be a file, or a folder of files, that holds lists of runs: an older layout, read in full.
    """
    shared = Shared(path)
    parts = shared.names() if shared.has("") else []
    recent, pages = shared.below("recent").names(), shared.below("pages").names()
    older = [f"{path}/{x}" for x in parts if x.endswith(".json")]
    if not recent and not pages:
        if not shared.has(""):
            return spark.createDataFrame([], HISTORY_SCHEMA)
        return newest(spark.read.schema(HISTORY_SCHEMA).json(path, multiLine=True), limit)
    files = [f"{path}/recent/{x}" for x in recent[:limit]]
    dates = sorted((_newest_of(x) for x in recent), reverse=True)[:limit]
    for name in pages:
        # Pages come by their newest date: once ``limit`` runs are as new as that, no later page matters.
        if len(dates) >= limit and dates[limit - 1] > _newest_of(name):
            break
        files.append(f"{path}/pages/{name}")
        rows = (shared.get(f"pages/{name}") or b"").splitlines()
        dates = sorted([*dates, *(_newest_of(_name(json.loads(r)["date"], "")) for r in rows)], reverse=True)[:limit]
    found = _read(spark, files)
    if older:
        found = found.unionByName(spark.read.schema(HISTORY_SCHEMA).json(older, multiLine=True))
    return newest(found.dropDuplicates(["id", "date"]), limit)


def newest(runs: DataFrame, limit: int = HISTORY_ROWS) -> DataFrame:
    return runs.orderBy(F.desc("date"), "id").limit(limit)

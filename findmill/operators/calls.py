"""Model calls that survive lost tasks, stops and restarts: answers are kept as they come.

Prompts are stored first, so a call has an id that stays. They are dealt into slots of a few calls; a task takes
slots one after the other. What it has answered it puts into the slot's folder in the shared store, every
``commit_seconds``, as a file that is there whole or not at all. A task that begins a slot, for the first time or again, reads
what the folder holds and asks for the rest only. So a lost executor, a failed job or a new driver repeats no
answer that was put down, and what a stop leaves can be read.

Calls at a time are bounded by the number of tasks, or, with a resource profile, by the task resource that
stands for one call; then a task is one slot, and Spark deals slots to executors as they get free.
"""

from __future__ import annotations

import io
import time
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.operators.inference import Backend, ask
from findmill.operators.rollup import eta_seconds, progress
from findmill.sources.shared import Shared
from findmill.sources.store import small_batches

SLOT_CALLS, COMMIT_SECONDS, STOP_SECONDS = 64, 5.0, 1.0
ANSWER = "call_id long, status string, raw string, model string, at double"
_ARROW = pa.schema([("call_id", pa.int64()), ("status", pa.string()), ("raw", pa.string()), ("model", pa.string()), ("at", pa.float64())])
STOP = "stop"


class _Slot:
    """The answers of one slot: those that are there, and those of this task that are not put down yet."""

    def __init__(self, folder: Shared, commit_seconds: float):
        self.folder, self.seconds = folder, commit_seconds
        self.rows: list[tuple] = []
        self.last = time.monotonic()
        self.known: set[int] = set()
        for name in folder.names():
            self.known.update(pq.read_table(io.BytesIO(folder.get(name)), columns=["call_id"]).column(0).to_pylist())

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if time.monotonic() - self.last >= self.seconds:
            self.put()

    def put(self) -> None:
        if self.rows:
            out = io.BytesIO()
            pq.write_table(pa.table([pa.array(x, f.type) for x, f in zip(zip(*self.rows), _ARROW)], schema=_ARROW), out)
            self.folder.put(f"{uuid.uuid4().hex}.parquet", out.getvalue())
        self.rows, self.last = [], time.monotonic()


def slot_of(call_id: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(call_id), F.lit(slots)).cast("int")


def ask_all(
    prompts: DataFrame, backend: Backend, model: str, folder: str, max_calls: int = 2, resources: ResourceProfile | None = None,
    slot_calls: int = SLOT_CALLS, commit_seconds: float = COMMIT_SECONDS,
) -> dict:
    """Ask for all ``prompts`` (call_id, prompt) without an answer in ``folder``; {"asked", "reused", "left"}.

    ``prompts`` is a stored table: its call_ids and their number stay, and so the slots. Null prompts are empty ones. After a file named
    ``stop`` appears in ``folder`` no further call begins; ``left`` counts the calls that this left out.
    """
    shared = Shared(folder)
    slots = max(1, -(-prompts.count() // slot_calls))
    tasks = slots if resources is not None else min(slots, max_calls)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, slot = None, None
        looked, stopped = 0.0, False
        for batch in batches:
            asked = reused = left = 0
            for number, call_id, prompt in zip(batch["slot"], batch["call_id"], batch["prompt"]):
                if number != now:
                    if slot:
                        slot.put()
                    now, slot = number, _Slot(shared.below(f"slot={number}"), commit_seconds)
                if call_id in slot.known:
                    reused += 1
                    continue
                if not stopped and time.monotonic() - looked >= STOP_SECONDS:
                    looked, stopped = time.monotonic(), shared.has(STOP)
                if stopped:
                    left += 1
                    continue
                slot.add((int(call_id), *ask(backend, model, prompt or ""), time.time()))
                asked += 1
            yield pd.DataFrame({"asked": [asked], "reused": [reused], "left": [left]})
        if slot:
            slot.put()

    dealt = prompts.select(slot_of(F.col("call_id"), slots).alias("slot"), "call_id", "prompt").repartitionById(tasks, F.col("slot") % tasks)
    more = {} if resources is None else {"profile": resources}
    made = dealt.sortWithinPartitions("slot", "call_id").mapInPandas(run, "asked long, reused long, left long", **more)
    with small_batches(prompts.sparkSession):
        return made.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("asked", "reused", "left"))).first().asDict()


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """What is answered so far, one row a call: if an attempt thought lost went on, its first answer counts."""
    if not any(x.startswith("slot=") for x in Shared(folder).names()):
        return spark.createDataFrame([], ANSWER)
    found = spark.read.schema(ANSWER).parquet(f"{folder}/slot=*")
    return found.groupBy("call_id").agg(F.min_by(F.struct("status", "raw", "model", "at"), "at").alias("first")).select("call_id", "first.*")


def with_answers(prompts: DataFrame, answered: DataFrame) -> DataFrame:
    """``prompts`` without texts, with status, raw, model and at; calls without an answer go."""
    return prompts.drop("prompt", "chunk").join(answered, "call_id")


def file_progress(prompts: DataFrame, answered: DataFrame) -> DataFrame:
    """(filepath, calls, done, failed, last): how far each file is; ``last`` is the time of its latest answer."""
    status = answered.select("call_id", "status", "at")
    both = prompts.select("call_id", "filepath").join(status, "call_id", "left")
    done = F.count("status")
    return both.groupBy("filepath").agg(F.count("*").alias("calls"), done.alias("done"), F.count_if(F.col("status") != "ok").alias("failed"), F.max("at").alias("last"))


def overall(files: DataFrame, total_files: int, elapsed: float) -> DataFrame:
    """(files, done_files, calls, done_calls, failed_calls, progress, eta_seconds) of ``file_progress``.

    A file is done when all its calls are answered; files without calls are done. Progress is in per cent of files, rounded down;
    the estimate is null before the first file.
    """
    total = F.lit(total_files)
    counted = files.agg(
        total.alias("files"), (total - F.count_if(F.col("done") < F.col("calls"))).alias("done_files"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        F.coalesce(F.sum("done"), F.lit(0)).alias("done_calls"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_calls"),
    )
    done = F.col("done_files")
    return counted.select(
        "*", F.when(total > 0, progress(done, total)).otherwise(F.lit(100)).cast("long").alias("progress"),
        F.when(done > 0, eta_seconds(F.lit(float(elapsed)), done, total)).alias("eta_seconds"),
    )

"""The engine's calls: run a scan, look at a run, export, patch."""

from __future__ import annotations

import json
import threading
import time
import uuid
from typing import NamedTuple

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.functions.rules import mode_of, profile_of
from findmill.functions.text import iso, safe_name
from findmill.operators.calls import COMMIT_SECONDS, SLOT_CALLS, STOP, answers, ask_all, file_progress, overall, with_answers
from findmill.operators.chunks import chunks, prompts
from findmill.operators.findings import assign_ids, findings, select_findings, with_snippets
from findmill.operators.inference import Backend
from findmill.operators.report import patches, save_run, stored_run
from findmill.operators.rollup import by_id, call_counters, run_summary
from findmill.sources.history import append
from findmill.sources.shared import Shared
from findmill.sources.tree import opened, source_tree

TEMPLATE = (
    "Review the source file below for security defects. Answer with a JSON list; each entry has title, severity, "
    "line, description, fix, type, confidence and reasoning.\nFile: ",
    "\n---\n",
    "\n---",
)
MODE_TEXT = {
    "rapid": "Report severe defects only.",
    "deep": "Follow data between functions.",
    "devsecops": "Include configuration, containers and build files.",
}


_BUSY = threading.Lock()
STEPS = ("files", "calls", "findings", "summary")


class Run(NamedTuple):
    run_id: str
    files: DataFrame
    calls: DataFrame
    findings: DataFrame
    summary: DataFrame


class Stopped(RuntimeError):
    """A scan was stopped; it leaves no history. ``run`` holds what the answers up to there gave, if there were any calls."""

    def __init__(self, run_id: str, run: Run | None = None):
        super().__init__(run_id)
        self.run_id, self.run = run_id, run


class _State:
    """What a scan is doing, in the store: any driver can read it."""

    def __init__(self, store: str, run_id: str, **given):
        self.shared = Shared(f"{store}/state/{run_id}")
        self.now = {"run_id": run_id, **given}

    def put(self, **changes) -> None:
        self.now |= {**changes, "updated": time.time()}
        self.shared.put("state.json", json.dumps(self.now).encode())


def run_scan(
    spark: SparkSession, target: str, backend: Backend, store: str, profile: str = "balanced", mode: str = "deep", keep_history: bool = True,
    resume: str | None = None, max_calls: int | None = None, resources: ResourceProfile | None = None, slot_calls: int = SLOT_CALLS,
    commit_seconds: float = COMMIT_SECONDS,
) -> Run | None:
    """Scan a target; None if no file matches (such runs leave no history).

    Files, prompts, answers and findings are stored in ``store``. Answers are put down as they come, so a lost task repeats none of them;
    ``resume`` takes the id of a scan that was stopped or failed, by this driver or another, and goes on where it ended. Calls at a time: those of
    the profile, or ``max_calls``, or, with a resource profile, as many as its task resource allows. One scan runs at a time in a
    driver. A stop lets running calls end, makes findings of what is answered, and raises ``Stopped``.
    """
    if not _BUSY.acquire(blocking=False):
        raise RuntimeError("a scan is running")
    run_id = resume or str(uuid.uuid4())[:8]
    state = _State(store, run_id, target=target, profile=profile, mode=mode, began=time.time())
    spark.sparkContext.addJobTag(f"scan-{run_id}")
    try:
        Shared(_answers(store, run_id)).drop(STOP)
        state.put(state="running", step=STEPS[0])
        limits = {"max_calls": max_calls or profile_of(profile).max_calls, "resources": resources, "slot_calls": slot_calls, "commit_seconds": commit_seconds}
        found = _scan(spark, state, target, backend, store, profile, mode, keep_history, limits)
        state.put(state="done")
        return found
    except Exception as e:
        stopped = Shared(_answers(store, run_id)).has(STOP)
        state.put(state="stopped" if stopped else "failed")
        if stopped and not isinstance(e, Stopped):
            raise Stopped(run_id) from e
        raise
    finally:
        spark.sparkContext.removeJobTag(f"scan-{run_id}")
        _BUSY.release()


def _answers(store: str, run_id: str) -> str:
    return f"{store}/answers/run_id={run_id}"


def run_status(spark: SparkSession, store: str, run_id: str) -> dict | None:
    """State (running, done, stopped or failed), step, and how far the calls are, from what the store holds.

    Files and calls done, progress in per cent of files and the estimate of the seconds left count the answers
    that are put down, so another driver sees them too, while the scan runs and after it.
    """
    raw = Shared(f"{store}/state/{run_id}").get("state.json")
    if raw is None:
        return None
    state = json.loads(raw)
    prompts = stored_run(spark, f"{store}/prompts", run_id)
    if prompts is not None:
        end = time.time() if state["state"] == "running" else state["updated"]
        row = overall(scan_progress(spark, store, run_id), state["files"], end - state["calls_began"]).first().asDict()
        state |= row
    if state["state"] == "done":
        state["progress"] = 100
    return {"progress": 0, **state}


def scan_progress(spark: SparkSession, store: str, run_id: str) -> DataFrame:
    """(filepath, calls, done, failed, last) of each file of a scan that has calls, as answers are put down."""
    return file_progress(stored_run(spark, f"{store}/prompts", run_id), answers(spark, _answers(store, run_id)))


def running_scans(store: str) -> list[str]:
    """The ids of the scans whose state in the store is running."""
    shared = Shared(f"{store}/state")
    states = [json.loads(shared.get(f"{x}/state.json") or b"{}") for x in shared.names()]
    return sorted(x["run_id"] for x in states if x.get("state") == "running")


def stop_scan(store: str, run_id: str, cancel: SparkSession | None = None) -> bool:
    """Stop a running scan, from any thread or driver: no further call begins, and the answers stay.

    Calls that run may end. With ``cancel``, the session that scans, its jobs are cancelled as well: then the answers that
    are put down stay, and the scan ends without findings.
    """
    if run_id not in running_scans(store):
        return False
    Shared(_answers(store, run_id)).put(STOP, b"")
    if cancel is not None:
        cancel.sparkContext.cancelJobsWithTag(f"scan-{run_id}")
    return True


def _enter(state: _State, store: str, step: str, **more) -> None:
    if step != "findings" and Shared(_answers(store, state.now["run_id"])).has(STOP):
        raise Stopped(state.now["run_id"])
    state.put(step=step, **more)


def _scan(spark: SparkSession, state: _State, target: str, backend: Backend, store: str, profile: str, mode: str, keep_history: bool, limits: dict) -> Run | None:
    plan, rules, run_id = profile_of(profile), mode_of(mode), state.now["run_id"]
    # Stored once: every later step, and a scan that goes on, sees the same files, and a clone can go.
    files = stored_run(spark, f"{store}/files", run_id)
    if files is None:
        with opened(spark, target) as folder:
            files = save_run(source_tree(spark, folder, rules.suffixes), f"{store}/files", run_id)
    files = files.drop("run_id")
    n_files = files.count()
    if not n_files:
        return None
    prompted = stored_run(spark, f"{store}/prompts", run_id)
    if prompted is None:
        cut = prompts(chunks(files, plan.chunk_size, plan.whole_file), TEMPLATE, MODE_TEXT.get(mode, MODE_TEXT["deep"])).drop("chunk")
        prompted = save_run(cut.withColumnRenamed("path", "filepath").withColumn("call_id", F.monotonically_increasing_id()), f"{store}/prompts", run_id)
    _enter(state, store, "calls", files=n_files, calls_began=time.time())
    left = ask_all(prompted, backend, plan.model, _answers(store, run_id), **limits)["left"]
    _enter(state, store, "findings")
    calls = with_answers(prompted, answers(spark, _answers(store, run_id))).withColumn("safe_name", safe_name(F.col("file")))
    raw = calls.where("status = 'ok'").select("run_id", "filepath", "chunk_idx", "raw")
    best = assign_ids(select_findings(findings(raw), mode, ("run_id", "filepath", "chunk_idx")))
    found = save_run(with_snippets(best, files), f"{store}/findings", run_id)
    if left or Shared(_answers(store, run_id)).has(STOP):
        raise Stopped(run_id, Run(run_id, files, calls, found, _summary(spark, state, found, calls, n_files)))
    _enter(state, store, "summary")
    summary = _summary(spark, state, found, calls, n_files)
    if keep_history:
        append(summary, f"{store}/history")
    return Run(run_id, files, calls, found, summary)


def _summary(spark: SparkSession, state: _State, found: DataFrame, calls: DataFrame, n_files: int) -> DataFrame:
    counters = call_counters(calls)
    row = (
        run_summary(found)
        .withColumns({c: counters.select(c).scalar() for c in counters.columns} | {"files": F.lit(n_files).cast("long")})
        .select(
            F.lit(state.now["run_id"]).alias("id"), iso(F.current_timestamp()).alias("date"),
            *(F.lit(state.now[x]).alias(x) for x in ("target", "profile", "mode")),
            F.struct("critical", "high", "medium", "low", "files").alias("stats"), "confidence_score",
            F.col("score").cast("long").alias("score"), "successful_analyses", "failed_analyses",
        )
    )
    return spark.createDataFrame([row.first()], row.schema)  # one row, so that its date stays


def generate_patch(run: Run, finding_id: int) -> DataFrame:
    return patches(by_id(run.findings, finding_id), run.files).select("id", "patch.*")

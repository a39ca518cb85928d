"""Exports: JSON rows, an HTML report, patches, and what a run stores."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from findmill.functions.text import confidence_colour, file_stamp, fresh, html_escape, joined, report_colour, safe_name
from findmill.operators.rollup import union_all
from findmill.sources.shared import Shared
from findmill.sources.sinks import write_document, write_files

PATCH = StructType(
    [StructField("ok", BooleanType())] + [StructField(x, StringType()) for x in ("diff", "before", "after", "error")]
)


def json_rows(found: DataFrame) -> DataFrame:
    return found.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def export_json(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def html_fragment(title: Column, sev: Column, confidence: Column, **optional: Column) -> Column:
    """One finding as HTML; values are escaped, optional lines are left out when empty."""
    lines = [
        F.concat(F.lit('<div class="finding" style="border-color:'), report_colour(sev), F.lit('"><h3>'), html_escape(title), F.lit("</h3>")),
        F.concat(F.lit("<p>"), html_escape(sev), F.lit(' <b style="color:'), confidence_colour(confidence), F.lit('">'), F.format_number(confidence, 2), F.lit("</b></p>")),
        *(F.when(v != "", F.concat(F.lit(f"<p>{name}: "), html_escape(v), F.lit("</p>"))) for name, v in optional.items()),
        F.lit("</div>"),
    ]
    return F.concat_ws("", *lines)


def report_rows(found: DataFrame) -> DataFrame:
    """(id, html), and a head (id 0) with the total; in order of id they are the document."""
    refs = joined(F.col("reasoning.cve_refs"))
    body = found.select(
        "id",
        html_fragment(
            F.col("title"), F.col("severity"), F.col("confidence"), File=F.col("file"), Description=F.col("description"),
            Fix=F.col("fix"), CVE=refs, Impact=F.col("reasoning.business_impact"), Exploit=F.col("reasoning.exploit_example"),
        ).alias("html"),
    )
    head = found.agg(F.lit(0).cast("long").alias("id"), F.concat(F.lit("<h1>Findings: "), F.count("*"), F.lit("</h1>")).alias("html"))
    return union_all(head, body)


def export_html(found: DataFrame, path: str) -> None:
    """The report as one file: there in full, or, if the job fails, as it was before."""
    write_document(report_rows(found), path)


def export_responses(calls: DataFrame, path: str) -> None:
    """Raw responses as files ``<time>_<name>_<call>.json`` below ``path``; ``calls`` has call_id, safe_name, raw and at."""
    name = F.concat(file_stamp(F.timestamp_seconds("at")), F.lit("_"), "safe_name", F.lit("_"), F.col("call_id").cast("string"), F.lit(".json"))
    write_files(calls.where("raw IS NOT NULL").select(name.alias("name"), F.col("raw").alias("content")), path)


def save_run(rows: DataFrame, path: str, run_id: str) -> DataFrame:
    """Store the rows of one run in a folder of its own below ``path`` and read them again.

    Other runs are neither listed nor overwritten, and a run without rows can be read too.
    """
    own = f"{path}/run_id={run_id}"
    rows.drop("run_id").write.mode("overwrite").parquet(own)  # what an attempt that failed has left goes
    return rows.sparkSession.read.parquet(own).withColumn("run_id", F.lit(run_id))


def stored_run(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """The rows that ``save_run`` stored, or None unless they are there in full."""
    own = f"{path}/run_id={run_id}"
    if not Shared(own).has("_SUCCESS"):
        return None
    return spark.read.parquet(own).withColumn("run_id", F.lit(run_id))


def save_responses(raw: DataFrame, path: str, run_id: str) -> DataFrame:
    """Raw responses of a run; name and chunk are part of the row, so nothing is overwritten."""
    return save_run(raw.withColumn("safe_name", safe_name(F.col("file"))), path, run_id)


def _span(start: int, count: int) -> str:
    """Lines of a hunk, counted from 1; none lie after the line before."""
    return f"{start + 1}" if count == 1 else f"{start + (count > 0)},{count}"


def make_patch(file: str, content: str | None, line: int | None, fix: str | None, skipped: int = 0) -> dict:
    """Replace one line by a fix with that line's indent, as a unified diff with three lines around it.

    Lines end with a line feed only. Of each line of the fix the white space in front gives way to the indent. ``content`` may be
    a part of a file that holds these lines: then ``line`` counts from its beginning, before which are ``skipped`` lines.
    """
    failed = {"ok": False, "diff": None, "before": None, "after": None}
    if content is None:
        return {**failed, "error": "file not found"}
    lines = re.findall(r"[^\n]*\n|[^\n]+", content)
    if line is None or not 1 <= line <= len(lines):
        return {**failed, "error": "line out of range"}
    if not (fix or "").strip():
        return {**failed, "error": "no fix"}
    old = lines[line - 1]
    indent = " " * (len(old) - len(old.lstrip()))
    new = [f"{indent}{x.lstrip()}\n" for x in fix.strip().split("\n")]
    diff = ""
    if new != [old]:
        # The old line may stay among the new ones: then there are only insertions around it.
        at = new.index(old) if old in new else None
        first = line - (at is None or at > 0)
        last = line - (at is not None and at == len(new) - 1)
        low, high = max(0, first - 3), min(len(lines), last + 3)
        middle = [f"-{old}", *(f"+{x}" for x in new)] if at is None else [*(f"+{x}" for x in new[:at]), f" {old}", *(f"+{x}" for x in new[at + 1 :])]
        body = [*(f" {x}" for x in lines[low : line - 1]), *middle, *(f" {x}" for x in lines[line:high])]
        head = f"--- a/{file}\n+++ b/{file}\n@@ -{_span(low + skipped, high - low)} +{_span(low + skipped, high - low + len(new) - 1)} @@\n"
        diff = head + "".join(x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n" for x in body)
    return {"ok": True, "diff": diff, "before": old.removesuffix("\n"), "after": "".join(new).removesuffix("\n"), "error": None}


@F.pandas_udf(PATCH)
def _patch(file: pd.Series, near: pd.Series, line: pd.Series, fix: pd.Series, skipped: pd.Series) -> pd.DataFrame:
    rows = [make_patch(f, c, None if pd.isna(n) else int(n), x, int(k)) for f, c, n, x, k in zip(file, near, line, fix, skipped)]
    return pd.DataFrame(rows, columns=["ok", "diff", "before", "after", "error"])


def patch(file: str, content: str, line: Column | str, fix: str) -> Column:
    """``make_patch`` of columns. Python gets the line and three lines on either side of it, not the whole content."""
    content, line = F.col(content), (F.col(line) if isinstance(line, str) else line).cast("long")
    # What lies behind the lines around is not cut: four further ones tell whether the last of them is whole.
    head = F.call_function("substring_index", content, F.lit("\n"), (F.greatest(F.lit(1), F.least(line, F.lit(1 << 30))) + 4).cast("int"))
    lines = F.split(head, "\n", -1)
    n = F.size(lines) - F.when(head.endswith("\n") | (head == ""), 1).otherwise(0)
    here = F.greatest(F.lit(1), F.least(line, n.cast("long"))).cast("int")
    first, last = F.greatest(F.lit(1), here - 3), F.least(n, here + 3)
    near = F.concat(F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n"), F.when(last < F.size(lines), "\n").otherwise(""))
    inside = line.isNotNull() & (line >= 1) & (line <= n)
    own = F.when(content.isNotNull(), F.when(inside, near).otherwise(""))
    skipped = F.when(inside, first - 1).otherwise(0)
    return _patch(F.col(file), own, F.when(inside, line - skipped).otherwise(line), F.col(fix), skipped)


def write_patches(patched: DataFrame, path: str) -> None:
    """Each usable patch as ``patch_<id>.patch`` below ``path``, all or none; ``patched`` has (id, ok, diff)."""
    name = F.concat(F.lit("patch_"), F.col("id").cast("string"), F.lit(".patch"))
    write_files(patched.where("ok").select(name.alias("name"), F.col("diff").alias("content")), path)


def first_named(files: DataFrame, names: DataFrame) -> DataFrame:
    """(file, path) for each name in ``names`` (column file): the first path with it."""
    return files.select("file", "path").join(names, "file", "left_semi").groupBy("file").agg(F.min("path").alias("path"))


def with_content(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` with the content of its file, looked up by path, else by name: then the first path with it.

    Paths are settled first, without contents. Contents are then cut down to those paths before they meet the
    findings, so few findings over a large tree move few contents.
    """
    asked = found.select("filepath", "file").distinct()
    paths = files.select(F.col("path").alias("filepath"))
    known = paths.join(asked, "filepath", "left_semi").distinct()
    lost = asked.join(known, "filepath", "left_anti")
    named = lost.join(first_named(files, lost.select("file").distinct()), "file")
    place = asked.join(known, "filepath", "left_semi").select("filepath", "file", F.col("filepath").alias("path")).unionByName(named.select("filepath", "file", "path"))
    texts = files.select("path", "content").join(place.select("path").distinct(), "path", "left_semi")
    path, file = fresh(found.columns, "_path", "_file")
    of = place.join(texts, "path").select(F.col("filepath").alias(path), F.col("file").alias(file), "content")
    same = F.col("filepath").eqNullSafe(F.col(path)) & F.col("file").eqNullSafe(F.col(file))
    return found.join(of, same, "left").select(*found.columns, "content")


def patches(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` with ``patch``."""
    made = with_content(found, files).withColumn("patch", patch("file", "content", F.col("line").cast("long"), "fix"))
    return made.select(*found.columns, "patch")

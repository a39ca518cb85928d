"""Incremental use: responses that arrive as files become findings and running counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from findmill.functions.text import severity
from findmill.operators.calls import ANSWER
from findmill.operators.findings import findings, select_findings, with_snippets
from findmill.operators.rollup import score, severity_counts
from findmill.sources.shared import Shared
from findmill.sources.tree import TreeChanges, source_tree


def response_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(filepath, raw) of saved responses as they arrive."""
    return (
        spark.readStream.format("text").option("wholetext", True).load(folder)
        .select(F.regexp_extract(F.col("_metadata.file_name"), r"^(?:\d{8}_)?\d{6}_(.+)\.json$", 1).alias("filepath"), F.col("value").alias("raw"))
    )


def publish_findings(raw: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Findings of each micro-batch, as Parquet at ``path``, by the same steps as in batch use.

    A batch is written under its own number, so one that is repeated after a failure replaces itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        findings(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then:
            then(batch.sparkSession.read.parquet(f"{path}/batch={number}"), number)

    return raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_stream(prompts: DataFrame, folder: str) -> DataFrame:
    """(filepath, file, chunk_idx, n_chunks, status, raw) of a scan's answers as its tasks put them down.

    ``prompts`` is the scan's stored table, ``folder`` that of its answers. A call that two attempts answered comes twice.
    """
    calls = prompts.select("call_id", "filepath", "file", "chunk_idx", "n_chunks")
    answered = prompts.sparkSession.readStream.schema(ANSWER).parquet(f"{folder}/slot=*")
    return answered.join(calls, "call_id").select("filepath", "file", "chunk_idx", "n_chunks", "status", "raw")


class _WholeFiles(StatefulProcessor):
    """Keeps the answers of a file until there is one for each chunk, then gives them out once, in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "chunk_idx int", "status string, raw string")
        self.state = handle.getValueState("state", "waiting int, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = self.state.get() if self.state.exists() else (0, False)
        waiting, done = have[0], have[1]
        n_chunks = None
        for batch in rows:
            if done:
                continue
            for chunk_idx, n, status, raw in zip(batch["chunk_idx"], batch["n_chunks"], batch["status"], batch["raw"]):
                n_chunks = int(n)
                if not self.chunks.containsKey((int(chunk_idx),)):
                    self.chunks.updateValue((int(chunk_idx),), (status, raw))
                    waiting += 1
        if not done and n_chunks is not None and waiting == n_chunks:
            found = sorted((k[0], v[0], v[1]) for k, v in self.chunks.iterator())
            self.chunks.clear()
            self.state.update((0, True))
            yield pd.DataFrame({"filepath": key[0], "chunk_idx": [x[0] for x in found], "status": [x[1] for x in found], "raw": [x[2] for x in found]})
        elif not done:
            self.state.update((waiting, False))

    def close(self) -> None:
        pass


def whole_files(answered: DataFrame) -> DataFrame:
    """(filepath, chunk_idx, status, raw) of files whose chunks are all answered; each file once, whatever comes again.

    State is kept by file: the answers of files that are not whole yet, and one mark for each that was given out.
    """
    answered.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return answered.groupBy("filepath").transformWithStateInPandas(
        _WholeFiles(), "filepath string, chunk_idx int, status string, raw string", "append", "none"
    )


def publish_by_file(answered: DataFrame, files: DataFrame, mode: str, path: str, checkpoint: str, live: bool = False) -> StreamingQuery:
    """The findings of each file as soon as its last chunk is answered, as Parquet below ``path``.

    The steps are those of a scan: severities, confidence, the best of each response, lines around. With ``live`` the query goes on with the scan,
    else it takes what is there and ends. A batch that a failure cut short is written again under its number, and what was published
    before a restart is not published again.
    """

    def one(batch: DataFrame, number: int) -> None:
        raw = batch.where("status = 'ok'").select("filepath", "chunk_idx", "raw")
        best = with_snippets(select_findings(findings(raw), mode), files)
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = whole_files(answered).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="1 second") if live else writer.trigger(availableNow=True)).start()


def running_counts(rows: DataFrame, severity_text: str) -> DataFrame:
    """Severity counts and score so far, for output mode 'complete'."""
    counted = rows.groupBy().agg(*severity_counts(severity(F.col(severity_text))))
    return counted.withColumn("score", score(F.col("critical"), F.col("high")))


def status(query: StreamingQuery) -> dict:
    return {"active": query.isActive, "progress": query.lastProgress}


MOST_UNKNOWN = 1000


def _above(rows: DataFrame, root: str) -> DataFrame:
    """(path, folder, child): each folder above a path up to ``root``, with the name in it that leads to the path."""
    inner = F.split(F.substring("path", len(root) + 2, 1 << 30), "/")
    place = F.posexplode("_parts").alias("_at", "child")
    folder = F.concat_ws("/", F.lit(root), F.slice("_parts", F.lit(1), F.col("_at")))
    return rows.select("path", inner.alias("_parts")).select("path", "_parts", place).select("path", folder.alias("folder"), "child")


def follow_tree(spark: SparkSession, folder: str, path: str, checkpoint: str, suffixes: tuple[str, ...] = (), settle_seconds: float = 1.0) -> StreamingQuery:
    """Bring the copy of a source tree at ``path`` up to date, and end: only what changed is read.

    Each batch stores the contents of changed files, and an index of all files with the batch that holds theirs. What a listed
    folder no longer names is gone, with all below. What it names and nobody knows (moved here, with older
    times) is read by path. ``current_tree`` reads the copy.
    """
    root = folder.rstrip("/")
    spark.dataSource.register(TreeChanges)

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        own = f"{path}/contents/batch={number}"
        batch.write.mode("overwrite").parquet(f"{own}/part=changed")
        changed = session.read.parquet(f"{own}/part=changed")
        files = changed.where("kind = 'file'").select("path")
        listed = changed.where("kind = 'folder'").select(F.col("path").alias("folder"), "names")
        before = _newest_index(session, path, number)
        old = session.createDataFrame([], "path string, batch long") if before is None else before
        gone = _above(old, root).join(listed, "folder").where(~F.array_contains("names", F.col("child"))).select("path").distinct()
        kept = old.join(gone, "path", "left_anti").join(files, "path", "left_anti")
        paths = kept.select("path").union(files)
        known = paths.union(_above(paths, root).select(F.col("folder").alias("path"))).union(listed.select(F.col("folder").alias("path"))).distinct()
        named = listed.select("folder", F.explode("names").alias("child")).select(F.concat_ws("/", "folder", "child").alias("path"))
        unknown = [r.path for r in named.join(known, "path", "left_anti").limit(MOST_UNKNOWN + 1).collect()]
        more = source_tree(session, root, suffixes)
        if len(unknown) <= MOST_UNKNOWN:  # else all is read again, and the index takes what it lacks
            below = [(F.col("path") == x) | F.col("path").startswith(f"{x}/") for x in unknown]
            more = more.where(reduce(Column.__or__, below, F.lit(False)))
        lacking = more.join(paths, "path", "left_anti").select(F.lit("file").alias("kind"), "path", "file", "ext", "content", F.lit(None).cast("array<string>").alias("names"))
        lacking.write.mode("overwrite").parquet(f"{own}/part=unknown")
        new = files.union(session.read.schema(changed.schema).parquet(f"{own}/part=unknown").select("path")).withColumn("batch", F.lit(number).cast("long"))
        kept.union(new).write.mode("overwrite").parquet(f"{path}/index/version={number:010}")

    stream = spark.readStream.format("treechanges").option("suffixes", ",".join(suffixes)).option("settleSeconds", settle_seconds).load(root)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest_index(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """(path, batch) of all files by the newest whole index, of those before a batch if one is given."""
    shared = Shared(f"{path}/index")
    names = [x for x in shared.names() if shared.has(f"{x}/_SUCCESS") and (below is None or int(x.split("=")[1]) < below)]
    return spark.read.parquet(f"{path}/index/{names[-1]}") if names else None


def current_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, ext, content) of the copy that ``follow_tree`` keeps at ``path``."""
    index = _newest_index(spark, path)
    if index is None:
        return spark.createDataFrame([], "path string, file string, ext string, content string")
    rows = spark.read.option("basePath", f"{path}/contents").parquet(f"{path}/contents/batch=*").where("kind = 'file'")
    return index.join(rows.withColumn("batch", F.col("batch").cast("long")), ["path", "batch"]).select("path", "file", "ext", "content")

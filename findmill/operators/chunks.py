"""Chunks of file contents, prompts, and context lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill.functions.rules import CHUNK_OVERLAP
from findmill.functions.text import has_text

BLOCK_LINES = 64


def cut_chunks(content: Column, size: int, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of ``size`` characters, each beginning ``size`` - ``overlap`` after the one before.

    The content is cut once, into stretches of that step, and a chunk is the beginning of those that follow
    each other: the work grows with the content, while a substring counts its characters from the start.
    """
    step = size - overlap
    parts = F.regexp_extract_all(content, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    wide = -(-size // step)
    joined = F.transform(F.array(parts), lambda p: F.transform(p, lambda _, i: F.substring(F.array_join(F.slice(p, i + 1, F.lit(wide)), ""), F.lit(1), F.lit(size))))
    return joined[0]


def chunks(files: DataFrame, size: int, whole_file: bool = False, content_col: str = "content") -> DataFrame:
    """``files`` with chunk_idx, n_chunks and chunk instead of the content; blank files have no chunk.

    Chunks of ``size`` characters overlap by ``CHUNK_OVERLAP``. With ``whole_file`` a content shorter
    than ``size`` is one chunk.
    """
    content = F.col(content_col)
    cut = cut_chunks(content, size)
    if whole_file:
        cut = F.when(F.length(content) < size, F.array(content)).otherwise(cut)
    kept = [c for c in files.columns if c != content_col]
    return (
        files.where(has_text(content))
        .withColumn("_parts", cut)
        .select(*kept, F.size("_parts").alias("n_chunks"), F.posexplode("_parts").alias("chunk_idx", "chunk"))
    )


def prompts(chunked: DataFrame, template: tuple[str, str, str], extra: str = "") -> DataFrame:
    """``prompt`` from a template of three texts around file name and chunk; one pass, nothing is replaced."""
    before, between, after = template
    return chunked.withColumn(
        "prompt", F.concat(F.lit(before), F.col("file"), F.lit(between), F.col("chunk"), F.lit(f"{after}\n{extra}"))
    )


def lines_of(content: Column) -> Column:
    """The lines as reading the file line by line gives them: a line feed at the end begins no further one."""
    return F.split(F.when(content.endswith("\n"), F.substring(content, F.lit(1), F.length(content) - 1)).otherwise(content), "\n")


def numbered(lines: Column, first: Column, line: Column, around: int = 5) -> Column:
    """The lines around ``line``, numbered, itself marked; ``first`` is the number of the array's first line."""
    low = F.greatest(F.lit(1), line - around)
    shown = F.slice(lines, (low - first + 1).cast("int"), F.greatest(F.lit(0), line + around - low + 1).cast("int"))
    marked = F.transform(shown, lambda x, i: F.concat(F.when(low + i == line, ">> ").otherwise("   "), (low + i).cast("string"), F.lit(": "), x))
    return F.array_join(marked, "\n")


def context(content: Column, line: Column, around: int = 5) -> Column:
    """Numbered lines around ``line``, which is marked; '' beyond the end; null without a line."""
    return F.when(line.isNotNull(), numbered(lines_of(content), F.lit(1), line, around))


def block_of(line: Column) -> Column:
    """The block of ``line_blocks`` that shows the surroundings of a line."""
    return F.floor((line - 1) / BLOCK_LINES)


def line_blocks(files: DataFrame, around: int = 5, content_col: str = "content") -> DataFrame:
    """``files`` with block, first and lines instead of the content: the index for joins on lines.

    A block is ``BLOCK_LINES`` lines and ``around`` more on either side, so all that surrounds a line is in one block: the band
    predicate "within ``around`` lines" becomes equality of (file, block). A content is split once, whatever
    number of lines is asked for.
    """
    kept = [c for c in files.columns if c != content_col]

    def cut(lines: Column) -> Column:
        # A line just beyond the end still has lines around it.
        starts = F.sequence(F.lit(0), F.size(lines) - 1 + around, F.lit(BLOCK_LINES))
        return F.transform(starts, lambda at: F.struct(
            F.greatest(at - around, F.lit(0)).alias("before"),
            F.slice(lines, F.greatest(at - around, F.lit(0)) + 1, at + BLOCK_LINES + around - F.greatest(at - around, F.lit(0))).alias("lines"),
        ))

    # The array of one holds the lines, so they are split once for all blocks.
    blocks = F.transform(F.array(lines_of(F.col(content_col))), cut)[0]
    rows = files.where(F.col(content_col).isNotNull()).select(*kept, F.posexplode(blocks).alias("block", "_block"))
    return rows.select(*kept, F.col("block").cast("long").alias("block"), (F.col("_block.before") + 1).alias("first"), F.col("_block.lines").alias("lines"))

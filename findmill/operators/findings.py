"""From raw model responses to typed findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findmill.functions.recover import recovered_json, truthy
from findmill.functions.rules import DEFAULTS, MIN_CONFIDENCE, NO_CONTEXT, mode_of
from findmill.functions.text import basename, blocked_terms, clamp_round, contains_any, digits, extension, fresh, severity
from findmill.operators.chunks import block_of, line_blocks, numbered
from findmill.sources.store import written

REQUIRED = ("title", "severity", "line", "description", "fix")


def objects(raw: DataFrame, raw_col: str = "raw", unwrap: str | None = None) -> DataFrame:
    """One row for each JSON object of a response: ``obj`` (variant), ``response_pos``, ``line_text``.

    An object is a list of one. Responses that don't parse, other values, and elements that aren't
    objects give no row. ``line_text`` is the line as it is written, as a variant would rewrite 10.0.
    With ``unwrap``, an object that has a list under that name stands for the list.
    """
    # A generator keeps the recovery in one place; a plain column would be copied into every later use.
    text = recovered_json(F.col(raw_col))
    if unwrap:
        inner = F.get_json_object(text, f"$.{unwrap}")
        text = F.when(inner.startswith("["), inner).otherwise(text)
    found = F.filter(F.array(text), lambda x: x.isNotNull())
    parsed = raw.select("*", F.explode(found).alias("_json"))
    value = F.parse_json("_json")
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    listed = parsed.select("*", is_list.alias("_list"), F.when(is_list, value.cast("array<variant>")).otherwise(F.array(value)).alias("_objs"))
    rows = listed.select(*listed.columns, F.posexplode("_objs").alias("response_pos", "obj")).drop("_objs")
    path = F.when(F.col("_list"), F.concat(F.lit("$["), F.col("response_pos"), F.lit("].line"))).otherwise("$.line")
    kept = rows.where(F.schema_of_variant("obj").startswith("OBJECT"))
    return kept.withColumn("line_text", F.call_function("get_json_object", F.col("_json"), path)).drop("_json", "_list")


def confidence(description: Column, complete: Column, line_text: Column, number: Column, blocked: Column) -> Column:
    """0 to 100: soft wording, completeness (a share), an unclear line, the model's own number, implausible types."""
    score = F.lit(100.0) - F.when(contains_any(description), 15.0).otherwise(0.0)
    score = score * (F.lit(0.7) + 0.3 * complete)
    clear = F.coalesce(line_text.rlike("^[0-9]+$") & (line_text != "0"), F.lit(False))
    score = score - F.when(clear, 0.0).otherwise(10.0)
    score = F.when(number.isNotNull(), (score + number) / 2).otherwise(score)
    return clamp_round(score - 30.0 * blocked)


def _number(value: Column) -> Column:
    """A JSON number or boolean as a double; null for anything else, strings of digits included."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), value.try_cast("double"))
        .when(kind == "BOOLEAN", value.try_cast("boolean").cast("double"))
    )


def findings(raw: DataFrame, path_col: str = "filepath", unwrap: str | None = None) -> DataFrame:
    """Typed findings of raw responses (columns ``path_col``, raw, and any others, which stay).

    Absent and null fields get defaults; ``degraded`` marks rows where a null stood for a text. An
    unknown severity is Low; a line of zero or without digits is null.
    """
    rows = objects(raw, unwrap=unwrap)
    obj = F.col("obj")

    def field(name: str, kind: str = "string") -> Column:
        return F.try_variant_get(obj, f"$.{name}", kind)

    def text(name: str) -> Column:
        return F.coalesce(field(name), F.lit(DEFAULTS[name]))

    reason = F.try_variant_get(obj, "$.reasoning", "variant")

    def why(name: str, kind: str = "string") -> Column:
        return F.try_variant_get(reason, f"$.{name}", kind)

    file = basename(F.col(path_col))
    complete = sum((truthy(field(x, "variant")).cast("int") for x in REQUIRED), F.lit(0)) / F.lit(5.0)
    given = F.coalesce(field("description"), F.lit(""))
    score = confidence(
        given, complete, F.col("line_text"), _number(field("confidence", "variant")),
        blocked_terms(extension(file), field("type"), field("title")),
    )
    sev = severity(field("severity"))
    none = F.array().cast("array<string>")
    made = {
        "file": file, "title": text("title"), "severity": sev, "line": digits(F.col("line_text")),
        "description": text("description"), "fix": text("fix"), "confidence": score,
        "snippet": F.coalesce(F.nullif(field("snippet"), F.lit("")), F.lit(DEFAULTS["snippet"])), "type": text("type"),
        "cve_reference": field("cve_reference"), "cwe_id": field("cwe_id"),
        "reasoning": F.struct(
            F.coalesce(why("pattern"), F.lit(DEFAULTS["pattern"])).alias("pattern"),
            F.coalesce(why("cve_refs", "array<string>"), none).alias("cve_refs"),
            F.coalesce(why("cwe_refs", "array<string>"), none).alias("cwe_refs"),
            *(F.coalesce(why(x), F.lit(DEFAULTS[x])).alias(x) for x in ("exploit_example", "business_impact", "attack_vector")),
            F.coalesce(why("mitigation_priority"), sev).alias("mitigation_priority"),
        ),
        "degraded": sum((F.coalesce((F.schema_of_variant(field(x, "variant")) == "VOID").cast("int"), F.lit(0)) for x in ("title", "description", "type")), F.lit(0)) > 0,
    }
    kept = [c for c in rows.columns if c not in (*made, "obj", "raw", "line_text")]
    return rows.select(*kept, *(c.alias(n) for n, c in made.items()))


def drop_non_findings(found: DataFrame) -> DataFrame:
    """Opt-in: without answers that name neither a title nor a description of a defect."""
    return found.where((F.col("title") != DEFAULTS["title"]) | (F.col("description") != DEFAULTS["description"]))


def drop_overlap_repeats(found: DataFrame) -> DataFrame:
    """Opt-in: a finding that overlapping chunks report twice (file, line and title alike) counts once."""
    return found.dropDuplicates(["filepath", "line", "title"])


def with_snippets(found: DataFrame, files: DataFrame) -> DataFrame:
    """Findings without a snippet of the model's own get the lines around theirs, or say why there are none.

    Findings meet blocks of lines by (file, block), and whether a file is there is told of what is asked for, before any lines
    are: so contents are dealt once, as blocks, and no finding carries lines from one task to another. Only blocks that are
    asked for meet the findings, and a file with very many findings spreads over its blocks. The work grows with the
    files' lines plus the findings.
    """
    line, needs = F.col("line"), F.col("snippet") == DEFAULTS["snippet"]
    block, first, lines, there = fresh(found.columns, "_block", "_first", "_lines", "_there")
    path, place = F.col("path").alias("filepath"), ["filepath", block]
    asked = found.where(needs & line.isNotNull()).select("filepath", block_of(line).alias(block)).distinct()
    known = asked.join(files.select(path), "filepath", "left_semi").select(*place, F.lit(True).alias(there))
    # Files that nothing asks for are cut as well: to drop them first would deal whole contents by file, then the blocks.
    cut = line_blocks(files.select(path, "content")).select("filepath", F.col("block").alias(block), F.col("first").alias(first), F.col("lines").alias(lines))
    both = found.withColumn(block, F.when(needs, block_of(line))).join(known, place, "left").join(cut.join(asked, place, "left_semi"), place, "left")
    around = (
        F.when(line.isNull(), F.lit(DEFAULTS["snippet"]))
        .when(F.col(there).isNull(), F.concat(F.lit(NO_CONTEXT), F.coalesce("filepath", F.lit(""))))
        .otherwise(F.coalesce(F.nullif(numbered(F.col(lines), F.col(first), line), F.lit("")), F.lit(DEFAULTS["snippet"])))
    )
    return both.withColumn("snippet", F.when(needs, around).otherwise(F.col("snippet"))).select(*found.columns)


def by_severity(found: DataFrame, mode: str) -> DataFrame:
    """The severities that a mode looks at."""
    return found.where(F.col("severity").isin(*mode_of(mode).severities))


def by_confidence(found: DataFrame, confidence_col: str = "confidence") -> DataFrame:
    return found.where(F.col(confidence_col) >= MIN_CONFIDENCE)


def best_of(found: DataFrame, group: tuple[str, ...], k: int, order: tuple, rank_col: str = "response_rank") -> DataFrame:
    """The first ``k`` rows of each group in an order, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return found.withColumn(rank_col, rank).where(F.col(rank_col) <= k)


def select_findings(found: DataFrame, mode: str, group: tuple[str, ...] = ("filepath", "chunk_idx")) -> DataFrame:
    """The mode's severities, then enough confidence, then the best few of each response (stable on ties)."""
    kept = by_confidence(by_severity(found, mode))
    return best_of(kept, group, mode_of(mode).per_response, (F.desc("confidence"), "response_pos"))


def assign_ids(found: DataFrame, run: tuple[str, ...] = ("run_id",), order: tuple[str, ...] = ("filepath", "chunk_idx", "response_rank")) -> DataFrame:
    """Dense ids from 1 within a run; a null run is a run too.

    Rows are dealt by ranges of run and order, sorted in their range and written, so their places stay.
    The rows of each run in each range are counted, and those counts, no more than runs and ranges
    together, are summed in order: neither a large run nor a large file has to be sorted in one task.
    """
    keys = [*run, *order]
    dealt = written(
        found.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranges"
    ).withColumn("_range", F.shiftright("_at", 33))
    counts = dealt.groupBy(*run, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*run).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shift = F.coalesce(before, F.lit(0)) - F.col("_first") + 1
    shifts = counts.select(*(F.col(c).alias(f"_run_{c}") for c in run), F.col("_range").alias("_run_range"), shift.alias("_shift"))
    same = F.col("_range") == F.col("_run_range")
    for c in run:
        same &= F.col(c).eqNullSafe(F.col(f"_run_{c}"))
    return dealt.join(shifts, same).select(*found.columns, (F.col("_at") + F.col("_shift")).alias("id"))

"""Column functions over names, texts and numbers. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from findmill.functions.rules import IMPLAUSIBLE, SOFT_TERMS


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores behind them as it takes to clash with no column of ``taken``."""
    known = {c.lower() for c in taken}
    made = []
    for name in names:
        while name.lower() in known:
            name += "_"
        made.append(name)
    return made


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """After the last dot; leading dots don't count, so .env and Dockerfile have none. Case stays."""
    return F.regexp_extract(name, r"^\.*[^.].*\.([^.]*)$", 1)


def severity(text: Column) -> Column:
    """Critical, High, Medium or Low by the first stem that occurs; null and anything else is Low."""
    low = F.lower(text)
    return (
        F.when(low.contains("crit"), "Critical").when(low.contains("high"), "High")
        .when(low.contains("med"), "Medium").otherwise("Low")
    )


def severity_rank(name: Column) -> Column:
    return reduce(lambda c, x: c.when(name == x[0], x[1]), (("High", 3), ("Medium", 2), ("Low", 1)), F.when(name == "Critical", 4)).otherwise(0)


def digits(text: Column) -> Column:
    """All ASCII digits joined, as a number; null for none and for zero."""
    number = F.regexp_replace(text, r"[^0-9]", "").try_cast("bigint")
    return F.when(number != 0, number)


def contains_any(text: Column, terms: tuple[str, ...] = SOFT_TERMS) -> Column:
    # The array holds the lowered text once; as a plain column it would be made again for every term.
    found = F.exists(F.array(F.lower(text)), lambda low: reduce(Column.__or__, [low.contains(t) for t in terms]))
    return F.coalesce(found, F.lit(False))


def blocked_terms(ext: Column, kind: Column, title: Column) -> Column:
    """How many terms that are implausible for the extension occur in the type or the title."""
    table = F.create_map(*(F.lit(x) for k, v in IMPLAUSIBLE.items() for x in (k, "|".join(v).upper())))
    terms = F.split(F.element_at(table, ext), r"\|")
    up, down = F.upper(F.coalesce(kind, F.lit(""))), F.upper(F.coalesce(title, F.lit("")))
    return F.coalesce(F.size(F.filter(terms, lambda t: up.contains(t) | down.contains(t))), F.lit(0))


def clamp_round(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_.-]", "_")


def or_else(text: Column, other: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(other))


def joined(refs: Column) -> Column:
    """References as one text; '' for none."""
    return F.coalesce(F.array_join(refs, ", "), F.lit(""))


def file_stamp(ts: Column) -> Column:
    """For names of files."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def clock(ts: Column) -> Column:
    """For log lines."""
    return F.date_format(ts, "HH:mm:ss")


def iso(ts: Column) -> Column:
    """For findings and the history; as text it sorts by time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def shown_time(ts: Column) -> Column:
    """For reports."""
    return F.date_format(ts, "dd/MM/yyyy HH:mm")


def timeout_seconds(base: int, prompt: Column) -> Column:
    return F.lit(base) + 10 * F.floor(F.length(prompt) / 10000).cast("int")


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def alert(sev: Column) -> Column:
    """Whether a finding is worth an alert of its own."""
    return F.coalesce(sev.isin("Critical", "High"), F.lit(False))


def report_colour(sev: Column) -> Column:
    return F.when(sev == "Critical", "red").when(sev == "High", "orange").otherwise("blue")


def confidence_colour(confidence: Column, middle: str = "orange") -> Column:
    return F.when(confidence >= 70, "green").when(confidence >= 40, middle).otherwise("red")


def fix_time(sev: Column) -> Column:
    from findmill.functions.rules import FIX_TIMES

    table = F.create_map(*(F.lit(x) for pair in FIX_TIMES.items() for x in pair))
    return F.coalesce(F.element_at(table, sev), F.lit("N/A"))


def impact(sev: Column, kind: Column) -> Column:
    low = F.lower(F.coalesce(kind, F.lit("")))
    critical = (
        F.when(low.contains("rce"), "production compromise").when(low.contains("sql"), "data breach").otherwise("high risk")
    )
    return F.when(sev == "Critical", critical).when(sev == "High", "compromised").when(sev == "Medium", "moderate").otherwise("improvement")


def html_escape(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text

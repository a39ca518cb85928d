"""Chat formatting with minimum-cost role repair.

A legal conversation may open with a system turn; then user and assistant alternate and the assistant has
the last word. An automaton over the last role says which turn may follow. For a conversation that breaks
the rules, dynamic programming finds the cheapest edits: merge a turn into the one before it, relabel it,
or insert empty turns. The repaired sequence is then rendered with turn markers.

A long conversation is never gathered. All turns are sorted over range partitions, and each conversation's
share of a partition is cut into segments of ``SEGMENT`` rows. Each segment gives one small matrix: the
cheapest cost from every state before it to every state after it. The matrices of a conversation, a few numbers for each segment, give the state at
each cut, and then each segment is repaired and rendered by itself between its two states. The pieces of
a conversation, in order, are its rendered text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import arrow_map, read_table, written

SEGMENT = 1024
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Which role may follow each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = 1 << 40
#: Other names of the roles.
ALIASES = {
    "system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "customer": USER,
    "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT, "agent": ASSISTANT,
}


def role_of(name: str | None) -> int:
    """The role of a name in any case; START for one that is null or unknown (relabelled whatever it becomes)."""
    return ALIASES.get((name or "").strip().lower(), START)


def _moves() -> dict[tuple[int, int], list[tuple[int, int, tuple]]]:
    """For (state, role): (cost, state after, edit); an edit is (inserted roles, role of the turn or 0 for a merge)."""
    found: dict = {}
    for state, role in product(range(4), repeat=2):
        options = []
        if state != START:
            options.append((MERGE + RELABEL * (state != role), state, ((), 0)))
        for target in (SYSTEM, USER, ASSISTANT):
            relabel = RELABEL * (target != role)
            if target in NEXT[state]:
                options.append((relabel, target, ((), target)))
            for a in NEXT[state]:
                if target in NEXT[a]:
                    options.append((relabel + INSERT, target, ((a,), target)))
                for b in NEXT[a]:
                    if target in NEXT[b]:
                        options.append((relabel + 2 * INSERT, target, ((a, b), target)))
        found[state, role] = options
    return found


MOVES = _moves()
#: What closes a conversation that ends in each state: cost and inserted roles.
CLOSE = {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}


def step_costs(costs: list[int], role: int) -> list[int]:
    out = [FAR] * 4
    for state, cost in enumerate(costs):
        if cost < FAR:
            for more, after, _ in MOVES[state, role]:
                out[after] = min(out[after], cost + more)
    return out


def repair(roles: list[int], entry: int, leave: int) -> list[tuple]:
    """The cheapest edits that lead from one state to another; of equal ones the first in a fixed order."""
    tables = [[0 if s == entry else FAR for s in range(4)]]
    for role in roles:
        tables.append(step_costs(tables[-1], role))
    edits, state = [], leave
    for i in range(len(roles) - 1, -1, -1):
        cost = tables[i + 1][state]
        before, edit = next(
            (s, e) for s in range(4) for more, after, e in MOVES[s, roles[i]]
            if after == state and tables[i][s] < FAR and tables[i][s] + more == cost
        )
        edits.append(edit)
        state = before
    return edits[::-1]


def _runs(batches: Iterator[pa.RecordBatch], key_columns: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal keys, over batch ends."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:key_columns] != key:
                if rows:
                    yield key, rows
                key, rows = row[:key_columns], []
            rows.append(row[key_columns:])
    if rows:
        yield key, rows


def segments(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(kind, conv, seg, turn, role, text, n, costs): turns (kind 1) and one matrix a segment (kind 0), null turns first.

    Exact repeats of a numbered turn of a known conversation are one turn, and ``n`` counts them. Turns
    without a number or a conversation all stay: a number of their own spreads even equal ones over the
    range partitions.
    """
    given = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    ).withColumn("own", F.when(F.col("conv").isNull() | F.col("turn").isNull(), F.monotonically_increasing_id()))
    kind = df.schema[conv_col].dataType.simpleString()
    order = ["conv", "turn", "role", "text", "own"]
    once = arrow_map(given.select(*order), f"conv {kind}, turn long, role string, text string, own long, n long", _once)
    return once.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _segments, f"kind int, conv {kind}, seg long, turn long, role string, text string, n long, costs array<long>"
    )


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Repeats that lie near each other are counted before the shuffle."""
    names = batch.schema.names
    rows = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([([], "count_all")])
    return rows.select([*names, "count_all"]).rename_columns([*names, "n"]).combine_chunks().to_batches()[0]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the segments of a sorted partition; a segment's rows come before its matrix."""
    seg = TaskContext.get().partitionId() << 32
    names = ["kind", "conv", "seg", "turn", "role", "text", "n", "costs"]
    rows: list[tuple] = []
    conv, costs, size, before = object(), None, 0, None
    conv_type = pa.null()

    def out() -> pa.RecordBatch:
        types = (pa.int32(), conv_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
        rows.clear()
        return made

    def turn_of(key: tuple, n: int) -> None:
        nonlocal conv, costs, size, seg
        if size == SEGMENT or size and key[0] != conv:
            rows.append((0, conv, seg, None, None, None, None, sum(costs, [])))
            seg, size = seg + 1, 0
        if not size:
            conv, costs = key[0], [[0 if a == b else FAR for b in range(4)] for a in range(4)]
        rows.append((1, conv, seg, *key[1:4], n, None))
        costs = [step_costs(row, role_of(key[2])) for row in costs]
        size += 1

    for batch in batches:
        conv_type = batch.column(0).type
        for *key, n in zip(*(c.to_pylist() for c in batch.columns)):
            if before is not None and key == before[0]:
                before[1] += n
                continue
            if before is not None:
                turn_of(*before)
            before = [key, n]
            if len(rows) >= SEGMENT:
                yield out()
    if before is not None:
        turn_of(*before)
        rows.append((0, conv, seg, None, None, None, None, sum(costs, [])))
        yield out()


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, seg, entry, leave, last) from the matrices of each conversation, in order of segments."""
    kind = pa.int64()
    for batch_key, rows in _runs(_typed(batches, kinds := []), 1):
        tables = [[0, FAR, FAR, FAR]]
        for _, costs in rows:
            tables.append([min(min(tables[-1][a] + costs[4 * a + b], FAR) for a in range(4)) for b in range(4)])
        state = min(range(4), key=lambda s: (tables[-1][s] + CLOSE[s][0], -s))
        out = []
        for i in range(len(rows) - 1, -1, -1):
            seg, costs = rows[i]
            entry = next(a for a in range(4) if tables[i][a] + costs[4 * a + state] == tables[i + 1][state])
            out.append((seg, entry, state, i == len(rows) - 1, i == 0))
            state = entry
        columns = [pa.array([batch_key[0]] * len(out), kinds[0])]
        columns += [pa.array(x, t) for x, t in zip(zip(*out), (kind, kind, kind, pa.bool_(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "seg", "entry", "leave", "last", "first"])


def _typed(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds[:] = [batch.column(0).type]
        yield batch


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "seg", "pos", "turn", "role", "action", "text", "rendered", "repeats"]
    for (conv, seg), rows in _runs(_typed(batches, kinds := []), 2):
        # The segment's states come first, then its turns.
        entry, leave, last, first = rows[0][5:]
        turns = [row[1:5] for row in rows[1:]]
        out: list[tuple] = []

        def add(turn: int | None, role: int, action: str, text: str, n: int = 0) -> None:
            opening = "" if first and not out else "<|end|>\n"
            out.append((turn, ROLES[role], action, text, f"{opening}<|{ROLES[role]}|>\n{text}", n))

        state = entry
        for (turn, name, text, n), (inserted, target) in zip(turns, repair([role_of(r[1]) for r in turns], entry, leave)):
            for role in inserted:
                add(None, role, "insert", "")
                state = role
            text = text or ""
            if target:
                add(turn, target, "keep" if role_of(name) == target else "relabel", text, n)
                state = target
            else:
                out.append((turn, ROLES[state], "merge", text, f"\n{text}" if text else "", n))
        if last:
            for role in CLOSE[leave][1]:
                add(None, role, "insert", "")
            *head, piece, n = out[-1]
            out[-1] = (*head, piece + "<|end|>\n", n)
        size = len(out)
        columns = [pa.array([conv] * size, kinds[0]), pa.array([seg] * size, pa.int64()), pa.array(range(size), pa.int64())]
        columns += [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), *[pa.string()] * 4, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names)


def repaired(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(``conv_col``, seg, pos, turn, role, action, text, rendered, repeats): the turns after repair, in order (seg, pos).

    ``action`` is keep, merge (into the turn before), relabel or insert. ``rendered`` pieces joined in
    order are the formatted conversation. Null roles and unknown ones are relabelled, null texts are
    empty, null turns come first, rows without a conversation id are one conversation. Turns with one
    number are ordered by role and text; an exact repeat of a numbered turn in a known conversation counts
    once, and ``repeats`` says how many rows it had (0: an inserted turn). All other rows stay. An empty
    table gives an empty result.
    """
    kind = df.schema[conv_col].dataType.simpleString()
    found = written(segments(df, conv_col, turn_col, role_col, text_col), "chat-segments")
    matrices = found.where("kind = 0").select("conv", "seg", "costs")
    states = "entry long, leave long, last boolean, first boolean"
    cuts = written(
        matrices.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_cuts, f"conv {kind}, seg long, {states}"),
        "chat-cuts",
    )
    # States and turns of a segment meet in one shuffle of the texts, without a join.
    both = cuts.withColumn("kind", F.lit(0)).unionByName(found.where("kind = 1").drop("costs"), allowMissingColumns=True)
    order = ["conv", "seg", "kind", "turn", "role", "text"]
    made = (
        both.select(*order, "n", "entry", "leave", "last", "first").repartition("conv", "seg").sortWithinPartitions(*order)
        .mapInArrow(_render, f"conv {kind}, seg long, pos long, turn long, role string, action string, text string, rendered string, repeats long")
    )
    return made.withColumnRenamed("conv", conv_col)


def op2_chat(spark, sf_dir: str) -> DataFrame:
    return repaired(read_table(spark, sf_dir, "conversations"))

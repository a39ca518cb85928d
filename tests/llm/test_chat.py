from itertools import product

import pytest

from findmill.llm import chat_repair as C

SF = "/root/testdata/sf0.001"
S, U, A = C.SYSTEM, C.USER, C.ASSISTANT


def legal(roles: list[int]) -> bool:
    state = C.START
    for role in roles:
        if role not in C.NEXT[state]:
            return False
        state = role
    return state in (C.START, A)


def brute_cost(roles: tuple[int, ...]) -> int:
    """Cheapest repair over all sequences of merges, relabels and insertions, by plain search."""
    best = {(0, C.START): 0}
    work = [(0, C.START)]
    answer = C.FAR
    while work:
        i, state = min(work, key=best.get)
        work.remove((i, state))
        cost = best[i, state]
        if i == len(roles) and state in (C.START, A):
            answer = min(answer, cost)
        after = [(i, role, C.INSERT) for role in C.NEXT[state]]
        if i < len(roles):
            after += [(i + 1, role, C.RELABEL * (role != roles[i])) for role in C.NEXT[state]]
            if state != C.START:
                after.append((i + 1, state, C.MERGE + C.RELABEL * (state != roles[i])))
        for j, role, more in after:
            if cost + more < best.get((j, role), C.FAR):
                best[j, role] = cost + more
                work.append((j, role))
    return answer


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_costs_equal_a_plain_search(n):
    for roles in product(range(4), repeat=n):
        costs = [0, C.FAR, C.FAR, C.FAR]
        for role in roles:
            costs = C.step_costs(costs, role)
        found = min(c + C.CLOSE[s][0] for s, c in enumerate(costs))
        assert found == brute_cost(roles), roles


def rendered(spark, rows, **kw) -> dict:
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, seg int")
    out: dict = {}
    for r in sorted(C.repaired(df).collect(), key=lambda r: (r.conv_id or -1, r.seg, r.pos)):
        out.setdefault(r.conv_id, []).append(r)
    return {k: ("".join(r.rendered for r in v), [r.action for r in v], v) for k, v in out.items()}


def test_repairs(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
        (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "assistant", "c"),
        (3, 0, "assistant", "first"), (4, 0, "user", "open"), (5, 0, None, "who"), (5, 1, "GPT", None),
        (None, None, "Human", "x"), (None, 4, "bot", "y"),
    ]
    found = rendered(spark, rows)
    assert found[1][0] == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert found[2][:2] == ("<|user|>\na\nb<|end|>\n<|assistant|>\nc<|end|>\n", ["keep", "merge", "keep"])
    assert found[3][:2] == ("<|user|>\n<|end|>\n<|assistant|>\nfirst<|end|>\n", ["insert", "keep"])
    assert found[4][:2] == ("<|user|>\nopen<|end|>\n<|assistant|>\n<|end|>\n", ["keep", "insert"])
    assert found[5][:2] == ("<|user|>\nwho<|end|>\n<|assistant|>\n<|end|>\n", ["relabel", "keep"])
    assert found[None][0] == "<|user|>\nx<|end|>\n<|assistant|>\ny<|end|>\n"


def test_long_conversations_cross_segments(spark):
    n = 3 * C.SEGMENT + 100
    roles = ["user" if i % 7 in (0, 1, 3) else "assistant" if i % 7 != 5 else "tool" for i in range(n)]
    found = rendered(spark, [(1, i, r, f"t{i}") for i, r in enumerate(roles)])
    made = [C.ROLES.index(r.role) for r in found[1][2] if r.action != "merge"]
    assert legal(made)
    assert [r.turn for r in found[1][2] if r.turn is not None] == list(range(n))
    cost = sum({"keep": 0, "merge": C.MERGE, "insert": C.INSERT, "relabel": C.RELABEL}[r.action] for r in found[1][2])
    cost += sum(C.RELABEL for r in found[1][2] if r.action == "merge" and C.role_of(roles[r.turn]) != C.ROLES.index(r.role))
    costs = [0, C.FAR, C.FAR, C.FAR]
    for role in roles:
        costs = C.step_costs(costs, C.role_of(role))
    assert cost == min(c + C.CLOSE[s][0] for s, c in enumerate(costs))


def test_repeated_turns_count_once_and_ties_are_ordered(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "c")]
    assert rendered(spark, rows)[1][0] == "<|user|>\na\nb<|end|>\n<|assistant|>\nc<|end|>\n"


def test_empty_table(spark):
    assert rendered(spark, []) == {}


def test_query_over_the_table(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    found: dict = {}
    for r in sorted(C.op2_chat(spark, SF).collect(), key=lambda r: (r.conv_id, r.seg, r.pos)):
        found.setdefault(r.conv_id, []).append(r)
    assert set(found) == {r.conv_id for r in turns.select("conv_id").distinct().collect()}
    kept = sum(r.turn is not None for rows in found.values() for r in rows)
    assert kept == turns.distinct().count()
    for rows in found.values():
        assert legal([C.ROLES.index(r.role) for r in rows if r.action != "merge"])
        assert "".join(r.rendered for r in rows).endswith("<|end|>\n")


def test_lost_turns_stay_and_repeats_are_counted(spark):
    rows = [(None, 1, "user", "yes")] * 3 + [(7, None, "user", "yes")] * 2 + [(8, 0, "user", "b")] * 4 + [(8, 1, "assistant", "c")]
    found = rendered(spark, rows)
    assert found[None][0].count("yes") == 3 and found[7][0].count("yes") == 2 and found[8][1] == ["keep", "keep"]
    assert [r.repeats for r in found[8][2]] == [4, 1] and sum(r.repeats for r in found[None][2]) == 3


def test_a_hot_group_is_cut_into_segments_over_tasks(spark):
    df = spark.range(6 * C.SEGMENT, numPartitions=5).selectExpr("cast(null as long) conv_id", "cast(null as long) turn", "'user' role", "'same' text")
    parts = C.segments(df, "conv_id", "turn", "role", "text").where("kind = 1").selectExpr("seg", "shiftright(seg, 32) part")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few here
    sizes = parts.groupBy("part", "seg").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in sizes) == 6 * C.SEGMENT and max(r["count"] for r in sizes) <= C.SEGMENT
    assert len({r.part for r in sizes}) > 1
    found = sorted(C.repaired(df).collect(), key=lambda r: (r.seg, r.pos))
    assert sum(r.repeats for r in found) == 6 * C.SEGMENT and legal([C.ROLES.index(r.role) for r in found if r.action != "merge"])

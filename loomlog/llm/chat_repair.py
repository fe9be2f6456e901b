"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

A legal conversation is an optional system turn, then user and assistant turns by turns, from a user turn to an assistant
turn. Dynamic programming over the automaton of what was written last decides, for each turn in order, whether it is
kept, relabelled or merged into the one before, and where empty turns are inserted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen, parallelism

#: What was written last: nothing, a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = (None, "system", "user", "assistant")
#: Costs. Merging a turn of another role costs its relabelling as well.
MERGE, MERGE_BLANK, INSERT, RELABEL, RELABEL_SYSTEM, RELABEL_UNKNOWN = 2, 1, 3, 5, 4, 1
#: Turns of one conversation that are solved in one go; longer ones are solved in chunks that fit together exactly.
CHUNK_TURNS = 100_000

_NEVER = 1 << 40


def role_number(role: str | None) -> int:
    """The state that a role writes; 0 for null and unknown ones. Case and white space around it don't matter."""
    role = (role or "").strip().lower()
    return NAMES.index(role) if role in NAMES[1:] else 0


def relabel_cost(role: int, other: int) -> int:
    return 0 if role == other else RELABEL_UNKNOWN if not role else RELABEL_SYSTEM if role == SYSTEM else RELABEL


def moves(role: int, blank: bool) -> list[list[tuple[int, int, str, tuple[str, ...]]]]:
    """By state before a turn: (state after, cost, action, roles inserted before it). Of equal costs the first one counts."""
    out: list[list] = [[] for _ in NAMES]
    for state in range(4):
        for new in (SYSTEM, USER, ASSISTANT):
            if new == SYSTEM:
                inserted = () if state == NOTHING else None
            elif new == USER:
                inserted = ("assistant",) if state == USER else ()
            else:
                inserted = () if state == USER else ("user",)
            if inserted is not None:
                cost = relabel_cost(role, new)
                out[state].append((new, cost + INSERT * len(inserted), "relabel" if cost else "keep", inserted))
        if state != NOTHING:
            out[state].append((state, (MERGE_BLANK if blank else MERGE) + relabel_cost(role, state), "merge", ()))
        out[state].sort(key=lambda m: (m[0], m[1], ("keep", "merge", "relabel").index(m[2])))
    return out


MOVES = {(role, blank): moves(role, blank) for role in range(4) for blank in (False, True)}
#: Cost of ending in a state: after a user turn an empty assistant turn is added, after a system turn alone one of each.
ENDING = (0, 2 * INSERT, INSERT, 0)
CLOSING = ((), ("user", "assistant"), ("assistant",), ())


def forward(turns: list[tuple[int, bool]], start: int) -> tuple[list[int], list[list]]:
    """Least cost of reaching each state after the turns from one state, and how each state was reached at each turn."""
    best = [_NEVER] * 4
    best[start] = 0
    back: list[list] = []
    for turn in turns:
        new, how = [_NEVER] * 4, [None] * 4
        for state, cost in enumerate(best):
            if cost < _NEVER:
                for after, more, action, inserted in MOVES[turn][state]:
                    if cost + more < new[after]:
                        new[after], how[after] = cost + more, (state, action, inserted)
        best = new
        back.append(how)
    return best, back


def repair(turns: list[tuple[int, bool]], start: int = NOTHING, end: int | None = None) -> tuple[int, list[tuple[int, str, tuple[str, ...]]]]:
    """(cost, one (state after, action, inserted roles) for each turn): the cheapest way, from ``start`` to ``end``.

    Without ``end``, the way that is cheapest with its ending. Ties go to the smaller state, from the last turn backward.
    """
    best, back = forward(turns, start)
    if end is None:
        end = min(range(4), key=lambda s: (best[s] + ENDING[s], s))
    path, state = [], end
    for how in reversed(back):
        before, action, inserted = how[state]
        path.append((state, action, inserted))
        state = before
    return best[end], path[::-1]


def summary(turns: list[tuple[int, bool]]) -> tuple[list[int], list[int]]:
    """A chunk as seen from outside: costs by (state before, state after), and, for each state after, the order in which
    states before it win ties (by their ways' states, from the last turn backward)."""
    costs, ways = [], []
    for start in range(4):
        best, back = forward(turns, start)
        costs += best
        for end in range(4):
            way, state = [], end
            if best[end] < _NEVER:
                for how in reversed(back):
                    state = how[state][0]
                    way.append(state)
            ways.append(way or [_NEVER + start])
    wins = [sorted(range(4), key=lambda s: ways[4 * s + end]).index(start) for start in range(4) for end in range(4)]
    return costs, wins


def stitched(chunks: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """(state before, state after) of each chunk of a conversation, from the chunks' summaries: those of the whole's way."""
    best = [0 if s == NOTHING else _NEVER for s in range(4)]
    back = []
    for costs, wins in chunks:
        new = [min((best[s] + costs[4 * s + t], wins[4 * s + t], s) for s in range(4)) for t in range(4)]
        back.append([s for _, _, s in new])
        best = [min(c, _NEVER) for c, _, _ in new]
    state = min(range(4), key=lambda s: (best[s] + ENDING[s], s))
    out = []
    for before in reversed(back):
        out.append((before[state], state))
        state = before[state]
    return out[::-1]


def opened(role: str, text: str, first: bool) -> str:
    return ("" if first else "<|end|>\n") + f"<|{role}|>\n{text}"


def safe(text: str | None) -> str:
    """Text that can't be taken for markers."""
    return (text or "").replace("<|", "< |")


def rendered(path: list[tuple[int, str, tuple[str, ...]]], texts: list[str | None], start: int, last: bool) -> list[str]:
    """Each turn's part of the rendered conversation; the parts of all its turns, in order, are the whole."""
    out, state = [], start
    for (after, action, inserted), text in zip(path, texts, strict=True):
        part = ""
        for role in inserted:
            part += opened(role, "", state == NOTHING)
            state = NAMES.index(role)
        if action == "merge":
            part += ("\n" if text else "") + safe(text)
        else:
            part += opened(NAMES[after], safe(text), state == NOTHING)
        state = after
        out.append(part)
    if last and out:
        out[-1] += "".join(opened(role, "", False) for role in CLOSING[state]) + "<|end|>\n"
    return out


def repair_conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row per turn: key, order, role, new_role, action (keep, relabel, merge), inserted (roles of empty turns before it),
    closing (roles of empty turns after it, at the end), rendered (its part of the conversation's text).

    A conversation's turns are taken by order, role and text hash (nulls first); repeated rows are turns of their own. Null
    and unknown roles can become any; null, empty and white texts are blank: merging them is cheaper. Rows with a null key
    make one conversation. An empty table gives no rows; other columns are ignored. Markers in texts are broken up.

    Rows are dealt by ranges of (key, order), so that a long conversation is spread over many tasks. Chunks of it are
    solved apart, from every state to every state, and stitched together by an exact min-plus product. What the driver
    and the tasks see of it is two small rows per task, and one for every ``chunk_turns`` turns of split conversations.
    """
    key_type, order_type = (turns.schema[c].dataType.simpleString() for c in (key, order))
    rows = turns.select(F.col(key).alias("key"), F.col(order).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    by = ["key", "turn", "role", F.xxhash64("text")]
    dealt = frozen(rows.repartitionByRange(parallelism(turns), *by).sortWithinPartitions(*by)).withColumn("p", F.spark_partition_id())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, int, list[tuple], bool]]:
        """(partition, key, chunk, rows, apart); apart: whether more of the conversation may be elsewhere."""
        some, number, first = [], 0, True
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if some and row[0] == some[0][0] and len(some) < chunk_turns:
                    some.append(row)
                    continue
                if some:
                    same = row[0] == some[0][0]
                    yield some[0][4], some[0][0], number, some, first or same or number > 0
                    number, first = (number + 1, first) if same else (0, False)
                some = [row]
        if some:
            yield some[0][4], some[0][0], number, some, True

    def kinds(some: list[tuple]) -> list[tuple[int, bool]]:
        return [(role_number(r[2]), not (r[3] or "").strip()) for r in some]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for p, name, number, some, apart in chunks(batches):
            if apart:
                costs, wins = summary(kinds(some))
                found.append({"p": p, "none": name is None, "name": str(name), "chunk": number, "costs": costs, "wins": wins})
        yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("p", pa.int32()), ("none", pa.bool_()), ("name", pa.string()), ("chunk", pa.int32()), ("costs", pa.list_(pa.int64())), ("wins", pa.list_(pa.int64()))]))

    def stitch(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["p", "chunk"])
        states = stitched([(list(c), list(w)) for c, w in zip(part["costs"], part["wins"], strict=True)])
        return pd.DataFrame({"p": part["p"], "chunk": part["chunk"], "none": part["none"], "name": part["name"], "before": [s for s, _ in states], "after": [t for _, t in states], "last": [i == len(states) - 1 for i in range(len(states))]})

    sent = dealt.mapInArrow(edges, "p int, none boolean, name string, chunk int, costs array<long>, wins array<long>").groupBy("none", "name")
    plan = {(r["p"], r["none"], r["name"], r["chunk"]): (r["before"], r["after"], r["last"]) for r in sent.applyInPandas(stitch, "p int, chunk int, none boolean, name string, before int, after int, last boolean").toLocalIterator()}
    shipped = turns.sparkSession.sparkContext.broadcast(plan)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        types = [head.schema.field(i).type for i in range(2)]

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield head
            yield from batches

        out, held = [], 0

        def passed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], types[0]), pa.array(columns[1], types[1]), *(pa.array(c, t) for c, t in zip(columns[2:], (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()), strict=True))]
            return pa.RecordBatch.from_arrays(arrays, names=["key", "turn", "role", "new_role", "action", "inserted", "closing", "rendered"])

        for p, name, number, some, apart in chunks(all_batches()):
            start, end, last = known[p, name is None, str(name), number] if apart else (NOTHING, None, True)
            _, path = repair(kinds(some), start, end)
            parts = rendered(path, [r[3] for r in some], start, last)
            for i, (row, (after, action, inserted), part) in enumerate(zip(some, path, parts, strict=True)):
                closing = CLOSING[after] if last and i == len(some) - 1 else ()
                out.append((row[0], row[1], row[2], NAMES[after], action, list(inserted), list(closing), part))
                held += len(part)
            if len(out) >= 5_000 or held >= 1 << 24:
                yield passed()
                out, held = [], 0
        if out:
            yield passed()

    result = dealt.mapInArrow(write, f"key {key_type}, turn {order_type}, role string, new_role string, action string, inserted array<string>, closing array<string>, rendered string")
    return result.withColumnsRenamed({"key": key, "turn": order})

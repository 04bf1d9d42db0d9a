"""Chat formatting with minimum-cost role repair.

Legal conversations are those of a small automaton: an optional system turn,
then user and assistant in turns, beginning with the user. A dynamic program
over the state after each turn chooses whether a turn is kept, relabelled,
merged into the turn before it, or preceded by an empty turn. Costs add up and
the least is sought, so a stretch of turns is a (min, +) matrix from state to
state: long conversations are cut where Spark's range partitions cut them. Their
stretches are summed up apart, costs to go run back over the sums, then each
stretch maps the states it may be entered in to those it leaves in, and these
maps are chained from the start: the same repair as in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from repograin.llm.store import saved

MERGE, RELABEL, INSERT = 1, 2, 3  # costs; a role that is none of the three costs UNKNOWN to relabel
UNKNOWN = 1
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
_STATE = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}  # legal turns after a state
_FAR = 1 << 40
NOTHING = [0, 0, 0, 0]  # costs after the end


def _steps(role: str | None) -> list[tuple[int, int, int, str, int | None]]:
    """All ways to take a turn: (state, next state, cost, action, empty turn put before), the preferred of equals first."""
    own = _STATE.get(role)
    out = []
    for state in range(4):
        for then in (SYSTEM, USER, ASSISTANT) if own == SYSTEM else (USER, ASSISTANT):  # no turn becomes a system turn
            label = 0 if own == then else UNKNOWN if own is None else RELABEL
            if then in _NEXT[state]:
                out.append((state, then, label, "relabel" if label else "keep", None))
            if state == then:
                out.append((state, then, label + MERGE, "relabel+merge" if label else "merge", None))
            for empty in _NEXT[state]:
                if then in _NEXT[empty] and empty != SYSTEM:
                    out.append((state, then, label + INSERT, "relabel" if label else "keep", empty))
    return sorted(out, key=lambda s: (s[2], s[4] is not None, s[3] != "keep", s[3] != "merge", s[1]))


STEPS = {role: _steps(role) for role in (*ROLES, None)}


def _known(role: str | None) -> str | None:
    return role if role in _STATE else None


def costs(roles: list[str | None]) -> np.ndarray:
    """4 x 4: least cost from the state before the stretch to the state after it."""
    total = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(total, 0)
    turn = {}
    for role, steps in STEPS.items():
        turn[role] = np.full((4, 4), _FAR, np.int64)
        for state, then, cost, _, _ in steps:
            turn[role][state, then] = min(turn[role][state, then], cost)
    for role in roles:
        total = np.minimum((total[:, :, None] + turn[_known(role)][None]).min(axis=1), _FAR)
    return total


def to_go(roles: list[str | None], after: list[int] = NOTHING) -> list[list[int]]:
    """Least cost from each state before each turn, and after the last one, to the end; ``after``: that from the stretch's end on."""
    out = [list(after)]
    for role in reversed(roles):
        now = [_FAR] * 4
        for state, then, cost, _, _ in STEPS[_known(role)]:
            now[state] = min(now[state], cost + out[-1][then])
        out.append(now)
    return out[::-1]


def repair(roles: list[str | None], first: int = START, after: list[int] = NOTHING) -> list[tuple[str, int, int | None]]:
    """(action, state after, empty turn put before) of every turn, at least cost from state ``first``.

    Of equally cheap repairs each turn, from the first on, takes the step that comes first in ``STEPS``. What a turn
    does thus follows from its state and the costs to go alone, wherever the conversation is cut.
    """
    left, state, out = to_go(roles, after), first, []
    for role, ahead in zip(roles, left[1:], strict=True):
        ways = (s for s in STEPS[_known(role)] if s[0] == state)
        _, state, _, action, empty = min(ways, key=lambda s: s[2] + ahead[s[1]])  # the first of equals
        out.append((action, state, empty))
    return out


def _escaped(text: str | None) -> str:
    """A turn's own text cannot open or close a turn."""
    return (text or "").replace("<|", "< |")


def _opened(state: int, before: int) -> str:
    return ("<|end|>\n" if before != START else "") + f"<|{ROLES[state - 1]}|>\n"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with the same first ``keys`` values; one run is held at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by_stretch(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    dealt = df.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "mark")
    return dealt.mapInArrow(run, schema)


def repaired_turns(df: DataFrame) -> DataFrame:
    """``conv_id, turn, tie, step, role, action, rendered``, one row per turn and one per empty turn put before it.

    Joined by (turn, tie, step), ``rendered`` is the whole conversation; ``tie``
    numbers rows of one turn number by role and text, ``step`` is 0 for an
    empty turn and 1 for the turn itself. Nulls: a null role is an unknown one,
    a null text an empty one, a null turn comes first, and rows without
    conv_id are one conversation. Turns of equal number stay together. ``conv_id``
    may have any type, ``turn`` is a whole number; other columns are not looked at.
    """
    rows = df.select("conv_id", "turn", "role", "text").withColumn("mark", F.xxhash64("text"))
    rows = saved(rows.repartitionByRange("conv_id", "turn").withColumn("part", F.spark_partition_id()), "turns")
    several = rows.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    cut = saved(several.where("low < high").select(F.col("conv_id").alias("_c"), "low", "high"), "long")  # fewer than there are partitions

    key_type = df.schema["conv_id"].dataType
    ddl, arrow = key_type.simpleString(), to_arrow_type(key_type)

    def batch(made: list[dict], **columns: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(made, pa.schema([("conv_id", arrow), ("part", pa.int32()), *columns.items()]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            yield batch([{"conv_id": group[0][0], "part": group[0][1], "costs": costs([r[2] for r in group]).ravel().tolist()}], costs=pa.list_(pa.int64()))

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            after, out = np.zeros(4, np.int64), []
            for conv_id, part, m in reversed(group):
                out.append({"conv_id": conv_id, "part": part, "after": after.tolist()})
                after = np.minimum((np.reshape(m, (4, 4)) + after[None]).min(axis=1), _FAR)
            yield batch(out, after=pa.list_(pa.int64()))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            roles, after = [r[2] for r in group], group[0][5]
            yield batch([{"conv_id": group[0][0], "part": group[0][1], "after": after, "leave": [repair(roles, s, after)[-1][1] for s in range(4)]}], after=pa.list_(pa.int64()), leave=pa.list_(pa.int32()))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            state, out = START, []
            for conv_id, part, after, leave in group:
                out.append({"conv_id": conv_id, "part": part, "entry": state, "after": after})
                state = leave[state]
            yield batch(out, entry=pa.int32(), after=pa.list_(pa.int64()))

    def in_order(stretches: DataFrame, run: Callable, made: str) -> DataFrame:
        """One row per stretch, those of a conversation in one task: at most as many as there are partitions."""
        return stretches.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, f"conv_id {ddl}, part int, {made}")

    def at_stretch(found: DataFrame) -> DataFrame:
        return F.broadcast(found.withColumnsRenamed({"conv_id": "_c", "part": "_p"}))

    same = rows.conv_id.eqNullSafe(F.col("_c")) & (rows.part == F.col("_p"))
    long_rows = rows.join(F.broadcast(cut), rows.conv_id.eqNullSafe(F.col("_c"))).select("conv_id", "part", "role", "turn", "mark")
    sums = _by_stretch(long_rows, summed, f"conv_id {ddl}, part int, costs array<bigint>")
    behind = saved(in_order(sums, ahead, "after array<bigint>"), "ahead")
    met = rows.join(at_stretch(behind), same).select("conv_id", "part", "role", "turn", "mark", "after")
    maps = _by_stretch(met, mapped, f"conv_id {ddl}, part int, after array<bigint>, leave array<int>")
    ends = in_order(maps, chained, "entry int, after array<bigint>").withColumnsRenamed({"conv_id": "_k"})
    ends = saved(ends.join(F.broadcast(cut), F.col("_k").eqNullSafe(F.col("_c"))).select("_c", F.col("part").alias("_p"), "entry", "after", (F.col("part") == F.col("high")).alias("final")), "ends")  # at most two per partition

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", arrow), ("turn", pa.int64()), ("tie", pa.int64()), ("step", pa.int32()), ("role", pa.string()), ("action", pa.string()), ("rendered", pa.string())])
        out: list[dict] = []
        for group in _groups(batches, 2):
            conv_id, _, _, _, _, _, entry, after, final = group[0]
            before, tie, last_turn = entry if entry is not None else START, 0, object()
            plan = repair([r[2] for r in group], before, after or NOTHING)
            for (_, _, _, turn, _, text, _, _, _), (action, state, empty) in zip(group, plan, strict=True):
                tie = tie + 1 if turn == last_turn else 0
                last_turn = turn
                base = {"conv_id": conv_id, "turn": turn, "tie": tie}
                if empty is not None:
                    out.append(base | {"step": 0, "role": ROLES[empty - 1], "action": "insert", "rendered": _opened(empty, before)})
                    before = empty
                opened = "\n" if action.endswith("merge") else _opened(state, before)
                out.append(base | {"step": 1, "role": ROLES[state - 1], "action": action, "rendered": opened + _escaped(text)})
                before = state
            if final is not False:
                out[-1]["rendered"] += "<|end|>\n"
            if len(out) >= 2_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    placed = rows.join(F.broadcast(ends), same, "left")
    return _by_stretch(placed.select("conv_id", "part", "role", "turn", "mark", "text", "entry", "after", "final"), mended, f"conv_id {ddl}, turn bigint, tie bigint, step int, role string, action string, rendered string")


def as_texts(turns: DataFrame) -> DataFrame:
    """``conv_id, text``: whole conversations, for those that fit in a row."""
    pieces = F.array_sort(F.collect_list(F.struct("turn", "tie", "step", "rendered")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["rendered"]), "").alias("text"))

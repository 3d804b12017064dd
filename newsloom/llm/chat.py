"""Chat formatting: least-cost repair of the order of roles, then rendering.

A legal conversation is an optional system turn, then user and assistant turns by turns, the user
first and the assistant last. Repair reads the turns in order and for each chooses to keep it,
relabel it, or merge it into the turn before; empty turns may be inserted where one is missing.
Every choice has a cost, and dynamic programming over the automaton's states finds the cheapest.

A conversation may be any length, so it is read in pieces. A piece turns into the table of least
costs from each state to each state; tables of a conversation combine in order (minimum of sums)
and give each piece its first and last state, between which it is repaired on its own.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_rows, stored

# Turns, and characters, of a piece.
PIECE_TURNS = 2_048
PIECE_CHARS = 4_000_000

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
# Names that stand for a role; any other name, or none, is unknown.
SYNONYMS = {
    "system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
    "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT,
}
# Which states may follow a state with a turn of their role.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COST_MERGE_SAME, COST_MERGE_OTHER, COST_INSERT = 1, 5, 2
COST_RELABEL, COST_RELABEL_UNKNOWN = 3, 1
INFINITE = 1 << 40


def role_of(name: str | None) -> int:
    """The state of a role name; START for an unknown one."""
    return SYNONYMS.get((name or "").strip().lower(), START)


def choices(state: int, role: int):
    """(cost, state after, inserted states, merged) for one turn of a role, cheapest kinds first."""

    def label(as_role: int) -> int:
        return 0 if as_role == role else COST_RELABEL_UNKNOWN if role == START else COST_RELABEL

    for after in NEXT[state]:
        yield label(after), after, (), False
    if state != START:
        same = COST_MERGE_SAME if role in (state, START) else COST_MERGE_OTHER
        yield same, state, (), True
    for between in NEXT[state]:
        if between != SYSTEM:
            for after in NEXT[between]:
                yield COST_INSERT + label(after), after, (between,), False


def transfer(roles: list[int]) -> list[list[int]]:
    """Least costs of a run of turns from each state to each state."""
    table = [[0 if i == j else INFINITE for j in range(4)] for i in range(4)]
    for role in roles:
        moved = [[INFINITE] * 4 for _ in range(4)]
        for state in range(4):
            for cost, after, _, _ in choices(state, role):
                for first in range(4):
                    total = table[first][state] + cost
                    if total < moved[first][after]:
                        moved[first][after] = total
        table = moved
    return table


def closing(state: int) -> int:
    """Cost of ending in a state: a missing last answer is inserted, an empty conversation is legal."""
    return {START: 0, SYSTEM: 2 * COST_INSERT, USER: COST_INSERT, ASSISTANT: 0}[state]


def path(roles: list[int], first: int, last: int) -> list[tuple[int, tuple[int, ...], bool]]:
    """The choices, as (state, inserted, merged), of the cheapest repair from first to last state.

    Of equal costs the one that `choices` names first, from the end backwards.
    """
    costs = [[INFINITE] * 4]
    costs[0][first] = 0
    back = []
    for role in roles:
        now, by = [INFINITE] * 4, [None] * 4
        for state in range(4):
            if costs[-1][state] >= INFINITE:
                continue
            for cost, after, inserted, merged in choices(state, role):
                if costs[-1][state] + cost < now[after]:
                    now[after] = costs[-1][state] + cost
                    by[after] = (state, inserted, merged)
        costs.append(now)
        back.append(by)
    steps, state = [], last
    for by in reversed(back):
        before, inserted, merged = by[state]
        steps.append((state, inserted, merged))
        state = before
    return steps[::-1]


def _pieces(conversations: DataFrame) -> DataFrame:
    """Runs of turns of one conversation, in order, none of unbounded size."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def task(batches):
        part, made = TaskContext.get().partitionId(), 0
        held, size, of = [], 0, None

        def piece():
            nonlocal made
            table = transfer([role_of(t["role"]) for t in held])
            made += 1
            return of, (part << 32) + made, list(held), [c for line in table for c in line]

        for batch in batches:
            done = []
            for conv, turn, role, text in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"]):
                if held and (conv != of or len(held) >= PIECE_TURNS or size >= PIECE_CHARS):
                    done.append(piece())
                    held, size = [], 0
                of = conv
                held.append({"turn": turn, "role": role, "text": text})
                size += len(text)
            yield dict(zip(("conv_id", "piece", "turns", "costs"), map(list, zip(*done))))
        if held:
            yield dict(zip(("conv_id", "piece", "turns", "costs"), map(list, zip(*[piece()]))))

    schema = (
        "conv_id long, piece long, turns array<struct<turn:long,role:string,text:string>>, "
        "costs array<long>"
    )
    return stored(arrow_rows(rows, task, schema), "chat-pieces")


def _states(pieces: DataFrame) -> DataFrame:
    """(piece, first, last, cost): the states each piece starts and ends in, and the whole cost."""

    def task(batches):
        for batch in batches:
            out = {n: [] for n in ("piece", "first", "last", "cost", "final")}
            for parts in batch["parts"]:
                costs, back = [0, INFINITE, INFINITE, INFINITE], []
                for part in parts:
                    c = part["costs"]
                    options = [
                        min((costs[s] + c[4 * s + e], s) for s in range(4)) for e in range(4)
                    ]
                    costs = [cost for cost, _ in options]
                    back.append([s for _, s in options])
                total, state = min((costs[s] + closing(s), s) for s in range(4))
                for at in range(len(parts) - 1, -1, -1):
                    out["piece"].append(parts[at]["piece"])
                    out["first"].append(back[at][state])
                    out["last"].append(state)
                    out["cost"].append(total)
                    out["final"].append(at == len(parts) - 1)
                    state = back[at][state]
            yield out

    parts = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("piece", "costs"))).alias("parts")
    )
    return arrow_rows(
        parts.select("parts"), task, "piece long, first int, last int, cost long, final boolean"
    )


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each turn that is read or inserted, in the order of (conv_id, piece, position).

    conv_id, piece, position, turn (null for an inserted one), role (as repaired), action (keep,
    relabel, merge, insert), cost (of the whole conversation), rendered: the text that the row adds
    to the conversation. The rendered parts in order are the chat: `<|role|>`, a line break, the
    text, and `<|end|>` with a line break before the next turn and at the end; a merged turn adds
    its text after a line break. Null texts are empty, null and unknown roles are relabelled at
    low cost, rows of equal turn are ordered by role and text, and each row counts. A null conv_id
    is a conversation of its own. An empty table gives no rows.
    """
    pieces = _pieces(conversations)
    rows = pieces.select("conv_id", "piece", "turns").join(_states(pieces), "piece")

    def task(batches):
        names = ("conv_id", "piece", "position", "turn", "role", "action", "cost", "rendered")
        for batch in batches:
            out = {n: [] for n in names}
            columns = [batch[c] for c in ("conv_id", "piece", "turns", "first", "last", "cost", "final")]
            for conv, piece, turns, first, last, cost, final in zip(*columns):
                begun, position = first != START, 0

                def add(turn, state, action, text, conv=conv, piece=piece, cost=cost):
                    nonlocal begun, position
                    if action == "merge":
                        text = "\n" + text
                    else:
                        text = ("<|end|>\n" if begun else "") + f"<|{ROLES[state]}|>\n{text}"
                    begun = True
                    for column, value in zip(
                        out.values(), (conv, piece, position, turn, ROLES[state], action, cost, text)
                    ):
                        column.append(value)
                    position += 1

                roles = [role_of(t["role"]) for t in turns]
                for t, role, (state, inserted, merged) in zip(turns, roles, path(roles, first, last)):
                    for extra in inserted:
                        add(None, extra, "insert", "")
                    action = "merge" if merged else "keep" if role == state else "relabel"
                    add(t["turn"], state, action, t["text"])
                if final:
                    for extra in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(last, ()):
                        add(None, extra, "insert", "")
                    out["rendered"][-1] += "<|end|>\n"
            yield out

    schema = (
        "conv_id long, piece long, position long, turn long, role string, action string, "
        "cost long, rendered string"
    )
    return arrow_rows(rows, task, schema)

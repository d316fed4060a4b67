"""Conversation structure repair (operator 13): survivor-coalescence Viterbi over edits.

Rows of a conversation stream through in order. For each state that the repaired roles can be in
(nothing yet, after the system row, after a user row, after an assistant row) the cheapest edits
are kept as a leaf of a backpointer tree with reference counts. Branches that no survivor needs
are freed; once all survivors share an ancestor, the edits up to it are final and are emitted, so
only the unresolved rows are held. Ties are decided by comparing the whole unresolved suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import ship_package

RESULT_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string, n_rows long, n_repaired long, most_held long"
)
#: Characters that do not count as text, and those that end a sentence.
SPACES = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
#: Role initials that may follow one another.
LEGAL_PAIRS = frozenset({"su", "ua", "au"})
#: State after emitting a role initial in a state: the repaired initials are (s?(ua)+)?.
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FINAL = ("", "a")
NAMES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


class Step:
    """An edit in the backpointer tree: its letter, the repaired row that it gives (None: none) and who refers to it."""

    __slots__ = ("parent", "letter", "row", "refs", "depth")

    def __init__(self, parent: Step | None, letter: str, row: tuple[str, str] | None) -> None:
        self.parent, self.letter, self.row, self.refs = parent, letter, row, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1


def _let_go(step: Step | None) -> None:
    """One reference less; branches without any are cut off up to their fork."""
    while step is not None:
        step.refs -= 1
        if step.refs:
            return
        parent, step.parent = step.parent, None
        step = parent


def less(a: Step, b: Step) -> bool:
    """Whether the letters that lead to ``a`` come before those to ``b``: they differ only after their fork."""
    ends: tuple[list[str], list[str]] = [], []
    while a is not b:
        if a.depth >= b.depth:
            ends[0].append(a.letter)
            a = a.parent
        else:
            ends[1].append(b.letter)
            b = b.parent
    return ends[0][::-1] < ends[1][::-1]


@dataclass
class Repair:
    """Cheapest edits of one conversation, fed row by row."""

    costs: Costs = Costs()
    audit: list[str] = field(default_factory=list)
    most_held: int = 0
    n_repaired: int = 0

    def __post_init__(self) -> None:
        self._root = Step(None, "", None)
        self._root.refs = 1
        self._best: dict[str, tuple[int, Step]] = {"": (0, self._root)}
        self._digest = hashlib.sha256()
        self._held = 1

    def add(self, role: str, text: str, truncated: bool, must_go: bool) -> None:
        self._insert()
        self._drop_dominated()
        found: dict[str, tuple[int, Step]] = {}
        extra = self.costs.truncated if truncated else 0
        for state, (cost, at) in self._best.items():
            self._offer(found, state, cost + self.costs.delete, at, "D", None)
            if must_go:
                continue
            kept = NEXT.get((state, role[:1]))
            if kept is not None:
                self._offer(found, kept, cost + extra, at, "K", (role, text))
            for initial, name in NAMES.items():
                if (state, initial) in NEXT:
                    self._offer(found, NEXT[state, initial], cost + extra + self.costs.rerole, at, "R", (name, text))
        for _, at in self._best.values():
            _let_go(at)
        self._best = found
        self._emit_resolved()

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, hash of the repaired rows)."""
        self._insert()
        ends = [self._best[s] for s in FINAL if s in self._best]
        chosen = ends[0]
        for other in ends[1:]:
            if (other[0], less(chosen[1], other[1])) < (chosen[0], True):
                chosen = other
        self._emit(self._path(chosen[1]))
        return chosen[0], "".join(self.audit), self._digest.hexdigest()

    def _offer(self, found: dict, state: str, cost: int, at: Step, letter: str, row: tuple[str, str] | None) -> bool:
        old = found.get(state)
        if old is not None and old[0] < cost:
            return False
        step = Step(at, letter, row)
        step.refs = 1
        if old is not None and old[0] == cost and not less(step, old[1]):
            _let_go(step)
            return False
        found[state] = (cost, step)
        if old is not None:
            _let_go(old[1])
        return True

    def _insert(self) -> None:
        """Rows inserted here: a state reached cheaper by inserting is taken so."""
        changed = True
        while changed:
            changed = False
            for state in list(self._best):
                cost, at = self._best[state]
                for initial, name in NAMES.items():
                    to = NEXT.get((state, initial))
                    if to is not None and self._offer(self._best, to, cost + self.costs.insert, at, "I", (name, "")):
                        changed = True

    def _drop_dominated(self) -> None:
        """A survivor goes where any way on from it is strictly dearer than the same way on after an assistant row.

        After the system row the same rows may follow; from nothing a system row may be kept, which
        then has to be deleted instead. Without this, deleting all rows would survive for ever and
        the edits would never be final.
        """
        done = self._best.get("a")
        for state, more in (("s", 0), ("", self.costs.delete)):
            other = self._best.get(state)
            if done is not None and other is not None and other[0] > done[0] + more:
                _let_go(self._best.pop(state)[1])

    def _path(self, leaf: Step) -> list[Step]:
        path = []
        while leaf is not self._root:
            path.append(leaf)
            leaf = leaf.parent
        return path[::-1]

    def _emit_resolved(self) -> None:
        leaf = next(iter(self._best.values()))[1]
        self.most_held = max(self.most_held, leaf.depth - self._root.depth)
        if self._root.refs != 1 or leaf is self._root:
            return
        final = []
        for step in self._path(leaf):
            final.append(step)
            if step.refs != 1:  # a fork, or the end of several survivors
                break
        self._emit(final)
        self._root.refs = 0
        self._root = final[-1]
        self._root.parent = None

    def _emit(self, steps: list[Step]) -> None:
        for step in steps:
            self.audit.append(step.letter)
            if step.row is not None:
                self._digest.update((("\n" if self.n_repaired else "") + ":".join(step.row)).encode())
                self.n_repaired += 1


class _Conversation:
    """Counts of one conversation and its repair; rows come in order and are not kept."""

    def __init__(self, costs: Costs) -> None:
        self.repair = Repair(costs)
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        row = turn, role, text
        again = again or row == self.last
        if self.last is not None and self.last[1][:1] + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        if turn is not None:
            self.turns += self.last is None or self.last[0] != turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        said = text.rstrip(SPACES)
        blank, cut = not said, bool(said) and said[-1] not in SENTENCE_ENDS and not again
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut
        self.rows += 1
        self.last = row
        self.repair.add(role, text, cut, blank or again)

    def row(self, conv: int | None) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit, digest = self.repair.finish()
        return (
            conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest,
            self.rows, self.repair.n_repaired, self.repair.most_held,
        )


def _space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) of ``turns``, damaged by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops the row (it stays, marked), 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes it a user's.
    """
    case = F.pmod(F.crc32(F.concat(_space(F.col("conv_id")), F.lit(":"), _space(F.col("turn"))).cast("binary")), F.lit(20))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    text = F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_case") == 3, 2).otherwise(1))
    return (
        rows.select("conv_id", "turn", _space(F.col("role")).alias("role"), _space(F.col("text")).alias("text"), case.alias("_case"))
        .select(
            "conv_id", "turn", F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
            (F.col("_case") == 0).alias("dropped"), F.explode(copies).alias("_copy"),
        )
        .drop("_copy")
    )


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation (``RESULT_SCHEMA``) of ``turns`` (conv_id, turn, role, text[, dropped]).

    Rows are taken by turn (nulls first), then role, then text. Null role and null text are one
    space; a null conv_id is one conversation. Rows marked ``dropped`` only make their conversation
    appear: without other rows it has zeros, an empty audit and the hash of the empty string.
    Repeated rows are duplicates of the first. Other columns are ignored. An empty table gives none.

    Whether a role and text came earlier in a conversation is found by an aggregate and a join on
    a hash of the text, so no task holds the texts of a conversation. The repair itself reads a
    conversation in order (its digest demands that) and keeps only the unresolved edits.
    """
    ship_package(turns.sparkSession)
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _space(F.col("role")).alias("role"), _space(F.col("text")).alias("text"), dropped.alias("dropped"),
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = (
        rows.where(~F.col("dropped"))
        .groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.sha2("text", 256).alias("_text"))
        .agg(F.min(place).alias("_first"))
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.sha2("text", 256) == F.col("_text"))
    marked = rows.join(first, same, "left").select(
        "conv_id", "turn", "role", "text", "dropped", (~place.eqNullSafe(F.col("_first"))).alias("again")
    )
    names = [c.split(" ")[0] for c in RESULT_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(done: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})

        now, state = None, None
        for batch in batches:
            done = []
            ids = [[None if v is pd.NA else int(v) for v in batch[c].astype("Int64")] for c in ("conv_id", "turn")]
            for conv, turn, role, text, gone, again in zip(*ids, batch["role"], batch["text"], batch["dropped"], batch["again"], strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(state.row(now))
                    now, state = conv, _Conversation(costs)
                if not gone:
                    state.add(turn, role, text, bool(again))
            if done:
                yield frame(done)
        if state is not None:
            yield frame([state.row(now)])

    return (
        marked.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
        .mapInPandas(run, RESULT_SCHEMA)
    )

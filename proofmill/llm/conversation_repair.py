"""Repair of damaged conversations by iterative-deepening A*.

A conversation is in order if its role initials read ``(s?(ua)+)?``. It is brought there by edits: Keep (0),
Rerole to user or assistant (2), Delete (3), Insert an empty user or assistant turn anywhere (2). Blank and
duplicate turns must go; a truncated turn that stays adds 1. The search is depth first, in ASCII order of the
edits' initials, under a bound on the cost; a state that failed is kept in a transposition table with the cost
that it needs at least, and the bound grows to what the first state needs. The first accepting path is
the cheapest, and the ASCII-least of those. What an edit can mend at most bounds the cost from below: each
turn that must go costs 3, each truncated one 1, and a run of b wrong neighbours among the rest takes b/2
edits, as one edit touches two neighbours and costs 2 or more.

Turns are range-sorted over all tasks, so no conversation has to fit a task. Those that lie whole inside a
task, with ``LONGEST`` turns at most, are repaired there. The others go on as pieces of ``PIECE`` turns. A piece is
searched from each state to each state; the cheapest ways through a conversation's pieces are then
added up in order, with one running digest for each state, in memory that only the audit grows.
No edit string of equal turns is the beginning of another, so strings of pieces compare like whole ones.

The first fault of a turn counts: blank (nothing but ASCII white space), duplicate (role and text seen
earlier in the conversation), truncated (last character that is no white space not one of ``.!?``). A null conversation id
is a conversation; a null turn number stands first and does not count for gaps; null roles and texts are one
space. Turns with one number stand in the order of a hash of role and text. Repeated rows are duplicate turns. A
conversation of which nothing is left has zeros, an empty audit and the digest of the empty text. Only the
four columns named are read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import WORDS, small_batches
from proofmill.session import written_once

SPACES = " \t\n\v\f\r"
#: Turns and characters of a conversation that is repaired at once; turns of a piece of a longer one.
LONGEST, LONGEST_CHARS, PIECE = 512, 4_000_000, 64

#: States by what came last: nothing, system, user, assistant; the state after a kept turn, and after an inserted or reroled one.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MADE = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
#: What comes after the last turn until the conversation is in order.
TAIL = ("", "II", "I", "")


class Turn(NamedTuple):
    initial: str
    goes: bool  # blank or duplicate
    truncated: bool


class Search:
    """Cheapest edits of some turns from a state to a state, or to the end of a conversation (target None)."""

    def __init__(self, turns: list[Turn], target: int | None):
        self.turns, self.target, self.n = turns, target, len(turns)
        self.table: dict[int, float] = {}  # by 4 times the turn plus the state: cost from there on at least
        self.options: dict[int, list[tuple[str, int, int]]] = {}
        ends = {None: "a", START: "", SYSTEM: "s", USER: "u", ASSISTANT: "a"}[target]
        # of the turns that may stay, from each on: the first one's initial, wrong neighbours that follow it at once, cost of later ones
        self.sure, self.first, self.run, self.later = [0] * (self.n + 1), [None] * (self.n + 1), [0] * (self.n + 1), [0] * (self.n + 1)
        for k in range(self.n - 1, -1, -1):
            turn, after = turns[k], self.first[k + 1]
            self.sure[k] = self.sure[k + 1] + (3 if turn.goes else turn.truncated)
            if turn.goes:
                self.first[k], self.run[k], self.later[k] = after, self.run[k + 1], self.later[k + 1]
                continue
            right = turn.initial == ends if after is None else turn.initial + after in ("su", "ua", "au")
            self.first[k] = turn.initial
            self.run[k] = 0 if right else self.run[k + 1] + 1
            self.later[k] = self.later[k + 1] + (2 * ((self.run[k + 1] + 1) // 2) if right else 0)

    def least(self, node: int) -> float:
        """A cost that no way from here on is below."""
        known = self.table.get(node)
        if known is None:
            k, state = divmod(node, 4)
            target, first = self.target, self.first[k]
            if target == START and state or target == SYSTEM and state > SYSTEM:
                known = inf
            elif first is not None:
                run = self.run[k] + (first not in KEPT[state])
                known = self.sure[k] + self.later[k] + 2 * ((run + 1) // 2)
            elif target is None:
                known = self.sure[k] + 2 * len(TAIL[state])
            else:
                known = self.sure[k] + (0 if state == target else 2 if k < self.n else inf)
            self.table[node] = known
        return known

    def edits(self, node: int) -> list[tuple[str, int, int]]:
        """Initial, cost and next node of what can be done, in ASCII order."""
        found = self.options.get(node)
        if found is None:
            k, state = divmod(node, 4)
            found = []
            turn = self.turns[k] if k < self.n else None
            if turn:
                found.append(("D", 3, node + 4))
            if turn or self.target is None:
                found.append(("I", 2, 4 * k + MADE[state]))
            if turn and not turn.goes:
                if turn.initial in KEPT[state]:
                    found.append(("K", int(turn.truncated), 4 * k + 4 + KEPT[state][turn.initial]))
                found.append(("R", 2 + turn.truncated, 4 * k + 4 + MADE[state]))
            self.options[node] = found
        return found

    def done(self, node: int) -> bool:
        k, state = divmod(node, 4)
        return k == self.n and (state in (START, ASSISTANT) if self.target is None else state == self.target)

    def __call__(self, start: int) -> tuple[int, str] | None:
        """Cost and initials of the edits; None where no edits lead to the target."""
        if self.done(start):
            return 0, ""
        bound = self.least(start)
        while bound < inf:
            path = self.descend(start, bound)
            if path is not None:
                return bound, "".join(path)
            bound = self.table[start]
        return None

    def descend(self, start: int, bound: int) -> list[str] | None:
        """The first accepting path within the bound; failing that, the table tells what each state needs."""
        path: list[str] = []
        open_ = [[start, bound, iter(self.edits(start)), inf, 0]]  # node, cost left, edits to try, least need seen, cost of the edit that led here
        while open_:
            top = open_[-1]
            for letter, cost, node in top[2]:
                need = cost + self.least(node)
                if need > top[1]:
                    top[3] = min(top[3], need)
                    continue
                path.append(letter)
                if self.done(node):
                    return path
                open_.append([node, top[1] - cost, iter(self.edits(node)), inf, cost])
                break
            else:
                self.table[top[0]] = max(top[3], self.table[top[0]])
                open_.pop()
                if open_:
                    path.pop()
                    open_[-1][3] = min(open_[-1][3], top[4] + self.table[top[0]])
        return None


def repaired(turns: list[tuple[str, str]], edits: str, state: int) -> list[str]:
    """``role:text`` of each turn after the edits."""
    lines, k = [], 0
    for edit in edits:
        if edit in "IR":
            state = MADE[state]
            lines.append(f"{NAME[state]}:{turns[k][1] if edit == 'R' else ''}")
        elif edit == "K":
            role, text = turns[k]
            state = KEPT[state][role[:1]]
            lines.append(f"{role}:{text}")
        k += edit != "I"
    return lines


class Faults:
    """Counts of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.first = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None  # initial of the turn before

    def turn(self, number: int | None, role: str, text: str, seen: bool) -> Turn:
        if number is not None and number != self.last:
            self.first = number if self.first is None else self.first
            self.last = number
            self.distinct += 1
        blank = WORDS.search(text) is None
        seen = seen and not blank
        truncated = not blank and not seen and text.rstrip(SPACES)[-1] not in ".!?"
        self.blank += blank
        self.duplicate += seen
        self.truncated += truncated
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        return Turn(initial, blank or seen, truncated)

    def counts(self) -> tuple[int, ...]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def whole(rows: list[tuple]) -> tuple:
    """Counts, cost, audit, digest and text of a conversation's rows ``number, role, text``."""
    faults, seen, turns = Faults(), set(), []
    for number, role, text in rows:
        turns.append(faults.turn(number, role, text, (role, text) in seen))
        seen.add((role, text))
    cost, audit = Search(turns, None)(START)
    text = "\n".join(repaired([r[1:] for r in rows], audit, START))
    return *faults.counts(), cost, audit, digest(text), text


class Ways:
    """The cheapest way from the start to each state, through the pieces so far."""

    def __init__(self, texts: bool) -> None:
        self.texts = texts
        # by state: cost, rank among the ways' strings, edits and lines as linked lists, digest, whether there is a line
        self.at: dict[int, tuple] = {START: (0, 0, None, None, hashlib.sha256(), False)}

    def onward(self, begin: int, cost: int, rank: int, edits: str, turns: list[tuple[str, str]]) -> tuple:
        before, _, audit, said, sha, some = self.at[begin]
        lines, sha = repaired(turns, edits, begin), sha.copy()
        for line in lines:
            sha.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
            some = True
        return before + cost, rank, (audit, edits), (said, lines) if self.texts else None, sha, some

    def extend(self, turns: list[tuple[str, str]], through: list[tuple[int, int, int, str]]) -> None:
        """Go through a piece, given begin, end, cost and edits of the cheapest way between any two states."""
        best: dict[int, tuple] = {}
        for begin, end, cost, edits in through:
            if begin in self.at:
                way = (self.at[begin][0] + cost, self.at[begin][1], edits, begin, cost)
                best[end] = min(best.get(end, way), way)
        strings = sorted(way[1:3] for way in best.values())
        self.at = {end: self.onward(way[3], way[4], strings.index(way[1:3]), way[2], turns) for end, way in best.items()}

    def finish(self) -> tuple:
        """Cost, audit, digest and text of the whole, once what is missing at the end is appended."""
        ways = [self.onward(state, 2 * len(TAIL[state]), way[1], TAIL[state], []) for state, way in self.at.items()]
        cost, _, audit, said, sha, _ = min(ways, key=lambda w: w[:2])
        return cost, "".join(unlinked(audit)), sha.hexdigest(), "\n".join(line for lines in unlinked(said) for line in lines)


def unlinked(chain: tuple | None) -> list:
    out = []
    while chain is not None:
        chain, value = chain
        out.append(value)
    return out[::-1]


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired")
RESULT_TYPES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"
RESULT_ARROW = [*[pa.int64()] * 6, *[pa.string()] * 3]


ROW = {"turn": pa.int64(), "role": pa.string(), "text": pa.string(), "present": pa.bool_()}
PIECE_TYPES = (
    "part int, no int, first long, last long, distinct long, blank long, duplicate long, truncated long, illegal long,"
    " initials array<string>, roles array<string>, texts array<string>, through array<string>"
)
PIECE_ARROW = [*[pa.int32()] * 2, *[pa.int64()] * 7, *[pa.list_(pa.string())] * 4]


def batch_of(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def order(*more: str) -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("hash"), *map(F.col, more)]


def range_sorted(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumn("hash", F.xxhash64("role", "text"))
    return keyed.repartitionByRange(*order()).sortWithinPartitions(*order("role", "text"))


def inside(rows: DataFrame, texts: bool) -> DataFrame:
    """Results of conversations that lie whole inside a task; rows of all others as they are (``cost`` is null)."""
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, {RESULT_TYPES}, turn long, role string, text string, present boolean"
    none, no_row = [None] * len(RESULT), [None] * len(ROW)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, chars, is_open, out, types = None, [], 0, True, [], None
        for batch in batches:
            types = [batch.schema.field(0).type, *RESULT_ARROW, *ROW.values()]
            for conv, *row in rows_of([batch]):
                if current != (conv,):
                    if held:
                        result = whole([r[:3] for r in held if r[3]])
                        out.append((*current, *result[:-1], result[-1] if texts else None, *no_row))
                    # the first conversation of a task may have begun in another
                    is_open, current, held, chars = current is None, (conv,), [], 0
                held.append(row)
                chars += len(row[2])
                if is_open or len(held) > LONGEST or chars > LONGEST_CHARS:
                    out += ((conv, *none, *r) for r in held)
                    is_open, held = True, []
            if out:
                yield batch_of(out, types, schema)
                out = []
        if held:  # and the last may go on in another
            yield batch_of([(*current, *none, *r) for r in held], types, schema)

    return rows.select("conv", *ROW).mapInArrow(scan, schema)


def marked(rows: DataFrame) -> DataFrame:
    """Add ``again``: the same role and text stand at an earlier turn number."""
    rows = rows.withColumn("of", F.struct("conv")).withColumn(
        "said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    )
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    repeats = (
        rows.filter("present").groupBy("of", "said").agg(F.min(place).alias("earliest"), F.count("*").alias("times"))
        .filter("times > 1").drop("times")
    )
    joined = rows.join(repeats, ["of", "said"], "left")
    return joined.select("conv", *ROW, F.coalesce(F.col("earliest") < place, F.lit(False)).alias("again"))


def pieces(rows: DataFrame) -> DataFrame:
    """Turns of ``conv`` in runs of PIECE at most, with counts and the cheapest edits from each state to each state."""
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, {PIECE_TYPES}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, types = TaskContext.get().partitionId(), 0, None
        current, held, before = None, [], None

        def piece() -> tuple:
            faults, turns, initials = Faults(), [], [r[1][:1] for r in held if r[3]]
            for number, role, text, present, seen in held:
                if present:
                    turns.append(faults.turn(number, role, text, seen))
            through = []
            for end in range(4):
                search = Search(turns, end)  # ways to one end share its table
                for begin in range(4):
                    found = search(begin)
                    if found is not None:
                        through.append(f"{begin} {end} {found[0]} {found[1]}")
            return (
                *current, part, no, faults.first, faults.last, faults.distinct, *faults.counts()[1:],
                [*initials[:1], *initials[-1:]],
                [r[1] for r in held if r[3]], [r[2] for r in held if r[3]], through,
            )

        out = []
        for batch in batches:
            types = [batch.schema.field(0).type, *PIECE_ARROW]
            for conv, number, role, text, present, again in rows_of([batch]):
                if current != (conv,) or len(held) >= PIECE:
                    if held:
                        out.append(piece())
                        no += 1
                    held = []
                    if current != (conv,):
                        current, before = (conv,), None
                same = (number, role, text)
                held.append((number, role, text, present, again or present and same == before))
                before = same if present else before
            if out:
                yield batch_of(out, types, schema)
                out = []
        if held:
            yield batch_of([piece()], types, schema)

    return range_sorted(rows).select("conv", *ROW, "again").mapInArrow(scan, schema)


def joined(parts: DataFrame, texts: bool) -> DataFrame:
    """Results of conversations from their pieces, one after the other."""
    kind = parts.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, {RESULT_TYPES}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ways, counts, span, initial, types = None, None, None, None, None, None

        def result() -> tuple:
            cost, audit, sha, text = ways.finish()
            gaps = 0 if span[0] is None else span[1] - span[0] + 1 - span[2]
            return (*current, gaps, *counts, cost, audit, sha, text if texts else None)

        for batch in batches:
            types, out = [batch.schema.field(0).type, *RESULT_ARROW], []
            for conv, _, _, first, last, distinct, blank, duplicate, truncated, illegal, initials, roles, said, through in rows_of([batch]):
                if current != (conv,):
                    if current:
                        out.append(result())
                    current, ways, counts, span, initial = (conv,), Ways(texts), [0] * 4, [None, None, 0], None
                if first is not None:
                    span = [first if span[0] is None else span[0], last, span[2] + distinct - (first == span[1])]
                if initials:
                    illegal += initial is not None and initial + initials[0] not in ("su", "ua", "au")
                    initial = initials[1]
                counts = [x + y for x, y in zip(counts, (blank, duplicate, truncated, illegal))]
                steps = (w.split(" ") for w in through)
                ways.extend(list(zip(roles, said)), [(int(b), int(e), int(c), edits) for b, e, c, edits in steps])
            if out:
                yield batch_of(out, types, schema)
        if current:
            yield batch_of([result()], types, schema)

    return parts.repartition("conv").sortWithinPartitions("conv", "part", "no").mapInArrow(scan, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with damage by a checksum of conversation and turn number; dropped turns stay as rows, not ``present``."""
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(as_text[0], F.lit(":"), as_text[1]).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(as_text[3], ".!?", "")).otherwise(as_text[3])
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(as_text[2]).alias("role"),
        text.alias("text"), (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("_", "times")


def repair(turns: DataFrame, texts: bool = True) -> DataFrame:
    """One row per ``conv_id``: gaps, faults by kind, wrong neighbours, cost, audit, digest of the repaired text.

    With ``texts`` also the text, as ``repaired``; a conversation must then fit a row. Rows whose ``present``, if
    there is such a column, is false are no turns, but make their conversation known.
    """
    spark = turns.sparkSession
    small_batches(spark)
    blank = F.lit(" ")
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"), present.alias("present"),
    )
    first = written_once(inside(range_sorted(rows), texts), "repaired")
    parts = written_once(pieces(marked(first.filter("cost IS NULL").select("conv", *ROW))), "pieces")
    results = first.filter("cost IS NOT NULL").select("conv", *RESULT).unionByName(joined(parts, texts))
    results = results.withColumnRenamed("conv", "conv_id")
    return results if texts else results.drop("repaired")

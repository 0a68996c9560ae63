"""Repair of conversations: the cheapest edits that make turns alternate.

A conversation is well formed if the first letters of its roles read
``(s?(ua)+)?``. Rows may be kept, given the role that fits, or deleted, and empty
turns inserted; each edit has a cost and a letter, and of the cheapest repairs the
one whose letters come first in ASCII order is taken.

Both rules are one number. The weight of a repair holds its cost in the high
digits and its letters in digits of three bits below, the first letter on top and
zeros at the end, so the least integer is the cheapest repair with the least
letters. The rows, with the state that the roles before them have reached, form an
acyclic graph; the least weight of each node is found from the end with ``min`` on
integers alone (putting an edit in front adds its cost above and moves the letters
one digit down).

A state and a letter say what the next state is. So two repairs of a stretch that
ends in a row differ in a letter within it, and long conversations are solved block by block from the
end, with the cost of the rest in the high digits: integers stay short.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.llm.registry import query, table
from patchlight.session import written

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
FAULTS = [None, BLANK, DUPLICATE, TRUNCATED]
INITIALS = "sua"
RETAG, REMOVE, INSERT, UNFINISHED = 1, 2, 5, 5
#: Rows whose order numbers share a piece, and rows that one integer covers.
PIECE, BLOCK = 4096, 256
#: States: nothing yet, after s, after u, after a. The state after a role, the state after the role that fits, and that role.
AFTER = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
FITS = [2, 2, 3, 2]
WANTED = ["user", "user", "assistant", "user"]
CODES = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = " DIKR"
BITS = 3

Moves = list[tuple[str, int, int]]


def row_moves(state: int, initial: str, fault: str | None) -> Moves:
    """(letter, cost, next state) of the edits of a row."""
    moves = [("D", REMOVE, state)]
    if fault in (BLANK, DUPLICATE):
        return moves
    extra = UNFINISHED if fault == TRUNCATED else 0
    if initial in AFTER[state]:
        moves.append(("K", extra, AFTER[state][initial]))
    return [*moves, ("R", RETAG + extra, FITS[state])]


#: Moves of a row of each kind, by its code: number of the initial (3 for any other) plus 4 times that of the fault.
MOVES = [[row_moves(s, (INITIALS + "-")[code % 4], FAULTS[code // 4]) for s in range(4)] for code in range(16)]


class Weights:
    """Integers with a cost above ``width`` letters."""

    def __init__(self, width: int):
        self.shift, self.top = BITS * width, BITS * (width - 1)
        self.mask = (1 << self.shift) - 1

    def of(self, cost: int) -> int:
        return cost << self.shift

    def put(self, letter: str, cost: int, rest: int) -> int:
        """The weight of an edit and of what follows it."""
        return (((rest >> self.shift) + cost) << self.shift) | (CODES[letter] << self.top) | ((rest & self.mask) >> BITS)

    def read(self, weight: int) -> tuple[int, str]:
        text, at = [], self.top
        while at >= 0 and (digit := (weight >> at) & 7):
            text.append(LETTERS[digit])
            at -= BITS
        return weight >> self.shift, "".join(text)

    def with_inserts(self, best: list[int]) -> list[int]:
        """Least weights if up to two turns are put in first; more would come back to a state at a cost."""
        for _ in range(2):
            best = [min(best[s], self.put("I", INSERT, best[FITS[s]])) for s in range(4)]
        return best


def solve_block(codes: list[int], ends: list[int | None], last: bool) -> tuple[list[int], list[str]]:
    """Least cost and its letters from each state before the block; ``ends`` has the cost after it, None for no way."""
    n = len(codes)
    # Deleting all rows and two insertions bound the cost, and so the insertions.
    w = Weights(n + (REMOVE * n + 2 * INSERT) // INSERT + 4)
    never = w.of(1 << 62)
    best = [never if c is None else w.of(c) for c in ends]
    if last:
        best = w.with_inserts(best)
    for code in reversed(codes):
        kind = MOVES[code]
        best = w.with_inserts([min(w.put(letter, cost, best[to]) for letter, cost, to in kind[s]) for s in range(4)])
    found = [w.read(b) for b in best]
    return [c for c, _ in found], [letters for _, letters in found]


def solve(codes: list[int], block: int = BLOCK) -> tuple[int, str]:
    """Least cost and the letters of a conversation, given the codes of its rows."""
    costs: list[int | None] = [0, None, None, 0]
    parts = []
    for start in range((len(codes) - 1) // block * block, -1, -block):
        costs, letters = solve_block(codes[start : start + block], costs, not parts)
        parts.append((start, letters))
    if not parts:
        return 0, ""
    state, audit = 0, []
    for start, letters in reversed(parts):
        audit.append(letters[state])
        at = start
        for letter in letters[state]:
            if letter == "I":
                state = FITS[state]
            else:
                state = next(to for name, _, to in MOVES[codes[at]][state] if name == letter)
                at += 1
    return costs[0], "".join(audit)


def steps_of(codes: list[int], audit: str) -> list[str]:
    """What becomes of each row: u and a insert a turn, U and A are the row under another role, K the row, nothing if deleted.

    Inserted turns stand with the row after them, those at the end with the last row.
    """
    steps, state, now = [], 0, ""
    for letter in audit:
        wanted = WANTED[state][0]
        if letter == "I":
            now, state = now + wanted, FITS[state]
            continue
        state = next(to for name, _, to in MOVES[codes[len(steps)]][state] if name == letter)
        steps.append(now + {"K": "K", "R": wanted.upper(), "D": ""}[letter])
        now = ""
    steps[-1:] = [step + now for step in steps[-1:]]
    return steps


def legal_pairs(codes: list[int]) -> int:
    letters = "".join((INITIALS + "-")[c % 4] for c in codes)
    return sum(letters[i : i + 2] in ("su", "ua", "au") for i in range(len(letters) - 1))


def with_faults(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, turn, role, text, pos, piece, fault) of every row of rows(conv_id, turn, role, text).

    ``pos`` follows the order of turn (nulls first), role and text within a conversation, without
    gaps within a ``piece``. Null roles and texts are one space; a null conv_id is a
    conversation. A row's first fault counts: blank, duplicate (its role and text came
    before), truncated (its last character but spaces is none of ``.!?``). Rows are dealt
    by ranges, so a conversation of any length is spread over tasks.
    """
    space = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    plain = rows.select("conv_id", "turn", space("role"), space("text"))
    # Samples of the keys go to the driver: they hold the first characters of a text only.
    dealt = plain.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("pos", F.monotonically_increasing_id())
    ordered = written(ordered.withColumn("piece", F.floor(F.col("pos") / piece)).withColumn("mark", F.md5("text")), "turns")
    first = ordered.groupBy("conv_id", "role", "mark").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(F.col("first").isNull(), DUPLICATE).when(truncated, TRUNCATED)
    return ordered.join(first, "pos", "left").select("conv_id", "turn", "role", "text", "pos", "piece", fault.alias("fault"))


def edits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, n_rows, illegal, cost, audit, steps) of every conversation in ``with_faults`` rows.

    ``steps`` has for each piece its first pos and what becomes of each row, see
    ``steps_of``; ``illegal`` counts neighbours whose initials are none of su, ua, au. A
    task gets a conversation as one character for each row, without texts.
    """
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    of_initial = F.when((initial > 0) & (F.col("role") != ""), initial - 1).otherwise(3)
    number = F.when(F.col("fault").isNull(), 0)
    for k, name in enumerate(FAULTS[1:], 1):
        number = number.when(F.col("fault") == name, k)
    coded = rows.select("conv_id", "piece", "pos", F.lower(F.hex((of_initial + 4 * number).cast("long"))).alias("code"))
    pieces = coded.groupBy("conv_id", "piece").agg(
        F.min("pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda r: r["code"]), "").alias("codes")
    )
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "codes"))).alias("pieces"))

    numbers = [(c, pa.int64()) for c in ("conv_id", "n_rows", "illegal", "cost")]
    part = pa.struct([("first", pa.int64()), ("steps", pa.list_(pa.string()))])
    schema = pa.schema([*numbers, ("audit", pa.string()), ("steps", pa.list_(part))])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, held in zip(batch.column("conv_id").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                codes = [int(c, 16) for p in held for c in p["codes"]]
                cost, audit = solve(codes, block)
                steps, at, parts = steps_of(codes, audit), 0, []
                for p in held:
                    parts.append({"first": p["first"], "steps": steps[at : at + len(p["codes"])]})
                    at += len(p["codes"])
                out.append({"conv_id": conv_id, "n_rows": at, "illegal": at - 1 - legal_pairs(codes), "cost": cost, "audit": audit, "steps": parts})
            yield pa.RecordBatch.from_pylist(out, schema)

    kind = "conv_id long, n_rows long, illegal long, cost long, audit string, steps array<struct<first:long,steps:array<string>>>"
    return whole.mapInArrow(solved, kind)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, pos, part, role, text) of the repaired conversations, in the order of pos and part, from ``with_faults`` rows and their ``edits``."""
    each = found.select(F.explode("steps").alias("p")).select("p.first", F.posexplode("p.steps").alias("at", "step")).where("step <> ''")
    each = each.select((F.col("first") + F.col("at")).alias("pos"), "step")
    joined = rows.join(each, "pos").select("conv_id", "pos", "role", "text", F.posexplode(F.split("step", "")).alias("part", "what"))
    role = F.when(F.lower("what") == "u", "user").when(F.lower("what") == "a", "assistant").otherwise(F.col("role"))
    text = F.when(F.col("what").isin("u", "a"), "").otherwise(F.col("text"))
    return joined.select("conv_id", "pos", "part", role.alias("role"), text.alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults chosen by crc32 of ``conv_id:turn``; nulls are one space there and in role and text."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(kind == 4, "user").otherwise(word("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "copy")


def _at(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on conv_id, where null is a value."""
    other = right.withColumnRenamed("conv_id", "_conv")
    return left.join(other, left["conv_id"].eqNullSafe(other["_conv"]), "left").drop("_conv")


@query
def op11_conversation_repair(spark, sf_dir):
    """Faults, cheapest edits and repaired digest of every damaged conversation."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = written(with_faults(damaged(said)), "faults")
    found = written(edits(rows), "edits")
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")
    counts = rows.groupBy("conv_id").agg(gaps, count(BLANK), count(DUPLICATE), count(TRUNCATED))
    line = F.struct("pos", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda r: r["line"])
    digest = repaired(rows, found).groupBy("conv_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    out = _at(_at(_at(said.select("conv_id").distinct(), counts), found.drop("steps")), digest)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *map(number, ["gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost"]), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"), number("n_rows"),
    )

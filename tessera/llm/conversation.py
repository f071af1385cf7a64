"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

A conversation is a sequence of rows; its cheapest repair is a path through four states of a small automaton. The
cost of the rest of a path from each state is a vector of four numbers, and such vectors are kept only at
checkpoints: the ends of blocks of about the square root of the longest conversation. Between checkpoints they are
computed anew, block by block, while the path is walked forward. Blocks are cut from a sort by range, so that a
conversation of any length is spread over tasks; what stands for a block is a 4 x 4 matrix of costs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

#: What edits cost, and what a row without an end adds where it stays.
REROLE, DELETE, INSERT, UNENDED = 3, 4, 3, 3
#: White space, and the marks that end a text.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Blocks hold at least this many rows, so that short conversations are one block.
LEAST_BLOCK = 64

#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
#: What has to come next, by state: the state it leads to and the role.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = ("user", "user", "assistant", "user")
#: Where a row of a class (system, user, assistant, other) leads from each state, or -1.
_KEEP = ((SYSTEM, -1, -1, -1), (USER, USER, -1, USER), (-1, -1, ASSISTANT, -1), (-1, -1, -1, -1))
_FAR = 1 << 60
#: The cost of the rest at the end of a conversation: it may end before its first row or after an assistant's.
_END = (0, 2 * INSERT, INSERT, 0)


def _with_inserts(plain: list[int]) -> list[int]:
    """Costs from each state where rows may be put in first; three in a row never pay."""
    once = [min(plain[s], INSERT + plain[_NEXT[s]]) for s in _STATES]
    return [min(once[s], INSERT + once[_NEXT[s]]) for s in _STATES]


def _back(code: int, rest: list[int]) -> list[int]:
    """The costs from each state before a row, from those behind it. Code 0: the row has to go; else 1 + 2 x class + unended."""
    if not code:
        return _with_inserts([DELETE + c for c in rest])
    kind, unended = divmod(code - 1, 2)
    extra, keep = UNENDED * unended, _KEEP[kind]
    plain = []
    for s in _STATES:
        best = min(DELETE + rest[s], REROLE + extra + rest[_NEXT[s]])
        if keep[s] >= 0:
            best = min(best, extra + rest[keep[s]])
        plain.append(best)
    return _with_inserts(plain)


def _behind(codes: bytes, again: list[int], after: list[int]) -> list[list[int]]:
    """The cost vectors before each row of a block, and ``after`` at its end. ``again``: copies of a row, which have to go."""
    out = [after]
    for code, n in zip(reversed(codes), reversed(again)):
        rest = [n * DELETE + c for c in out[-1]] if n else out[-1]
        out.append(_back(code, rest))
    out.reverse()
    return out


def block_matrix(codes: bytes, again: list[int]) -> list[int]:
    """Costs from each state before a block to each state behind it, as 16 numbers, a row for each state behind."""
    unit = lambda t: _with_inserts([0 if s == t else _FAR for s in _STATES])
    return [c for t in _STATES for c in _behind(codes, again, unit(t))[0]]


def before_block(matrix: list[int], after: list[int]) -> list[int]:
    """The cost vector before a block from the one behind it."""
    return [min(matrix[4 * t + s] + after[t] for t in _STATES) for s in _STATES]


def walk(codes: bytes, again: list[int], after: list[int], state: int, last: bool) -> tuple[list[str], list[int], int]:
    """(edits of each row, state before each row, state behind the block): of the cheapest edits the ASCII-least.

    Tried are D, I, K and R in this order, and the first that keeps the cost tight is taken. Different edits of one
    initial do not exist, so the walk finds the least text. Rows put in at the end belong to the last row.
    """
    costs = _behind(codes, again, after)
    texts, states = [], []
    for i, (code, n) in enumerate(zip(codes, again)):
        rest = [n * DELETE + c for c in costs[i + 1]]
        kind, unended = divmod(code - 1, 2)
        extra = UNENDED * unended
        text = ""
        states.append(state)
        while True:
            left = costs[i][state]
            if DELETE + rest[state] == left:
                text += "D"
                break
            ahead = _NEXT[state]
            if INSERT + costs[i][ahead] == left:
                text, state = text + "I", ahead
                continue
            keep = _KEEP[kind][state]
            if keep >= 0 and extra + rest[keep] == left:
                text, state = text + "K", keep
            else:
                text, state = text + "R", ahead
            break
        texts.append(text + "D" * n)
        if last and i == len(codes) - 1:
            while costs[-1][state]:
                texts[-1], state = texts[-1] + "I", _NEXT[state]
    return texts, states, state


def apply(edits: str, state: int, role: str, text: str) -> Iterator[tuple[str, str]]:
    """The rows (role, text) that stand for one row after its edits."""
    for e in edits:
        if e == "K":
            yield role, text
            state = next((_KEEP[k][state] for k, r in enumerate("sua") if role.startswith(r)), state)
        elif e != "D":
            yield _ROLE[state], text if e == "R" else ""
            state = _NEXT[state]


# ------------------------------------------------------------------ rows to blocks


def _batches(rows: Iterator[list], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    kept: list = []
    for row in rows:
        kept.append(row)
        if len(kept) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in kept], schema)
            kept = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in kept], schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _mapped(df: DataFrame, rows, schema: str, arrow: pa.Schema) -> DataFrame:
    """``df`` through ``rows``, which takes an iterator of tuples and gives one; nothing but its own state is held."""
    return df.mapInArrow(lambda batches: _batches(rows(_rows(batches)), arrow), schema)


def _arrow(df: DataFrame, *more: tuple[str, pa.DataType]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([*to_arrow_schema(df.schema), *more])


def texts_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, content): null roles and texts as one space; ``content`` tells (role, text) apart."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), content.alias("content"))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, content, initial, n, fault, n_duplicate): the kinds of rows of each conversation and turn, with faults.

    ``n`` rows are equal. ``fault`` is that of the first of them: blank, duplicate, truncated or null; the others are
    duplicates where it is not blank. Rows are in the order of turn (nulls first), then content.
    """
    end = _trimmed(F.col("text"))
    kinds = texts_of(rows).select("conv_id", "turn", "content", F.left("role", F.lit(1)).alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(*ENDS)).alias("open"))
    counted = kinds.groupBy("conv_id", "turn", "content", "initial", "blank", "open").agg(F.count("*").alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    who = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    keyed = materialize(counted.select("*", at.alias("at"), F.sha2(F.concat(F.col("content"), who), 256).alias("key")), "conversation-rows")
    first = keyed.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("weight"))
    met = join_hot(keyed, materialize(first, "conversation-first"), "key", "weight")
    later = F.col("at") != F.col("first")
    fault = F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("open"), "truncated")
    again = F.when(F.col("blank"), 0).when(later, F.col("n")).otherwise(F.col("n") - 1)
    return met.select("conv_id", "turn", "content", "initial", "n", fault.alias("fault"), again.alias("n_duplicate"))


def _blocks(size: int):
    def run(rows: Iterator[tuple]) -> Iterator[list]:
        part, number, held, illegal, before = TaskContext.get().partitionId(), 0, [], 0, None

        def block() -> list:
            codes, again = bytes(r[4] for r in held), [r[5] for r in held]
            return [held[0][0], part, number, [r[1] for r in held], [r[2] for r in held], codes, again, block_matrix(codes, again), held[0][3], held[-1][3], illegal]

        for row in rows:  # (conv_id, turn, content, initial, code, again)
            if held and (held[0][0] != row[0] or len(held) == size):
                yield block()
                number, held, illegal, before = number + 1, [], 0, None
            illegal += row[5] + (before is not None and before + row[3] not in ("su", "ua", "au"))
            held.append(row)
            before = row[3]
        if held:
            yield block()

    return run


def _checkpoints(rows: Iterator[tuple]) -> Iterator[list]:
    """The cost vectors behind each block of a conversation, from its blocks' matrices; and what joins its blocks."""
    for _, own in groupby(rows, key=lambda r: r[0]):
        own = list(own)
        after, out = list(_END), []
        for k in range(len(own) - 1, -1, -1):
            conv, part, number, matrix, first, last, illegal = own[k]
            if k:
                illegal += own[k - 1][5] + first not in ("su", "ua", "au")
            before = before_block(matrix, after)
            out.append([conv, part, number, after, k == 0, k == len(own) - 1, illegal, before[START] if not k else None])
            after = before
        yield from reversed(out)


def _walks(rows: Iterator[tuple]) -> Iterator[list]:
    for conv, part, number, turns, contents, codes, again, after, is_first, is_last in rows:
        edits, states, ends = [], [], []
        for s in _STATES[:1] if is_first else _STATES:
            text, state, end = walk(codes, again, after, s, is_last)
            edits.append(text), states.append(state), ends.append(end)
        yield [conv, part, number, turns, contents, edits, states, ends]


def _entries(rows: Iterator[tuple]) -> Iterator[list]:
    """The state in which each block of a conversation is entered."""
    for _, own in groupby(rows, key=lambda r: r[0]):
        state = START
        for conv, part, number, ends in own:
            yield [part, number, state]
            state = ends[state] if len(ends) > 1 else ends[0]


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, edits) of rows (conv_id, turn, role, text).

    conversations: (conv_id, gaps, blank, duplicate, truncated, illegal, cost), a row for each conversation.
    edits: (conv_id, turn, content, part, block, at, edits, state), a row for each kind of row of a turn, with the
    initials of its edits, those before it first, and the state in which they begin; (part, block, at) is its place.
    """
    known = materialize(faults(rows), "conversation-faults")
    longest = known.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    size = max(LEAST_BLOCK, math.isqrt(longest) + 1)
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", 0, "u", 1, "a", 2)]), F.col("initial")), F.lit(3))
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    code = F.when(gone, 0).otherwise(1 + 2 * kind + F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int"))
    ordered = known.select("conv_id", "turn", "content", "initial", code.alias("code"), (F.col("n") - 1).alias("again"))
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "content"]
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by)
    conv, turn = known.schema["conv_id"].dataType.simpleString(), known.schema["turn"].dataType.simpleString()
    a_conv, a_turn = _arrow(known.select("conv_id")).field(0), _arrow(known.select("turn")).field(0).type
    longs, texts, place = pa.list_(pa.int64()), pa.list_(pa.string()), [("part", pa.int32()), ("block", pa.int64())]
    lists = [("turns", pa.list_(a_turn)), ("contents", texts)]
    blocks = materialize(
        _mapped(
            ordered, _blocks(size),
            f"conv_id {conv}, part int, block long, turns array<{turn}>, contents array<string>, codes binary, again array<long>, matrix array<long>, first string, last string, illegal long",
            pa.schema([a_conv, *place, *lists, ("codes", pa.binary()), ("again", longs), ("matrix", longs), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())]),
        ),
        "conversation-blocks",
    )
    in_order = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    points = materialize(
        _mapped(
            in_order(blocks.select("conv_id", "part", "block", "matrix", "first", "last", "illegal")), _checkpoints,
            f"conv_id {conv}, part int, block long, after array<long>, is_first boolean, is_last boolean, illegal long, cost long",
            pa.schema([a_conv, *place, ("after", longs), ("is_first", pa.bool_()), ("is_last", pa.bool_()), ("illegal", pa.int64()), ("cost", pa.int64())]),
        ),
        "conversation-checkpoints",
    )
    met = blocks.select("conv_id", "part", "block", "turns", "contents", "codes", "again").join(points.select("part", "block", "after", "is_first", "is_last"), ["part", "block"])
    walked = materialize(
        _mapped(
            met.select("conv_id", "part", "block", "turns", "contents", "codes", "again", "after", "is_first", "is_last"), _walks,
            f"conv_id {conv}, part int, block long, turns array<{turn}>, contents array<string>, edits array<array<string>>, states array<array<long>>, ends array<long>",
            pa.schema([a_conv, *place, *lists, ("edits", pa.list_(texts)), ("states", pa.list_(longs)), ("ends", longs)]),
        ),
        "conversation-walks",
    )
    several = points.filter("NOT (is_first AND is_last)").select("part", "block")
    chain = in_order(walked.select("conv_id", "part", "block", "ends").join(several, ["part", "block"], "left_semi").select("conv_id", "part", "block", "ends"))
    entries = _mapped(chain, _entries, "part int, block long, entry long", pa.schema([*place, ("entry", pa.int64())]))
    own = F.least(F.coalesce("entry", F.lit(0)), F.size("ends") - 1).cast("int") + 1
    taken = walked.join(entries, ["part", "block"], "left").select(
        "conv_id", "part", "block", F.posexplode(F.arrays_zip("turns", "contents", F.element_at("edits", own).alias("edits"), F.element_at("states", own).alias("states"))).alias("at", "x")
    )
    edits = taken.select("conv_id", F.col("x.turns").alias("turn"), F.col("x.contents").alias("content"), "part", "block", "at", F.col("x.edits").alias("edits"), F.col("x.states").alias("state"))
    per_turn = known.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum("n_duplicate").alias("duplicate"),
        F.sum((F.coalesce(F.col("fault") == "truncated", F.lit(False))).cast("long")).alias("truncated"),
    )
    wide = "decimal(38,0)"
    span = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count("turn").cast(wide)
    stats = per_turn.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).try_cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    costs = points.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
    joined = stats.alias("s").join(costs.alias("c"), F.expr("s.conv_id <=> c.conv_id")).select("s.*", "c.illegal", "c.cost")
    return joined, edits


def _row_key() -> Column:
    """One key of a kind of row, so that texts are grouped and joined by the same shuffle."""
    shown = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    return F.sha2(F.concat(F.col("content"), shown("turn"), F.lit(" "), shown("conv_id")), 256)


def _with_texts(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with the role and text they are made to; equal rows of a turn count once."""
    texts = texts_of(rows).select(_row_key().alias("row"), "role", "text").groupBy("row").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return texts.join(edits.withColumn("row", _row_key()), "row").select("conv_id", "part", "block", "at", "role", "text", "edits", "state")


def repaired_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, part, block, at, k, role, text): the rows of the repaired conversations, ordered by (part, block, at, k).

    Spread over tasks by row, however long a conversation is.
    """
    found = _with_texts(rows, edits)

    def run(given: Iterator[tuple]) -> Iterator[list]:
        for conv, part, block, at, role, text, done, state in given:
            for k, (r, t) in enumerate(apply(done, state, role, text)):
                yield [conv, part, block, at, k, r, t]

    head = found.select("conv_id", "part", "block", "at")
    kind = found.schema["conv_id"].dataType.simpleString()
    return _mapped(found, run, f"conv_id {kind}, part int, block long, at int, k long, role string, text string", _arrow(head, ("k", pa.int64()), ("role", pa.string()), ("text", pa.string())))


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): the initials of all edits, and the SHA-256 of ``role:text`` lines, by conversation.

    A digest runs over a conversation from end to end, so its rows pass one task, as a sorted stream of which only one
    batch is held.
    """
    found = _with_texts(rows, edits)
    found = found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "at")

    def run(given: Iterator[tuple]) -> Iterator[list]:
        for conv, own in groupby(given, key=lambda r: r[0]):
            sha, audit, some = hashlib.sha256(), [], False
            for _, _, _, _, role, text, done, state in own:
                audit.append(done)
                for r, t in apply(done, state, role, text):
                    sha.update(f"{chr(10) if some else ''}{r}:{t}".encode("utf-8", "surrogatepass"))
                    some = True
            yield [conv, "".join(audit), sha.hexdigest()]

    kind = found.schema["conv_id"].dataType.simpleString()
    return _mapped(found, run, f"conv_id {kind}, audit string, repaired_sha256 string", _arrow(found.select("conv_id"), ("audit", pa.string()), ("repaired_sha256", pa.string())))


def repair(rows: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """What is wrong with each conversation and its cheapest repair: a row for each conv_id of ``rows`` and ``all_ids``.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows (conv_id, turn,
    role, text) stand in the order of their turns, nulls first, and of equal turns by a digest of role and text. The
    first fault of a row counts: blank, duplicate of an earlier row of the conversation (role and text), or without
    an end mark. Keep costs 0, Rerole 3, Delete 4 (blank and duplicate rows have to go), Insert of an empty row 3; an
    unended row that stays adds 3. The result's role initials are ``(s?(ua)+)?``.

    Null roles and texts count as one space. A null conv_id is one conversation. Conversations of ``all_ids`` without
    rows: zeros, empty audit, digest of nothing. Extra columns are ignored. ``rows`` is read twice and should give the
    same rows each time.
    """
    stats, edits = plan(rows)
    made = digests(rows, edits)
    found = stats.alias("s").join(made.alias("d"), F.expr("s.conv_id <=> d.conv_id")).select("s.*", "d.audit", "d.repaired_sha256")
    if all_ids is None:
        return found
    ids = all_ids.select("conv_id").distinct().alias("i")
    zero = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return ids.join(found.alias("f"), F.expr("i.conv_id <=> f.conv_id"), "left").select(
        "i.conv_id", *zero, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )

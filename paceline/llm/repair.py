"""Conversation structure repair: the cheapest edits that make roles alternate.

The turns of a conversation are symbols of role and fault. Equal symbols on end are one run. Cost
is a min-plus recurrence over four states, so a run is one matrix to the power of its length: powers
of two of it are cached and advance a run in as many steps as its length has digits. The choices are
unrolled from these by halves, which are cached as well.

Conversations are cut into chunks of bounded size. A chunk is a matrix as a run is, so chunks of one
conversation are worked on apart from each other, and only their matrices meet.
"""

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from paceline.session import saved

#: Costs of the edits; a truncated turn that stays costs MEND more.
DELETE, INSERT, REROLE, MEND = 4, 3, 3, 3
#: States: nothing yet, after the system turn, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Symbols: twice the class of the role, 1 more if truncated; a turn that has to go is one of its own.
CLASSES = {"s": 0, "u": 1, "a": 2}
OTHER, GONE = 3, 8
#: Rows of a chunk.
CHUNK = 1 << 16
WHITE = " \t\n\x0b\x0c\r"
FAR = 1 << 60
NAMES = {USER: "user", ASSISTANT: "assistant"}
DONE = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def after_insert(state: int) -> int:
    """The state after a turn whose role can be chosen."""
    return ASSISTANT if state == USER else USER


def after_keep(state: int, role: int) -> int | None:
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if role == 2 and state == USER else None


def product(a: Matrix, b: Matrix) -> Matrix:
    columns = list(zip(*b, strict=True))
    return tuple(
        tuple(min(FAR, *(x + y for x, y in zip(row, col, strict=True))) for col in columns) for row in a
    )


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in a)


@lru_cache(maxsize=None)
def transition(symbol: int) -> Matrix:
    """Least cost from each state before a turn to each one after it, insertions before it included."""
    role, mend = symbol // 2, MEND * (symbol % 2)
    out = []
    for start in range(4):
        row, state, spent = [FAR] * 4, start, 0
        for _ in range(3):  # a third insertion would come back to a state that is cheaper without
            row[state] = min(row[state], spent + DELETE)
            if symbol != GONE:
                kept, chosen = after_keep(state, role), after_insert(state)
                if kept is not None:
                    row[kept] = min(row[kept], spent + mend)
                row[chosen] = min(row[chosen], spent + REROLE + mend)
            state, spent = after_insert(state), spent + INSERT
        out.append(tuple(row))
    return tuple(out)


@lru_cache(maxsize=4096)
def power(symbol: int, digit: int) -> Matrix:
    """The transition of 2 ** digit equal turns."""
    if not digit:
        return transition(symbol)
    half = power(symbol, digit - 1)
    return product(half, half)


def digits(count: int) -> list[int]:
    return [d for d in range(count.bit_length()) if count >> d & 1]


def matrix_of(runs: Iterable[tuple[int, int]]) -> Matrix:
    out = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
    for symbol, count in runs:
        for digit in digits(count):
            out = product(out, power(symbol, digit))
    return out


def level(v: Vector) -> Vector:
    least = min(v)
    return tuple(x - least for x in v)


@lru_cache(maxsize=1 << 16)
def unrolled(symbol: int, digit: int, ahead: Vector, state: int) -> tuple[str, int]:
    """Edits of 2 ** digit equal turns, of the cheapest the least, and the state they end in.

    ahead is what remains to be paid after them from each state, up to a constant.
    """
    if digit:
        middle = level(applied(power(symbol, digit - 1), ahead))
        first, state = unrolled(symbol, digit - 1, middle, state)
        second, state = unrolled(symbol, digit - 1, ahead, state)
        return first + second, state
    before, edits = applied(transition(symbol), ahead), ""
    role, mend = symbol // 2, MEND * (symbol % 2)
    while True:  # edits in the order of their letters
        if DELETE + ahead[state] == before[state]:
            return edits + "D", state
        chosen = after_insert(state)
        if INSERT + before[chosen] == before[state]:
            edits, state = edits + "I", chosen
            continue
        kept = after_keep(state, role)
        if kept is not None and mend + ahead[kept] == before[state]:
            return edits + "K", kept
        return edits + "R", chosen


@lru_cache(maxsize=1 << 16)
def edits_of(
    runs: tuple[tuple[int, int], ...], ahead: Vector, state: int, last: bool
) -> tuple[tuple[tuple[str, int], ...], int]:
    """(edits, times) of a chunk that is entered in a state, and the state it ends in."""
    ends = []
    for symbol, count in reversed(runs):
        for digit in digits(count):  # from the right: the last turns first
            ends.append((symbol, digit, level(ahead)))
            ahead = applied(power(symbol, digit), ahead)
    out: list[tuple[str, int]] = []
    for symbol, digit, then in reversed(ends):
        if symbol == GONE:
            out.append(("D", 1 << digit))  # insertions can wait until after it
        else:
            text, state = unrolled(symbol, digit, then, state)
            out.append((text, 1))
    while last and DONE[state]:
        out.append(("I", 1))
        state = after_insert(state)
    return tuple(out), state


def collapsed(symbols: Iterable[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    """Runs of (symbol, copies) of turns; all copies of a turn but the first have to go."""
    runs: list[list[int]] = []
    for symbol, copies in symbols:
        for one, count in ((symbol, 1), (GONE, copies - 1)):
            if copies and count:
                if runs and runs[-1][0] == one:
                    runs[-1][1] += count
                else:
                    runs.append([one, count])
    return tuple(map(tuple, runs))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns as (conv_id, turn, role, text, copies) with faults that their ids choose.

    By the remainder of crc32 of ``conv_id:turn`` to 20: 0 drops the turn (no copies), 1 empties
    its text, 2 takes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it the user's. A null role or text
    becomes one space, and so does a null id in the hash; conv_id and turn stay null.
    """

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    chosen = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    return turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), chosen.alias("f")).select(
        "conv_id",
        "turn",
        F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("f") == 1, "")
        .when(F.col("f") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("f") == 0, 0).when(F.col("f") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def ordered(turns: DataFrame) -> DataFrame:
    """Distinct turns with their place ``at`` in the order of conversations, and their symbols.

    Turns are in the order of turn, nulls first; of one turn in that of role and hash of the text,
    so equal turns stand together. Ranges of this order are dealt to tasks: a long conversation
    goes to many.
    """
    counted = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = ["conv_id", "turn", "role", "digest"]
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    role = F.lit(OTHER)
    for letter, number in CLASSES.items():
        role = F.when(initial == letter, number).otherwise(role)
    placed = saved(
        counted.withColumns(
            {
                "digest": F.unhex(F.sha2("text", 256)),
                "class": role,
                "blank": F.length(body) == 0,
                "open": ~F.substring(body, -1, 1).isin(".", "!", "?"),
            }
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    first = (
        placed.where("copies > 0")
        .groupBy("conv_id", "role", "digest")
        .agg(F.min("at").alias("at"))
        .select("at", F.lit(True).alias("first"))
    )
    fault = (
        F.when(F.col("copies") == 0, None)
        .when(F.col("blank"), "blank")
        .when(F.col("first").isNull(), "duplicate")
        .when(F.col("open"), "truncated")
    )
    return (
        placed.join(first, "at", "left")
        .withColumns({"fault": fault, "chunk": F.floor(F.col("at") / CHUNK)})
        .withColumn(
            "symbol",
            F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(
                2 * F.col("class") + F.when(F.col("fault") == "truncated", 1).otherwise(0)
            ),
        )
        .select("conv_id", "chunk", "at", "turn", "role", "text", "copies", "class", "fault", "symbol")
    )


def named(rows: DataFrame, text: str) -> str:
    """A schema text that begins with the conversation's id, of whatever type."""
    return f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {text}"


def batch_of(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in like]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, like, strict=True)], schema=like
    )


def output(found: Iterator[tuple], like: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in found:
        held.append(row)
        if len(held) == size:
            yield batch_of(held, like)
            held = []
    yield batch_of(held, like)


VECTOR = pa.list_(pa.int64())
EDITS = pa.list_(pa.struct([("edits", pa.string()), ("times", pa.int64())]))


def chunk_edits(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, entry, edits): the edits of each chunk of ordered turns, as (edits, times),
    and the state in which it is entered."""
    id_type = to_arrow_type(turns.schema["conv_id"].dataType)
    grouped = (
        turns.where("copies > 0")
        .groupBy("conv_id", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("at", "symbol", "copies"))).alias("turns"))
    )
    schema_a = pa.schema(
        [("conv_id", id_type), ("chunk", pa.int64()), ("symbols", VECTOR), ("counts", VECTOR), ("matrix", VECTOR)]
    )

    def matrices(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                runs = collapsed((t["symbol"], t["copies"]) for t in row["turns"])
                flat = [x for line in matrix_of(runs) for x in line]
                found.append((row["conv_id"], row["chunk"], [s for s, _ in runs], [c for _, c in runs], flat))
            yield batch_of(found, schema_a)

    chunks = saved(
        grouped.mapInArrow(
            matrices,
            named(turns, "chunk long, symbols array<long>, counts array<long>, matrix array<long>"),
        )
    )
    schema_b = pa.schema(
        [("conv_id", id_type), ("chunk", pa.int64()), ("ahead", VECTOR), ("first", pa.bool_()), ("last", pa.bool_())]
    )

    def costs(batches):
        """What remains to be paid after each chunk, chunks of a conversation from the last one on."""

        def walk():
            held, ahead = None, DONE
            for batch in batches:
                for row in batch.to_pylist():
                    last = held is None or held[0] != row["conv_id"]
                    if held is not None:
                        yield (*held[:3], last, held[3])
                    ahead = DONE if last else ahead
                    held = (row["conv_id"], row["chunk"], list(ahead), last)
                    flat = row["matrix"]
                    ahead = applied(tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4)), ahead)
            if held is not None:
                yield (*held[:3], True, held[3])

        yield from output(walk(), schema_b)

    ahead = (
        chunks.select("conv_id", "chunk", "matrix")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("chunk"))
        .mapInArrow(costs, named(turns, "chunk long, ahead array<long>, first boolean, last boolean"))
    )
    schema_c = pa.schema(
        [("conv_id", id_type), ("chunk", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("edits", EDITS)]
    )

    def options(batches):
        """The edits from every state in which a chunk may be entered."""
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                runs = tuple(zip(row["symbols"], row["counts"], strict=True))
                for entry in (START,) if row["first"] else range(4):
                    edits, leave = edits_of(runs, level(tuple(row["ahead"])), entry, row["last"])
                    pairs = [{"edits": e, "times": n} for e, n in edits]
                    found.append((row["conv_id"], row["chunk"], entry, leave, pairs))
            yield batch_of(found, schema_c)

    each = saved(
        chunks.alias("a")
        .join(ahead.alias("b"), F.expr("a.conv_id <=> b.conv_id and a.chunk = b.chunk"))
        .select("a.conv_id", "a.chunk", "symbols", "counts", "ahead", "first", "last")
        .mapInArrow(
            options,
            named(turns, "chunk long, entry int, exit int, edits array<struct<edits: string, times: long>>"),
        )
    )
    schema_d = pa.schema([("conv_id", id_type), ("chunk", pa.int64()), ("entry", pa.int32())])

    def choices(batches):
        """The state in which each chunk is entered, chunks in order."""

        def walk():
            conv, chunk, state, leave = (), None, START, START
            for batch in batches:
                for row in batch.to_pylist():
                    if (row["conv_id"],) != conv:
                        conv, chunk, leave = (row["conv_id"],), None, START
                    if row["chunk"] != chunk:
                        chunk, state = row["chunk"], leave
                    if row["entry"] == state:
                        leave = row["exit"]
                        yield row["conv_id"], row["chunk"], state

        yield from output(walk(), schema_d)

    taken = (
        each.select("conv_id", "chunk", "entry", "exit")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "chunk", "entry")
        .mapInArrow(choices, named(turns, "chunk long, entry int"))
    )
    same = "a.conv_id <=> b.conv_id and a.chunk = b.chunk and a.entry = b.entry"
    return each.alias("a").join(taken.alias("b"), F.expr(same)).select("a.conv_id", "a.chunk", "a.entry", "edits")


class Cursor:
    """Edits of a chunk, one at a time."""

    def __init__(self, pieces: list[dict]):
        self.pieces = [[p["edits"], p["times"]] for p in pieces if p["edits"] and p["times"]]
        self.piece, self.letter = 0, 0

    def peek(self) -> str:
        return self.pieces[self.piece][0][self.letter] if self.piece < len(self.pieces) else ""

    def take(self) -> str:
        edit, piece = self.peek(), self.pieces[self.piece]
        self.letter += 1
        if self.letter == len(piece[0]):
            self.letter, piece[1] = 0, piece[1] - 1
            self.piece += not piece[1]
        return edit

    def skip(self, count: int) -> None:
        """Pass so many deletions."""
        while count:
            piece = self.pieces[self.piece]
            if len(piece[0]) > 1:
                self.take()
                count -= 1
                continue
            step = min(count, piece[1])
            piece[1], count = piece[1] - step, count - step
            self.piece += not piece[1]


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row, edit, times, role, text) of every edit, in order.

    Rows come in the order of (conv_id, chunk, kind, at): the edits of a chunk, then its turns. An
    insertion at the end comes with the last turn. A turn without copies gives its row and no edit.
    """
    cursor, state, before = Cursor([]), START, None

    def insertions(row):
        nonlocal state
        while cursor.peek() == "I":
            cursor.take()
            state = after_insert(state)
            yield row, "I", 1, NAMES[state], ""

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if before is not None:
                    yield from insertions(before)
                cursor, state, before = Cursor(row["edits"]), row["entry"], None
                continue
            if not row["copies"]:
                yield row, "", 0, None, None
                continue
            yield from insertions(row)
            edit, role = cursor.take(), None
            if edit == "K":
                state, role = after_keep(state, row["class"]), row["role"]
            elif edit == "R":
                state = after_insert(state)
                role = NAMES[state]
            yield row, edit, 1, role, row["text"] if role is not None else None
            if row["copies"] > 1:
                cursor.skip(row["copies"] - 1)
                yield row, "D", row["copies"] - 1, None, None
            before = row
    if before is not None:
        yield from insertions(before)


def edit_stream(turns: DataFrame, *by: str) -> DataFrame:
    """Ordered turns and the edits of their chunks, rows with equal ``by`` in one task and in order."""
    turns = saved(turns)
    edits = chunk_edits(turns).select("conv_id", "chunk", F.lit(0).alias("kind"), "entry", "edits")
    both = turns.withColumn("kind", F.lit(1)).unionByName(edits, allowMissingColumns=True)
    return both.repartition(*by).sortWithinPartitions("conv_id", "chunk", "kind", "at")


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, at, step, edit, times, role, text): the edits, and so the repaired conversations.

    turns are (conv_id, turn, role, text) and may have ``copies``, how often each counts; other
    columns are left out. A null role or text counts as one space, rows with a null conv_id are one
    conversation. edit is K (kept), R (other role), I (inserted, empty text) or D (deleted, role and
    text are null; ``times`` copies). ``at`` and ``step`` give the order. Each chunk of a
    conversation is a group of its own, so a long one is edited by many tasks.
    """
    rows = edit_stream(ordered(tidy(turns)), "conv_id", "chunk")
    like = pa.schema(
        [
            ("conv_id", to_arrow_type(turns.schema["conv_id"].dataType)),
            ("at", pa.int64()),
            ("step", pa.int32()),
            ("edit", pa.string()),
            ("times", pa.int64()),
            ("role", pa.string()),
            ("text", pa.string()),
        ]
    )

    def run(batches):
        def walk():
            at, step = None, 0
            for row, edit, times, role, text in edited(batches):
                if times:
                    step = step + 1 if row["at"] == at else 0
                    at = row["at"]
                    yield row["conv_id"], at, step, edit, times, role, text

        yield from output(walk(), like)

    return rows.mapInArrow(
        run, named(turns, "at long, step int, edit string, times long, role string, text string")
    )


def tidy(turns: DataFrame) -> DataFrame:
    return turns.select(
        "conv_id",
        "turn",
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        (F.col("copies") if "copies" in turns.columns else F.lit(1)).cast("long").alias("copies"),
    )


def repairs(turns: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cost of the repair, the edits and a digest.

    turns as for :func:`repaired`; a conversation all of whose turns have no copies has zeros, an
    empty audit and the digest of an empty text. No rows give none. gaps are the numbers missing
    between the first and the last turn, 0 if all are null. A digest goes over the repaired text
    from start to end, so this last pass reads a conversation in one task, as a stream; its edits
    have been found before, in many. audit is one string, which bounds a conversation to 2 ** 31 edits.
    """
    rows = edit_stream(ordered(tidy(turns)), "conv_id")
    like = pa.schema(
        [("conv_id", to_arrow_type(turns.schema["conv_id"].dataType))]
        + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def run(batches):
        def walk():
            report = None
            for row, edit, times, role, text in edited(batches):
                if report is None or report.conv != row["conv_id"]:
                    if report is not None:
                        yield report.row()
                    report = Report(row["conv_id"])
                report.add(row, edit, times, role, text)
            if report is not None:
                yield report.row()

        yield from output(walk(), like, 500)

    return rows.mapInArrow(
        run,
        named(
            turns,
            "gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
            " audit string, repaired_sha256 string",
        ),
    )


class Report:
    """Counts of one conversation whose edits come in order."""

    def __init__(self, conv):
        self.conv, self.faults, self.illegal, self.cost = conv, {}, 0, 0
        self.at = self.role = self.low = self.turn = None
        self.turns, self.audit, self.lines, self.sha = 0, [], 0, hashlib.sha256()

    def add(self, row, edit, times, role, text):
        if row["copies"] and row["at"] != self.at:
            self.at = row["at"]
            self.meet(row)
        self.audit.append(edit * times)
        mend = MEND if row["fault"] == "truncated" and edit in "KR" else 0
        self.cost += times * {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT, "": 0}[edit] + mend
        if role is not None:
            self.sha.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.lines += 1

    def meet(self, row):
        """Count a turn with all its copies."""
        for fault, count in ((row["fault"], 1), ("blank" if row["fault"] == "blank" else "duplicate", row["copies"] - 1)):
            self.faults[fault] = self.faults.get(fault, 0) + count
        if self.role is not None:
            self.illegal += (self.role, row["class"]) not in ((0, 1), (1, 2), (2, 1))
        self.illegal += row["copies"] - 1
        self.role = row["class"]
        if row["turn"] is not None and row["turn"] != self.turn:
            self.low = row["turn"] if self.low is None else self.low
            self.turn, self.turns = row["turn"], self.turns + 1

    def row(self):
        gaps = 0 if self.turn is None else self.turn - self.low + 1 - self.turns
        found = [self.faults.get(f, 0) for f in ("blank", "duplicate", "truncated")]
        return self.conv, min(gaps, 2**63 - 1), *found, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()

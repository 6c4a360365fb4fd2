"""Conversation structure repair with Four-Russians block tables.

A conversation is a sequence of rows, each reduced to one symbol: the initial of its role (s,
u, a or another), whether it is truncated, or that it must go (blank or repeated). The cheapest
edits that make the initials read ``(s?(ua)+)?`` come from a dynamic program over four states
(start, after s, after u, after a) whose costs-to-go form a vector. Vectors, less their
smallest entry, take few values, so the step over every block of ``BLOCK`` symbols is computed
once, from each such vector: a conversation is then worked off from its end by lookups, one a
block. The edits are read from its beginning: each block is expanded backward from the vector at
its right border and walked with the ASCII-least edit among the cheapest, which makes ties safe.

Rows are dealt out by ranges of (conversation, turn, role, text) and packed into pieces of
bounded size. A conversation that lies in one piece is finished where it is. Of longer ones,
pieces exchange only prints of rows, block-table steps and entry states; texts move once more,
in order, to the task that streams a conversation's digest. SHA-256 is sequential, so that task
passes over one conversation, holding one batch of rows at a time.

Nulls: a null role or text counts as one space (so such a text is blank); null turns come first
and do not count for gaps; a null conv_id is a conversation of its own. Rows of equal turn are
ordered by role, then text (bytes). Empty texts are blank. Repeated rows are duplicates. Very
long texts fill a piece alone. Empty tables give no rows; other columns are not read. Gaps beyond
a long are given as the greatest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import Cache, columns_as, map_rows, once_per_worker
from fleetpulse.session import stage

#: Symbols of a block in the tables.
BLOCK = 4
#: A piece ends after so many rows, or once its texts have so many characters.
PIECE_ROWS, PIECE_CHARS = 512, 2**20

# Costs of edits, roles of inserted and re-roled rows, white space, ends of sentences.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
USER, ASSISTANT = "user", "assistant"
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after an inserted or re-roled row, by the state before it.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
#: The state after a kept row, by (state, initial); None where it must not be kept.
_KEEP = (
    (_SYSTEM, _USER, None, None),
    (None, _USER, None, None),
    (None, None, _ASSISTANT, None),
    (None, _USER, None, None),
)
_INITIALS = {"s": 0, "u": 1, "a": 2}
_OTHER = 3
_NONE, _BLANK, _DUPLICATE, _CUT = range(4)
_GONE, _SYMBOLS = 8, 9
_LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
_MOST = 2**63 - 1


def _symbol(mark: int) -> int:
    """A row's symbol from its mark, which is its initial plus four times its fault."""
    fault, initial = divmod(mark, 4)
    return _GONE if fault in (_BLANK, _DUPLICATE) else initial + (4 if fault == _CUT else 0)


class Tables:
    """Reachable normalised vectors and the block steps between them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors: list[tuple[int, ...]] = []
        self._ids: dict[tuple[int, ...], int] = {}
        self.end = self._id(self._closed([0, 10**6, 10**6, 0]))
        steps = []
        for vector in self.vectors:  # grows while new vectors are found
            steps.append([self._id(self.before(vector, symbol)) for symbol in range(_SYMBOLS)])
        self.one = np.array(steps)
        # A block's number has its first symbol in the highest place; its last one acts first.
        table = self.one
        for _ in range(block - 1):
            table = self.one[table].transpose(0, 2, 1).reshape(len(steps), -1)
        self.whole = table
        self._expanded = Cache(lambda key: self._expand(*key))

    def _id(self, vector: list[int]) -> int:
        key = tuple(v - min(vector) for v in vector)
        if key not in self._ids:
            self._ids[key] = len(self.vectors)
            self.vectors.append(key)
        return self._ids[key]

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        """Costs once rows may also be inserted first."""
        user = min(costs[_USER], INSERT + costs[_ASSISTANT])
        assistant = min(costs[_ASSISTANT], INSERT + costs[_USER])
        return [min(costs[_START], INSERT + user), min(costs[_SYSTEM], INSERT + user), user, assistant]

    def before(self, vector: tuple[int, ...], symbol: int) -> list[int]:
        """Costs-to-go before a row, from those after it."""
        return self._closed([min(c for _, c, _ in moves(vector, symbol, s)) for s in range(4)])

    def codes(self, marks: bytes) -> list[tuple[int, ...]]:
        """The blocks of a piece; the first may be short."""
        symbols = [_symbol(m) for m in marks]
        first = len(symbols) % self.block
        cuts = [0] * (first > 0) + list(range(first, len(symbols), self.block))
        return [tuple(symbols[a:b]) for a, b in zip(cuts, [*cuts[1:], len(symbols)], strict=False)]

    def step(self, vector, code: tuple[int, ...]):
        """The vector before a block; ``vector`` may be an array of all of them."""
        if len(code) < self.block:
            for symbol in reversed(code):
                vector = self.one[vector, symbol]
            return vector
        number = 0
        for symbol in code:
            number = number * _SYMBOLS + symbol
        return self.whole[vector, number]

    def walk(self, marks: bytes, tail: int, state: int, last: bool) -> tuple[str, int]:
        """The least cheapest edits of a piece from ``state`` on, and the state after them."""
        blocks, borders = self.codes(marks), [tail]
        for code in reversed(blocks):
            borders.append(int(self.step(borders[-1], code)))
        edits = []
        for code, right in zip(blocks, reversed(borders[:-1]), strict=True):
            text, state = self._expanded[code, right, state]
            edits.append(text)
        while last and state not in (_START, _ASSISTANT):
            edits.append("I")
            state = _NEXT[state]
        return "".join(edits), state

    def _expand(self, code: tuple[int, ...], right: int, state: int) -> tuple[str, int]:
        after = [list(self.vectors[right])]
        for symbol in reversed(code):
            after.append(self.before(tuple(after[-1]), symbol))
        after.reverse()
        edits = []
        for i, symbol in enumerate(code):
            while True:
                here, going = after[i], moves(after[i + 1], symbol, state)
                inserted = _NEXT[state]
                options = [*going, ("I", INSERT + here[inserted], inserted)]
                edit, _, state = min(o for o in options if o[1] == here[state])
                edits.append(edit)
                if edit != "I":
                    break
        return "".join(edits), state


def moves(after, symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits that use up a row: letter, cost to go with it, state after it."""
    found = [("D", DELETE + after[state], state)]
    if symbol != _GONE:
        cut, initial = divmod(symbol, 4)
        kept, toll = _KEEP[state][initial], TRUNCATED * cut
        if kept is not None:
            found.append(("K", toll + after[kept], kept))
        found.append(("R", REROLE + toll + after[_NEXT[state]], _NEXT[state]))
    return found


def tables() -> Tables:
    return once_per_worker("conversation-tables", Tables)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its
    text, 2 takes out its sentence ends, 3 repeats it, 4 makes the user its role. A dropped row
    stays as a mark (``live`` false), so that its conversation stays known."""
    named = columns_as(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    rows = named.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    made = rows.withColumn("_kind", kind).select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") != 0, F.when(F.col("_kind") == 4, USER).otherwise(F.col("role"))).alias("role"),
        F.when(
            F.col("_kind") != 0,
            F.when(F.col("_kind") == 1, "")
            .when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")),
        ).alias("text"),
        (F.col("_kind") != 0).alias("live"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
    )
    return made.drop("_copy")


def _initial(role: str) -> int:
    return _INITIALS.get(role[:1], _OTHER)


class _Piece:
    def __init__(self, conv_id, no: int, opens: bool):
        self.conv_id, self.no, self.opens = conv_id, no, opens
        self.turns, self.roles, self.texts, self.marks, self.prints = [], [], [], [], []
        self.seen, self.size = set(), 0

    def add(self, turn, role: str, text: str) -> None:
        said = text.rstrip(SPACE)
        fault = _BLANK if not said else _CUT if said[-1] not in ENDS else _NONE
        if said:
            # The role's length makes the joined text unambiguous.
            joined = f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")
            self.prints.append(hashlib.md5(joined).digest())
            if self.prints[-1] in self.seen:
                fault = _DUPLICATE
            self.seen.add(self.prints[-1])
        else:
            self.prints.append(b"")
        self.marks.append(_initial(role) + 4 * fault)
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    def row(self, part: int, opens: bool) -> tuple:
        return (self.conv_id, part, self.no, opens, self.turns, self.roles, self.texts,
                bytes(self.marks), self.prints if opens else [])


_PIECE = """conv_id long, part int, no long, opens boolean, turns array<bigint>, roles array<string>,
    texts array<string>, marks binary, prints array<binary>"""


def _packed(batches: Iterator[pa.RecordBatch], rows: int, chars: int) -> Iterator[_Piece | tuple]:
    """Pieces of the sorted rows of one partition, numbered in their order. The first and the last conversation may go on
    in its neighbours, so they are open, as are those of several pieces."""
    part, piece = TaskContext.get().partitionId(), None
    for batch in batches:
        held = batch.to_pydict()
        for conv_id, turn, role, text, live in zip(
            held["conv_id"], held["turn"], held["role"], held["text"], held["live"], strict=True
        ):
            if piece is None:
                piece = _Piece(conv_id, 0, True)
            elif conv_id != piece.conv_id:
                yield piece.row(part, piece.opens)
                piece = _Piece(conv_id, piece.no + 1, False)
            elif len(piece.marks) >= rows or piece.size >= chars:
                yield piece.row(part, True)
                piece = _Piece(conv_id, piece.no + 1, True)
            if live:
                piece.add(turn, role, text)
    if piece is not None:
        yield piece.row(part, True)


def pieces(rows: DataFrame, most_rows: int = PIECE_ROWS, most_chars: int = PIECE_CHARS) -> DataFrame:
    """Rows (as :func:`damaged` gives them) in order, packed into pieces of bounded size."""
    short = F.char_length("role") < 32
    # Bounded sort keys for the ranges: equal keys stay together, and sorting ends the order.
    ranged = rows.repartitionByRange(
        "conv_id", "turn", F.substring("role", 1, 32), F.when(short, F.substring("text", 1, 64))
    ).sortWithinPartitions("conv_id", "turn", "role", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_packed(batches, most_rows, most_chars), schema, most_chars)

    schema = _schema(_PIECE)
    return ranged.mapInArrow(pack, _PIECE)


def _schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(text))


def _batched(rows: Iterator[tuple], schema: pa.Schema, chars: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of some thousand rows, or fewer once their texts are long."""
    texts = schema.get_field_index("texts")
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 if texts < 0 else sum(map(len, row[texts])) + 1
        if len(held) >= 2000 or size >= 4 * chars:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_PLACE = ["conv_id", "part", "no"]


def _with_repeats(opened: DataFrame) -> DataFrame:
    """Open pieces with ``later``: places of rows that an earlier piece holds already."""
    said = opened.select(*_PLACE, F.posexplode("prints").alias("place", "print")).where(
        F.octet_length("print") > 0
    )
    # Within a piece repeats are known, so one row a print and piece is enough.
    firsts = said.groupBy(*_PLACE, "print").agg(F.min("place").alias("place"))
    firsts = stage(firsts, "conversation-prints")
    known = firsts.groupBy("conv_id", "print").agg(
        F.min(F.struct("part", "no")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    shared = known.where(F.col("n") > 1).select(
        F.col("conv_id").alias("_conv"), F.col("print").alias("_print"), "first"
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("print") == F.col("_print"))
    again = firsts.join(shared, same).where(F.struct("part", "no") != F.col("first"))
    places = again.groupBy("part", "no").agg(F.collect_list("place").alias("later"))
    return opened.join(places, ["part", "no"], "left")


def _marks_with(marks: bytes, later: list[int] | None) -> bytes:
    held = bytearray(marks)
    for place in later or []:
        held[place] = held[place] % 4 + 4 * _DUPLICATE
    return bytes(held)


def _chain(df: DataFrame, schema: str, follow) -> DataFrame:
    """``follow`` over the sorted slim rows of each partition, carried from row to row."""
    target = _schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                carried, out = follow(carried, row)
                made.append(out)
            if made:
                yield _batch(made, target)

    return df.mapInArrow(run, schema)


def _tails(slim: DataFrame) -> DataFrame:
    """The vector at the right border of each open piece, chained from the end over the
    pieces' own steps (each from every vector at once, so these are made in parallel)."""

    def steps(batch: dict[str, list]) -> dict[str, list]:
        made = tables()
        start = np.arange(len(made.vectors))

        def whole(marks: bytes) -> bytes:
            at = start
            for code in reversed(made.codes(marks)):
                at = made.step(at, code)
            return at.astype(np.uint16).tobytes()

        return {**{c: batch[c] for c in _PLACE}, "step": [whole(m) for m in batch["marks"]]}

    def follow(carried, row):
        same = carried is not None and carried[0] == row["conv_id"]
        tail = carried[1] if same else tables().end
        head = int(np.frombuffer(row["step"], np.uint16)[tail])
        return (row["conv_id"], head), (row["part"], row["no"], tail, not same)

    stepped = map_rows(slim, "conv_id long, part int, no long, step binary", steps)
    ordered = stepped.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.desc("part"), F.desc("no")
    )
    return _chain(ordered, "part int, no long, tail int, last boolean", follow)


def _entries(slim: DataFrame) -> DataFrame:
    """The state before each open piece, chained over the pieces' exits from every state."""

    def exits(batch: dict[str, list]) -> dict[str, list]:
        made = tables()
        found = [
            bytes(made.walk(marks, tail, state, last)[1] for state in range(4))
            for marks, tail, last in zip(batch["marks"], batch["tail"], batch["last"], strict=True)
        ]
        return {**{c: batch[c] for c in _PLACE}, "exits": found}

    def follow(carried, row):
        same = carried is not None and carried[0] == row["conv_id"]
        state = carried[1] if same else _START
        return (row["conv_id"], row["exits"][state]), (row["part"], row["no"], state)

    left = map_rows(slim, "conv_id long, part int, no long, exits binary", exits)
    ordered = left.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return _chain(ordered, "part int, no long, entry int", follow)


_REPAIRED = """conv_id long, part int, no long, opens boolean, edits string, roles array<string>,
    texts array<string>, blank long, duplicate long, truncated long, illegal long, cost long,
    first_initial int, last_initial int, first_turn long, last_turn long, turns long"""


def _repaired(row: dict) -> tuple:
    made = tables()
    marks = _marks_with(row["marks"], row["later"])
    edits, _ = made.walk(marks, row["tail"], row["entry"], row["last"])
    state, place, cost, roles, texts = row["entry"], 0, 0, [], []
    for edit in edits:
        if edit == "I":
            text, role = "", None
        else:
            role, text, mark = row["roles"][place], row["texts"][place], marks[place]
            place += 1
            if edit == "D":
                cost += DELETE
                continue
            cost += TRUNCATED * (mark // 4 == _CUT)
        if edit == "K":
            state = _KEEP[state][_initial(role)]
        else:
            cost += INSERT if edit == "I" else REROLE
            state = _NEXT[state]
            role = USER if state == _USER else ASSISTANT
        roles.append(role)
        texts.append(text)
    faults, initials = [m // 4 for m in marks], [m % 4 for m in marks]
    pairs = zip(initials, initials[1:], strict=False)
    known = [t for t in row["turns"] if t is not None]
    return (
        row["conv_id"], row["part"], row["no"], row["opens"], edits, roles, texts,
        faults.count(_BLANK), faults.count(_DUPLICATE), faults.count(_CUT),
        sum(pair not in _LEGAL_PAIRS for pair in pairs), cost,
        initials[0] if initials else None, initials[-1] if initials else None,
        known[0] if known else None, known[-1] if known else None, len(list(groupby(known))),
    )


def repaired_pieces(rows: DataFrame, most_rows: int = PIECE_ROWS, most_chars: int = PIECE_CHARS) -> DataFrame:
    """Pieces of repaired conversations: the edits, the roles and texts that are left or
    added, and counts. Pieces of one conversation follow each other by (part, no)."""
    packed = stage(pieces(rows, most_rows, most_chars), "conversation-pieces")
    end = tables().end
    whole = packed.where(~F.col("opens")).select(
        "*",
        F.lit(None).cast("array<int>").alias("later"),
        F.lit(end).alias("tail"),
        F.lit(True).alias("last"),
        F.lit(_START).alias("entry"),
    )
    opened = packed.where("opens")
    repeats = _with_repeats(opened.select(*_PLACE, "prints", "marks"))

    def marked(batch: dict[str, list]) -> dict[str, list]:
        marks = [_marks_with(m, x) for m, x in zip(batch["marks"], batch["later"], strict=True)]
        return {**{c: batch[c] for c in _PLACE}, "marks": marks, "later": batch["later"]}

    slim = stage(
        map_rows(
            repeats.select(*_PLACE, "marks", "later"),
            "conv_id long, part int, no long, marks binary, later array<int>",
            marked,
        ),
        "conversation-marks",
    )
    tails = stage(_tails(slim), "conversation-tails")
    bordered = slim.join(tails, ["part", "no"])
    entries = _entries(bordered.select(*_PLACE, "marks", "tail", "last"))
    borders = bordered.select("part", "no", "later", "tail", "last").join(entries, ["part", "no"])
    # Spread again: the chains leave a conversation's pieces where they were chained.
    joined = opened.join(borders, ["part", "no"]).select(*whole.columns)
    target = _schema(_REPAIRED)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (_repaired(row) for batch in batches for row in batch.to_pylist())
        yield from _batched(found, target, most_chars)

    return whole.unionByName(joined).mapInArrow(repair, _REPAIRED)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """One row per turn of the repaired conversations, with its place."""
    made = repaired_pieces(rows)
    return made.select(
        *_PLACE, F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "_turn")
    ).select(*_PLACE, "place", F.col("_turn.roles").alias("role"), F.col("_turn.texts").alias("text"))


_REPORT = """conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long,
    cost long, audit string, repaired_sha256 string"""


class _Digest:
    """What is known of one conversation while its pieces pass."""

    def __init__(self, conv_id):
        self.conv_id, self.sha, self.begun, self.edits = conv_id, hashlib.sha256(), False, []
        self.sums, self.initial, self.low, self.high, self.turns = [0] * 5, None, None, None, 0

    def add(self, row: dict) -> None:
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
            self.sums[i] += row[name]
        if row["first_initial"] is not None:
            if self.initial is not None:
                self.sums[3] += (self.initial, row["first_initial"]) not in _LEGAL_PAIRS
            self.initial = row["last_initial"]
        if row["turns"]:
            self.turns += row["turns"] - (row["first_turn"] == self.high)
            self.low = row["first_turn"] if self.low is None else self.low
            self.high = row["last_turn"]
        self.edits.append(row["edits"])
        for role, text in zip(row["roles"], row["texts"], strict=True):
            line = f"{role}:{text}".encode("utf-8", "surrogatepass")
            self.sha.update(b"\n" + line if self.begun else line)
            self.begun = True

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        blank, duplicate, truncated, illegal, cost = self.sums
        return (self.conv_id, min(gaps, _MOST), blank, duplicate, truncated, illegal, cost,
                "".join(self.edits), self.sha.hexdigest())


def repair_report(rows: DataFrame, most_rows: int = PIECE_ROWS, most_chars: int = PIECE_CHARS) -> DataFrame:
    """Per conversation of :func:`damaged` rows: faults, cost, edits and the repaired digest."""
    made = stage(repaired_pieces(rows, most_rows, most_chars), "conversation-repaired")
    target = _schema(_REPORT)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or row["conv_id"] != held.conv_id:
                    if held is not None:
                        yield held.row()
                    held = _Digest(row["conv_id"])
                held.add(row)
        if held is not None:
            yield held.row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(digests(batches), target, most_chars)

    # Only conversations that lie in several partitions, or may do so, are brought together.
    opened = made.where("opens").repartition("conv_id")
    ordered = opened.sortWithinPartitions("conv_id", "part", "no")
    whole = made.where(~F.col("opens")).mapInArrow(run, _REPORT)
    return whole.unionByName(ordered.mapInArrow(run, _REPORT))


def sql() -> str:
    """DuckDB SQL of the report: a plain dynamic program, one row a step, from the last row on.
    Each state holds its least (cost, edits, repaired lines)."""

    def made(cost: str, edits: str, lines: str) -> str:
        return f"{{'c': {cost}, 'e': {edits}, 'r': {lines}}}"

    def inserted(name: str, role: str) -> str:
        line = f"'{role}:' || chr(10) || {name}.r"
        return made(f"{name}.c + {INSERT}", f"'I' || {name}.e", line)

    gone = "fault IN ('blank', 'duplicate')"
    toll = f"(CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END)"

    def kept(name: str) -> str:
        line = f"role || ':' || text || chr(10) || {name}.r"
        return made(f"{name}.c + {toll}", f"'K' || {name}.e", line)

    def rerole(name: str, role: str) -> str:
        line = f"'{role}:' || text || chr(10) || {name}.r"
        return made(f"{name}.c + {toll} + {REROLE}", f"'R' || {name}.e", line)

    def used(state: str, keeps: dict[str, str], role: str, target: str) -> str:
        deleted = made(f"{state}.c + {DELETE}", f"'D' || {state}.e", f"{state}.r")
        chosen = " ".join(f"WHEN '{x}' THEN {kept(t)}" for x, t in keeps.items())
        more = f"least({rerole(target, role)}, CASE left(role, 1) {chosen} ELSE {rerole(target, role)} END)"
        return f"CASE WHEN {gone} THEN {deleted} ELSE least({deleted}, {more}) END"

    return f"""
WITH RECURSIVE remainders AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda v, _:
      CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v
    FROM range(256) AS r(i))),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
kinds AS (
  SELECT named.*, xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda v, b: xor(v >> 8, t[CAST((xor(v, b) & 255) + 1 AS INTEGER)])), 4294967295) % 20 AS kind
  FROM named, remainders),
live AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN '{USER}' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM kinds)),
placed AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM live),
marked AS (
  SELECT *, CASE WHEN said = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed),
walk AS (
  SELECT conv_id, count(*) + 1 AS i, {made("0", "''", "''")} AS b,
    {made("6", "'II'", f"'{USER}:' || chr(10) || '{ASSISTANT}:' || chr(10)")} AS s,
    {made("3", "'I'", f"'{ASSISTANT}:' || chr(10)")} AS u, {made("0", "''", "''")} AS a
  FROM placed GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(b, {inserted("u", USER)}), least(s, {inserted("u", USER)}), u, a FROM (
    SELECT conv_id, i, b, s, least(u, {inserted("a", ASSISTANT)}) AS u, least(a, {inserted("u", USER)}) AS a
    FROM (
      SELECT m.conv_id, m.i, {used("b", {"s": "s", "u": "u"}, USER, "u")} AS b,
        {used("s", {"u": "u"}, USER, "u")} AS s, {used("u", {"a": "a"}, ASSISTANT, "a")} AS u,
        {used("a", {"u": "u"}, USER, "u")} AS a
      FROM walk JOIN marked m ON m.conv_id IS NOT DISTINCT FROM walk.conv_id AND m.i = walk.i - 1))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
  coalesce(b.e, '') AS audit, sha256(coalesce(left(b.r, length(b.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM o.conv_id AND walk.i = 1
"""

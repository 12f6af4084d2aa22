"""Conversation structure repair by composing weighted finite-state machines.

Three machines: the input acceptor is the conversation, a state between any two rows; the edit transducer keeps, reroles or deletes
a row and inserts rows anywhere, at costs; the role grammar accepts `(s?(ua)+)?`. Their composition is built lazily: states are
(row, grammar state, rows inserted since), arcs are made when a state is reached, and since at most two rows are worth inserting at one
place there are no cycles, so one pass in topological order finds the shortest path. Weights are pairs (cost, edits as a string),
added by min and multiplied by (+, concatenation). Equal costs over the same rows never give edits of which one begins the other, for
what it has more would be insertions, which cost; so the order survives appending, and pieces of a conversation can be composed
separately.

That is how long conversations are spread: rows are dealt by ranges of (conversation, turn), each task composes runs of at most
`RUN` rows into a 4 x 4 matrix of weights (grammar state before and after), and matrices are multiplied conversation by conversation, which
moves an edit a row and no text. Only the digest of the repaired text has to see the texts of a conversation one after the other, since
SHA-256 is sequential; it streams them, holding a hash and the edits. No row is held with others of its conversation.

Defined results: rows are taken by turn, nulls first, then by role and text; null roles and texts, and null ids and turns
where they are hashed, count as one space, which is a role outside the grammar; copies of a row are duplicates; a null
conversation id is a conversation; an empty table gives an empty result; extra columns are ignored. An initial is the first
character of a role, none for an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import materialize, shuffle_partitions

RUN = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Role initials to grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. Conversations may end in ACCEPTED.
GRAMMAR: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
BLANK, FIRST_SEEN, ENDED = "blank", "first_seen", "ended"

Weight = tuple[int, str]
#: Of what may follow one grammar state: the cheapest edits that lead to each.
Weights = dict[int, Weight]


def inserted(at: Weights) -> Weights:
    """at, with the rows worth inserting: arcs that take no input, a layer for each inserted row."""
    best, layer = dict(at), at
    for _ in range(2):
        further: Weights = {}
        for state, (cost, edits) in layer.items():
            for initial, to in GRAMMAR[state].items():
                if initial in NAMES:
                    weight = (cost + INSERT, edits + "I")
                    if weight < further.get(to, weight + ("",)):
                        further[to] = weight
        layer = {}
        for to, weight in further.items():
            if to not in best or weight < best[to]:
                best[to] = layer[to] = weight
    return best


def consumed(at: Weights, initial: str, must_go: bool, ended: bool) -> Weights:
    """at, after one row: the arcs of the edit transducer that the grammar lets through."""
    out: Weights = {}

    def reach(to: int, cost: int, edits: str) -> None:
        if to not in out or (cost, edits) < out[to]:
            out[to] = cost, edits

    extra = 0 if ended else TRUNCATED
    for state, (cost, edits) in at.items():
        reach(state, cost + DELETE, edits + "D")
        if not must_go:
            for symbol, to in GRAMMAR[state].items():
                if symbol == initial:
                    reach(to, cost + KEEP + extra, edits + "K")
                if symbol in NAMES:
                    reach(to, cost + REROLE + extra, edits + "R")
    return out


def compose(rows: Sequence[tuple[str, bool, bool]], begin: int) -> Weights:
    """Cheapest edits over rows (initial, must go, ended) from one grammar state to each that can be reached."""
    at = inserted({begin: (0, "")})
    for row in rows:
        at = inserted(consumed(at, *row))
    return at


def multiply(at: Weights, matrix: dict[int, Weights]) -> Weights:
    out: Weights = {}
    for state, (cost, edits) in at.items():
        for to, (more, further) in matrix.get(state, {}).items():
            weight = cost + more, edits + further
            if to not in out or weight < out[to]:
                out[to] = weight
    return out


def applied(edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The repaired rows as role:text, one after the other."""
    state, letters = 0, iter(edits)

    def insert() -> str:
        nonlocal state
        initial, state = next((i, to) for i, to in GRAMMAR[state].items() if i in NAMES)
        return NAMES[initial] + ":"

    for role, text in rows:
        letter = next(letters)
        while letter == "I":
            yield insert()
            letter = next(letters)
        if letter == "R":
            yield insert() + text
        elif letter == "K":
            state = GRAMMAR[state][role[:1]]
            yield f"{role}:{text}"
    for _ in letters:
        yield insert()


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies: 0 where a row is dropped, 2 where it is repeated."""
    text_of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), (F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col)).cast("binary")) % 20).alias("k"))
    gone = F.col("k") == 0
    text = F.when(gone | (F.col("k") == 1), "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(gone, "").when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(gone, 0).when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("copies"))


def faulty(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copies), equal rows as one, with blank, ended and first_seen (no earlier turn has the role and text)."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = rows.select("*", F.unhex(said).alias("said"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias(BLANK), ended.alias(ENDED))
    rows = materialize(rows, "repair-rows")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.where(f"copies > 0 and not {BLANK}").groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n"))
    # only what was said in several turns has to be looked up
    first = first.where("n > 1").select("c", "s", "first")
    found = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    earliest = F.col("first").isNull() | (F.col("first.turn").eqNullSafe(F.col("turn")))
    return found.select("conv_id", "turn", "role", "text", "copies", BLANK, ENDED, earliest.alias(FIRST_SEEN))


_PIECE = "conv_id long, head string, n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string, matrix string"
_SUMMED = ("blank", "duplicate", "truncated", "illegal")


class Piece:
    """What is known of up to RUN rows of a conversation in order."""

    def __init__(self, conv: int | None):
        self.conv, self.rows, self.count = conv, [], dict.fromkeys(_SUMMED, 0)
        self.turns, self.first_turn, self.last_turn, self.first_initial, self.last_initial = 0, None, None, None, None

    def add(self, turn: int | None, role: str, blank: bool, ended: bool, seen: bool) -> None:
        initial, fault = role[:1], blank or seen
        self.count["blank"] += blank
        self.count["duplicate"] += not blank and seen
        self.count["truncated"] += not fault and not ended
        if self.last_initial is not None:
            self.count["illegal"] += self.last_initial + initial not in ("su", "ua", "au")
        else:
            self.first_initial = initial
        self.last_initial = initial
        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.rows.append((initial, fault, ended))

    def row(self, begins: tuple[int, ...]) -> tuple:
        matrix = {g: compose(self.rows, g) for g in begins}
        written = ";".join(f"{g}>{h}:{cost}:{edits}" for g, found in matrix.items() for h, (cost, edits) in found.items())
        return self.conv, len(self.rows), *self.count.values(), self.turns, self.first_turn, self.last_turn, self.first_initial, self.last_initial, written


def _matrix(written: str) -> dict[int, Weights]:
    out: dict[int, Weights] = {}
    for entry in filter(None, written.split(";")):
        way, cost, edits = entry.split(":")
        out.setdefault(int(way[0]), {})[int(way[2])] = int(cost), edits
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _order(first: str) -> list[Column]:
    return [F.col(first).asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def pieces(rows: DataFrame, run: int = RUN) -> DataFrame:
    """rows of faulty() in order, composed: a row for each run of rows of a conversation; task and piece give their order."""
    schema = pa.schema([("conv_id", pa.int64()), ("task", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), *[(c, pa.int64()) for c in (*_SUMMED, "turns", "first_turn", "last_turn")], ("first_initial", pa.string()), ("last_initial", pa.string()), ("matrix", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, own, whole, out = TaskContext.get().partitionId(), 0, None, False, []

        def close(piece: Piece) -> None:
            nonlocal k
            # what begins here surely begins in grammar state 0; the first of a task may go on from another's
            found = piece.row((0,) if whole else (0, 1, 2, 3))
            out.append((found[0], task, k, *found[1:]))
            k += 1

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                for conv, turn, role, copies, blank, ended, first in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns)):
                    if own is None or conv != own.conv:
                        if own is not None:
                            close(own)
                        own, whole = Piece(conv), own is not None
                    for i in range(copies):
                        if len(own.rows) == run:
                            close(own)
                            own, whole = Piece(conv), False
                        own.add(turn, role, blank, ended, i > 0 or not first)
                if len(out) >= 500:
                    yield _batch(out, schema)
                    out.clear()
        if own is not None:
            close(own)
        yield _batch(out, schema)

    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *_order("conv_id")).sortWithinPartitions(*_order("conv_id"))
    ddl = "conv_id long, task long, piece long, n long, " + ", ".join(f"{c} long" for c in (*_SUMMED, "turns", "first_turn", "last_turn")) + ", first_initial string, last_initial string, matrix string"
    return dealt.select("conv_id", "turn", "role", "copies", BLANK, ENDED, FIRST_SEEN).mapInArrow(walk, ddl)


def multiplied(parts: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    names = ["conv_id", "gaps", *_SUMMED, "cost", "audit"]
    schema = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in names])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, conv, out = False, None, []
        sums: dict[str, int] = {}
        at: Weights = {}
        turns, least, most, last_initial = 0, None, None, None

        def close() -> None:
            cost, edits = min(at[g] for g in ACCEPTED if g in at)
            out.append((conv, 0 if least is None else most - least + 1 - turns, *sums.values(), cost, edits))

        for batch in batches:
            for row in batch.to_pylist():
                if not known or row["conv_id"] != conv:
                    if known:
                        close()
                    known, conv, at, sums = True, row["conv_id"], {0: (0, "")}, dict.fromkeys(_SUMMED, 0)
                    turns, least, most, last_initial = 0, None, None, None
                for c in _SUMMED:
                    sums[c] += row[c]
                if row["first_initial"] is not None:
                    if last_initial is not None:
                        sums["illegal"] += last_initial + row["first_initial"] not in ("su", "ua", "au")
                    last_initial = row["last_initial"]
                if row["first_turn"] is not None:
                    turns += row["turns"] - (row["first_turn"] == most)
                    least, most = row["first_turn"] if least is None else least, row["last_turn"]
                at = multiply(at, _matrix(row["matrix"]))
            yield _batch(out, schema)
            out.clear()
        if known:
            close()
        yield _batch(out, schema)

    dealt = parts.repartition(shuffle_partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "task", "piece")
    return dealt.mapInArrow(fold, ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in names))


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: a stream of each conversation's rows behind its edits."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                yield from zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, out = stream(batches), []
        ahead = next(every, None)

        def own(conv: int | None) -> Iterator[tuple[str, str]]:
            nonlocal ahead
            ahead = next(every, None)
            while ahead is not None and ahead[1] == 1 and ahead[0] == conv:
                for _ in range(ahead[4]):
                    yield ahead[2], ahead[3]
                ahead = next(every, None)

        while ahead is not None:
            conv, digest, n = ahead[0], hashlib.sha256(), 0
            for line in applied(ahead[3], own(conv)):
                digest.update((("\n" if n else "") + line).encode("utf-8", "surrogatepass"))
                n += 1
            out.append((conv, digest.hexdigest()))
            if len(out) >= 500:
                yield _batch(out, schema)
                out.clear()
        yield _batch(out, schema)

    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    both = heads.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies"))
    dealt = both.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", *_order("turn")[1:])
    return dealt.select("conv_id", "kind", "role", "text", "copies").mapInArrow(walk, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    known = materialize(faulty(rows), "repair-faults")
    audits = materialize(multiplied(pieces(known)), "repair-audits")
    found = digests(known, audits).withColumnRenamed("conv_id", "of")
    return audits.join(found, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

"""Repair of conversations by iterative-deepening A*.

The rows of a conversation, in turn order, are kept, given another role or deleted, and
empty turns are inserted, until the roles read ``(s?(ua)+)?``. A depth-first search tries
edits in ASCII order under a bound on the cost; a failed state keeps the least cost that
could still lead on from it, which prunes it later and, at the root, is the next bound. The
first accepting path under the first bound that has one is the cheapest, and among equal
costs the ASCII-least.

Rows are dealt by ranges of (conversation, turn, role, text) and cut into chunks. A
conversation that lies whole in one chunk is searched at once. For a longer one the same
search gives the cost of every chunk between every pair of states, these sum up from the end
to the cost that lies behind each chunk, and then every chunk is searched for itself for
each state that it may be entered in. So no task holds more than a chunk at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import small_batches
from lexigrain.llm.folders import landed
from lexigrain.operators.joins import lookup

CHUNK = 64  # rows that are searched at a time
CHUNK_TEXT = 8 << 20  # characters after which a chunk takes no further row
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)  # what was said last
FAR = 1 << 60
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: What lies behind the last row: insertions that complete the pattern.
TAILS = ["", "II", "I", ""]
END_COSTS = [INSERT * len(tail) for tail in TAILS]
_NEXT = [USER, USER, ASSISTANT, USER]
_SAID = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
SYMBOLS = "xsuaoSUAO"  # x: must go; s, u, a or other role; capital: truncated


def _moves(symbol: str, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows consumed, state after) in ASCII order of the edits."""
    moves = [("D", DELETE, 1, state), ("I", INSERT, 0, _NEXT[state])]
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        said = _SAID.get(symbol.lower())
        if said == _NEXT[state] or (said == SYSTEM and state == START):
            moves.append(("K", KEEP + extra, 1, said))
        else:
            moves.append(("R", REROLE + extra, 1, _NEXT[state]))
            return moves
        if said == SYSTEM:
            moves.append(("R", REROLE + extra, 1, USER))
    return moves


MOVES = {(symbol, state): _moves(symbol, state) for symbol in SYMBOLS for state in range(4)}


def _least(symbols: str, behind: list[int]) -> list[int]:
    """A cost that no path from a state (row and what was said last) can undercut.

    Rows that must go cost their deletion, truncated ones, other roles and a system row
    after the start what is least for them. Two neighbours of one role need an edit more:
    an insertion, or a new role, which can mend two such pairs, or the deletion of one.
    Half costs are counted for that, fewer where a truncated row may go.
    """
    n, floor = len(symbols), min(behind)
    least = [0] * (4 * n) + list(behind)
    base = halves = system = 0
    after = ""
    for row in range(n - 1, -1, -1):
        symbol = symbols[row]
        if symbol == "x":
            base += DELETE
        else:
            kind = symbol.lower()
            if kind in "ua":
                base += TRUNCATED if symbol != kind else 0
                if after.lower() == kind:
                    halves += 2 if symbol != kind or after != kind else 3
                after = symbol
            else:
                base += min(REROLE + TRUNCATED, DELETE) if symbol != kind else REROLE
                system |= kind == "s"
                after = ""
        bound = base + (halves + 1) // 2 + floor
        least[4 * row:4 * row + 4] = [bound - (REROLE if system else 0), bound, bound, bound]
    return least


def search(symbols: str, entry: int = START, behind: list[int] = END_COSTS,
           least: list[int] | None = None) -> tuple[int, str, int]:
    """(cost, edits, state after) of the cheapest, then ASCII-least, path over rows.

    A path ends with its last row; ``behind`` gives the cost that follows in each state
    (``FAR``: not allowed). ``least`` is what searches of the same rows have learned.
    """
    least = _least(symbols, behind) if least is None else least
    end = 4 * len(symbols)
    bound = least[entry]
    while bound < FAR:
        # a frame: state, cost so far, its moves, the next of them, the least cost seen beyond
        frames, path = [[entry, 0, None, 0, FAR]], []
        while frames:
            frame = frames[-1]
            state, spent, moves, at, beyond = frame
            if moves is None:
                if spent + least[state] > bound:
                    frames.pop()
                    if path:
                        path.pop()
                    continue
                if state >= end:
                    return bound, "".join(path), state - end
                row, said = divmod(state, 4)
                moves = frame[2] = MOVES[symbols[row], said]
            elif at:  # back from a move that failed
                _, cost, rows, said = moves[at - 1]
                frame[4] = beyond = min(beyond, cost + least[state - state % 4 + 4 * rows + said])
            if at == len(moves):
                least[state] = max(least[state], beyond)
                frames.pop()
                if path:
                    path.pop()
                continue
            edit, cost, rows, said = moves[at]
            frame[3] = at + 1
            path.append(edit)
            frames.append([state - state % 4 + 4 * rows + said, spent + cost, None, 0, FAR])
        bound = least[entry] if least[entry] > bound else FAR
    return FAR, "", entry


def crossing_costs(symbols: str) -> list[int]:
    """The costs of a chunk from each state to each state, ``FAR`` where there is no way."""
    costs = [FAR] * 16
    for leave in range(4):
        behind = [FAR] * 4
        behind[leave] = 0
        least = _least(symbols, behind)
        for entry in reversed(range(4)):
            if leave < entry and entry < USER or leave < USER and entry >= USER:
                continue  # nothing said is taken back
            if entry == START and leave == SYSTEM and not set(symbols) & {"s", "S"}:
                continue
            costs[4 * entry + leave] = search(symbols, entry, behind, least)[0]
    return costs


def apply_edits(edits: str, roles: list[str], texts: list[str],
                state: int = START) -> tuple[list[str], list[str]]:
    """The turns that edits make of rows."""
    new_roles, new_texts, row = [], [], 0
    for edit in edits:
        if edit == "D":
            row += 1
            continue
        if edit == "K" and state == START and roles[row].startswith("s"):
            state = SYSTEM
        else:
            state = _NEXT[state]
        named = "user" if state == USER else "assistant"
        new_roles.append(roles[row] if edit == "K" else named)
        new_texts.append("" if edit == "I" else texts[row])
        row += edit != "I"
    return new_roles, new_texts


def fault(text: str, repeated: bool) -> str | None:
    """The first fault of a row."""
    said = text.rstrip(WHITE)
    if not said:
        return "blank"
    if repeated:
        return "duplicate"
    return None if said[-1] in ENDS else "truncated"


COUNTS = ["turns", "blank", "duplicate", "truncated", "illegal"]
FACTS = ("first_turn long, last_turn long, turns long, blank long, duplicate long, "
         "truncated long, illegal long, first_initial string, last_initial string")
_FACT_NAMES = [f.split()[0] for f in FACTS.split(", ")]
CHUNKS = f"symbols string, roles array<string>, texts array<string>, {FACTS}"
PIECES = (f"piece long, last boolean, cost long, edits string, roles array<string>, "
          f"texts array<string>, {FACTS}")


class _Chunk:
    """Rows of a conversation that are gathered until they are searched."""

    def __init__(self):
        self.symbols, self.roles, self.texts = [], [], []
        self.turn = self.initial = self.first_turn = self.first_initial = None
        self.counts = dict.fromkeys(COUNTS, 0)
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        wrong, initial, counts = fault(text, repeated), role[:1], self.counts
        if wrong:
            counts[wrong] += 1
        if turn is not None and turn != self.turn:
            counts["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn = turn
        if self.initial is None:
            self.first_initial = initial
        elif self.initial + initial not in ("su", "ua", "au"):
            counts["illegal"] += 1
        self.initial = initial
        symbol = initial if initial in _SAID else "o"
        if wrong in ("blank", "duplicate"):
            symbol = "x"
        elif wrong:
            symbol = symbol.upper()
        self.symbols.append(symbol)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    def facts(self) -> list:
        return [self.first_turn, self.turn, *(self.counts[c] for c in COUNTS),
                self.first_initial, self.initial]


def _marked(rows: DataFrame) -> DataFrame:
    """Different rows with how often they are there and whether an earlier turn says the same."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    said = F.md5(F.concat_ws(":", F.col("conv_id").isNull().cast("string"), F.length(conv).cast(
        "string"), F.length("role").cast("string"), conv, "role", "text"))
    seen = rows.filter("copies > 0").groupBy(said.alias("_said")).agg(
        F.min(F.struct("turn")).alias("_first"), F.max(F.struct("turn")).alias("_final")).filter(
        "_first < _final").select("_said", "_first")
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    found = lookup(counted.withColumn("_said", said), landed(seen, "seen"), ["_said"], ["turn"])
    again = F.col("_first").isNotNull() & (F.col("_first") < F.struct("turn"))
    return found.select("conv_id", "turn", "role", "text", "copies", again.alias("again"))


def _chunks(marked: DataFrame, chunk: int) -> DataFrame:
    """Chunks of rows in order; a conversation inside one range and chunk is repaired at once."""
    order = ["conv_id", "turn", "role", "text"]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "range", F.spark_partition_id())
    key = marked.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        rows: list[list] = []
        conv, held, entire, number, size = None, None, False, 0, 0

        def close(alone: bool) -> None:
            nonlocal number, size
            cost, edits, roles, texts = None, None, held.roles, held.texts
            symbols = "".join(held.symbols)
            if alone:
                cost, path, state = search(symbols)
                edits = path + TAILS[state]
                roles, texts = apply_edits(edits, roles, texts)
            rows.append([conv, at, number, alone, cost, edits, None if alone else symbols, roles,
                         texts, *held.facts()])
            number += 1
            size += held.size

        def flush() -> pa.RecordBatch:
            nonlocal size
            size = 0
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema,
                                                     strict=True)], schema=schema)
            rows.clear()
            return batch

        at = 0
        for batch in small_batches(batches):
            if schema is None:
                schema = pa.schema([
                    ("conv_id", batch.schema.field("conv_id").type), ("range", pa.int32()),
                    ("number", pa.int64()), ("whole", pa.bool_()), ("cost", pa.int64()),
                    ("edits", pa.string()), ("symbols", pa.string()),
                    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                    *((n, pa.string() if "initial" in n else pa.int64()) for n in _FACT_NAMES)])
            for row in batch.to_pylist():
                at = row["range"]
                if held is None:  # may have begun in the range before
                    conv, held, entire = row["conv_id"], _Chunk(), False
                elif row["conv_id"] != conv:
                    close(alone=entire)
                    conv, held, entire = row["conv_id"], _Chunk(), True
                again = row["again"]
                for _ in range(row["copies"]):
                    if len(held.symbols) >= chunk or held.size > CHUNK_TEXT:
                        close(alone=False)
                        held, entire = _Chunk(), False
                    held.add(row["turn"], row["role"], row["text"], again)
                    again = True
                    if len(rows) >= 1000 or size > CHUNK_TEXT:
                        yield flush()
        if held is not None:
            close(alone=False)  # may go on in the next range
            yield flush()

    return landed(ranged.mapInArrow(
        run, f"conv_id {key}, range int, number long, whole boolean, cost long, edits string, "
             f"{CHUNKS}"), "chunks")


def _behind(chunks: DataFrame) -> DataFrame:
    """(range, number, behind): what follows each chunk costs, by the state it is left in."""
    key = chunks.schema["conv_id"].dataType.simpleString()

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [crossing_costs(s) for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(costs, pa.list_(pa.int64()))],
                names=["conv_id", "range", "number", "costs"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, behind = object(), END_COSTS
        for batch in batches:
            out = []
            for own, costs in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(),
                                  strict=True):
                if own != conv:
                    conv, behind = own, END_COSTS
                out.append(behind)
                behind = [min(FAR, min(costs[4 * p + q] + behind[q] for q in range(4)))
                          for p in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:3], pa.array(out, pa.list_(pa.int64()))],
                names=["range", "number", "behind"])

    crossed = chunks.select("conv_id", "range", "number", "symbols").mapInArrow(
        cross, f"conv_id {key}, range int, number long, costs array<long>")
    return crossed.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.desc("range"), F.desc("number")).mapInArrow(
        back, "range int, number long, behind array<long>")


def _walked(chunks: DataFrame) -> DataFrame:
    """Pieces of conversations of several chunks, in order and in one task each."""
    key = chunks.schema["conv_id"].dataType.simpleString()
    facts = [f for f in chunks.schema.fieldNames() if f in _FACT_NAMES]

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for symbols, behind in zip(column(batch, "symbols"), column(batch, "behind"),
                                       strict=True):
                least = _least(symbols, behind)
                paths.append([dict(zip(("cost", "edits", "state"), search(
                    symbols, entry, behind, least), strict=True)) for entry in range(4)])
            kind = pa.list_(pa.struct([("cost", pa.int64()), ("edits", pa.string()),
                                       ("state", pa.int32())]))
            kept = [i for i, n in enumerate(batch.schema.names) if n not in ("symbols", "behind")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(paths, kind)],
                names=[*(batch.schema.names[i] for i in kept), "paths"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, piece, cost = None, START, 0, 0

        def made(last: bool) -> pa.RecordBatch:
            nonlocal state
            path = held["paths"][state]
            edits = path["edits"] + (TAILS[path["state"]] if last else "")
            roles, texts = apply_edits(edits, held["roles"], held["texts"], state)
            state = path["state"]
            values = [held["conv_id"], piece, last, cost, edits, roles, texts,
                      *(held[f] for f in facts)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[
                    "conv_id", "piece", "last", "cost", "edits", "roles", "texts", *facts])

        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.bool_(), pa.int64(),
                     pa.string(), pa.list_(pa.string()), pa.list_(pa.string()),
                     *(pa.string() if "initial" in f else pa.int64() for f in facts)]
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                fresh = held is None or row["conv_id"] != held["conv_id"]
                if held is not None:
                    yield made(last=fresh)
                if fresh:
                    state, piece, cost = START, 0, row["paths"][START]["cost"]
                else:
                    piece += 1
                held = row
        if held is not None:
            yield made(last=True)

    def column(batch: pa.RecordBatch, name: str) -> list:
        return batch.column(batch.schema.get_field_index(name)).to_pylist()

    columns = (f"conv_id {key}, range int, number long, roles array<string>, "
               f"texts array<string>, {FACTS}")
    entered = chunks.join(_behind(chunks), ["range", "number"]).select(
        "conv_id", "range", "number", "roles", "texts", *facts, "symbols", "behind")
    searched = entered.mapInArrow(
        both, f"{columns}, paths array<struct<cost: long, edits: string, state: int>>")
    return searched.repartition("conv_id").sortWithinPartitions(
        "conv_id", "range", "number").mapInArrow(walk, f"conv_id {key}, {PIECES}")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", copies: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Pieces of repaired conversations with the edits that were made.

    Columns: conv_id, piece (from 0), last, cost (of the whole conversation), edits (of this
    piece; K keep, R new role, D delete, I insert), roles and texts of the repaired turns, and
    facts about the rows: first_turn, last_turn, turns (different ones), blank, duplicate,
    truncated, illegal (neighbours that are not su, ua or au), first and last initial.
    Most conversations are one piece; the pieces of a long one follow each other in one task.

    Rows are taken by turn (nulls first), role and text. Null roles and texts become one
    space; a null conversation is one of its own. Repeated rows are duplicates of the first.
    ``copies`` names a column that says how often a row counts; a conversation whose rows all
    count 0 has one piece without edits. An empty table gives no rows; other columns are
    not read. A conversation of any length is worked on by chunks: only the costs of its
    chunks (16 numbers each) and, one at a time, its pieces pass through one task.
    """
    count = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    plain = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), count.alias("copies"))
    chunks = _chunks(_marked(plain), chunk)
    alone = chunks.filter("whole").select(
        "conv_id", F.lit(0).cast("long").alias("piece"), F.lit(True).alias("last"), "cost",
        "edits", "roles", "texts", *_FACT_NAMES)
    return alone.unionByName(_walked(chunks.filter("not whole")))


def summarise(pieces: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and a digest of the repaired turns.

    Reads the pieces as :func:`repair` gives them: in order, in one task per conversation. A
    piece is forgotten when its text is in the digest; the audit is put together in memory.
    """
    key = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                 "repaired_sha256"]
        digest, edits, total, said = hashlib.sha256(), [], {}, False
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["piece"] == 0:
                    digest, edits, said = hashlib.sha256(), [], False
                    total = dict.fromkeys(COUNTS, 0) | {"first": None, "turn": None,
                                                        "initial": None}
                for name in COUNTS:
                    total[name] += row[name]
                if row["first_turn"] is not None:
                    total["turns"] -= row["first_turn"] == total["turn"]
                    total["turn"] = row["last_turn"]
                    if total["first"] is None:
                        total["first"] = row["first_turn"]
                if row["first_initial"] is not None:
                    total["illegal"] += total["initial"] is not None and (
                        total["initial"] + row["first_initial"] not in ("su", "ua", "au"))
                    total["initial"] = row["last_initial"]
                edits.append(row["edits"])
                for role, text in zip(row["roles"], row["texts"], strict=True):
                    digest.update(f"{chr(10) * said}{role}:{text}".encode())
                    said = True
                if row["last"]:
                    gaps = 0 if total["first"] is None else (
                        total["turn"] - total["first"] + 1 - total["turns"])
                    done.append([row["conv_id"], gaps, *(total[c] for c in COUNTS[1:]),
                                 row["cost"], "".join(edits), digest.hexdigest()])
            if done:
                kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(),
                         pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds,
                                                    strict=True)], names=names)

    return pieces.mapInArrow(
        run, f"conv_id {key}, gaps long, blank long, duplicate long, truncated long, "
             "illegal long, cost long, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults by the checksum of ``conv_id:turn``, and ``copies`` of each row.

    0 drops a row (it counts 0 times), 1 empties its text, 2 takes out ``.!?``, 3 repeats it,
    4 makes it the user's. Nulls are one space.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, text = F.crc32(key) % 20, F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(
            F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(
            text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))

"""Structure of conversations: faults counted, and the cheapest edits that give alternating roles, by an auction over a lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..tables import Scratch
from .streams import in_order

#: The characters that count as blank, costs of the edits, and what an undeleted truncated row costs.
BLANK = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state that the next user or assistant leads to.
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
#: A row's code: its role's initial, and whether it must go or is truncated.
INITIALS, MUST_GO, IS_CUT = {"s": 1, "u": 2, "a": 3}, 4, 8


def damaged(turns: DataFrame, key_col: str = "conv_id") -> DataFrame:
    """key, turn, role, text of a table with faults, for tests of a repair: crc32 of `key:turn`, modulo 20, is 0 for rows that are
    dropped, 1 for an emptied text, 2 for a text without `.`, `!` and `?`, 3 for a row that comes twice, 4 for the role user.

    A null role or text is one space, in the result too; so is a null key or turn where it is hashed. Repeated rows are damaged alike.
    An empty table gives no rows. Other columns are dropped."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(spaced(key_col), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(draw == 4, "user").otherwise(spaced("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)))
    return turns.select(key_col, "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


def _named(turns: DataFrame, key_col: str) -> DataFrame:
    """key, turn, role, text and the digest of the text, which orders rows of one turn and role."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(key_col).alias("key"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def coded(turns: DataFrame) -> DataFrame:
    """Of rows (key, turn, role, text, digest) each distinct (key, turn, role, digest) with n, its number, initial, blank, cut, and
    first: is no row with this role and text before it?"""
    bare = F.rtrim("text", F.lit(BLANK))
    rows = turns.select("key", "turn", "role", "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    rows = rows.groupBy("key", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    earlier = Window.partitionBy("key", "role", "digest").orderBy("turn")
    return rows.withColumns({"first": F.row_number().over(earlier) == 1, "initial": F.substring("role", 1, 1)})


def _row_arcs() -> list[list[list[tuple[str, int, int]]]]:
    """Of each code and state the edits of a row: (initial, cost, state after)."""
    out = []
    for code in range(16):
        initial, must_go, extra = code & 3, code & MUST_GO, TRUNCATED if code & IS_CUT else 0
        states = []
        for q in range(4):
            arcs = [("D", DELETE, q)]
            if not must_go:
                if initial == INITIALS["s"] and q == START:
                    arcs.append(("K", extra, AFTER_S))
                if initial == NEXT[q]:
                    arcs.append(("K", extra, NEXT[q]))
                arcs.append(("R", REROLE + extra, NEXT[q]))
            states.append(arcs)
        out.append(states)
    return out


_ARCS = _row_arcs()


def auction(codes: bytes) -> tuple[int, str]:
    """The least cost of edits that give `(s?(ua)+)?`, and of the cheapest edits' initials the least in ASCII order.

    Nodes are (rows done, state), arcs the edits, with integer costs; a node's price never exceeds an arc's cost plus the price at its
    end. A path starts at each node, the last rows' first: while its end's price is below the least of cost plus price over its arcs, the
    price rises to that and the path contracts by a node, else it extends over that arc. A path that meets a settled node, whose price
    is its distance from the goal, is a shortest one, and settles all its nodes. The prices of a place start at the least of
    the place after, so each path is short. Then an arc is on a shortest path if it is tight, and the walk over tight arcs that takes the
    least initial each time gives the audit: no two arcs of a node have one initial.
    """
    n = len(codes)
    goal = 4 * (n + 1)
    price, settled = [0] * (goal + 1), bytearray(goal + 1)
    settled[goal] = 1

    def arcs(node: int) -> list[tuple[str, int, int]]:
        at, q = divmod(node, 4)
        out = [("I", INSERT, 4 * at + NEXT[q])]
        if at < n:
            out += [(x, cost, 4 * at + 4 + to) for x, cost, to in _ARCS[codes[at]][q]]
        elif q in (START, AFTER_A):
            out.append(("", 0, goal))
        return out

    for at in range(n, -1, -1):
        if at < n:
            price[4 * at : 4 * at + 4] = [min(price[4 * at + 4 : 4 * at + 8])] * 4
        for origin in range(4 * at, 4 * at + 4):
            path = [] if settled[origin] else [origin]
            while path:
                end = path[-1]
                least, to = min((cost + price[x], x) for _, cost, x in arcs(end))
                if price[end] < least:
                    price[end] = least
                    if len(path) > 1:
                        path.pop()
                elif settled[to]:
                    for x in path:
                        settled[x] = 1
                    path = []
                else:
                    path.append(to)

    audit, node = [], 0
    while node != goal:
        initial, node = min((x, to) for x, cost, to in arcs(node) if price[node] == cost + price[to])
        audit.append(initial)
    return price[0], "".join(audit)


_AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(turns: DataFrame, key_col: str = "conv_id") -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost and audit of each key with a row.

    A conversation's rows are ordered by turn (null first), those of one turn by role, then by the SHA-256 of the text. Each row's first fault
    counts: blank (only characters of BLANK), duplicate (the role and text of an earlier row), truncated (the last character but these
    isn't `.`, `!` or `?`). gaps: missing numbers between the least and the largest turn; illegal: neighbours whose roles' initials are not su, ua or
    au. cost and audit: the cheapest edits of all rows that give the roles `(s?(ua)+)?` (see `auction`): K(eep) 0, R(erole) to user or assistant 1,
    D(elete) 2, which blank and duplicate rows must have, I(nsert) an empty user or assistant 5; a truncated row that stays costs 5 more.

    A null role or text is one space; null keys are one conversation. Repeated rows are duplicates. An empty table gives no rows. Other
    columns are not read. Texts leave their rows as digests only; a conversation's rows then pass one task in order, which holds a byte and
    four prices for each: no more than the audit, which is one value, has characters.
    """
    rows = coded(_named(turns, key_col))
    types = f"key {rows.schema['key'].dataType.simpleString()}, {_AUDIT}"

    class Now:
        def __init__(self, key):
            self.key, self.codes, self.counts = key, bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            self.turns, self.least, self.most, self.before = 0, None, None, None

        def add(self, turn, initial, blank, cut, first, n):
            if turn is not None and turn != self.most:
                self.turns, self.most = self.turns + 1, turn
                self.least = turn if self.least is None else self.least
            again = n if not first else n - 1
            self.counts["blank"] += n if blank else 0
            self.counts["duplicate"] += 0 if blank else again
            self.counts["truncated"] += 1 if cut and first and not blank else 0
            code = INITIALS.get(initial, 0)
            self.codes += bytes([code | (MUST_GO if blank or not first else IS_CUT if cut else 0)]) + bytes([code | MUST_GO]) * (n - 1)
            legal = ("su", "ua", "au")
            self.counts["illegal"] += (n - 1) + (self.before is not None and self.before + initial not in legal)
            self.before = initial

        def result(self) -> tuple:
            gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
            return self.key, gaps, *self.counts.values(), *auction(bytes(self.codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = None, None
        for batch in batches:
            done = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or key != now.key:
                    if now is not None:
                        done.append(now.result())
                    now = Now(key)
                now.add(*row)
            schema = pa.schema([pa.field("key", batch.schema.field(0).type), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
            yield _table(done, schema)
        if now is not None:
            yield _table([now.result()], schema)

    dealt = in_order(rows, ["key"], ["turn", "role", "digest"]).select("key", "turn", "initial", "blank", "cut", "first", "n")
    return dealt.mapInArrow(run, types).withColumnRenamed("key", key_col)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Replay:
    """The rows of a repaired conversation, given its audit and its rows one by one."""

    WORDS = {AFTER_U: "user", AFTER_A: "assistant"}

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _new(self) -> str:
        self.state = NEXT[self.state]
        return self.WORDS[self.state]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._new(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER_S if role[:1] == "s" else NEXT[self.state]
            yield "K", role, text
        elif edit == "R":
            yield "R", self._new(), text


def _replayed(turns: DataFrame, found: DataFrame, key_col: str) -> DataFrame:
    """Each conversation's audit, then its rows in order, dealt by key."""
    names = [f.name for f in found.schema if f.name != key_col]
    none = lambda kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds]
    text = [("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "binary")]
    heads = found.select(F.col(key_col).alias("key"), F.lit(0).alias("kind"), *none(text), *names)
    rows = _named(turns, key_col).select("key", F.lit(1).alias("kind"), *(c for c, _ in text), *none([(f.name, f.dataType) for f in found.schema if f.name != key_col]))
    return in_order(heads.unionByName(rows), ["key"], ["kind", "turn", "role", "digest"]).drop("digest", "turn")


def repaired(turns: DataFrame, found: DataFrame, key_col: str = "conv_id") -> DataFrame:
    """key, place (from 0), edit (K, R or I), role and text: the rows of the repaired conversations, given `audits` of the same turns."""
    both = _replayed(turns, found.select(key_col, "audit"), key_col)
    key_type = both.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, place, last, schema = None, 0, None, None
        for batch in batches:
            schema = pa.schema([pa.field("key", batch.schema.field(0).type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            out: list[tuple] = []
            for key, kind, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    for x in replay.inserted() if replay else ():
                        out.append((last, place, *x))
                        place += 1
                    replay, place, last = Replay(audit), 0, key
                else:
                    for x in replay.row(role, text):
                        out.append((key, place, *x))
                        place += 1
            yield _table(out, schema)
        if replay:
            yield _table([(last, place + k, *x) for k, x in enumerate(replay.inserted())], schema)

    return both.mapInArrow(run, f"key {key_type}, place long, edit string, role string, text string").withColumnRenamed("key", key_col)


def with_digest(turns: DataFrame, found: DataFrame, key_col: str = "conv_id") -> DataFrame:
    """`audits` of the same turns with repaired_sha256, that of the repaired rows as `role:text`, joined by line ends. A task holds one row at a time."""
    both = _replayed(turns, found, key_col)
    types = f"key {both.schema['key'].dataType.simpleString()}, {_AUDIT}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, replay, state, empty, schema = None, None, None, True, None

        def write(rows) -> None:
            nonlocal empty
            for _, role, text in rows:
                state.update((("" if empty else "\n") + f"{role}:{text}").encode())
                empty = False

        def result() -> tuple:
            write(replay.inserted())
            return (*head, state.hexdigest())

        for batch in batches:
            schema = pa.schema([pa.field("key", batch.schema.field(0).type), *list(batch.schema)[4:], pa.field("repaired_sha256", pa.string())])
            done = []
            for key, kind, role, text, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if replay:
                        done.append(result())
                    head, replay, state, empty = (key, *rest), Replay(rest[-1]), hashlib.sha256(), True
                else:
                    write(replay.row(role, text))
            yield _table(done, schema)
        if replay:
            yield _table([result()], schema)

    return both.mapInArrow(run, types).withColumnRenamed("key", key_col)


def repair(turns: DataFrame, keys: DataFrame | None = None, key_col: str = "conv_id") -> DataFrame:
    """`audits` with repaired_sha256 (see `with_digest`). With `keys`, a row for each distinct key of it, and for one without a turn zeros, an
    empty audit and the hash of the empty string."""
    scratch = Scratch(turns.sparkSession, "repair")
    found = with_digest(turns, scratch.save(audits(turns, key_col), "audits"), key_col)
    if keys is None:
        return found
    every, own = keys.select(F.col(key_col).alias("__key")).distinct(), [c for c in found.columns if c != key_col]
    joined = every.join(found, F.col("__key").eqNullSafe(F.col(key_col)), "left")
    default: dict[str, Column] = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return joined.select(F.col("__key").alias(key_col), *(F.coalesce(c, default.get(c, F.lit(0).cast("long"))).alias(c) for c in own))

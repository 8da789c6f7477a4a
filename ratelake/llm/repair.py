"""Conversation structure repair by iterative-deepening A*.

A conversation's rows, in turn order, are edited until their roles read
``(s?(ua)+)?``: an optional system turn, then user and assistant in alternation, or nothing.
Going through the rows, the search either

* Deletes the row (4), which it must where the row is blank or repeats an earlier one,
* Inserts an empty user or assistant turn before it (3),
* Keeps it (0) if its role fits, or
* Reroles it to the role that fits (3);

a truncated row that is not deleted adds 3. The repair is the cheapest sequence of edits, and
of these the one whose initials are the ASCII-least string.

``cheapest_edits`` is a depth-first search that tries edits in ASCII order within a cost
bound, which then rises to the least cost beyond it. A table of failed states (row, role
expected) holds the least that a state is known to cost from there on, so a state is not
searched again with no more money. It starts from a relaxed problem: blocks of rows in which
any role may be expected at the start of a block. The first path that ends well is the answer.

Rows are dealt by conversation and streamed in order through Arrow batches; a task holds one
conversation at a time: a byte a row for the search, and its texts while they are within
``HELD_BYTES``. Texts of larger conversations are never held: their digest is taken in a second
pass that meets each conversation's edits first and streams its rows by.

Defined results: null roles and texts, and null ids inside the damage key, count as one
space; rows with null ids form one conversation; rows of one turn are taken by role and
text; a role fits by its first letter, an empty role never fits; ``gaps`` stays within a
long; conversations without rows after damage give zeros and the digest of nothing; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.llm.common import saved, small_side

# What an edit costs, in ASCII order of the initials.
DELETE, INSERT, KEEP, REROLE, UNFINISHED = 4, 3, 0, 3, 3
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK = r"[\x20\x09-\x0D]"
HELD_BYTES = 32 << 20
BLOCK = 64
FAR = 1 << 60

# Expected next: 0 system or user, 1 user after system, 2 assistant, 3 user (or the end).
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
INSERTED = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
KEPT = ({"s": AFTER_SYSTEM, "u": AFTER_USER}, {"u": AFTER_USER}, {"a": AFTER_ASSISTANT}, {"u": AFTER_USER})
NAMED = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
GOOD, CUT, GONE = range(3)  # nothing wrong, truncated, to be deleted

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def edits_from(expected: int, role: str, fault: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, rows taken, role expected next) of every edit, in ASCII order."""
    out = [("D", DELETE, 1, expected), ("I", INSERT, 0, INSERTED[expected])]
    if fault != GONE:
        more = UNFINISHED if fault == CUT else 0
        if role in KEPT[expected]:
            out.append(("K", KEEP + more, 1, KEPT[expected][role]))
        out.append(("R", REROLE + more, 1, INSERTED[expected]))
    return out


EDITS = {(e, r, f): edits_from(e, r, f) for e in range(4) for r in "sua?" for f in (GOOD, CUT, GONE)}
CODES = [(r, f) for r in "sua?" for f in (GOOD, CUT, GONE)]
CODE = {rf: i for i, rf in enumerate(CODES)}
MOVES = [[EDITS[e, r, f] for e in range(4)] for r, f in CODES]
AT_END = [[("I", INSERT, 0, INSERTED[e])] for e in range(4)]


def relaxed_costs(codes: bytes) -> list[int]:
    """For every row and role expected (index ``4 * row + expected``) a cost that no repair of the rest undercuts.

    Exact within a block; at a block's end any expected role may go on as any other.
    """
    n = len(codes)
    block = max(BLOCK, n // BLOCK)
    low = [FAR] * (4 * n + 4)
    after = [0, FAR, FAR, 0]
    for e in (AFTER_USER, START, AFTER_SYSTEM):  # at the end only insertions are left
        after[e] = min(after[e], INSERT + after[INSERTED[e]])
    low[4 * n :] = after
    for i in range(n - 1, -1, -1):
        if (i + 1) % block == 0 and i + 1 < n:
            after = [min(after)] * 4
        here = [min((c + after[to] for _, c, taken, to in MOVES[codes[i]][e] if taken), default=FAR) for e in range(4)]
        for _ in range(3):  # insertions go round the expected roles
            here = [min(here[e], INSERT + here[INSERTED[e]]) for e in range(4)]
        low[4 * i : 4 * i + 4] = here
        after = here
    return low


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and initials of the cheapest edits (ties: ASCII-least) of rows given by their ``CODE``."""
    n = len(codes)
    low = relaxed_costs(codes)
    while True:
        bound = low[START]
        # A frame: state, money left, edits not tried yet, least cost found among those that failed.
        state, money = START, bound
        moves, least = iter(MOVES[codes[0]][START] if n else AT_END[START]), FAR
        path: list[tuple[int, int, Iterator[tuple[str, int, int, int]], int, int]] = []
        initials: list[str] = []
        while True:
            if state // 4 == n and state % 4 in (START, AFTER_ASSISTANT):
                return bound, "".join(initials)
            for initial, cost, taken, to in moves:
                child = 4 * (state // 4 + taken) + to
                total = cost + low[child]
                if total <= money:
                    path.append((state, money, moves, least, cost))
                    initials.append(initial)
                    state, money, least = child, money - cost, FAR
                    row = state // 4
                    moves = iter(MOVES[codes[row]][to] if row < n else AT_END[to])
                    break
                least = min(least, total)
            else:  # a failed state: remember what it costs at least
                low[state] = max(low[state], least)
                if not path:
                    break
                failed = low[state]
                state, money, moves, least, cost = path.pop()
                initials.pop()
                least = min(least, cost + failed)


class Repaired:
    """SHA-256 of a repaired conversation, fed its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.expected, self.first, self.hash = audit, 0, START, True, hashlib.sha256()

    def _put(self, role: bytes, text: bytes) -> None:
        self.hash.update((b"" if self.first else b"\n") + role + b":" + text)
        self.first = False

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.expected = INSERTED[self.expected]
            self._put(NAMED[self.expected].encode(), b"")
            self.at += 1

    def row(self, role: bytes, text: bytes) -> None:
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.expected = KEPT[self.expected][chr(role[0])]
            self._put(role, text)
        elif edit == "R":
            self.expected = INSERTED[self.expected]
            self._put(NAMED[self.expected].encode(), text)

    def digest(self) -> str:
        self._insertions()
        return self.hash.hexdigest()


@dataclass
class Conversation:
    """What is gathered of one conversation while its rows go by."""

    held: bool
    codes: bytearray = field(default_factory=bytearray)
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])  # blank, duplicate, truncated, illegal
    low: int | None = None
    high: int | None = None
    turns: int = 0
    initial: str = ""
    rows: list[tuple[bytes, bytes]] = field(default_factory=list)

    def add(self, turn: int | None, role: bytes, text: bytes | None, initial: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.codes and self.initial + initial not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.initial = initial
        if fault:
            self.counts[fault - 1] += 1
        self.codes.append(CODE[initial if initial and initial in "sua" else "?", (GOOD, GONE, GONE, CUT)[fault]])
        if self.held:
            self.rows.append((role, text or b""))

    def result(self) -> tuple[int, int, int, int, int, int, str, str | None]:
        cost, audit = cheapest_edits(bytes(self.codes))
        digest = None
        if self.held:
            repaired = Repaired(audit)
            for role, text in self.rows:
                repaired.row(role, text)
            digest = repaired.digest()
        gaps = 0 if self.low is None or self.high is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return (gaps, *self.counts, cost, audit, digest)  # type: ignore[return-value]


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations after the damage that ``crc32(conv_id:turn) % 20`` asks for: conv_id, turn, role, text."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(own("conv_id"), F.lit(":"), own("turn")), "UTF-8")) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), own("role").alias("role"), own("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")
    )
    return rows.drop("copy")


def _last_mark() -> Column:
    """The last character that is no white space, '' if there is none."""
    return F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Rows dealt by conversation, in turn order within it."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text")


def _same() -> Column:
    """A digest of role and text."""
    return F.sha2(F.encode(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256)


def _facts(rows: DataFrame) -> DataFrame:
    """Rows with ``shared`` (role and text occur again in the conversation) and ``again`` (first in an earlier turn).

    The first turn is found by aggregation, so rows that share role and text are not brought together.
    """
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    keyed = rows.withColumn("same", _same())
    firsts = keyed.groupBy("conv_id", "same").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = saved(firsts.select(F.col("conv_id").alias("c"), F.col("same").alias("s"), F.col("first.turn").alias("first_turn")))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s"))
    joined = keyed.join(small_side(firsts, firsts.count()), on, "left")
    later = F.col("s").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    return joined.select("conv_id", "turn", "role", "text", F.col("s").isNotNull().alias("shared"), later.alias("again"))


def _repairs(rows: DataFrame, held: bool) -> DataFrame:
    """conv_id and ``RESULT`` of every conversation of ordered rows (texts are held only if asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
        )
        own: Conversation | None = None
        now: int | None = None
        met: set[str] = set()
        last = None
        for batch in batches:
            out = []
            ids, turns, roles, initials, marks, shared, again = (batch.column(i).to_pylist() for i in range(7))
            texts = batch.column(7).to_pylist() if held else [None] * len(ids)
            sames = batch.column(8).to_pylist()
            for conv, turn, role, initial, mark, twin, later, text, same in zip(ids, turns, roles, initials, marks, shared, again, texts, sames, strict=True):
                if own is None or conv != now:
                    if own is not None:
                        out.append((now, *own.result()))
                    own, now, last = Conversation(held), conv, None
                    met = set()
                if last != turn or not own.codes:
                    met, last = set(), turn
                repeat = later
                if twin and not later:  # the first turn that holds it: the first row of it there is the original
                    repeat = same in met
                    met.add(same)
                fault = 1 if mark == "" else 2 if repeat else 0 if mark in ".!?" else 3
                own.add(turn, role, text, initial, fault)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, *own.result()), schema, strict=True)], schema=schema)

    columns = [
        "conv_id", "turn", F.col("role").cast("binary"), F.left("role", F.lit(1)), _last_mark(), "shared", "again",
        F.col("text").cast("binary") if held else F.lit(None).cast("binary"),
        F.when(F.col("shared"), _same()),
    ]
    named = [F.col(c).alias(f"f{i}") if isinstance(c, str) else c.alias(f"f{i}") for i, c in enumerate(columns)]
    return rows.select(*named).mapInArrow(run, f"conv_id long, {RESULT}")


def _digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations of any size: each one's edits come first, then its rows stream by."""
    heads = repairs.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    both = heads.unionAll(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Repaired | None = None
        now: int | None = None

        def ended() -> pa.RecordBatch:
            assert own is not None
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([own.digest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            for conv, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == 0:
                    if own is not None:
                        yield ended()
                    own, now = Repaired(text.decode()), conv
                else:
                    assert own is not None
                    own.row(role, text)
        if own is not None:
            yield ended()

    ordered = _ordered(both, "kind")
    return ordered.select("conv_id", "kind", F.col("role").cast("binary"), F.col("text").cast("binary")).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_report(rows: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Damage the conversations, then one row per original conversation: faults, cheapest repair, digest."""
    everyone = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    facts = _facts(damaged(rows))
    large = facts.groupBy("conv_id").agg(F.sum(F.octet_length("text").cast("long") + F.octet_length("role") + 64).alias("size")).where(F.col("size") > held_bytes)
    large = saved(large.select(F.col("conv_id").alias("c")))
    n = large.count()
    on = F.col("conv_id").eqNullSafe(F.col("c"))
    if n:
        some = facts.join(small_side(large, n), on, "left_semi")
        open_ = saved(_repairs(_ordered(some), held=False).drop("repaired_sha256"))
        digests = _digests(some, open_)
        found = open_.join(digests.withColumnRenamed("conv_id", "c"), on).select("conv_id", *[p.split()[0] for p in RESULT.split(", ")])
        found = found.unionAll(_repairs(_ordered(facts.join(small_side(large, n), on, "left_anti")), held=True))
    else:
        found = _repairs(_ordered(facts), held=True)
    found = found.withColumnRenamed("conv_id", "c")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    nothing = hashlib.sha256().hexdigest()
    return everyone.join(found, on, "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def oracle_sql(table: str = "conversations") -> str:
    """The same report in DuckDB: CRC-32 by table, and a fold over each conversation's rows that keeps the best
    (cost, initials, repaired rows) for every role that may be expected next."""
    far = f"{{'c': CAST({FAR} AS BIGINT), 'a': '', 'o': ''}}"

    def step(e: int, cost: object, initial: str, out: str) -> str:
        return f"{{'c': s[{e + 1}].c + {cost}, 'a': s[{e + 1}].a || '{initial}', 'o': s[{e + 1}].o || {out}}}"

    def inserted(to: int) -> str:
        froms = [e for e in range(4) if INSERTED[e] == to]
        return f"list_min([s[{to + 1}]" + "".join(", " + step(e, INSERT, "I", f"'{NAMED[to]}:' || chr(10)") for e in froms) + "])"

    def for_each(value: str, body: str) -> str:
        return f"list_transform([{value}], lambda s: {body})[1]"

    closed = "[" + ", ".join(inserted(e) if e in NAMED else f"s[{e + 1}]" for e in range(4)) + "]"

    def closure(value: str) -> str:
        return for_each(for_each(for_each(value, closed), closed), closed)

    def taken(to: int) -> str:
        more = f"CASE WHEN r.f = 'truncated' THEN {UNFINISHED} ELSE 0 END"
        options = [step(to, DELETE, "D", "''")]
        for e in range(4):
            for letter, after in KEPT[e].items():
                if after == to:
                    kept = step(e, f"({more})", "K", "r.role || ':' || r.text || chr(10)")
                    options.append(f"CASE WHEN r.stays AND r.i = '{letter}' THEN {kept} ELSE {far} END")
            if INSERTED[e] == to:
                given = step(e, f"{REROLE} + ({more})", "R", f"'{NAMED[to]}:' || r.text || chr(10)")
                options.append(f"CASE WHEN r.stays THEN {given} ELSE {far} END")
        return f"list_min([{', '.join(options)}])"

    fold = for_each(closure("acc"), "[" + ", ".join(taken(e) for e in range(4)) + "]")
    start = "[{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}, " + ", ".join([far] * 3) + "]"
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM {table}
),
d AS (
  SELECT k.*, xor(list_reduce(list_transform(range(length(key)), lambda i: CAST(ascii(substr(key, CAST(i AS INTEGER) + 1, 1)) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM k, crc
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE kind <> 0)
),
numbered AS (
  SELECT *, left(role, 1) AS i, right(rtrim(text, {space}), 1) AS mark,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM hurt
),
faulty AS (
  SELECT *, CASE WHEN mark = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f,
    lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM numbered
),
convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'role': role, 'text': text, 'i': i, 'f': f, 'stays': f IN ('', 'truncated')}} ORDER BY pos) AS rows
  FROM faulty GROUP BY conv_id
),
solved AS (SELECT *, {closure(f"list_reduce(rows, lambda acc, r: {fold}, {start})")} AS s FROM convs),
best AS (SELECT * EXCLUDE (rows, s), list_min([s[1], s[4]]) AS b FROM solved)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(left(b.o, greatest(length(b.o) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {table}) a LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id
"""

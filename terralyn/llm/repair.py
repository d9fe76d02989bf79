"""Operator 11: repair of the structure of conversations, at the least cost and with the ASCII-least list of edits.

A repaired conversation is empty, or an optional system row and then user and assistant rows in turns. Edits: Keep (0),
Rerole to user or assistant (1), Delete (2, a must for blank and repeated rows), Insert an empty user or assistant row
(5); a truncated row that stays costs 5 more. Edits are found by depth-first branch-and-bound (`search`): an explicit
stack goes through lists of edits in ASCII order; a node is a row and a state of the grammar; suffix lower bounds are
counted once from the end; a node's dominance table holds the least cost that reached it, and since a later list is
ASCII-greater, equal cost is worse; what cannot beat the incumbent is cut, until the stack is empty.

Rows are numbered by conversation and turn in ranges, and searched in blocks of BLOCK numbers, so a conversation of any
length is spread over tasks. A conversation that reaches the end of a block is searched from each state to each state
there, and a pass over costs and ranks alone (at most 32 numbers for a block) joins the parts. That is exact: a part's
edits end with a row's edit, so of two lists for the same rows neither is the start of the other.
What stays sequential, as the digest asks for it, is one SHA-256 for each conversation; its texts stream through a task
that holds none of them, only the letters of the edits.

Cases: null roles and texts count as one space, null turns come first and make no gap; a null conv_id is a conversation
of its own; rows that share a turn are ordered by role and text (the first HEAD characters, then a hash); equal rows are
duplicates wherever they stand; any role but those with the initials s, u, a can only be reroled or deleted; other
columns are not read. gaps beyond a long count as the greatest long.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralyn.operators.relational import numbered

from .common import checkpoint, freed, shuffle_parts

#: Costs, and white space.
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
#: Rows that a task searches at a time.
BLOCK = 1024
#: Characters of a text that order rows of one turn and role.
HEAD = 256
#: States of the grammar: nothing yet, after system, user, assistant. GO: where the next row that may be inserted leads.
GO = (2, 2, 3, 2)
#: Where a kept row leads from each state, by its initial s, u, a or another; -1: nowhere.
KEEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: Cost of the rows inserted after the last one.
AFTER = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one row in four damaged, by a checksum of its conversation and turn."""
    space = F.lit(" ")
    text = F.coalesce(F.col("text").cast("string"), space)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_kind")).where("_kind <> 0")
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """n, conv_id, turn, role, text: rows numbered by conversation, then turn."""
    space = F.lit(" ")
    own = rows.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    at = F.struct("conv_id", "turn", "role", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("any"))
    return checkpoint(numbered(own.withColumn("_at", at), "_at", "n").select(F.col("n").cast("long"), "conv_id", "turn", "role", "text"))


def _fault(first: Column) -> Column:
    """A row's first fault, as a letter: b blank, d duplicate, t truncated, - none."""
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    return F.when(solid == "", "b").when(~first, "d").when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "t").otherwise("-")


def bounds(kinds: str, faults: str, leave: int | None) -> list[list[int]]:
    """The least cost of what follows each node (row, state); leave: the state to end in, None for a whole conversation."""
    below = list(AFTER) if leave is None else [0 if q == leave else NEVER for q in range(4)]
    out = [below]
    for kind, fault in zip(reversed(kinds), reversed(faults), strict=True):
        stays = 0 if fault == "-" else TRUNCATED if fault == "t" else NEVER
        own = []
        for q in range(4):
            kept = KEEP[q]["sua-".index(kind)]
            least = min(DELETE + below[q], stays + RE_ROLE + below[GO[q]])
            own.append(min(least, stays + below[kept]) if kept >= 0 else least)
        for _ in range(2):  # two inserts in a row reach every state that inserts reach
            own = [min(own[q], INSERT + own[GO[q]]) for q in range(4)]
        out.append(own)
        below = own
    return out[::-1]


def search(kinds: str, faults: str, enter: int = 0, leave: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits, the ASCII-least of these, by branch-and-bound; None where no edits lead there.

    kinds: a row's initial, or - for roles that no conversation may have; faults: a letter of `_fault` for each row.
    """
    n, bound = len(kinds), bounds(kinds, faults, leave)
    if bound[0][enter] >= NEVER:
        return None
    limit, audit = bound[0][enter] + 1, ""  # some edits cost what the root's bound says; the incumbent must reach it
    reached = [[NEVER] * 4 for _ in range(n + 1)]
    trail: list[str] = []
    stack = [(0, enter, 0, "", 0)]
    while stack:
        i, q, cost, letter, depth = stack.pop()
        if cost + bound[i][q] >= limit or cost >= reached[i][q]:
            continue
        reached[i][q] = cost
        del trail[max(depth - 1, 0) :]
        if letter:
            trail.append(letter)
        if i == n and (q == leave if leave is not None else q in (0, 3)):
            limit, audit = cost, "".join(trail)
            continue
        depth += 1
        if i < n:
            stays = 0 if faults[i] == "-" else TRUNCATED if faults[i] == "t" else NEVER
            if stays < NEVER:
                stack.append((i + 1, GO[q], cost + RE_ROLE + stays, "R", depth))
                kept = KEEP[q]["sua-".index(kinds[i])]
                if kept >= 0:
                    stack.append((i + 1, kept, cost + stays, "K", depth))
        if i < n or leave is None:
            stack.append((i, GO[q], cost + INSERT, "I", depth))
        if i < n:
            stack.append((i + 1, q, cost + DELETE, "D", depth))
    return limit, audit


def _parts(size: int):
    """Searches the parts of conversations in each block of size numbers: costs, ranks and audits from each state to each, or of the whole."""

    def settle(rows):
        ids, ns, kinds, faults = rows
        cuts = [0, *[k for k in range(1, len(ids)) if ids[k] != ids[k - 1]], len(ids)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            kind, fault = "".join(kinds[a:b]), "".join(faults[a:b])
            whole = a > 0 and b < len(ids)
            if whole:
                cost, audit = search(kind, fault)
                costs, ranks, audits = [cost], [0], [audit]
            else:
                found = [search(kind, fault, q, x) for q in range(4) for x in range(4)]
                costs, audits = [f[0] if f else NEVER for f in found], [f[1] if f else "" for f in found]
                ranks = [sorted(audits[k // 4 * 4 : k // 4 * 4 + 4]).index(audits[k]) for k in range(16)]
            out.append((ids[a], ns[a], whole, fault, costs, ranks, audits))
        return out

    def run(batches):
        held, block = ([], [], [], []), None
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("conv_id", "n", "kind", "fault")]
            done = []
            for row in zip(*rows, strict=True):
                if row[1] // size != block:
                    if held[0]:
                        done += settle(held)
                    held, block = ([], [], [], []), row[1] // size
                for column, value in zip(held, row, strict=True):
                    column.append(value)
            if done:
                yield _batch(done, _PART, batch.schema.field("conv_id").type)
            kind = batch.schema.field("conv_id").type
        if held[0]:
            yield _batch(settle(held), _PART, kind)

    return run


_PART = [("n", pa.int64()), ("whole", pa.bool_()), ("faults", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))]
_ROW = [("nth", pa.int64()), ("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("was", pa.string()), ("role", pa.string()), ("text", pa.string())]


def _batch(rows: list[tuple], columns: list, kind: pa.DataType) -> pa.RecordBatch:
    columns = [("conv_id", kind), *columns]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])


def _joined(batches):
    """(n, enter, leave) of each part: the cheapest way through a conversation's parts, by their costs and ranks."""

    def settle(parts):
        least, ways = list(AFTER), []
        for _, costs, ranks in reversed(parts):
            way = [min(((costs[4 * q + x] + least[x], ranks[4 * q + x], x) for x in range(4))) for q in range(4)]
            ways.append([w[2] for w in way])
            least = [min(w[0], NEVER) for w in way]
        q, out = 0, []
        for (n, _, _), way in zip(parts, reversed(ways), strict=True):
            out.append((n, q, way[q]))
            q = way[q]
        out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 4)  # the last part has the rows inserted at the end
        return out

    held, last = [], None
    for batch in batches:
        done = []
        for key, *part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "costs", "ranks")), strict=True):
            if held and key != last:
                done += settle(held)
                held = []
            last = key
            held.append(part)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], ["n", "enter", "leave"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*settle(held), strict=True)], ["n", "enter", "leave"])


def _audits(rows: DataFrame) -> DataFrame:
    """conv_id, n, faults, audit: the edits of each part of a conversation, the first row's number and its rows' faults."""
    parts, kind = shuffle_parts(rows.sparkSession), rows.schema["conv_id"].dataType.simpleString()
    same = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = rows.groupBy("conv_id", same.alias("same")).agg(F.min("n").alias("n")).select("n", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    slim = rows.select("conv_id", "n", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("kind"), _fault(F.lit(True)).alias("fault")).join(first, "n", "left")
    slim = slim.select("conv_id", "n", "kind", F.when((F.col("fault") != "b") & F.col("first").isNull(), "d").otherwise(F.col("fault")).alias("fault"))
    dealt = slim.withColumn("block", F.floor(F.col("n") / BLOCK)).repartition(parts, "block").sortWithinPartitions("n").drop("block")
    found = checkpoint(dealt.mapInArrow(freed(_parts(BLOCK)), f"`conv_id` {kind}, n long, whole boolean, faults string, costs array<long>, ranks array<int>, audits array<string>"))
    open_ = found.where("not whole").select("conv_id", "n", "costs", "ranks").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "n")
    ways = open_.mapInArrow(_joined, "n long, enter long, leave long")
    last = F.when(F.col("leave") < 4, "").when(F.col("leave") == 5, "II").when(F.col("leave") == 6, "I").otherwise("")
    audit = F.when(F.col("whole"), F.col("audits")[0]).otherwise(F.concat(F.expr("audits[4 * enter + leave % 4]"), last))
    return found.join(ways, "n", "left").select("conv_id", "n", "faults", audit.alias("audit"))


def edited(rows: DataFrame) -> DataFrame:
    """Every edit of every conversation, in order: conv_id, nth, edit, fault, turn, was, role, text.

    edit: D, I, K or R; was and turn: the row's own, null for inserted rows; role and text: the repaired row's, null for
    deleted ones. Rows of a conversation lie in one partition, in order.
    """
    own = _ordered(rows)
    kind = own.schema["conv_id"].dataType.simpleString()
    audits = _audits(own).select("conv_id", "n", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), F.col("faults").alias("role"), F.col("audit").alias("text"))
    both = audits.unionByName(own.select("conv_id", "n", F.lit(1).alias("tag"), "turn", "role", "text"))
    dealt = both.repartition(shuffle_parts(own.sparkSession), "conv_id").sortWithinPartitions("conv_id", "n", "tag")

    def run(batches):
        names = (None, None, "user", "assistant")
        todo, faults, state, nth, last, kept = iter(""), iter(""), 0, 0, None, None
        kind = None

        def inserted(letters):
            nonlocal state, nth
            for letter in letters:
                if letter != "I":
                    return letter
                state = GO[state]
                out.append((last, nth, "I", "-", None, None, names[state], ""))
                nth += 1
            return None

        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for key, tag, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "tag", "turn", "role", "text")), strict=True):
                if tag == 0:
                    inserted(todo)  # what the part before has left
                    if kept is None or key != last:
                        state, nth, last, kept = 0, 0, key, True
                    todo, faults = iter(text), iter(role)
                    continue
                edit, fault = inserted(todo), next(faults)
                if edit == "K":
                    state = KEEP[state]["sua".index(role[0])]
                    out.append((key, nth, edit, fault, turn, role, role, text))
                elif edit == "R":
                    state = GO[state]
                    out.append((key, nth, edit, fault, turn, role, names[state], text))
                else:
                    out.append((key, nth, edit, fault, turn, role, None, None))
                nth += 1
            if out:
                yield _batch(out, _ROW, kind)
        out = []
        inserted(todo)
        if out:
            yield _batch(out, _ROW, kind)

    return dealt.mapInArrow(run, f"`conv_id` {kind}, nth long, edit string, fault string, turn long, was string, role string, text string")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, nth, turn (null for inserted rows), role, text."""
    return edited(rows).where("edit <> 'D'").select("conv_id", "nth", "turn", "role", "text")


class _Report:
    """What the digest counts of one conversation while its edits stream by."""

    def __init__(self):
        self.faults = {"b": 0, "d": 0, "t": 0, "-": 0}
        self.illegal = self.cost = self.turns = 0
        self.before = self.low = self.high = None
        self.audit, self.hash, self.any = [], hashlib.sha256(), False

    def add(self, edit, fault, turn, was, role, text):
        self.audit.append(edit)
        self.cost += {"K": 0, "R": RE_ROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "t" and edit != "D" else 0)
        if edit != "I":
            self.faults[fault] += 1
            if self.before is not None:
                self.illegal += self.before + was[:1] not in ("su", "ua", "au")
            self.before = was[:1]
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if edit != "D":
            self.hash.update(("\n" * self.any + role + ":" + text).encode())
            self.any = True

    def row(self, key):
        gaps = min(self.high - self.low + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
        return (key, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_DIGEST = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def digests(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations: faults after the damage, the cheapest edits, and a digest of the repair."""
    rows = edited(damaged(conversations))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        report, last, kind = None, None, None
        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for key, nth, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "nth", "edit", "fault", "turn", "was", "role", "text")), strict=True):
                if nth == 0:
                    if report:
                        done.append(report.row(last))
                    report, last = _Report(), key
                report.add(*rest)
            if done:
                yield _batch(done, _DIGEST, kind)
        if report:
            yield _batch([report.row(last)], _DIGEST, kind)

    found = rows.mapInArrow(run, f"`conv_id` {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    out = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("_id").alias("conv_id"), *[F.coalesce(F.col(c), none.get(c, F.lit(0).cast("long"))).alias(c) for c, _ in _DIGEST])


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _edit(state: str, cost: str, letter: str, said: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 's': {state}.s || {said}}}"


def _closed(names: tuple[str, str, str, str]) -> tuple[str, str]:
    """The states after user and after assistant, rows inserted before them included: the rest do not change."""
    none, system, user, assistant = names
    add = lambda state, role: _edit(state, str(INSERT), "I", f"chr(10) || '{role}:'")
    once = _least(user, add(none, "user"), add(system, "user"), add(assistant, "user"))
    return once, _least(assistant, add(user, "assistant"), f"{{'c': {INSERT} + ({once}).c, 'a': ({once}).a || 'I', 's': ({once}).s || chr(10) || 'assistant:'}}")


def _sql() -> str:
    """The same by a recursion over rows: of every state of the grammar the cheapest edits so far, with their audit and text."""
    never = "{'c': 1000000000000, 'a': '', 's': ''}"
    stays = "CASE r.fault WHEN '-' THEN 0 WHEN 't' THEN 5 ELSE 1000000000000 END"
    keep = lambda state, kind: f"CASE WHEN r.kind = '{kind}' THEN {_edit(state, stays, 'K', 'chr(10) || r.role || chr(58) || r.text')} ELSE {never} END"
    turn = lambda state, role: _edit(state, f"1 + {stays}", "R", f"chr(10) || '{role}:' || r.text")
    gone = lambda state: _edit(state, "2", "D")
    user = _least(gone("t.q2"), *[turn(f"t.q{k}", "user") for k in (0, 1, 3)], *[keep(f"t.q{k}", "u") for k in (0, 1, 3)])
    rows = f"SELECT t.conv_id, t.n + 1 AS n, {gone('t.q0')} AS q0, {_least(gone('t.q1'), keep('t.q0', 's'))} AS q1, {user} AS p2, {_least(gone('t.q3'), turn('t.q2', 'assistant'), keep('t.q2', 'a'))} AS p3 FROM t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.n = t.n + 1"
    q2, q3 = _closed(("q0", "q1", "p2", "p3"))
    first = "{'c': 0, 'a': '', 's': ''}"
    start2, start3 = _closed((first, never, never, never))
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), h AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM k
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM o
), r AS (
  SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS kind,
    CASE WHEN solid = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN solid[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair, lag(n) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM e
), t AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, {first} AS q0, {never} AS q1, {start2} AS q2, {start3} AS q3 FROM r
  UNION ALL SELECT conv_id, n, q0, q1, {q2} AS q2, {q3} AS q3 FROM ({rows})
), last AS (
  SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1
), b AS (
  SELECT last.*, {_least('t.q0', 't.q3')} AS q FROM last JOIN t ON t.conv_id IS NOT DISTINCT FROM last.conv_id AND t.n = last.n
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(q.c, 0) AS BIGINT) AS cost, coalesce(q.a, '') AS audit, sha256(coalesce(q.s[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
"""


SQL = _sql()

"""Operator 5: line dedup by an exact set-similarity join.

A line's tokens are its distinct words, A-Z in lower case. A line goes if an earlier line (smaller doc_id, or earlier in
the same document) has a token set whose Jaccard similarity with its own is at least 4/5, judged on the input. Tokens
are ordered by rarity, so a line meets only the lines with which it shares a token of its rarest fifth, its prefix;
pairs then pass a length filter, a positional filter (what follows the first shared token must suffice) and a parity
bitmap (each token that only one line has flips one of its 128 bits), none of which loses a pair, and are verified on
the words of both lines.

Rarity comes from a table of 2 ** COUNTER_BITS counts over all documents, whose size does not grow with the corpus: words
that share a counter are taken as equally rare, which costs time, never a pair. A token that occurs once can match
nothing and is not sent. In place of a token as common as COMMON, a line sends the pairs that it makes with the tokens of
the prefix one longer: two similar lines share two tokens there. Lines with equal sets are settled by a fingerprint of
128 bits, the later ones of a step before the shuffle.

Entries travel in packets, one for each partition of keys, so Spark moves thousands of rows, not one for each key.
In a first round a line names its best earlier candidate under each key, and the best of those is verified; lines of
one cluster meet under many keys, so this keeps the work in proportion to the lines. Under a key of more than CROWD lines the
best is one of the FIRST nearest earlier candidates. A line that its best candidate does not settle, and that had
others, gets all of them in a second round: ASKED lines at most are sent to all tasks, which name their candidates;
more are met by key again, with bitmaps of a fixed size to leave out what they do not ask for.

Cases: a null or empty text has one empty line; lines without a word always stay; a document whose lines all go is kept
with an empty text. Rows are told apart as common.identified says: rows that share an id, or have none, are documents of
their own, and of equal rows the first stays whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpoint, freed, identified, mix64, placed_words, retexted, retexted_schema, shuffle_parts, steps, utf8

COUNTER_BITS = 23
SLICE_BITS = 17
#: Code of 2048 occurrences, from which a token counts as common.
COMMON = 160
#: Tokens from which a line with common ones sends keys of whole groups of tokens, in place of keys of pairs.
LONG = 400
#: Lines under one key from which a line looks at its FIRST nearest earlier candidates only, in the first round.
CROWD, FIRST = 1024, 64
#: Entries that a task holds before it sends packets.
HELD = 1 << 18
#: Documents whose ids, and lines whose numbers, are sent to every executor at most; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_LINES = 250_000, 2_000_000
#: Lines whose keys are sent to every executor in the second round.
ASKED = 20_000
#: Bitmaps of lines, keys and tokens that the second round asks for: a fixed size; a chance hit costs time only.
BIT_SLOTS = 1 << 23


def similar(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether common / (n + m - common) is at least 4/5."""
    return 9 * common >= 4 * (n + m)


def _code(count: np.ndarray) -> np.ndarray:
    """Counts up to 128 as they are, larger ones on a scale of eighths of a doubling."""
    return np.where(count <= 128, count, np.minimum(255, 128 + 8 * np.log2(np.maximum(count, 1) / 128))).astype(np.uint8)


def rarity(docs: DataFrame) -> np.ndarray:
    """The code of each counter: words of all documents, counted by hash. 2 ** COUNTER_BITS bytes."""
    mask, per = U64((1 << COUNTER_BITS) - 1), 1 << SLICE_BITS

    def count(batches):
        table = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in steps(offsets):
                hashes, _, _ = placed_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                np.add.at(table, (hashes & mask).astype(np.int64), np.uint32(1))
        for k in range(0, len(table), per):
            own = np.flatnonzero(table[k : k + per])
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([k // per], pa.int32()), pa.array([own.astype(np.uint32).tobytes()], pa.binary()), pa.array([table[k + own].tobytes()], pa.binary())], ["slice", "at", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*(batch.column(c) for c in ("slice", "at", "n")), strict=True):
                own = sums.setdefault(k.as_py(), np.zeros(per, np.int64))
                own[np.frombuffer(at.as_buffer(), np.uint32)] += np.frombuffer(n.as_buffer(), np.uint32)
        for k, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_code(own).tobytes()], pa.binary())], ["slice", "codes"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(freed(count), "slice int, at binary, n binary")
    codes = np.zeros(1 << COUNTER_BITS, np.uint8)
    for row in parts.repartition(shuffle_parts(docs.sparkSession), "slice").mapInArrow(add, "slice int, codes binary").collect():
        codes[row["slice"] * per : (row["slice"] + 1) * per] = np.frombuffer(row["codes"], np.uint8)
    return codes


def _order(line: np.ndarray, rank: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Places in order of line, rank and tie, by one sort of 64-bit words where their top bits tell all apart."""
    bits = max(1, int(line[-1]).bit_length()) if len(line) else 1
    word = line.astype(U64) << U64(64 - bits) | rank >> U64(bits)
    order = np.argsort(word)
    own = word[order]
    same = own[1:] == own[:-1]
    if same.any() and (tie[order][1:][same] != tie[order][:-1][same]).any():
        return np.lexsort((tie, rank, line))
    return order


def line_sets(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of each line, in order of row, line and hash; each line's bounds in them, row and number.

    wanted, a bitmap of tokens, leaves out the lines that hold none of them.
    """
    hashes, bounds, starts = placed_words(data, offsets)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    line = row + breaks[starts]  # grows by one at each break and each text
    if wanted is not None and len(line):
        hit = np.zeros(line[-1] + 1, bool)
        hit[line[wanted[_slots(hashes)]]] = True
        use = hit[line]
        hashes, line, row, starts = hashes[use], line[use], row[use], starts[use]
    order = _order(line, hashes, hashes)
    hashes, line, row, starts = hashes[order], line[order], row[order], starts[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, line, row, starts = hashes[new], line[new], row[new], starts[new]
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    number = breaks[starts[first]] - breaks[offsets[:-1][row[first]]]
    return hashes, np.append(first, len(line)), row[first], number


def _prints(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of the sets between cuts."""
    n = np.diff(cuts).astype(U64)
    return tuple(mix64(np.add.reduceat(mix64(hashes ^ U64(c)), cuts[:-1]) + n) for c in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D))


def _signatures(hashes: np.ndarray, cuts: np.ndarray, use: np.ndarray):
    """(keys, lines, least token of each) of the lines in use, each of LONG tokens at least: a few keys for ten tokens.

    Lines are in bands by length, each 5/4 of the one before. Two similar lines whose shorter one is in a band differ in
    under a quarter of the band's end, so when that band deals tokens to half as many groups again, a third of the groups
    are the same in both. A group's tokens as a whole are a key. An eighth of the groups are empty and no key; that all
    equal ones are empty has a chance under 1e-15 from LONG on. A line sends the keys of its own band and of the one before.
    """
    lines = np.flatnonzero(use)
    if not len(lines):
        return
    n = np.diff(cuts)[lines]
    band = np.floor(np.log(n / LONG) / np.log(1.25) + 1e-9).astype(np.int64)
    token = np.concatenate([hashes[cuts[k] : cuts[k + 1]] for k in lines])
    for level in (band, band - 1):
        some = level >= 0
        groups = np.floor(0.25 * LONG * 1.25 ** (level + 1.0)).astype(np.int64) + 1
        groups += groups // 2
        own, line, size, shelf = token[np.repeat(some, n)], np.repeat(lines[some], n[some]), np.repeat(groups[some], n[some]), np.repeat(level[some], n[some])
        if not len(own):
            continue
        group = (mix64(own ^ U64(0x6C62272E07BB0142)) % size.astype(U64)).astype(np.int64)
        order = np.lexsort((group, line))
        own, line, group, shelf = own[order], line[order], group[order], shelf[order]
        starts = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (group[1:] != group[:-1])]))
        name = mix64(group[starts].astype(U64) * U64(0x9E3779B97F4A7C15) + shelf[starts].astype(U64) + U64(0x5A17))
        yield mix64(np.add.reduceat(mix64(own ^ U64(0x3C6EF372FE94F82B)), starts) + name), line[starts], np.minimum.reduceat(own, starts)


def _marks(hashes: np.ndarray, cuts: np.ndarray, codes: np.ndarray):
    """For some lines (cuts in hashes): parity bitmap, and keys with the line, position and first token of each."""
    n = np.diff(cuts)
    line = np.repeat(np.arange(len(n)), n)
    bit, high = U64(1) << ((hashes >> U64(42)) & U64(63)), (hashes >> U64(41)) & U64(1) == U64(1)
    parity = [np.bitwise_xor.reduceat(np.where(high == side, bit, U64(0)), cuts[:-1]) for side in (False, True)]
    code = codes[(hashes & U64((1 << COUNTER_BITS) - 1)).astype(np.int64)]
    order = _order(line, code.astype(U64) << U64(56) | hashes >> U64(8), hashes)
    token, code = hashes[order], code[order]
    pos = np.arange(len(token)) - cuts[:-1][line]
    reach = (n - (4 * n + 4) // 5 + 1)[line]
    own = np.flatnonzero((pos < reach) & (code > 1) & (code < COMMON))
    keys, at, where, first = [token[own]], [line[own]], [pos[own]], [token[own]]
    common = (pos < reach) & (code >= COMMON)
    crowded = np.bincount(line[common], minlength=len(n)) > 0
    short = 4 * n < 5 * LONG
    live = np.flatnonzero((pos <= reach) & (short & crowded)[line])
    step = 1
    while len(live):
        live = live[live + step < len(token)]
        live = live[(line[live + step] == line[live]) & (pos[live + step] <= reach[live])]
        own = live[common[live] | common[live + step]]
        own = own[(code[own] > 1) & (code[own + step] > 1)]
        keys.append(mix64(token[own] * U64(0x9E3779B97F4A7C15) + token[own + step]))
        at.append(line[own])
        where.append(np.full(len(own), -1))
        first.append(token[own])
        step += 1
    for key, own, least in _signatures(hashes, cuts, (n >= LONG) & crowded):
        keys.append(key)
        at.append(own)
        where.append(np.full(len(own), -1))
        first.append(least)
    return parity, *map(np.concatenate, (keys, at, where, first))


#: Columns of an entry under a key, and of one under a fingerprint.
_KEYED = [("key", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4"), ("print", "<u4"), ("b0", "<u8"), ("b1", "<u8"), ("asked", "<u1")]
_EQUAL = [("key", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("line", "<i4")]
_FOUND = "_doc long, line long, to_doc long, to_line long, apart int, more boolean"


def _packed(entries: list[np.ndarray], kinds: list) -> bytes:
    """Column after column, of each its first bytes, then its second ones: the shuffle's compression then takes small numbers well."""
    planes = lambda e, kind: np.ascontiguousarray(e.astype(kind, copy=False)).view(np.uint8).reshape(len(e), np.dtype(kind).itemsize).T
    return b"".join(planes(e, kind).tobytes() for e, (_, kind) in zip(entries, kinds, strict=True))


def _unpacked(packets: list, kinds: list) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in kinds)
    columns = {name: [] for name, _ in kinds}
    for packet in packets:
        buffer = packet if isinstance(packet, bytes) else packet.as_buffer()
        n, at = len(buffer) // width, 0
        for name, kind in kinds:
            size = np.dtype(kind).itemsize
            columns[name].append(np.ascontiguousarray(np.frombuffer(buffer, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
            at += n * size
    return {name: np.concatenate(own) for name, own in columns.items()}


def _packets(held: list[list[np.ndarray]], kinds: list, kind: int, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, kind, packet) of the entries that a task holds."""
    entries = [np.concatenate(c) for c in zip(*held, strict=True)]
    bucket = (entries[0] % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, cuts = np.unique(bucket[order], return_index=True)
    entries = [e[order] for e in entries]
    ends = [*cuts[1:].tolist(), len(order)]
    packets = [_packed([e[a:b] for e in entries], kinds) for a, b in zip(cuts.tolist(), ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), kind, np.int32)), pa.array(packets, pa.binary())], ["bucket", "kind", "packet"])


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) & U64(BIT_SLOTS - 1)).astype(np.int64)


def _lines_hash(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(doc.astype(U64) * U64(0x9E3779B97F4A7C15) + line.astype(U64))


def _ordered(e: dict[str, np.ndarray], by: str) -> dict[str, np.ndarray]:
    """Entries in order of key, by and rank, and the place where each key starts; rank is their order by document and line."""
    order = np.lexsort((e["rank"], e["key"])) if by == "doc" else np.lexsort((e["rank"], e[by], e["key"]))
    e = {k: v[order] for k, v in e.items()}
    new = np.concatenate([[True], e["key"][1:] != e["key"][:-1]])
    e["start"] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return e


def _alike(e: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of entries of like length that the positional filter and the bitmap leave, and how many tokens part them."""
    n, pos = e["n"], e["pos"]
    rest = np.where((pos[a] >= 0) & (pos[b] >= 0), np.minimum(n[a] - pos[a], n[b] - pos[b]), np.minimum(n[a], n[b]))
    near = similar(rest, n[a], n[b])
    a, b = a[near], b[near]
    apart = sum(np.bitwise_count(e[c][a] ^ e[c][b]).astype(np.int64) for c in ("b0", "b1"))
    near = similar((n[a] + n[b] - apart) // 2, n[a], n[b])
    return a[near], b[near], apart[near]


def _entries(e: dict[str, np.ndarray], every: bool) -> dict[str, np.ndarray]:
    """Entries in order of key, document and line; of equal sets under a key only the first, and those that ask."""
    order = np.lexsort((e["line"], e["doc"]))
    e = {k: v[order].astype(np.int64) if k in ("n", "pos", "line") else v[order] for k, v in e.items()}
    e["rank"] = np.arange(len(order))
    name = mix64(e["key"] ^ mix64(e["print"].astype(U64) << U64(32) | e["n"].astype(U64)) ^ e["b0"])
    order = np.argsort(name)
    new = np.concatenate([[True], name[order][1:] != name[order][:-1]])
    if not new.all():
        own = np.minimum.reduceat(order, np.flatnonzero(new))
        own = np.union1d(own, np.flatnonzero(e["asked"])) if every else np.sort(own)
        e = {k: v[own] for k, v in e.items()}
    return e


def _walk(e: dict[str, np.ndarray]):
    """(entries, places of a line and of its best earlier one, how many tokens part them, whether it had more) under each key."""
    e = _entries(e, False)
    names, size = np.unique(e["key"], return_counts=True)
    size = size[np.searchsorted(names, e["key"])]
    crowd = size > CROWD
    for part, by in ((~crowd & (size > 1), "n"), (crowd, "doc")):
        own = _ordered({k: v[part] for k, v in e.items()}, by)
        n, rank, start = own["n"], own["rank"], own["start"]
        best, had = np.full(len(n), 1 << 62), np.zeros(len(n), np.int64)
        live, step = np.arange(len(n)), 1
        while len(live):
            live = live[live - step >= start[live]]
            to = live - step
            near = 5 * n[to] >= 4 * n[live]
            if by == "n":  # lines grow under a key, so further ones are no longer near
                live = live[near]
                to, near = live - step, slice(None)
            else:
                near &= 5 * n[live] >= 4 * n[to]
            a, b, apart = _alike(own, live[near], to[near])
            late = rank[a] > rank[b]
            a, b = np.where(late, a, b), np.where(late, b, a)
            np.minimum.at(best, a, apart << 40 | b)
            np.add.at(had, a, 1)
            if by == "doc":
                live = live[had[live] < FIRST]
            step += 1
        a = np.flatnonzero(had)
        yield own, a, best[a] & ((1 << 40) - 1), best[a] >> 40, had[a] > 1


def _walk_all(e: dict[str, np.ndarray]):
    """(entries, places of a line that asks and of an earlier one, how many tokens part them, nothing): all candidates."""
    e = _ordered(_entries(e, True), "doc")
    n, live, step, out = e["n"], np.flatnonzero(e["asked"]), 1, []
    while len(live):
        live = live[live - step >= e["start"][live]]
        to = live - step
        near = (5 * n[to] >= 4 * n[live]) & (5 * n[live] >= 4 * n[to])
        out.append(_alike(e, live[near], to[near]))
        step += 1
        if sum(len(x[0]) for x in out) > 1 << 20:
            yield e, *map(np.concatenate, zip(*out, strict=True)), np.zeros(0, bool)
            out = []
    if out:
        yield e, *map(np.concatenate, zip(*out, strict=True)), np.zeros(0, bool)


def matches(docs: DataFrame, codes, asked=None) -> DataFrame:
    """(_doc, line, to_doc, to_line, apart, more): lines that equal an earlier one (to_doc null), and candidates with an earlier one.

    Under each key a line gets the best of its FIRST nearest earlier candidates; more tells that it had others. With
    asked, bitmaps of lines and keys, the lines of the first get all their candidates, under the keys of the second.
    """
    buckets = shuffle_parts(docs.sparkSession)
    every = asked is not None  # the functions below must not hold a DataFrame

    def send(batches):
        table, (lines, wanted, tokens) = codes.value, asked.value if every else (None, None, None)
        keyed, equal, settled = [], [], []

        def flush(least):
            for held, kinds, kind in ((keyed, _KEYED, 1), (equal, _EQUAL, 0), (settled, _EQUAL, 2)):
                if sum(len(x[0]) for x in held) > least:
                    yield _packets(held, kinds, kind, buckets)
                    held.clear()

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("_doc").to_numpy()
            for i, j in steps(offsets):
                hashes, cuts, row, number = line_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tokens)
                if not len(row):
                    continue
                doc, size = ids[i + row], np.diff(cuts)
                f1, f2 = _prints(hashes, cuts)
                order = np.lexsort((number, doc, f1))
                copy = np.zeros(len(size), bool)
                copy[order[1:]] = (f1[order][1:] == f1[order][:-1]) & (f2[order][1:] == f2[order][:-1])
                if not every:
                    equal.append([f1[~copy], f2[~copy], doc[~copy], number[~copy]])
                    settled.append([_lines_hash(doc[copy], number[copy]), f2[copy], doc[copy], number[copy]])
                marked = ~copy & (size > 3)  # smaller sets are similar to equal ones only
                if every:
                    of_asked = lines[_slots(_lines_hash(doc, number))]
                    marked |= of_asked & (size > 3)
                hashes = hashes[np.repeat(marked, size)]
                cuts = np.concatenate([[0], np.cumsum(size[marked])])
                if not len(hashes):
                    continue
                (b0, b1), keys, at, where, _ = _marks(hashes, cuts, table)
                own = np.flatnonzero(marked)
                if every:
                    use = wanted[_slots(keys)]
                    keys, at, where = keys[use], at[use], where[use]
                is_asked = of_asked[own] if every else np.zeros(len(own), bool)
                keyed.append([keys, doc[own][at], number[own][at], size[own][at], where, (f1[own] >> U64(32))[at], b0[at], b1[at], is_asked[at]])
                yield from flush(HELD)
        yield from flush(0)

    def meet(batches):
        def found(doc, line, to_doc=None, to_line=None, apart=None, more=None):
            other = [pa.nulls(len(doc), pa.int64())] * 2 if to_doc is None else [pa.array(to_doc), pa.array(to_line.astype(np.int64))]
            apart = pa.nulls(len(doc), pa.int32()) if apart is None else pa.array(apart.astype(np.int32))
            more = pa.nulls(len(doc), pa.bool_()) if more is None or len(more) != len(doc) else pa.array(more)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(line.astype(np.int64)), *other, apart, more], ["_doc", "line", "to_doc", "to_line", "apart", "more"])

        def work(kind, packets):
            e = _unpacked(packets, _KEYED if kind == 1 else _EQUAL)
            if kind == 2:
                yield found(e["doc"], e["line"])
            elif kind == 0:
                order = np.lexsort((e["line"], e["doc"], e["more"], e["key"]))
                key, more = e["key"][order], e["more"][order]
                again = order[1:][(key[1:] == key[:-1]) & (more[1:] == more[:-1])]
                yield found(e["doc"][again], e["line"][again])
            else:
                for e, a, b, apart, more in (_walk_all if every else _walk)(e):
                    yield found(e["doc"][a], e["line"][a], e["doc"][b], e["line"][b], apart, more)

        now, held = None, []
        for batch in batches:
            for kind, packet in zip(batch.column("kind").to_pylist(), batch.column("packet"), strict=True):
                if kind != now and held:
                    yield from work(now, held)
                    held = []
                now = kind
                held.append(packet)
        if held:
            yield from work(now, held)

    rows = docs.select("_doc", "text").mapInArrow(freed(send), "bucket int, kind int, packet binary")
    dealt = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind")
    return dealt.mapInArrow(freed(meet), _FOUND)


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(_doc, line) of candidates (_doc, line, to_doc, to_line) whose words are similar to those of the earlier line."""
    pairs = checkpoint(pairs.distinct())
    ends = pairs.select("_doc", "line").unionByName(pairs.select(F.col("to_doc").alias("_doc"), F.col("to_line").alias("line")))
    wanted = checkpoint(ends.groupBy("_doc").agg(F.collect_set("line").alias("lines")))
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text, lines in zip(batch.column("_doc").to_pylist(), batch.column("text"), batch.column("lines").to_pylist(), strict=True):
                own = (text.as_py() or "").split("\n")
                out += [(doc, k, own[k]) for k in lines]
            doc, line, text = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int64()), pa.array(text, pa.string())], ["_doc", "line", "words"])

    def words(text: str) -> set[bytes]:
        return set(text.encode().lower().split())

    def hold(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("words").to_pylist(), batch.column("to_words").to_pylist(), strict=True):
                x, y = words(x), words(y)
                good.append(9 * len(x & y) >= 4 * (len(x) + len(y)))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("_doc", "line")], ["_doc", "line"])

    texts = checkpoint(docs.select("_doc", "text").join(F.broadcast(wanted) if few else wanted, "_doc").mapInArrow(freed(cut), "_doc long, line long, words string"))
    with_to = pairs.join(texts.select(F.col("_doc").alias("to_doc"), F.col("line").alias("to_line"), F.col("words").alias("to_words")), ["to_doc", "to_line"])
    return with_to.join(texts, ["_doc", "line"]).select("_doc", "line", "words", "to_words").mapInArrow(hold, "_doc long, line long")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Which of BIT_SLOTS slots the column h names, by Spark's bitmap aggregates."""
    slot = F.col("h") + 1  # these aggregates count from 1
    rows = hashes.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(BIT_SLOTS, bool)
    for row in rows:
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        at = (row["k"] - 1) * len(bits)
        out[at : at + len(bits)] = bits
    return out


def _named(docs: DataFrame, codes, open_: DataFrame) -> DataFrame:
    """(_doc, line, to_doc, to_line): all earlier candidates of at most ASKED open lines (_doc, line), whose keys all tasks get."""
    wanted = checkpoint(open_.groupBy("_doc").agg(F.collect_set("line").alias("lines")))

    def keys(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, lists = batch.column("_doc").to_numpy(), batch.column("lines")
            ask = _lines_hash(np.repeat(ids, np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy())
            for i, j in steps(offsets):
                hashes, cuts, row, number = line_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.diff(cuts)
                own = np.flatnonzero(np.isin(_lines_hash(ids[i + row], number), ask) & (size > 3))
                if len(own):
                    (b0, b1), key, at, where, first = _marks(hashes[np.repeat(np.isin(np.arange(len(size)), own), size)], np.concatenate([[0], np.cumsum(size[own])]), codes.value)
                    entries = [key, ids[i + row[own]][at], number[own][at], size[own][at], where, np.zeros(len(at)), b0[at], b1[at], np.ones(len(at))]
                    yield pa.RecordBatch.from_arrays([pa.array([_packed(entries, _KEYED)], pa.binary()), pa.array([first.tobytes()], pa.binary())], ["packet", "first"])

    got = docs.select("_doc", "text").join(F.broadcast(wanted), "_doc").mapInArrow(freed(keys), "packet binary, first binary").toArrow()
    e = _unpacked(got.column("packet").to_pylist(), _KEYED) if len(got) else {name: np.zeros(0, kind) for name, kind in _KEYED}
    order = np.argsort(e["key"])
    e = {k: v[order] for k, v in e.items()}
    e["who"] = np.unique(_lines_hash(e["doc"], e["line"]), return_inverse=True)[1]
    tokens = np.zeros(BIT_SLOTS, bool)
    for first in got.column("first").to_pylist():
        tokens[_slots(np.frombuffer(first, U64))] = True
    held = docs.sparkSession.sparkContext.broadcast((e, tokens))

    def name(batches):
        (e, tokens), table = held.value, codes.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("_doc").to_numpy()
            for i, j in steps(offsets):
                hashes, cuts, row, number = line_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tokens)
                size = np.diff(cuts)
                marked = size > 3
                if not marked.any():
                    continue
                hashes, cuts = hashes[np.repeat(marked, size)], np.concatenate([[0], np.cumsum(size[marked])])
                doc, number, size = ids[i + row[marked]], number[marked], size[marked]
                (b0, b1), key, at, where, _ = _marks(hashes, cuts, table)
                low, high = (np.searchsorted(e["key"], key, side) for side in ("left", "right"))
                met = np.repeat(np.arange(len(key)), high - low)
                to = low[met] + np.arange(len(met)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
                line = at[met]
                n, m = size[line], e["n"][to].astype(np.int64)
                p, q = where[met], e["pos"][to]
                rest = np.where((p >= 0) & (q >= 0), np.minimum(n - p, m - q), np.minimum(n, m))
                earlier = (doc[line] < e["doc"][to]) | ((doc[line] == e["doc"][to]) & (number[line] < e["line"][to]))
                apart = np.bitwise_count(b0[line] ^ e["b0"][to]).astype(np.int64) + np.bitwise_count(b1[line] ^ e["b1"][to])
                good = np.flatnonzero(earlier & (5 * n >= 4 * m) & (5 * m >= 4 * n) & similar(rest, n, m) & similar((n + m - apart) // 2, n, m))
                if not len(good):
                    continue
                prints = _prints(hashes, cuts)[0][line[good]].view(np.int64)
                _, once = np.unique(np.stack([e["who"][to[good]], prints]), axis=1, return_index=True)
                good, prints = good[once], prints[once]
                columns = (e["doc"][to[good]], e["line"][to[good]].astype(np.int64), doc[line[good]], number[line[good]].astype(np.int64), prints)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_doc", "line", "to_doc", "to_line", "print"])

    pairs = docs.select("_doc", "text").mapInArrow(freed(name), "_doc long, line long, to_doc long, to_line long, print long")
    return pairs.groupBy("_doc", "line", "print").agg(F.min(F.struct("to_doc", "to_line")).alias("to")).select("_doc", "line", "to.to_doc", "to.to_line")


def _asked(docs: DataFrame, codes, open_: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of the open lines (_doc, line), of their keys and of the keys' first tokens."""
    wanted = checkpoint(open_.groupBy("_doc").agg(F.collect_set("line").alias("lines")))
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS

    def keys(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("_doc").to_numpy()
            lists = batch.column("lines")
            ask = _lines_hash(np.repeat(ids, np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy())
            for i, j in steps(offsets):
                hashes, cuts, row, number = line_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.diff(cuts)
                own = np.isin(_lines_hash(ids[i + row], number), ask) & (size > 3)
                if own.any():
                    _, got, _, _, first = _marks(hashes[np.repeat(own, size)], np.concatenate([[0], np.cumsum(size[own])]), codes.value)
                    yield pa.RecordBatch.from_arrays([pa.array(_slots(got)), pa.array(_slots(first))], ["h", "first"])

    def names(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(_lines_hash(batch.column("_doc").to_numpy(), batch.column("line").to_numpy())))], ["h"])

    own = docs.select("_doc", "text").join(F.broadcast(wanted) if few else wanted, "_doc").mapInArrow(freed(keys), "h long, first long")
    own = checkpoint(own.distinct())
    return _bitmap(open_.mapInArrow(names, "h long")), _bitmap(own), _bitmap(own.select(F.col("first").alias("h")))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(_doc, lines): the numbers, from 0, of the lines that go from each of the rows (_doc, text)."""
    spark = docs.sparkSession
    codes = spark.sparkContext.broadcast(rarity(docs))  # a fixed size
    found = checkpoint(matches(docs, codes))
    gone = found.where("to_doc is null").select("_doc", "line")
    best = F.min(F.struct("apart", "to_doc", "to_line")).alias("b")
    many = (F.bool_or("more") | (F.min(F.struct("to_doc", "to_line")) < F.max(F.struct("to_doc", "to_line")))).alias("more")
    lines = checkpoint(found.where("to_doc is not null").groupBy("_doc", "line").agg(best, many).join(gone, ["_doc", "line"], "left_anti"))
    alike = checkpoint(_verified(docs, lines.select("_doc", "line", "b.to_doc", "b.to_line")))
    open_ = checkpoint(lines.where("more").select("_doc", "line").join(alike, ["_doc", "line"], "left_anti"))
    gone = gone.unionByName(alike)
    many = open_.limit(ASKED + 1).count()
    if many > ASKED:
        asked = spark.sparkContext.broadcast(_asked(docs, codes, open_))  # a fixed size
        again = matches(docs, codes, asked).select("_doc", "line", "to_doc", "to_line")
        gone = gone.unionByName(_verified(docs, again.join(open_, ["_doc", "line"], "left_semi")))
    elif many:
        gone = gone.unionByName(_verified(docs, _named(docs, codes, open_)))
    return gone.groupBy("_doc").agg(F.collect_set("line").alias("_lines"))


def _with_lines(docs: DataFrame) -> DataFrame:
    own = identified(docs)
    lines = checkpoint(repeated_lines(own))
    size = lines.agg(F.count("*"), F.sum(F.size("_lines"))).first()
    few = size[0] <= BROADCAST_IDS and (size[1] or 0) <= BROADCAST_LINES
    return own.join(F.broadcast(lines) if few else lines, "_doc", "left")


def _kept(batch: pa.RecordBatch):
    """(lines, lines that go, text that stays) of each row."""
    for text, gone in zip(batch.column("text"), batch.column("_lines"), strict=True):
        lines = (text.as_py() or "").split("\n")
        out = set(gone.as_py() or ())
        yield len(lines), len(out), "\n".join(x for k, x in enumerate(lines) if k not in out) if out else "\n".join(lines)


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_sha256 of each row."""

    def run(batches):
        for batch in batches:
            rows = [(n, gone, len(text), hashlib.sha256(text.encode()).hexdigest()) for n, gone, text in _kept(batch)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_lines", "n_removed", "kept_chars", "kept_sha256"])

    own = docs.select(F.col("doc_id").cast("long"), "text")
    return _with_lines(own).select("row.doc_id", "text", "_lines").mapInArrow(freed(run), "doc_id long, n_lines long, n_removed long, kept_chars long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents, other columns as they are, without the lines that go; n_chars, where there is one, is set anew."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            yield retexted(batch, names, [text for _, _, text in _kept(batch)])

    return _with_lines(docs).select("text", "row", "_lines").mapInArrow(freed(run), retexted_schema(docs))


SQL = r"""
WITH w AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS t FROM w
), s AS (
  SELECT DISTINCT doc_id, line, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS g FROM l
), n AS (
  SELECT doc_id, line, count(*) AS n, string_agg(g, ' ' ORDER BY g) AS k FROM s GROUP BY 1, 2
), f AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, line) AS nth FROM n
), df AS (SELECT g, count(*) AS df FROM s GROUP BY 1),
p AS (
  SELECT s.doc_id, s.line, s.g, f.n, row_number() OVER (PARTITION BY s.doc_id, s.line ORDER BY df, s.g) AS pos
  FROM s JOIN f USING (doc_id, line) JOIN df USING (g) WHERE nth = 1
), c AS (
  SELECT DISTINCT a.doc_id AS da, a.line AS la, b.doc_id AS db, b.line AS lb, a.n AS na, b.n AS nb
  FROM (SELECT * FROM p WHERE pos <= n - ceil(0.8 * n) + 1) a
  JOIN (SELECT * FROM p WHERE pos <= n - ceil(0.8 * n) + 1) b
    ON a.g = b.g AND (a.doc_id, a.line) < (b.doc_id, b.line) AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
), v AS (
  SELECT db, lb FROM c JOIN s x ON x.doc_id = da AND x.line = la JOIN s y ON y.doc_id = db AND y.line = lb AND y.g = x.g
  GROUP BY da, la, db, lb, na, nb HAVING 9 * count(*) >= 4 * (na + nb)
), gone AS (
  SELECT doc_id, line FROM f WHERE nth > 1 UNION SELECT db, lb FROM v
), k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.doc_id) AS n_removed,
         coalesce(string_agg(t, chr(10) ORDER BY l.line) FILTER (gone.doc_id IS NULL), '') AS kept
  FROM l LEFT JOIN gone USING (doc_id, line) GROUP BY 1
)
SELECT doc_id, n_lines, n_removed, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM k
"""

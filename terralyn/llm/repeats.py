"""Operator 2: suffix-array dedup of repeated passages.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the corpus: in a document with a smaller
id, or earlier in the same one. Every such string (a window) holds KGRAM-byte strings; the one with the smallest hash
is its anchor, so equal windows have equal anchors. Runs of windows with one anchor are blocks of LENGTH to
2 * LENGTH - KGRAM bytes, and all copies of a window lie in blocks of one anchor. The work is then local to an anchor:

1. Blocks, as hashes, are shuffled by anchor. Copies of a whole block are settled there: all but the first go.
2. Only where an anchor has blocks that differ is text needed. Those blocks are cut out and shuffled by anchor, and an
   enhanced suffix array of each anchor's blocks is scanned with a stack: its LCP intervals of LENGTH bytes or more
   that differ in the byte to the left are the maximal repeats, each with all its occurrences. All but the first go.
3. The spans of a document are joined to it, merged and cut out.

Anchors so common that one task would notice (a share of all blocks of 1 / (4 x shuffle partitions)) are found
beforehand by a count over all documents, a list whose length that share bounds; their k-grams are chosen as anchors
only by windows that hold no other. Copies within one step of a task are settled before the shuffle.

Cases: a null text counts as empty; texts under LENGTH bytes lose nothing; of equal texts the first keeps its own. Rows
are told apart as common.identified says, so those that share an id, or have none, are documents of their own. A repeat longer than a block comes out as a chain of overlapping groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, U64, byte_table, checkpoint, mix64, powers, freed, identified, retexted, retexted_schema, shared_folder, shuffle_parts, steps, utf8, _BASE, _BASE_INV

LENGTH = 100
KGRAM = 32
#: Text of one step: positions must fit 24 bits.
_POSITION = U64((1 << 24) - 1)


class Blocks:
    """The blocks of some texts: window ranges [first, stop) in their joined bytes, anchor and content hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, common: np.ndarray | None = None):
        n = len(data)
        self.first = self.stop = self.at = np.zeros(0, np.int64)
        self.anchor = self.content = np.zeros(0, U64)
        if n < LENGTH:
            return
        total = np.zeros(n + 1, U64)
        np.cumsum(byte_table(3)[data] * powers(_BASE, n), out=total[1:])
        back = powers(_BASE_INV, n + 1)
        grams = mix64((total[KGRAM:] - total[:-KGRAM]) * back[: n - KGRAM + 1])
        order = grams >> U64(1)
        if common is not None and len(common):
            seen = np.zeros(1 << 16, bool)
            seen[(common >> U64(48)).astype(np.int64)] = True
            maybe = np.flatnonzero(seen[(grams >> U64(48)).astype(np.int64)])
            order[maybe[np.isin(grams[maybe], common)]] |= U64(1 << 63)
        low = (order & ~_POSITION) | np.arange(len(order), dtype=U64)
        span, width = 1, LENGTH - KGRAM + 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        at = (low & _POSITION).astype(np.int64)
        live = np.zeros(n + 1, np.int32)  # windows that lie in one text
        starts, ends = offsets[:-1], offsets[1:] - LENGTH + 1
        long = ends > starts
        np.add.at(live, starts[long], 1)
        np.add.at(live, ends[long], -1)
        live = np.cumsum(live)[: len(at)] > 0
        same = np.zeros(len(at), bool)
        same[1:] = (at[1:] == at[:-1]) & live[:-1]
        self.first = np.flatnonzero(live & ~same)
        if not len(self.first):
            return
        ending = live.copy()
        ending[:-1] &= ~(same[1:] & live[1:])
        self.stop = np.flatnonzero(ending) + 1
        self.at = at[self.first]
        self.anchor = grams[self.at]
        self.content = mix64((total[self.stop - 1 + LENGTH] - total[self.first]) * back[self.first] + (self.stop - self.first).astype(U64) * U64(0x9E3779B97F4A7C15))


def _segments(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Steps of rows as (first row, last row, first byte, last byte); a very long text comes in overlapping parts."""
    most = 4 * STEP_BYTES
    for i, j in steps(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if j > i + 1 or b - a <= most:
            yield i, j, a, b
            continue
        while a < b:
            yield i, j, a, min(a + most, b)
            if a + most >= b:
                break
            a += most - LENGTH + 1


def _rows(batch: pa.RecordBatch, common: np.ndarray | None) -> Iterator[tuple[Blocks, np.ndarray, np.ndarray]]:
    """Blocks of a batch by steps, with each block's document and start in it."""
    data, offsets = utf8(batch.column("text"))
    ids = batch.column("_doc").to_numpy(zero_copy_only=False)
    for i, j, a, b in _segments(offsets):
        blocks = Blocks(data[a:b], np.clip(offsets[i : j + 1] - a, 0, b - a), common)
        row = np.searchsorted(offsets, blocks.first + a, side="right") - 1
        yield blocks, ids[row], blocks.first + a - offsets[row]


def common_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors that hold about 1 / (4 x shuffle partitions) of all blocks or more, by a count over all documents.

    Each step of a task sends the anchors that reach that share of its own blocks, so what arrives is bounded by the
    share, not by the corpus; an anchor that is common overall is common in at least some steps.
    """
    share = 1 / (4 * shuffle_parts(docs.sparkSession))

    def run(batches):
        for batch in batches:
            for blocks, _, _ in _rows(batch, None):
                anchors, counts = np.unique(blocks.anchor, return_counts=True)
                own = counts >= max(8, share * len(blocks.anchor))
                names = pa.array([*anchors[own].view(np.int64).tolist(), None], pa.int64())
                yield pa.RecordBatch.from_arrays([names, pa.array([*counts[own].tolist(), len(blocks.anchor)], pa.int64())], ["anchor", "n"])

    sums = docs.select("_doc", "text").mapInArrow(freed(run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    sums = checkpoint(sums)
    total = sums.where("anchor is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = sums.where((F.col("anchor").isNotNull()) & (F.col("n") >= share * total / 2)).select("anchor").collect()
    return np.sort(np.array([r[0] for r in got], np.int64).view(U64))


def _settled(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(_doc, at, anchor): blocks that go whole (anchor null) and blocks to compare. at is start << 7 | windows."""

    def cut(batches):
        for batch in batches:
            for blocks, doc, start in _rows(batch, common):
                at = start << 7 | (blocks.stop - blocks.first)
                order = np.lexsort((at, doc, blocks.content, blocks.anchor))
                anchor, content = blocks.anchor[order], blocks.content[order]
                doc, at = doc[order], at[order]
                copy = np.zeros(len(at), bool)
                copy[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
                anchor[copy] = mix64(doc[copy].astype(U64) * U64(0x9E3779B97F4A7C15) + at[copy].astype(U64))
                at[copy] = ~at[copy]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(at)], ["anchor", "content", "_doc", "at"])

    def settle(batches):
        names = ["anchor", "content", "_doc", "at"]
        held = [np.zeros(0, np.int64)] * 4

        def out(anchor, content, doc, at):
            settled = at < 0
            yield doc[settled], ~at[settled], None
            anchor, content, doc, at = (x[~settled] for x in (anchor, content, doc, at))
            new = np.ones(len(at), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            own = new.copy()
            own[1:] |= content[1:] != content[:-1]
            yield doc[~own], at[~own], None
            group = np.cumsum(new) - 1
            differ = own & (np.bincount(group, own)[group] > 1) if len(at) else own
            yield doc[differ], at[differ], anchor[differ]

        def batch_of(doc, at, anchor):
            third = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), third], ["_doc", "at", "anchor"])

        for batch in batches:
            now = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)]
            end = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last anchor may go on
            held = [x[end:] for x in now]
            for part in out(*(x[:end] for x in now)):
                yield batch_of(*part)
        for part in out(*held):
            yield batch_of(*part)

    parts = shuffle_parts(docs.sparkSession)
    blocks = docs.select("_doc", "text").mapInArrow(freed(cut), "anchor long, content long, _doc long, at long")
    dealt = blocks.repartition(parts, "anchor").sortWithinPartitions("anchor", "content", "_doc", "at")
    return dealt.mapInArrow(freed(settle), "_doc long, at long, anchor long")


def _texts(docs: DataFrame, compare: DataFrame) -> DataFrame:
    """(anchor, _doc, start, text binary) of blocks to compare, cut out of their documents."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            lists = batch.column("blocks")
            cuts, own = lists.offsets.to_numpy(), lists.values
            at, anchor = (own.field(k).to_numpy() for k in (0, 1))
            doc = batch.column("_doc").to_numpy()
            row = np.repeat(np.arange(len(doc)), np.diff(cuts))
            at, anchor = at[cuts[0] : cuts[-1]], anchor[cuts[0] : cuts[-1]]
            start, size = at >> 7, (at & 127) + LENGTH - 1
            ends = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(ends[-1]) + np.repeat(offsets[:-1][row] + start - ends[:-1], size)
            text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[take])])
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc[row]), pa.array(start), text], ["anchor", "_doc", "start", "text"])

    lists = compare.groupBy("_doc").agg(F.collect_list(F.struct("at", "anchor")).alias("blocks"))
    joined = docs.join(lists, "_doc").select("_doc", "text", "blocks")
    return joined.mapInArrow(freed(run), "anchor long, _doc long, start long, text binary")


def maximal_repeats(group: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray, rows: int = 60_000) -> Iterator[tuple[np.ndarray, int]]:
    """Maximal repeats of at least LENGTH bytes among blocks of one group each.

    first, size: where in data a block lies; group: its group, in order. Gives for each repeat the places in data of all
    its occurrences, and its length. Suffixes that start with a string of LENGTH bytes found once in their group
    belong to no repeat and are left out; the others are sorted, with the lengths of their common prefixes.
    """
    windows = size - LENGTH + 1
    block = np.repeat(np.arange(len(first)), windows)
    inside = np.arange(len(block)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = first[block] + inside
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(byte_table(5)[data] * powers(_BASE, len(data)), out=total[1:])
    key = mix64((total[place + LENGTH] - total[place]) * powers(_BASE_INV, len(data) + 1)[place] + group[block].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key = key[order]
    twin = np.zeros(len(key), bool)
    twin[1:] = key[1:] == key[:-1]
    twin[:-1] |= twin[1:]
    order, key = order[twin], key[twin]
    at = 0
    while at < len(order):
        end = min(at + rows, len(order))
        end = int(np.searchsorted(key, key[end - 1], side="right"))
        own = order[at:end]
        yield from _scan(data, place[own], first[block[own]], (first + size)[block[own]], group[block[own]])
        at = end


def _scan(data: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The enhanced suffix array of some suffixes and the scan of its LCP intervals with a stack."""
    width = int((high - place).max())
    reach = high - place
    table = data[np.minimum(place[:, None] + np.arange(width)[None, :], len(data) - 1)]
    table[np.arange(width)[None, :] >= reach[:, None]] = 0
    names = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), table, reach.astype(">u2").view(np.uint8).reshape(-1, 2)], axis=1)
    order = np.argsort(np.ascontiguousarray(names).view(f"V{names.shape[1]}").ravel(), kind="stable")
    table, place, low, reach, group = table[order], place[order], low[order], reach[order], group[order]
    differs = table[1:] != table[:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    lcp = np.minimum(lcp, np.minimum(reach[1:], reach[:-1]))
    lcp[group[1:] != group[:-1]] = 0
    left = np.where(place > low, data[np.maximum(place - 1, 0)].astype(np.int64), -1 - np.arange(len(place)))  # a block's start differs from all
    steps_ = [0, *lcp.tolist(), 0]
    n = len(place)
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])  # an interval is left-diverse if this grows in it
    grown = change.tolist()
    stack: list[tuple[int, int]] = []  # (length, first suffix) of open intervals
    for j in range(1, n + 1):
        h, start = steps_[j], j - 1
        while stack and stack[-1][0] > h:
            length, start = stack.pop()
            if grown[j - 1] > grown[start]:
                yield place[start:j], length
        if h >= LENGTH and (not stack or stack[-1][0] < h):
            stack.append((h, start))


def _merged(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans as the runs that they cover: nested and overlapping repeats of a place leave the task once."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + size)[order]
    _, number = np.unique(doc, return_inverse=True)
    lift = number * (int(stop.max(initial=0)) + 1)  # so that the running end of one document lies under the next one's starts
    ends = np.maximum.accumulate(stop + lift)
    new = np.ones(len(doc), bool)
    new[1:] = (start + lift)[1:] > ends[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (ends - lift)[last] - start[first]


def _compared(texts: DataFrame, every: bool = False) -> DataFrame:
    """(_doc, start, size) of occurrences that go; with every, all of them as (repeat, size, _doc, start, block), block being the start of theirs."""

    def work(anchor, doc, start, text):
        data, offsets = utf8(text)
        size = np.diff(offsets)
        group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]])) if len(anchor) else anchor
        out = []
        if len(size):
            for places, length in maximal_repeats(group, data, offsets[:-1], size):
                block = np.searchsorted(offsets, places, side="right") - 1
                ids, at = doc[block], start[block] + places - offsets[block]
                best = np.lexsort((at, ids))
                name = mix64(np.array([anchor[block[0]], at[best[0]], ids[best[0]], length]).astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
                out.append((ids[best], at[best], length, int(np.bitwise_xor.reduce(name)), start[block][best]))
        if not out:
            return
        ids, at = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        counts = [len(x[0]) for x in out]
        size = np.repeat([x[2] for x in out], counts)
        head = np.zeros(len(ids), bool)
        head[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
        if every:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x[3] for x in out]), counts)), pa.array(size), pa.array(ids), pa.array(at), pa.array(np.concatenate([x[4] for x in out]))], ["repeat", "size", "_doc", "start", "block"])
        else:
            columns = _merged(ids[~head], at[~head], size[~head])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_doc", "start", "size"])

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None or not len(held) else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            anchors = held.column("anchor").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(anchors) else np.zeros(1, int)
            size = utf8(held.column("text"))[1]
            at = 0
            for i, j in steps(size[cuts], STEP_BYTES // 2):
                if j >= len(cuts) - 1:
                    break
                part = held.slice(cuts[i], cuts[j] - cuts[i])
                yield from work(*(part.column(c).to_numpy() for c in ("anchor", "_doc", "start")), part.column("text"))
                at = cuts[j]
            held = held.slice(at)
        if held is not None:
            yield from work(*(held.column(c).to_numpy() for c in ("anchor", "_doc", "start")), held.column("text"))

    dealt = texts.repartition(shuffle_parts(texts.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(freed(run), "repeat long, size long, _doc long, start long, block long" if every else "_doc long, start long, size long")


def _spans(docs: DataFrame) -> DataFrame:
    """(_doc, start, size): the spans that go."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "repeats")
    _settled(docs, common_anchors(docs)).write.parquet(folder)
    marks = spark.read.parquet(folder)
    whole = marks.where("anchor is null").select("_doc", F.shiftright("at", 7).alias("start"), (F.col("at").bitwiseAND(127) + LENGTH - 1).alias("size"))
    texts = _texts(docs, marks.where("anchor is not null").select("_doc", "at", "anchor"))
    return whole.unionByName(_compared(texts))


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(repeat, size, _doc, start, first): maximal repeats of LENGTH bytes or more with all their occurrences, a row for each.

    Each block that occurs several times is a repeat as a whole, and stands once in the suffix array of its anchor's
    blocks; what the array finds in it is found in all its copies. first marks the earliest occurrence. _doc is doc_id where
    all ids differ, else a number as common.identified gives it.
    """
    docs = identified(docs)
    common = common_anchors(docs)

    def cut(batches):
        for batch in batches:
            for blocks, doc, start in _rows(batch, common):
                columns = [blocks.anchor.view(np.int64), blocks.content.view(np.int64), doc, start << 7 | (blocks.stop - blocks.first)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "content", "_doc", "at"])

    blocks = checkpoint(docs.select("_doc", "text").mapInArrow(freed(cut), "anchor long, content long, _doc long, at long"))
    kinds = checkpoint(blocks.groupBy("anchor", "content").agg(F.min(F.struct("_doc", "at")).alias("rep"), F.count("*").alias("n")))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    texts = _texts(docs, kinds.join(several, "anchor").select("rep._doc", "rep.at", "anchor"))
    start, size = F.shiftright("at", 7), F.col("at").bitwiseAND(127) + LENGTH - 1
    copied = kinds.where("n > 1").select("anchor", "content", F.col("rep._doc").alias("_rep"), F.shiftright("rep.at", 7).alias("block"))
    copies = checkpoint(blocks.join(copied, ["anchor", "content"]).select(F.xxhash64("anchor", "content").alias("repeat"), size.alias("size"), "_doc", start.alias("start"), "_rep", "block"))
    found = checkpoint(_compared(texts, every=True))
    moved = copies.select("_rep", "block", F.col("_doc").alias("_to"), F.col("start").alias("_at")).where("_rep <> _to or block <> _at")
    spread = found.join(moved, (found["_doc"] == moved["_rep"]) & (found["block"] == moved["block"])).select("repeat", "size", F.col("_to").alias("_doc"), (F.col("start") - moved["block"] + F.col("_at")).alias("start"))
    names = ["repeat", "size", "_doc", "start"]
    rows = checkpoint(copies.select(names).unionByName(found.select(names)).unionByName(spread).distinct())
    least = rows.groupBy("repeat").agg(F.min(F.struct("_doc", "start")).alias("_f"))
    return rows.join(least, "repeat").select(*names, (F.struct("_doc", "start") == F.col("_f")).alias("first"))


def _kept(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, np.minimum(start, len(data)), 1)
    np.add.at(edge, np.minimum(start + size, len(data)), -1)
    gone = np.cumsum(edge)[:-1] > 0
    return data[~gone], int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and bool(gone[0])))


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    lists = spans.groupBy("_doc").agg(F.collect_list(F.struct("start", "size")).alias("_spans"))
    return docs.join(lists, "_doc", "left")


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int, int]]:
    data, offsets = utf8(batch.column("text"))
    spans = batch.column("_spans")
    for k in range(len(batch)):
        own = spans[k].values
        text = data[offsets[k] : offsets[k + 1]]
        if own is None or not len(own):
            yield k, text, 0, 0
        else:
            yield k, *_kept(text, own.field(0).to_numpy(), own.field(1).to_numpy())


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""

    def run(batches):
        for batch in batches:
            sizes = np.diff(utf8(batch.column("text"))[1])
            rows = [(gone, runs, hashlib.sha256(kept).hexdigest()) for _, kept, gone, runs in _cut(batch)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = identified(docs.select(F.col("doc_id").cast("long"), "text"))
    return _with_spans(own, _spans(own)).select("row.doc_id", "text", "_spans").mapInArrow(freed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents, other columns as they are, without the bytes that go; characters cut in half go as well.

    n_chars, where there is one, is the new text's length.
    """
    names = docs.columns

    def run(batches):
        for batch in batches:
            yield retexted(batch, names, [bytes(kept).decode("utf-8", "ignore") for _, kept, _, _ in _cut(batch)])

    own = identified(docs)
    return _with_spans(own, _spans(own)).select("text", "row", "_spans").mapInArrow(freed(run), retexted_schema(docs))

"""Exact links between sets of shingles, for the operators that join documents by similarity.

`meeting` finds which sets may link at all: shingles are ordered by rarity (a table of counters over all documents, then
the hash), and of two sets that are similar enough the smaller one's first n - ceil(2t / (1 + t) n) + 1 shingles meet the
greater one's first n - ceil(t n) + 1. Sets that share one of these are a group; equal groups are passed on once. A key that
the counters show to be hot never meets in one task: its sets are joined to the smallest of them by a partial aggregate.

`settled` confirms links inside clusters. A task takes a block of a cluster's sets with their texts, asks `judge` for its
pairs, the most alike first, and confirms them in chunks; a pair that confirmed links already connect needs no
confirmation. Overlaps are counted exactly on rows of bits, one bit for each shingle that two sets of the block share, and
links are confirmed word by word. A cluster of one block is then done. In a larger one, some sets of each
component meet next, and at last the sets outside the cluster's largest component meet all others, so no pair between
components is left out and a text travels once for each block of those. Blocks and stretches are bounded by their shingles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terralyn.operators.graph import components

from .common import U64, checkpoint, freed, mix64, shuffle_parts, shuffled, steps, utf8, word_hashes

#: Counters of shingles, and those that a task of their sum holds.
COUNTER_BITS, SLICE_BITS = 22, 16
#: A key is hot where its counter is over this many rows and over this many times the mean counter.
CROWD, TIMES = 4096, 16
#: Ids that are sent to every executor at most, 6 MB with the columns of a group; more are joined by a shuffle.
BROADCAST_IDS = 1 << 16
#: Sets and shingles of a block at most, on average, and sets that one task holds against a block.
BLOCK, BLOCK_SHINGLES, STRETCH = 1024, 1 << 19, 1 << 12
#: Sets of each component of a cluster's block that meet those of other blocks.
LEADERS = 4
#: Bytes of bits that one step compares.
BIT_BYTES = 1 << 23


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, bounds = word_hashes(data, offsets)
    if not len(hashes):
        return [np.zeros(0, U64)] * (len(offsets) - 1)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = hashes[a:b]
        if b - a >= words:
            grams = own[: b - a - words + 1]
            for k in range(1, words):
                grams = mix64(grams * U64(0x9E3779B97F4A7C15) + own[k : b - a - words + 1 + k])
        elif b > a:  # the whole sequence as one shingle, apart from shingles of full length
            grams = mix64(np.cumsum(own * U64(0xC2B2AE3D27D4EB4F))[-1:] + U64(b - a))
        else:
            grams = own
        out.append(np.unique(grams))
    return out


def word_shingles(text: bytes, words: int) -> set[tuple[bytes, ...]]:
    """The same sets in words."""
    own = text.lower().split()
    return set(zip(*(own[k:] for k in range(words)), strict=False)) if len(own) >= words else {tuple(own)} if own else set()


def few(df: DataFrame) -> DataFrame:
    """A table that is sent to every executor where it has BROADCAST_IDS rows at most, and shuffled otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else shuffled(df)


def label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds component to rows with an id: the id itself where it has no link."""
    return rows.join(shuffled(labels.select("id", F.col("component").alias("_c"))), "id", "left").withColumn("component", F.coalesce("_c", "id")).drop("_c")


def every(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def rarity(docs: DataFrame, words: int) -> np.ndarray:
    """Counters of the shingles of all rows (text), by hash, as halves of doublings in a byte."""
    mask, per = U64((1 << COUNTER_BITS) - 1), 1 << SLICE_BITS

    def count(batches):
        table = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in steps(offsets):
                for own in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words):
                    np.add.at(table, (own & mask).astype(np.int64), np.uint32(1))
        for k in range(0, len(table), per):
            own = np.flatnonzero(table[k : k + per])
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([k // per], pa.int32()), pa.array([own.astype("<u4").tobytes()], pa.binary()), pa.array([table[k + own].tobytes()], pa.binary())], ["slice", "at", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*(batch.column(c) for c in ("slice", "at", "n")), strict=True):
                own = sums.setdefault(k.as_py(), np.zeros(per, np.int64))
                own[np.frombuffer(at.as_buffer(), np.uint32)] += np.frombuffer(n.as_buffer(), np.uint32)
        for k, own in sums.items():
            codes = np.where(own < 8, own, 2 + 2 * np.log2(np.maximum(own, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([codes.tobytes()], pa.binary()), pa.array([int(own.sum())], pa.int64())], ["slice", "codes", "n"])

    parts = docs.select("text").mapInArrow(freed(count), "slice int, at binary, n binary")
    codes = np.zeros(1 << COUNTER_BITS, np.uint8)
    for row in parts.repartition(shuffle_parts(docs.sparkSession), "slice").mapInArrow(add, "slice int, codes binary, n long").collect():
        codes[row["slice"] * per : (row["slice"] + 1) * per] = np.frombuffer(row["codes"], np.uint8)
    return codes


def hot_code(codes: np.ndarray) -> int:
    """The least code of a hot key: over CROWD rows, and over TIMES the mean counter."""
    mean = np.mean(2.0 ** ((codes.astype(float) - 2) / 2))
    return int(np.ceil(2 + 2 * np.log2(max(CROWD, TIMES * mean))))


def meeting(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(bucket, id) of groups of sets that may link, and (src, dst) that joins the sets of hot keys; of rows (id, text)."""
    spark, codes = docs.sparkSession, rarity(docs, words)
    sent, hot, parts = spark.sparkContext.broadcast(codes), hot_code(codes), shuffle_parts(spark)

    def keys(batches):
        mask = U64((1 << COUNTER_BITS) - 1)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("id").to_numpy()
            for i, j in steps(offsets):
                out = []
                for k, own in zip(ids[i:j].tolist(), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words), strict=True):
                    n = len(own)
                    code = sent.value[(own & mask).astype(np.int64)]
                    reach, index = n + percent * -n // 100 + 1, n + 2 * percent * -n // (100 + percent) + 1
                    order = np.lexsort((own, code))[:reach] if n else np.zeros(0, np.int64)
                    first = np.arange(len(order)) < index
                    use = code[order] > 1  # a shingle of one set meets nothing
                    out.append((own[order][use].view(np.int64), np.full(int(use.sum()), k), first[use], code[order][use] >= hot))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "id", "first", "hot"])

    def group(batches):
        """Ids that share a key, one of them among its first shingles, under the hash of their list."""
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

        def out(rows):
            key, ids, first = rows
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            some = np.add.reduceat(first.astype(np.int64), starts) > 0
            name = mix64(np.add.reduceat(mix64(ids.astype(U64) + U64(0x2545F4914F6CDD1D)), starts) + size.astype(U64))
            use = np.repeat((size > 1) & some, size)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[use].view(np.int64)), pa.array(ids[use])], ["bucket", "id"])

        for batch in batches:
            columns = [batch.column("key").to_numpy(), batch.column("id").to_numpy(), batch.column("first").to_numpy(zero_copy_only=False)]
            now = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            if not len(now[0]):
                continue
            end = int(np.searchsorted(now[0], now[0][-1]))
            if end:
                yield out([c[:end] for c in now])
            held = [c[end:] for c in now]
        if len(held[0]):
            yield out(held)

    rows = checkpoint(docs.select("id", "text").mapInArrow(freed(keys), "key long, id long, first boolean, hot boolean"))
    dealt = rows.where("not hot").select("key", "id", "first").repartition(parts, "key").sortWithinPartitions("key", "id")
    groups = dealt.mapInArrow(freed(group), "bucket long, id long").distinct()
    crowds = rows.where("hot").groupBy("key").agg(F.min("id").alias("src"), F.count("*").alias("n"), F.max("first").alias("first")).where("first and n > 1").select("key", "src")
    crowds = checkpoint(crowds)
    stars = rows.where("hot").join(few(crowds), "key").select("src", F.col("id").alias("dst")).where("src <> dst").distinct()
    return groups, stars


class Overlaps:
    """The sets of a block: their sizes, and how many hashes pairs of them share."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner.astype(np.int32)[order]
        del order
        new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
        del flat
        shared = np.zeros(len(new), bool)
        shared[1:] |= ~new[1:]
        shared[:-1] |= ~new[1:]
        place = np.cumsum(new & shared)[shared] - 1
        self.bits = np.zeros((len(sets), max(1, (int(place[-1]) + 64) // 64 if len(place) else 1)), U64)
        np.bitwise_or.at(self.bits, (owner[shared], place >> 6), U64(1) << (place & 63).astype(U64))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, step = np.zeros(len(a), np.int64), max(1, BIT_BYTES // (8 * self.bits.shape[1]))
        for k in range(0, len(a), step):
            out[k : k + step] = np.bitwise_count(self.bits[a[k : k + step]] & self.bits[b[k : k + step]]).sum(axis=1)
        return out


class Block:
    """Some sets of a cluster in a task: ids, components so far, which of them ask, their features, texts and shingles."""

    def __init__(self, table: pa.Table, words: int):
        self.words = words
        self.ids, self.part = (table.column(c).to_numpy() for c in ("id", "component"))
        self.asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        self.features = table.column("feature").combine_chunks()
        self.data, self.offsets = utf8(table.column("text").combine_chunks())
        self.sets: list[np.ndarray] = []
        for i, j in steps(self.offsets):
            self.sets += shingle_sets(self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i], words)

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def linked(block: Block, first: np.ndarray, second: np.ndarray, how: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links among pairs of places that connect what all links among them connect; greater how come first."""
    order = np.argsort(-how, kind="stable")
    first, second = first.astype(np.int32)[order], second.astype(np.int32)[order]
    del order
    _, root = np.unique(block.part, return_inverse=True)
    up = list(range(int(root.max()) + 1 if len(root) else 0))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sizes = Overlaps(block.sets) if len(first) else None
    out, at, step = [], 0, 1 << 12
    while at < len(first):
        now = np.array([top(x) for x in range(len(up))])[root]
        a, b = first[at : at + step], second[at : at + step]
        at += step
        step = min(2 * step, 1 << 18)
        apart = now[a] != now[b]
        a, b = a[apart], b[apart]
        both = sizes.common(a, b)
        good = 100 * (both + 2) >= percent * (sizes.n[a] + sizes.n[b] - both)  # by words where hashes say yes, or no by a hair
        for i, j in zip(a[good].tolist(), b[good].tolist(), strict=True):
            x, y = top(int(root[i])), top(int(root[j]))
            if x != y:
                one, other = (word_shingles(block.text(k), block.words) for k in (i, j))
                if 100 * len(one & other) >= percent * len(one | other):
                    up[max(x, y)] = min(x, y)
                    out.append((int(block.ids[i]), int(block.ids[j])))
    return out


Judge = Callable[[Block], tuple[np.ndarray, np.ndarray, np.ndarray]]


def confirmed(groups: DataFrame, docs: DataFrame, features: DataFrame, judge: Judge, words: int, percent: int) -> DataFrame:
    """(src, dst): the links of groups (g1, g2, g3, asks, id, component), confirmed on docs (id, text); features: (id, feature)."""
    groups = checkpoint(groups)
    members = few(checkpoint(groups.select("id").distinct()))
    texts = checkpoint(docs.select("id", "text").join(members, "id").join(shuffled(features.join(members, "id")), "id"))
    names = ["g1", "g2", "g3", "asks", "id", "component", "feature", "text"]
    dealt = texts.join(few(groups), "id").select(names).repartition(shuffle_parts(docs.sparkSession), "g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "id")

    def run(batches):
        held, tag = [], None

        def settle():
            block = Block(pa.Table.from_batches(held).combine_chunks(), words)
            found = linked(block, *judge(block), percent)
            src, dst = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("g1", "g2", "g3")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and tuple(keys[lo]) != tag:
                    yield settle()
                    held = []
                tag = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield settle()

    return dealt.mapInArrow(freed(run), "src long, dst long")


def _blocks(rows: str, shingles: str, size: int):
    return F.greatest(F.ceil(F.expr(rows) / size), F.ceil(F.expr(shingles) / BLOCK_SHINGLES)).cast("int")


def settled(clusters: DataFrame, sets: DataFrame, docs: DataFrame, features: DataFrame, judge: Judge, words: int, percent: int) -> DataFrame:
    """(id, component): the sets that confirmed links inside clusters connect; sets: (id, n_shingles)."""
    clusters = checkpoint(clusters.select("id", F.col("component").alias("cluster")).join(shuffled(sets), "id"))
    size = clusters.groupBy("cluster").agg(_blocks("count(*)", "sum(n_shingles)", BLOCK).alias("blocks"), _blocks("count(*)", "sum(n_shingles)", STRETCH).alias("stretches"))
    place = checkpoint(clusters.join(few(checkpoint(size)), "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")))
    none = F.lit(0)

    def confirm(groups):
        return confirmed(groups, docs, features, judge, words, percent)

    links = checkpoint(confirm(place.select(F.col("cluster").alias("g1"), F.col("block").alias("g2"), none.alias("g3"), F.lit(True).alias("asks"), "id", F.col("id").alias("component"))))
    labels = checkpoint(components(links))
    wide = place.where("blocks > 1")
    if not wide.limit(1).count():
        return labels
    own = label(wide, labels)
    nth = F.row_number().over(Window.partitionBy("cluster", "block", "component").orderBy(F.xxhash64("id")))
    leaders = own.withColumn("nth", nth).where(F.col("nth") <= LEADERS)
    sizes = leaders.groupBy("cluster").agg(_blocks("count(*)", "sum(n_shingles)", BLOCK).alias("_b"))
    leaders = leaders.join(few(checkpoint(sizes)), "cluster").select(F.col("cluster").alias("g1"), F.pmod(F.xxhash64("id", none), "_b").cast("int").alias("g2"), none.alias("g3"), F.lit(True).alias("asks"), "id", "component")
    links = checkpoint(links.unionByName(confirm(leaders)))
    labels = checkpoint(components(links))
    own = label(wide, labels)
    sizes = own.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "component")).alias("most")).where("n > most.n")
    own = own.join(few(checkpoint(sizes)), "cluster").withColumns({"outside": F.col("component") != F.col("most.component"), "_b": _blocks("n - most.n", "s - most.s", BLOCK)})
    own = own.withColumns({"g2": F.pmod(F.xxhash64("id", none), "_b").cast("int"), "g3": F.pmod(F.xxhash64("id", F.lit(1)), "stretches").cast("int")})
    asking = own.where("outside").withColumn("g3", every("stretches")).withColumn("asks", F.lit(True))
    asked = own.withColumn("g2", every("_b")).join(shuffled(asking.select("cluster", "g2", "g3", "id")), ["cluster", "g2", "g3", "id"], "left_anti").withColumn("asks", F.lit(False))
    names = [F.col("cluster").alias("g1"), "g2", "g3", "asks", "id", "component"]
    links = checkpoint(links.unionByName(confirm(asking.select(names).unionByName(asked.select(names)))))
    return checkpoint(components(links))

"""Operator 12: how far the sources of each language diverge, by a recount of its frequent terms.

The first pass counts in how many documents of its language each term stands, exactly, and keeps those of LEAST documents
or more. The kept (language, term) keys are dealt to shards of about SHARD keys by a hash; each shard gets a minimal
perfect hash (displacements for buckets, the fullest first) and its keys in the order of their slots. The second pass
broadcasts the shards, looks every term up, holds it against the stored key, and adds to dense arrays of slots, one for
each (language, source). Shards are sent in rounds of ROUND_BYTES at most, one pass over the texts for each, so what a
worker holds is bounded whatever the size of the vocabulary. Counts of one (shard, language, source) are added up in a
stream; a task then has the dense counts of one shard and language for all sources, and derives the parts of all sums.

Probabilities are 1 + floor(1000000000 * (count + 1) / (N + V)) by long division on 64-bit integers, exact for counts under 9.2e15.

Cases: null text, lang and source count as empty; a language without kept terms has pairs of value 0 and no terms; a
group without terms takes part with counts of 0; a document without terms names its group; ids are not read, repeated
rows are documents of their own; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, checkpoint, freed, mix64, shuffle_parts

#: Documents of its language that hold a kept term at least; ranks of terms for each group; the scale of probabilities.
LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Keys of a shard on average, keys of a bucket on average.
SHARD, BUCKET = 4096, 4
#: Bytes of shards that a pass over the texts sends to every worker, and bytes of dense slots that a task holds.
ROUND_BYTES, DENSE_BYTES = 48 << 20, 64 << 20
#: Different terms that a task of the first pass holds.
HELD_TERMS = 400_000

#: Bytes as the terms have them: A-Z as a-z, all ASCII but letters as a space.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def _texts(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term) of terms in least documents of a language or more."""

    def run(batches):
        held: dict[str, Counter] = {}
        size = 0

        def out():
            for lang, own in held.items():
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "term", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            for lang, text in zip(langs, texts, strict=True):
                own = held.setdefault(lang, Counter())
                size -= len(own)
                own.update(set(terms(text.as_py())))
                size += len(own)
                if size > HELD_TERMS:
                    yield from out()
                    size = 0
        yield from out()

    counts = _texts(docs).select("lang", "text").mapInArrow(freed(run), "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def _key(lang: str, term: bytes) -> bytes:
    """Terms hold no NUL, so the first one ends the term."""
    return term + b"\x00" + lang.encode()


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], U64)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(hashes ^ U64(0x5851F42D4C957F2D)) % U64(shards)).astype(np.int64)


def _slot(hashes: np.ndarray, moved: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The slot of keys whose bucket has displacement moved; a negative one names the slot itself."""
    spread = (mix64(hashes + moved.astype(U64) * U64(0x9E3779B97F4A7C15)) % n.astype(U64)).astype(np.int64)
    return np.where(moved < 0, -1 - moved, spread)


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, slot of each key): slots are 0 .. n - 1, each once. Hashes must differ."""
    n = len(hashes)
    buckets = n // BUCKET + 1
    bucket = (hashes % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    moves, slots, free = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    size = np.diff(cuts)
    for b in np.argsort(-size, kind="stable")[: int((size > 1).sum())].tolist():
        own, at = order[cuts[b] : cuts[b + 1]], 0
        while True:
            tries = np.arange(at, at + 64)
            got = _slot(np.repeat(hashes[own][None, :], 64, 0), np.repeat(tries[:, None], len(own), 1), np.full((64, len(own)), n))
            ordered = np.sort(got, axis=1)
            good = np.flatnonzero(free[got].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
            if len(good):
                moves[b], slots[own] = tries[good[0]], got[good[0]]
                free[got[good[0]]] = False
                break
            at += 64
    alone = np.flatnonzero(size == 1)  # buckets of one key take what is left
    left = np.flatnonzero(free)
    moves[alone], slots[order[cuts[alone]]] = -1 - left, left
    return moves, slots


_SHARD = ["shard", "moves", "lengths", "keys", "codes", "names"]
_SHARD_TYPES = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.string())]


def build(vocabulary: DataFrame, shards: int) -> DataFrame:
    """(shard, moves, lengths, keys, codes, names): a perfect hash for each shard.

    Its keys stand in the order of their slots, with the places of their languages among names.
    """

    def number(batches):
        for batch in batches:
            langs, words = batch.column("lang"), batch.column("term")
            keys = [_key(a.as_py(), b.as_py().encode()) for a, b in zip(langs, words, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_shard(_hashes(keys), shards)) if keys else pa.array([], pa.int64()), langs, words], ["shard", "lang", "term"])

    def settle(shard, langs, words):
        keys = [_key(a, b.encode()) for a, b in zip(langs, words, strict=True)]
        hashes = _hashes(keys)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms share a hash of 64 bits: choose another seed")
        moves, slots = perfect_hash(hashes)
        order = np.argsort(slots).tolist()
        keys, names = [keys[k] for k in order], sorted(set(langs))
        code = {name: k for k, name in enumerate(names)}
        row = shard, moves.astype("<i4").tobytes(), np.array([len(k) for k in keys], "<i4").tobytes(), b"".join(keys), np.array([code[langs[k]] for k in order], "<i4").tobytes(), names
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, _SHARD_TYPES, strict=True)], _SHARD)

    def grow(batches):
        shard, langs, words = None, [], []
        for batch in batches:
            for k, lang, word in zip(*(batch.column(c).to_pylist() for c in ("shard", "lang", "term")), strict=True):
                if k != shard and langs:
                    yield settle(shard, langs, words)
                    langs, words = [], []
                shard = k
                langs.append(lang)
                words.append(word)
        if langs:
            yield settle(shard, langs, words)

    dealt = vocabulary.mapInArrow(number, "shard long, lang string, term string").repartition(shuffle_parts(vocabulary.sparkSession), "shard").sortWithinPartitions("shard", "lang", "term")
    return dealt.mapInArrow(grow, "shard long, moves binary, lengths binary, keys binary, codes binary, names array<string>")


def _stored(lengths: bytes, keys: bytes) -> pa.Array:
    """The keys of a shard, in the order of their slots."""
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<i4"))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(keys)])


class Lookup:
    """Some shards' perfect hashes, in a worker."""

    def __init__(self, rows: list[tuple], shards: int):
        """rows: as of `build`."""
        self.shards = shards
        self.first, self.count, self.start, self.buckets = (np.zeros(shards, np.int64) for _ in range(4))
        keys, moves, own, n, at = [], [], {}, 0, 0
        for shard, moved, lengths, stored, codes, names in rows:
            moves.append(np.frombuffer(moved, "<i4"))
            keys.append(_stored(lengths, stored))
            codes = np.frombuffer(codes, "<i4")
            for k, name in enumerate(names):
                own.setdefault(name, []).append(n + np.flatnonzero(codes == k))
            self.first[shard], self.count[shard], self.start[shard], self.buckets[shard] = n, len(codes), at, len(moves[-1])
            n, at = n + len(codes), at + len(moves[-1])
        self.moves = np.concatenate(moves) if moves else np.zeros(0, np.int32)
        self.keys = pa.concat_arrays(keys) if keys else pa.array([], pa.binary())
        #: Of each language, its slots; of each slot, its place among those of its language.
        self.slots = {lang: np.concatenate(at) for lang, at in own.items()}
        self.place = np.zeros(n, np.int64)
        for at in self.slots.values():
            self.place[at] = np.arange(len(at))

    def slots_of(self, keys: list[bytes]) -> np.ndarray:
        """Each key's slot among all, -1 for those that are not stored."""
        if not keys or not len(self.keys):
            return np.full(len(keys), -1)
        hashes = _hashes(keys)
        shard = _shard(hashes, self.shards)
        n = self.count[shard]
        here = np.flatnonzero(n > 0)
        out = np.full(len(keys), -1)
        shard, hashes = shard[here], hashes[here]
        bucket = (hashes % self.buckets[shard].astype(U64)).astype(np.int64)
        slot = self.first[shard] + _slot(hashes, self.moves[self.start[shard] + bucket].astype(np.int64), n[here])
        stored = pc.equal(self.keys.take(pa.array(slot)), pa.array(keys, pa.binary()).take(pa.array(here))).to_numpy(zero_copy_only=False)
        out[here[stored]] = slot[stored]
        return out

    def where(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, slot in it) of slots among all."""
        there = np.flatnonzero(self.count)
        order = there[np.argsort(self.first[there])]
        at = np.searchsorted(self.first[order], slot, side="right") - 1
        return order[at], slot - self.first[order[at]]


_NAMES = ["shard", "lang", "source", "slots", "counts"]
_COUNTS = "shard long, lang string, source string, slots binary, counts binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def _by(number: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal numbers."""
    cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(number) else np.zeros(1, np.int64)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


_LOOKUPS: dict[str, Lookup] = {}


def _lookup(name: str, sent, shards: int) -> Lookup:
    """The shards that a worker has last been sent; its later tasks find them built."""
    if name not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[name] = Lookup(sent.value, shards)
    return _LOOKUPS[name]


def recount(docs: DataFrame, rows: list[tuple], shards: int) -> DataFrame:
    """(shard, lang, source, slots, counts): what each task has counted of each group, for the shards of one deal.

    shard is the number of the deal; slots are (shard, slot in it) in 32 bits each, arrays little-endian bytes. There is a
    row for each task, group and deal, however many shards there are.
    """
    sent, deal, name = docs.sparkSession.sparkContext.broadcast(rows), -(-shards // shuffle_parts(docs.sparkSession)), uuid.uuid4().hex

    def run(batches):
        table = _lookup(name, sent, shards)
        dense: dict[tuple[str, str], np.ndarray] = {}
        size = seen = 0

        def out():
            found = []
            for (lang, source), counts in dense.items():
                used = np.flatnonzero(counts)
                shard, slot = table.where(table.slots[lang][used])
                order = np.argsort(shard, kind="stable")
                entry, n = (shard << 32 | slot)[order], counts[used][order].astype("<i8")
                found += [(int(entry[a] >> 32) // deal, lang, source, entry[a:b].astype("<i8").tobytes(), n[a:b].tobytes()) for a, b in _by((entry >> 32) // deal)]
            dense.clear()
            if found:
                yield _rows(found)

        for batch in batches:
            groups: dict[tuple[str, str], Counter] = {}
            held = 0
            for i, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                if lang in table.slots:
                    own = groups.setdefault((lang, source), Counter())
                    held -= len(own)
                    own.update(said := terms(batch.column("text")[i].as_py()))
                    held, seen = held + len(own), seen + len(said)
                if i + 1 == batch.num_rows or held > HELD_TERMS:
                    for (lang, source), own in groups.items():
                        slot = table.slots_of([_key(lang, t) for t in own])
                        known = slot >= 0
                        counts = dense.get((lang, source))
                        if counts is None:
                            counts = dense[lang, source] = np.zeros(len(table.slots[lang]), np.uint32)
                            size += counts.nbytes
                        counts[table.place[slot[known]]] += np.fromiter(own.values(), np.uint32, len(own))[known]
                        if size > DENSE_BYTES or seen > 1 << 31:  # a slot holds 32 bits
                            yield from out()
                            size = seen = 0
                    groups, held = {}, 0
        yield from out()

    return _texts(docs).mapInArrow(freed(run), _COUNTS)


def _added(batches):
    """Adds up the counts of one deal, language and source, whose rows follow each other; a row for each of its shards."""
    tag, entries, counts, held = None, [], [], 0

    def summed():
        nonlocal entries, counts, held
        entry, place = np.unique(np.concatenate(entries), return_inverse=True)
        total = np.zeros(len(entry), np.int64)
        np.add.at(total, place, np.concatenate(counts))
        entries, counts, held = [entry], [total], 0

    def settled():
        summed()
        entry, n = entries[0], counts[0]
        return [(int(entry[a] >> 32), *tag, (entry[a:b] & 0xFFFFFFFF).astype("<i4").tobytes(), n[a:b].astype("<i8").tobytes()) for a, b in _by(entry >> 32)]

    for batch in batches:
        done = []
        for deal, lang, source, slots, n in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
            if (lang, source) != tag or deal != last:
                if tag is not None:
                    done += settled()
                tag, last, entries, counts, held = (lang, source), deal, [], [], 0
            entries.append(np.frombuffer(slots, "<i8"))
            counts.append(np.frombuffer(n, "<i8"))
            held += len(entries[-1])
            if held > HELD_TERMS:
                summed()
        if done:
            yield _rows(done)
    if tag is not None and (done := settled()):
        yield _rows(done)


def probabilities(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kept)), by long division in base 1000; exact for totals under 9.2e15."""
    below = np.int64(total + kept)
    whole, rest = np.divmod(counts.astype(np.int64) + 1, below)
    for _ in range(3):  # SCALE is 1000 ** 3
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _parts(own: pa.Table, counted: pa.Table) -> pa.Table:
    """The sums and terms of one (shard, lang): own has its facts in one row, counted the counts of its groups."""
    names = ["part", "lang", "source", "item", "value"]
    if not own.num_rows:
        return pa.table({n: pa.array([], pa.int64() if n == "value" else pa.string()) for n in names})
    row = own.to_pylist()[0]
    sources, totals, kept, total, lang = row["sources"], row["totals"], row["kept"], row["total"], row["lang"]
    place = {s: k for k, s in enumerate(sources)}
    index = np.zeros(max(row["slots"]) + 1, np.int64)
    index[row["slots"]] = np.arange(len(row["slots"]))
    counts = np.zeros((len(sources), len(row["slots"])), np.int64)
    for source, slots, n in zip(counted["source"].to_pylist(), counted["slots"].to_pylist(), counted["counts"].to_pylist(), strict=True):
        counts[place[source], index[np.frombuffer(slots, "<i4")]] = np.frombuffer(n, "<i8")
    p = np.stack([probabilities(c, t, kept) for c, t in zip(counts, totals, strict=True)])
    q = probabilities(counts.sum(axis=0), total, kept)
    words = np.array(row["terms"], object)
    raw = np.array([w.encode() for w in row["terms"]], object)
    out = []
    for k, source in enumerate(sources):
        sums = _gain(p[k][None, :], p).sum(axis=1).tolist()
        out += [("pair", lang, source, other, v) for j, (other, v) in enumerate(zip(sources, sums, strict=True)) if j != k]
        used = np.flatnonzero((counts[k] > 0) & (p[k] > q))
        value = _gain(p[k][used], q[used])
        if len(used) > TOP:  # what this shard can put among the first TOP, equal values included
            most = np.partition(value, len(value) - TOP)[len(value) - TOP]
            used, value = used[value >= most], value[value >= most]
        best = sorted(zip((-value).tolist(), raw[used].tolist(), words[used].tolist(), strict=True))[:TOP]
        out += [("term", lang, source, w, -v) for v, _, w in best]
    return pa.table({n: pa.array(c, pa.int64() if n == "value" else pa.string()) for n, c in zip(names, zip(*out, strict=True) if out else [[]] * 5, strict=True)})


def rounds(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Shards (number, bytes) in runs of at most so many bytes; a larger one stands alone."""
    out: list[list[int]] = []
    room = -1
    for shard, size in sizes:
        if size > room:
            out.append([])
            room = most
        out[-1].append(shard)
        room -= size
    return out


def divergence(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, part, item, value, rank: the sources of each language against each other, and each one's own terms."""
    spark = docs.sparkSession
    groups = checkpoint(_texts(docs).select("lang", "source").distinct())
    vocabulary = checkpoint(kept_terms(docs, least))
    shards = max(1, -(-vocabulary.count() // SHARD))
    hashes = checkpoint(build(vocabulary, shards))
    sizes = hashes.select("shard", F.expr("length(moves) + 8 * length(lengths) + length(keys)").alias("bytes")).orderBy("shard")
    sizes = [tuple(r) for r in sizes.toLocalIterator()]
    counted = None
    for own in rounds(sizes, ROUND_BYTES):
        rows = [tuple(r) for r in hashes.where(F.col("shard").between(own[0], own[-1])).select(*_SHARD).collect()]
        found = checkpoint(recount(docs, rows, shards))
        counted = found if counted is None else counted.unionByName(found)
    if counted is None:
        counted = spark.createDataFrame([], _COUNTS)
    order = ["shard", "lang", "source"]
    counted = checkpoint(counted.repartition(shuffle_parts(spark), *order).sortWithinPartitions(*order).mapInArrow(freed(_added), _COUNTS))

    def summed(batches):
        for batch in batches:
            n = [int(np.frombuffer(c.as_buffer(), "<i8").sum()) for c in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), pa.array(n, pa.int64())], ["lang", "source", "n"])

    totals = counted.select("lang", "source", "counts").mapInArrow(summed, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"))
    each = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    facts = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"), F.sum("n").alias("total")).join(kept, "lang")
    facts = facts.select("lang", F.col("g.source").alias("sources"), F.col("g.n").alias("totals"), "total", "kept")

    def named(batches):
        for batch in batches:
            for shard, lengths, keys, codes, names in zip(*(batch.column(c).to_pylist() for c in ("shard", "lengths", "keys", "codes", "names")), strict=True):
                own: dict[str, list] = {name: [] for name in names}
                for k, (key, code) in enumerate(zip(_stored(lengths, keys).to_pylist(), np.frombuffer(codes, "<i4").tolist(), strict=True)):
                    own[names[code]].append((k, key.partition(b"\x00")[0].decode()))
                columns = [pa.array([shard] * len(own), pa.int64()), pa.array(list(own), pa.string())]
                columns += [pa.array([[x[j] for x in at] for at in own.values()], pa.list_(t)) for j, t in enumerate((pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "lang", "slots", "terms"])

    keys = hashes.select("shard", "lengths", "keys", "codes", "names").mapInArrow(named, "shard long, lang string, slots array<int>, terms array<string>").join(facts, "lang")
    found = checkpoint(keys.groupBy("shard", "lang").cogroup(counted.groupBy("shard", "lang")).applyInArrow(_parts, "part string, lang string, source string, item string, value long"))
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.join(others, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    own = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.unionByName(own)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), w AS (SELECT row, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
ln AS (SELECT lang, sum(total)::HUGEINT AS total FROM gn GROUP BY 1),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.total + v.v) AS p
  FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term
), q AS (
  SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 1)) // (ln.total + v.v) AS q
  FROM k JOIN ln USING (lang) JOIN v USING (lang) LEFT JOIN (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2) s USING (lang, term)
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= 200
"""

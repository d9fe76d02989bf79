"""Operator 3: near-dedup of documents by an LSH forest over MinHash signatures.

Every distinct set of shingles has TREES signatures of DEPTH hashes. Each tree is a sorted order of its signatures. A
region is a run of sets that share SHALLOW hashes of a tree; where more than REGION sets do, its longer prefixes are
followed, as deep as they must be to hold REGION sets, and a run that is still larger at full depth is cut into windows
of sorted neighbours. All pairs of a region that agree in AGREE of all TREES x DEPTH hashes are candidates, and what they
join is a cluster. Every region that was followed deeper is gone through again without a cap: its sets outside the region's
largest cluster are held, in blocks, against all of its sets in other clusters, and pairs that agree join these as well.
So two sets that share SHALLOW hashes in a tree and agree in AGREE of all are in one cluster.

Links are confirmed inside clusters, on the full texts (`linking.settled`): pairs of a block that agree in AGREE hashes,
the most alike first, by exact overlaps of their sets and then word by word, until confirmed links connect what they can.

Cases: a null, empty or blank text has no shingles and links with nothing; a text with fewer words than a shingle is
one shingle; documents with equal sets (a fingerprint of 128 bits) are one node, so any number of copies costs a row each; rows are
told apart as common.identified says, so those that share an id, or have none, are documents of their own. A group
whose rows all lack an id has a null component_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralyn.operators.graph import components

from . import linking
from .common import U64, checkpoint, freed, group_facts, identified, mix64, salted, shuffle_parts, shuffled, steps, unwrapped, utf8
from .linking import Block, every, few, label, settled

TREES, DEPTH, SHALLOW, REGION = 12, 6, 3, 32
#: Equal hashes of all TREES x DEPTH that a candidate needs: 5 standard deviations under a similarity of 0.8.
AGREE = 40
PERCENT = 80
#: Words of a shingle, unless a caller asks for others.
WORDS = 2
#: Sets of a block, and sets that are held against a block, of wide regions.
BLOCK, STRETCH = 1024, 1 << 12
#: Rows of one prefix that a task sorts out at a time.
HOLD = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return linking.shingle_sets(data, offsets, words)


def word_shingles(text: str, words: int = WORDS) -> set[tuple[bytes, ...]]:
    """The same sets in words."""
    return linking.word_shingles(text.encode(), words)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES x DEPTH minima of each set; a row of zeros for an empty one."""
    n = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), TREES * DEPTH), np.uint32)
    full = np.flatnonzero(n)
    if len(full):
        flat = np.concatenate([sets[k] for k in full])
        low, high = flat.astype(np.uint32), (flat >> U64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        seeds = mix64(np.arange(1, TREES * DEPTH + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        for k, seed in enumerate(seeds.tolist()):
            mixed = (low ^ np.uint32(seed >> 32)) * np.uint32((seed | 1) & 0xFFFFFFFF)
            out[full, k] = np.minimum.reduceat(mixed ^ (mixed >> np.uint32(15)) ^ high, starts)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A column of equally long byte strings."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return utf8(column)[0].reshape(-1, width)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """_doc, n_shingles, f1 and f2 (a set's 128-bit fingerprint), sig (all its minima) of rows (_doc, text)."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in steps(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                prints = np.array([[np.sum(mix64(s ^ U64(c)), dtype=U64) for c in (0x1234567, 0x89ABCDE)] for s in sets], U64).view(np.int64).reshape(-1, 2)
                columns = [batch.column("_doc").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), _binary(signatures(sets).view(np.uint8))]
                yield pa.RecordBatch.from_arrays(columns, ["_doc", "n_shingles", "f1", "f2", "sig"])

    return docs.select("_doc", "text").mapInArrow(freed(run), "_doc long, n_shingles long, f1 long, f2 long, sig binary")


def _named(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit name of columns of 64-bit values."""
    out = mix64(parts[0].astype(U64))
    for p in parts[1:]:
        out = mix64(out * U64(0x9E3779B97F4A7C15) + p.astype(U64))
    return out.view(np.int64)


def _regions(head: np.ndarray, rest: np.ndarray, last: np.ndarray, ids: np.ndarray, tied: bool) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(places, names, wide) of the regions of sorted rows: head names SHALLOW hashes, rest the next two, last the sixth.

    wide regions hold over REGION rows and come along with the deeper regions inside; tied says that head goes on beyond.
    """
    out = []
    levels = [head, _named(head, rest >> 32), _named(head, rest), _named(head, rest, last)]
    todo = [(0, len(head), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        own = levels[depth][lo:hi]
        cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [hi - lo]]) + lo
        size = np.diff(cuts)
        small = (size >= 2) & (size <= REGION) if not (tied and depth == 0) else np.zeros(len(size), bool)
        places = np.arange(lo, hi)[np.repeat(small, size)]
        out.append((places, levels[depth][places], False))
        for k in np.flatnonzero((size > REGION) | (tied and depth == 0)):
            a, b = int(cuts[k]), int(cuts[k + 1])
            if depth == 0:
                out.append((np.arange(a, b), head[a:b], True))
            if depth + 1 < len(levels):
                todo.append((a, b, depth + 1))
            else:
                for at in range(a, b, REGION):
                    window = np.arange(at, min(at + REGION, b))
                    out.append((window, _named(levels[depth][window], np.full(len(window), ids[at])), False))
    return out


def forest(reps: DataFrame) -> DataFrame:
    """(region, id, wide): the regions that hold each of the rows (id, sig)."""

    def plant(batches):
        for batch in batches:
            sig = _bytes(batch.column("sig"), 4 * TREES * DEPTH).view("<u4").astype(U64)
            values = sig.reshape(len(sig), TREES, DEPTH)
            head = _named(np.broadcast_to(np.arange(TREES), values.shape[:2]), *(values[:, :, k] for k in range(SHALLOW)))
            rest = (values[:, :, SHALLOW] << U64(32) | values[:, :, SHALLOW + 1]).view(np.int64)
            ids = np.repeat(batch.column("id").to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (head.ravel(), rest.ravel(), values[:, :, DEPTH - 1].astype(np.int64).ravel(), ids)], ["head", "rest", "last", "id"])

    def grow(batches):
        names = ["head", "rest", "last", "id"]
        held = [np.zeros(0, np.int64)] * 4
        before = None

        def out(rows, tied):
            got = [g for g in _regions(*rows, tied) if len(g[0])]
            if got:
                place, region = (np.concatenate([g[k] for g in got]) for k in (0, 1))
                wide = np.concatenate([np.full(len(g[0]), g[2]) for g in got])
                yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(rows[3][place]), pa.array(wide)], ["region", "id", "wide"])

        for batch in batches:
            now = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)]
            if not len(now[0]):
                continue
            end = int(np.searchsorted(now[0], now[0][-1]))  # the last prefix may go on
            tie = end and now[0][0] == before
            if tie:  # a prefix of which a part has gone: its regions are wide whatever their size here
                stop = int(np.searchsorted(now[0], before, side="right"))
                yield from out([c[:stop] for c in now], True)
                now, end = [c[stop:] for c in now], end - stop
                before = None
            yield from out([c[:end] for c in now], False)
            held = [c[end:] for c in now]
            if len(held[0]) > HOLD:
                before = held[0][0]
                yield from out(held, True)
                held = [c[:0] for c in held]
        if len(held[0]):
            stop = int(np.searchsorted(held[0], before, side="right")) if before is not None and held[0][0] == before else 0
            yield from out([c[:stop] for c in held], True)
            yield from out([c[stop:] for c in held], False)

    rows = reps.select("id", "sig").mapInArrow(plant, "head long, rest long, last long, id long")
    dealt = rows.repartition(shuffle_parts(reps.sparkSession), "head").sortWithinPartitions("head", "rest", "last", "id")
    return dealt.mapInArrow(freed(grow), "region long, id long, wide boolean")


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x[:, None, :] == y[None, :, :]).sum(axis=2)


def _short(column: pa.Array) -> np.ndarray:
    """The low bytes of all minima: enough to count agreement, which chance hits can only raise."""
    return _bytes(column, 4 * TREES * DEPTH).reshape(-1, TREES * DEPTH, 4)[:, :, 0]


_PAIRS = "a long, b long, agree int"


def _pairs(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agree.astype(np.int32))], ["a", "b", "agree"])


def candidates(regions: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, agree), a < b, of the pairs of all regions that are not wide."""

    def pair(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not len(table):
                continue
            held = table.to_batches()[0]
            region, ids, sig = held.column("region").to_numpy(), held.column("id").to_numpy(), _short(held.column("sig"))
            cuts = np.concatenate([[0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(region)]])
            yield from work(cuts[:-1], ids, sig)
            held = held.slice(int(cuts[-2]))
        if held is not None:
            yield from work(np.array([0, len(held)]), held.column("id").to_numpy(), _short(held.column("sig")))

    def work(cuts, ids, sig):
        out = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            agree = _agreement(sig[lo:hi], sig[lo:hi])
            i, j = np.nonzero(np.triu(agree >= AGREE, 1))
            out.append((ids[lo:hi][i], ids[lo:hi][j], agree[i, j]))
        if out:
            yield _pairs(*(np.concatenate(c) for c in zip(*out, strict=True)))

    members = regions.where("not wide").select("region", "id").join(shuffled(reps), "id").select("region", "id", "sig")
    dealt = members.repartition(shuffle_parts(reps.sparkSession), "region").sortWithinPartitions("region")
    return dealt.mapInArrow(freed(pair), _PAIRS).groupBy("a", "b").agg(F.max("agree").alias("agree"))


def across(regions: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, agree) between clusters (labels) of the wide regions: of each set outside the largest, the best pair with each other cluster."""
    parts = shuffle_parts(reps.sparkSession)
    rows = checkpoint(label(regions.where("wide").select("region", "id"), labels))
    sizes = rows.groupBy("region", "component").agg(F.count("*").alias("n"))
    facts = sizes.groupBy("region").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).where("n > most.n")
    own = checkpoint(rows.join(few(checkpoint(facts)), "region").select("region", "id", "component", (F.col("component") != F.col("most.component")).alias("outside"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / STRETCH).cast("int").alias("stretches")))
    own = own.join(shuffled(reps), "id").withColumns({"block": F.pmod(F.xxhash64("id"), "blocks").cast("int"), "stretch": F.pmod(F.xxhash64("id", F.lit(1)), "stretches").cast("int")})
    held = own.where("outside").withColumn("stretch", every("stretches")).withColumn("asks", F.lit(0))
    met = own.withColumn("block", every("blocks")).withColumn("asks", F.lit(1))
    names = ["region", "block", "stretch", "asks", "id", "component", "sig"]
    dealt = held.select(names).unionByName(met.select(names)).repartition(parts, "region", "block", "stretch").sortWithinPartitions("region", "block", "stretch", "asks")

    def run(batches):
        tag, block = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("region", "block", "stretch", "asks")], axis=1)
            ids, part, sig = batch.column("id").to_numpy(), batch.column("component").to_numpy(), _short(batch.column("sig"))
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if tuple(keys[lo, :3]) != tag:
                    tag, block = tuple(keys[lo, :3]), None
                if keys[lo, 3] == 0:
                    new = ids[lo:hi], part[lo:hi], sig[lo:hi]
                    block = new if block is None else tuple(np.concatenate(c) for c in zip(block, new, strict=True))
                elif block is not None:
                    for at in range(lo, hi, 64):
                        to = min(at + 64, hi)
                        agree = _agreement(block[2], sig[at:to])
                        i, j = np.nonzero((agree >= AGREE) & (block[1][:, None] != part[at:to][None, :]))
                        if len(i):
                            order = np.lexsort((-agree[i, j], part[at:to][j], i))
                            i, j = i[order], j[order]
                            best = np.concatenate([[True], (i[1:] != i[:-1]) | (part[at:to][j][1:] != part[at:to][j][:-1])])
                            yield _pairs(block[0][i[best]], ids[at:to][j[best]], agree[i[best], j[best]])

    return dealt.mapInArrow(freed(run), _PAIRS).groupBy("a", "b").agg(F.max("agree").alias("agree"))


def judge(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block, one of which asks, that agree in AGREE hashes, with how many agree."""
    sig, out = _short(block.features), []
    asking = np.flatnonzero(block.asks)
    for at in range(0, len(sig), 64):
        other = np.arange(at, min(at + 64, len(sig)))
        agree = _agreement(sig[asking], sig[other])
        i, j = np.nonzero((agree >= AGREE) & (block.part[asking][:, None] != block.part[other][None, :]) & (~block.asks[other][None, :] | (asking[:, None] < other[None, :])))
        out.append((asking[i].astype(np.int32), other[j].astype(np.int32), agree[i, j].astype(np.int16)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def near_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(_doc, n_shingles, component) of rows (_doc, text); component is the smallest _doc reached, itself included."""
    rows = salted(checkpoint(sketches(docs, words)), "_doc")
    full = rows.where("n_shingles > 0")
    key = ["f1", "f2", "n_shingles"]
    first = group_facts(full.select("_doc", *key, "_salt"), key, [F.min("_doc").alias("rep")], [F.min("rep").alias("rep")])
    nodes = checkpoint(full.select("_doc", *key, "_salt").join(shuffled(first), [*key, "_salt"]).select("_doc", "rep", "n_shingles"))
    reps = full.select(F.col("_doc").alias("id"), "sig").join(shuffled(nodes.where("_doc = rep").select(F.col("rep").alias("id"))), "id", "left_semi")
    regions = checkpoint(forest(reps))
    pairs = candidates(regions, reps).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    pairs = checkpoint(pairs)
    clusters = checkpoint(components(pairs))
    if regions.where("wide").limit(1).count():
        more = checkpoint(across(regions, reps, clusters).select(F.col("a").alias("src"), F.col("b").alias("dst")))
        if more.limit(1).count():
            clusters = checkpoint(components(pairs.unionByName(more)))
    sets = nodes.where("_doc = rep").select(F.col("rep").alias("id"), "n_shingles")
    texts = docs.select(F.col("_doc").alias("id"), "text")
    labels = settled(clusters, sets, texts, reps.select("id", F.col("sig").alias("feature")), judge, words, PERCENT)
    own = label(nodes.select("_doc", F.col("rep").alias("id")), labels).select("_doc", "component")
    return rows.select("_doc", "n_shingles").join(shuffled(own), "_doc", "left").select("_doc", "n_shingles", F.coalesce("component", "_doc").alias("component"))


def near_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; one row of each component is kept."""
    own = identified(docs.select("doc_id", "text"))
    ids = own.select("_doc", F.col("row.doc_id").cast("long").alias("doc_id"))
    rows = near_components(own, words).join(shuffled(ids), "_doc")
    out = rows.join(shuffled(ids.select(F.col("_doc").alias("component"), F.col("doc_id").alias("component_id"))), "component")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("_doc") == F.col("component")).alias("kept"))


def without_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs that are kept: the first of each component."""
    own = identified(docs)
    kept = near_components(own, words).where("_doc = component").select("_doc")
    return unwrapped(own.join(shuffled(kept), "_doc", "left_semi"), docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
         ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep
  FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY 1)),
r AS (SELECT s.* FROM s JOIN same USING (doc_id) WHERE doc_id = rep),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
  UNION ALL SELECT rep, doc_id FROM same WHERE rep <> doc_id
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (
  SELECT DISTINCT a AS id, a AS seen FROM e
  UNION SELECT t.id, e.b FROM t JOIN e ON t.seen = e.a
), m AS (SELECT id, min(seen) AS component_id FROM t GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id,
       coalesce(m.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id
"""

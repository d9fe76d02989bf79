"""Operator 12 against its SQL on the given and on odd documents, in one round and in many."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralyn.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string"


def held_against_sql(got, rows):
    documents = pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])})
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(divergence.SQL).fetchall())


def odd_rows():
    rng = np.random.default_rng(4)
    words = ["Café", "CAFÉ", "naïve", "日本", "a", "B", "the", "The", "x1y", "q\x00r", "ÄB", "äb", "-", "don't", *(f"w{chr(97 + k)}" for k in range(20)), *(f"r{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300))]
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 60))), ["en", "de", None, "", "lonely", "zz"][k % 6 if k % 7 else 0], [None, "s1", "s2", "", "ü", "S"][(k * k) % 6]) for k in range(400)]
    rows += [(None, None, "en", "empty"), (None, None, "nothing", "s1"), (1, "", "nothing", "s2"), (1, "one two", "nothing", "s3"), (1, "word " * 90_000, "en", "long"), (1, "word " * 3, "en", "long"), (1, "word", "en", "s1")]
    return rows


@pytest.mark.parametrize(("shard", "room", "dense", "held"), [(4096, 48 << 20, 64 << 20, 400_000), (40, 1500, 200, 20)])
def test_odd_documents_equal_sql(spark, monkeypatch, shard, room, dense, held):
    """Also with small shards, a pass over the texts for each, and dense slots sent on all the time."""
    for name, value in (("SHARD", shard), ("ROUND_BYTES", room), ("DENSE_BYTES", dense), ("HELD_TERMS", held)):
        monkeypatch.setattr(divergence, name, value)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("term", "shard", "n", "part", "rank")]).repartition(3)
    held_against_sql(divergence.divergence(docs), rows)


def test_whole_table_equals_sql(spark, sf, oracle):
    got = sorted(map(tuple, queries.op12_source_divergence(spark, sf).collect()))
    assert got == sorted(oracle.execute(divergence.SQL).fetchall())


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 100, 5000):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        moves, slots = divergence.perfect_hash(hashes)
        assert sorted(slots.tolist()) == list(range(n))
        bucket = (hashes % np.uint64(len(moves))).astype(np.int64)
        assert (divergence._slot(hashes, moves[bucket].astype(np.int64), np.full(n, n)) == slots).all()


def test_lookup_refuses_keys_that_are_not_stored(spark):
    words = [f"w{k}" for k in range(500)]
    vocabulary = spark.createDataFrame([("en", w) for w in words] + [("de", "w1")], "lang string, term string")
    rows = [tuple(r) for r in divergence.build(vocabulary, 7).collect()]
    table = divergence.Lookup(rows, 7)
    keys = [divergence._key("en", w.encode()) for w in words] + [divergence._key("de", b"w1")]
    slots = table.slots_of(keys)
    assert sorted(slots.tolist()) == list(range(501))
    assert (table.slots_of([divergence._key("de", f"w{k}".encode()) for k in range(2, 500)]) == -1).all()
    few = divergence.Lookup(rows[:3], 7)
    assert {k for k, s in zip(keys, few.slots_of(keys), strict=True) if s >= 0} == {k for r in rows[:3] for k in divergence._stored(r[2], r[3]).to_pylist()}


def test_long_division_is_exact():
    rng = np.random.default_rng(3)
    for total in (0, 7, 10**9, 9 * 10**15):
        counts = np.array([0, min(total, 1), total, *rng.integers(0, total + 1, 50).tolist()])
        want = [1 + 10**9 * (int(c) + 1) // (total + 3) for c in counts]
        assert divergence.probabilities(counts, total, 3).tolist() == want


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []

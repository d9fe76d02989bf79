"""Operator 11 against a search through all edits, over the whole table and odd conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from terralyn.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), ""
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out += "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-"
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit, repaired rows) by labels of whole (cost, audit, rows) that go forward, all of them kept apart by what they have said so far."""

    def closed(labels):  # labels by the initials so far that matter: none, s, ...u, ...a
        for _ in range(3):
            for at, (cost, audit, said) in list(labels.items()):
                role = "assistant" if at == "u" else "user"
                new = cost + 5, audit + "I", [*said, (role, "")]
                if new[:2] < labels.get(role[0], (1 << 60, ""))[:2]:
                    labels[role[0]] = new
        return labels

    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    labels = closed({"": (0, "", [])})
    for (_, _, role, text), f in zip(rows, fault, strict=True):
        after = {}
        for at, (cost, audit, said) in labels.items():
            ways = [(at, cost + 2, "D", said)]
            if f in "-t":
                more = 5 if f == "t" else 0
                if role[:1] and role[:1] in allowed[at]:
                    ways.append((role[0], cost + more, "K", [*said, (role, text)]))
                for new in ("user", "assistant"):
                    if new[0] in allowed[at]:
                        ways.append((new[0], cost + more + 1, "R", [*said, (new, text)]))
            for to, c, letter, told in ways:
                if (c, audit + letter) < after.get(to, (1 << 60, ""))[:2]:
                    after[to] = c, audit + letter, told
        labels = closed(after)
    return min((v for k, v in labels.items() if k in ("", "a")), key=lambda v: v[:2])


def expected(table):
    by = {}
    for row in table:
        by.setdefault(row[0], []).append(row)
    out = []
    for conv, rows in by.items():
        own = damaged(rows)
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = {r[1] for r in own if r[1] is not None}
        fault = faults(own)
        initials = [r[2][:1] for r in own]
        cost, audit, said = cheapest(own, fault)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, fault.count("b"), fault.count("d"), fault.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, digest))
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "What?", "and so", " . \t", "", None, "日本語。", "Fine. ", "x" * 50_000 + ".", "dots... then", "\x85", "a.\n\n"]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "sys"]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randint(1, 14)):
            at = rng.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, at, rng.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1])[0], rng.choices(texts, [8, 8, 8, 4, 1, 1, 1, 2, 4, 0.1, 2, 1, 1])[0]))
    return rows + [(7, 2, "user", "twice"), (7, 2, "user", "twice"), (9000, 1, None, None)]


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table_equals_all_edits(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(queries.op11_conversation_repair(spark, sf)) == expected(map(tuple, table.select("conv_id", "turn", "role", "text").collect()))


@pytest.mark.parametrize("block", [1024, 5])
def test_odd_conversations_equal_all_edits(spark, monkeypatch, block):
    """Also where nearly all conversations are joined from parts."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = odd_rows()
    table = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("n", "kind", "_id", "edit", "_kind", "first")]).repartition(3)
    assert got(repair.digests(table)) == expected(rows)


def test_one_conversation_of_a_third_of_all_rows(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Right.", f"Line {t}.", "cut"])) for t in range(4000)] + [(2 + k, 0, "user", "Alone.") for k in range(50)]
    assert got(repair.digests(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_all_short_lists_of_rows():
    """The search against every list of edits, by hand: all rows of two kinds and three faults, up to four of them."""
    grammar = re.compile("(s?(ua)+)?")
    rng = random.Random(2)
    for n in range(4):
        for kinds in itertools.product("sua-", repeat=n):
            for fault in itertools.product("bt-", repeat=n):
                if n == 3 and rng.random() > 0.01:
                    continue
                best = None
                choices = [["D"] + ([] if f == "b" else ["Ru", "Ra"] + (["K" + k] if k != "-" else [])) for k, f in zip(kinds, fault, strict=True)]
                for edits in itertools.product(*choices):
                    for adds in itertools.product(["", "u", "a", "ua", "au"], repeat=n + 1):
                        said, audit, cost = adds[0], "I" * len(adds[0]), 5 * len(adds[0])
                        if cost > 10:
                            continue
                        for edit, f, add in zip(edits, fault, adds[1:], strict=True):
                            said, audit = said + edit[1:] + add, audit + edit[0] + "I" * len(add)
                            cost += {"D": 2, "R": 1, "K": 0}[edit[0]] + (5 if f == "t" and edit != "D" else 0) + 5 * len(add)
                        if (best is None or (cost, audit) < best) and grammar.fullmatch(said):
                            best = cost, audit
                assert repair.search("".join(kinds), "".join(fault)) == best


def test_repaired_rows_are_whole_conversations(spark, sf):
    rows = repair.repaired(spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id % 2 = 0")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.nth)):
        by.setdefault(r.conv_id, []).append(r)
    for own in by.values():
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in own))
        assert [r.turn for r in own if r.turn is not None] == sorted(r.turn for r in own if r.turn is not None)


def test_empty_tables(spark):
    assert repair.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = repair.digests(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert list(map(tuple, row)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]

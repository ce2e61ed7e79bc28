"""The trie of conversation prefixes against one made of Python tuples, and the query against its SQL."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import prefix_trie, queries

duckdb = pytest.importorskip("duckdb")

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "k1 string, conv_id long, turn long, role string, text string, depth int, heavy string"


def table(spark, turns):
    return spark.createDataFrame([("x", *t, 3, None) for t in turns], SCHEMA)


def brute(turns, borrow=False):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            identity = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, role, identity, text))
    own = {c: [(role, text) for *_, role, _, text in sorted(ts)] for c, ts in convs.items()}
    if borrow:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % 20, [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}
    members = collections.defaultdict(list)
    for c in sorted(own):
        for d in range(len(own[c]) + 1):
            members[tuple(own[c][:d])].append(c)
    rows = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in below if x}
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in below if x)
        children = sum(len(x) == len(node) + 1 for x in below)
        ends = ",".join(str(c) for c in ids if len(own[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        rows.append((ids[0], len(node), parent, len(ids), children, sum(x not in parents for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def some_turns(seed, n=60):
    rng, turns = random.Random(seed), []
    for c in rng.sample(range(200), n):
        for t in range(rng.choice([1, 1, 2, 4, 7])):
            turns.append((c, t, rng.choice(["user", "user", None]), rng.choice(["a", "a b", "a  c d", "", None]) if t else "hello there you"))
    turns += [(c, t, "user", "same every time") for c in range(300, 380) for t in range(5)]  # one group of copies
    turns += [(500, None, "user", "null turn"), (500, 0, "user", "z"), (500, 0, "user", "b"), (500, 0, "user", "b"), (500, None, "a", "null turn")]
    turns += [(None, 0, "user", "of nobody"), (None, None, None, None)]
    rng.shuffle(turns)
    return turns


@pytest.mark.parametrize(("seed", "shard_rows"), [(1, 50_000), (2, 40), (3, 1)])
def test_nodes(spark, seed, shard_rows):
    turns = some_turns(seed)
    found = prefix_trie.prefix_trie(table(spark, turns), shard_rows=shard_rows)
    assert sorted(map(tuple, found.collect()), key=str) == brute(turns)


def test_borrowed_turns(spark):
    turns = some_turns(4, 90)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    found = prefix_trie.prefix_trie(table(spark, turns), h, F.col("conv_id") - F.col("conv_id") % 20, 3, shard_rows=30)
    assert sorted(map(tuple, found.collect()), key=str) == brute(turns, True)


def test_one_long_conversation_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 16)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 8)
    turns = [(7, t, "user", f"word {t % 5}") for t in range(90)] + [(c, t, "user", f"word {t % 5}") for c in (8, 9, 30) for t in range(40 + c)]
    found = prefix_trie.prefix_trie(table(spark, turns), shard_rows=25)
    assert sorted(map(tuple, found.collect()), key=str) == brute(turns)


def test_empty_table_has_no_root(spark):
    assert prefix_trie.prefix_trie(table(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(table(spark, [(None, 0, "user", "x")])).count() == 0


def test_slots_are_minimal_and_verified(monkeypatch):
    rng = np.random.default_rng(1)
    for levels in (48, 2):  # with two levels many digests are left to the list
        monkeypatch.setattr(prefix_trie, "LEVELS", levels)
        for n in (0, 1, 2, 5000):
            digests = rng.integers(-(2**62), 2**62, (n, 2))
            slots = prefix_trie.SlotTable(digests).slots(digests)
            assert sorted(slots.tolist()) == list(range(n))
            others = rng.integers(-(2**62), 2**62, (2000, 2))
            assert (prefix_trie.SlotTable(digests).slots(others) == -1).all()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    cursor = con.execute(queries.ORACLES["op13_prefix_trie"])
    names = [c[0] for c in cursor.description]
    found = queries.QUERIES["op13_prefix_trie"](spark, FOLDER).select(*names)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(cursor.fetchall(), key=str)

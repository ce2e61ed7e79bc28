"""Runs of repeated words against trying every period at every place."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, awkward, table

from docengine.llm import periodic_runs, queries

FOLDER = "/root/testdata/sf0.001"


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            e = k
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - k + q
            if length >= max(6, 4 * q):
                body = words[k : k + length]
                if not any(all(body[x] == body[x + r] for x in range(length - r)) for r in range(1, q)):
                    found.append((k, length, q))
            k = max(e, k + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped)


def longest_lyndon(word):
    return [next((m - i for m in range(i + 1, len(word)) if word[m:] < word[i:]), len(word) - i) for i in range(len(word))]


def test_lyndon_lengths():
    rng = random.Random(3)
    for _ in range(1500):
        word = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 30))]
        assert periodic_runs.lyndon_lengths(word) == longest_lyndon(word)


def test_code_zero_ends_a_stretch():
    rng = random.Random(4)
    for _ in range(300):
        parts = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        joined = [c for part in parts for c in [*part, 0]]
        expected = [n for part in parts for n in [*longest_lyndon(part), 0]]
        found = periodic_runs.lyndon_lengths(joined)
        assert [n for c, n in zip(joined, found, strict=True) if c] == [n for c, n in zip(joined, expected, strict=True) if c]


def test_runs_of_many_rows():
    rng = random.Random(5)
    for _ in range(600):
        rows = [[rng.randint(0, rng.choice([0, 1, 1, 2, 4])) for _ in range(rng.randint(0, 60))] for _ in range(rng.randint(1, 5))]
        for row in rows:
            if len(row) > 8 and rng.random() < 0.5:
                a = rng.randrange(len(row))
                p = 1 + (len(row) - a) // rng.randint(3, 9)
                row[:] = [row[i] if i < a else row[a + (i - a) % p] for i in range(len(row))]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        found = periodic_runs.find(offsets, np.array([c for r in rows for c in r], np.int64))
        expected = [(int(o) + s, length, q) for o, row in zip(offsets, rows, strict=False) for s, length, q in brute_runs(row)]
        assert list(zip(*(x.tolist() for x in found), strict=True)) == expected


def test_false_hash_equality_is_caught(monkeypatch):
    codes = np.array([1, 2, 3] * 5 + [4])
    monkeypatch.setattr(periodic_runs, "BASES", ((0, 0), *periodic_runs.BASES))  # a base of zero calls nearly all equal
    assert [x.tolist() for x in periodic_runs.runs_of(codes, np.zeros(len(codes), bool))] == [[0], [15], [3]]


def test_awkward_texts(spark):
    texts = awkward() + [(3, "a a a a a a"), (3, None), (None, "b a " * 9), (None, ""), (900, "w " * 100_000), (901, "a b c " * 7), (902, "A a " * 6)]
    found = periodic_runs.find_runs(table(spark, texts)).collect()
    expected = []
    for i, text in texts:
        words = (text or "").encode().split()
        runs = [(0, 100_000, 1)] if i == 900 else brute_runs(words)
        expected.append((i, runs, collapsed(words, runs).decode()))
    assert sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found), key=str) == sorted(expected, key=str)
    assert periodic_runs.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_query(spark):
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert found.keys() == texts.keys()
    periodic = 0
    for i, text in texts.items():
        words, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        if n > 1500:
            continue  # trying all periods takes too long
        runs = brute_runs(words)
        periodic += bool(runs)
        top = (None,) * 4
        if runs:
            s, length, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            top = (s, length, q, 1000 * length // q)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())
        assert found[i] == (len(runs), *top, *digests)
    assert periodic > 5

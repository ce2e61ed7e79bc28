"""Exact dedup, n-gram join, suffix dedup, BPE, token files, sharding: brute force, round trips, awkward tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import SCHEMA, awkward, group_by_text, linked_components, prose, removed, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docengine.llm import bpe, exact_dedup, ngram_join, sharding, suffix_dedup, token_output

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("keep, best", [("smallest", min), ("largest", max)])
def test_exact_dedup(docs, keep, best):
    found = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, keep=keep).collect()}
    for text, ids in group_by_text(awkward()).items():
        for i in ids:
            assert (found[i]["keep_id"], found[i]["group_size"], found[i]["kept"]) == (best(ids), len(ids), i == best(ids))
            assert found[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    stay = exact_dedup.kept_documents(docs, keep)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(best(x) for x in group_by_text(awkward()).values())


def test_exact_dedup_repeated_and_null_ids(spark, empty):
    found = exact_dedup.exact_dedup(table(spark, [(1, "x"), (1, "x"), (None, "x"), (None, "y"), (2, None)])).collect()
    assert len(found) == 5 and sum(r["kept"] for r in found) == 3
    assert {r["group_size"] for r in found} == {3, 1}
    assert exact_dedup.exact_dedup(empty).collect() == []
    odd = table(spark, [(1, "x"), (1, "x"), (1, "y"), (2, "y"), (None, "x"), (None, "z"), (3, None), (4, "")])
    stay = exact_dedup.kept_documents(odd)
    assert stay.columns == odd.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in stay.collect()), key=str) == sorted([(None, "x"), (1, "y"), (None, "z"), (3, "")], key=str)
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(empty, keep="first")


def test_exact_dedup_runs_no_python(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near_duplicates(docs):
    expected = linked_components(dict(awkward()))
    found = {r["doc_id"]: r for r in ngram_join.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in found.items()} == expected
    stay = sorted(r["doc_id"] for r in ngram_join.one_of_each(docs).collect())
    assert stay == sorted(i for i, c in expected.items() if i == c)


def test_near_duplicates_of_a_frequent_passage(spark):
    """Many unrelated texts share most of a passage: frequent subsets are skipped and made up for."""
    rng = random.Random(3)
    passage = prose(rng, 60)
    texts = [passage + " " + prose(rng, rng.randint(4, 60)) for _ in range(120)]
    texts += [" ".join(w if rng.random() > 0.01 else "new" for w in passage.split()) for _ in range(60)]
    texts += [t + " more" for t in texts[:10]]
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(table(spark, list(enumerate(texts)))).collect()}
    assert found == linked_components(dict(enumerate(texts)))


def test_segments_leave_no_pair_uncovered():
    """Sizes within the ratio are at most one band apart."""
    for n in range(1, 3000):
        band = int(np.searchsorted(ngram_join.BANDS, n))
        assert n * 4 // 3 <= ngram_join.BANDS[band + 1]


def test_near_duplicates_of_odd_tables(spark, empty):
    assert ngram_join.near_duplicates(empty).collect() == []
    found = ngram_join.near_duplicates(table(spark, [(None, "a b"), (4, "a b"), (4, "a b"), (9, "A B"), (5, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["n_shingles"]) for r in found) == [(-1, 4, 1), (4, 4, 1), (4, 4, 1), (5, 5, 0), (9, 4, 1)]


def test_suffix_dedup(docs):
    flags = removed(dict(awkward()))
    for r in suffix_dedup.remove_repeats(docs).collect():
        body, gone = (dict(awkward())[r["doc_id"]] or "").encode(), flags[r["doc_id"]]
        assert r["n_bytes"] == len(body)
        assert bytes(r["kept"]) == bytes(c for c, g in zip(body, gone, strict=True) if not g)
        spans = bytearray(len(body))
        for s in r["spans"] or ():
            spans[s["start"] : s["stop"]] = b"\1" * (s["stop"] - s["start"])
        assert spans == gone


def test_suffix_dedup_chunks(monkeypatch):
    """Long texts are hashed in chunks; every window still has exactly one anchor range."""
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    _, at, low, high = suffix_dedup.anchors(data, np.array([2000, 5000]))
    starts = sorted(s for a, lo, hi in zip(at.tolist(), low.tolist(), high.tolist(), strict=True) for s in range(a - hi, a - lo + 1))
    assert starts == [*range(1901), *range(2000, 4901)]


def test_suffix_dedup_of_odd_tables(spark, empty):
    assert suffix_dedup.remove_repeats(empty).collect() == []
    found = suffix_dedup.remove_repeats(table(spark, [(None, "q" * 150), (3, "q" * 120), (3, "r"), (4, "q" * 120)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"]) for r in found) == [(-1, 150), (3, 120), (4, 120)]
    assert {r["doc_id"]: len(r["kept"]) for r in found} == {None: 1, 3: 0, 4: 0}


def test_suffix_buckets_are_even():
    """Anchors have the least hashes of their windows; that must not bring them all to the first buckets."""
    data = np.random.default_rng(3).integers(97, 123, 300_000).astype(np.uint8)
    keys, _, _, _ = suffix_dedup.anchors(data, np.array([len(data)]))
    sizes = np.bincount(suffix_dedup.bucket_of(keys, 100), minlength=100)
    assert len(keys) > 5000 and sizes.max() < 2 * sizes.mean() and sizes.min() > 0


def test_suffix_dedup_in_turns(spark, monkeypatch):
    """The result does not depend on the number of turns in which the buckets come."""
    rng = random.Random(5)
    passages = [prose(rng, 40) for _ in range(6)]
    texts = [(i, " ".join(rng.choice([prose(rng, 9), rng.choice(passages)]) for _ in range(6))) for i in range(60)]
    expected = {i: bytes(x for x, gone in zip(t.encode(), flags, strict=True) if not gone) for (i, t), flags in zip(texts, removed(dict(texts)).values(), strict=True)}
    assert any(len(expected[i]) < len(t.encode()) for i, t in texts)
    for sent in (0, 120, 2000):
        monkeypatch.setattr(suffix_dedup, "SENT", sent)
        assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(table(spark, texts)).collect()} == expected


def test_suffix_contexts_hold_what_strings_cover():
    data = np.arange(1, 251, dtype=np.uint8)
    right, left = suffix_dedup.contexts(data, np.array([0, 120, 150]), np.array([0, 20, 0]), np.array([0, 68, 10]))
    assert bytes(right[0]) == bytes(data[:100]) and not left[0].any()
    assert bytes(right[1]) == bytes(data[120:200]) + bytes(20) and bytes(left[1]) == bytes(data[52:120][::-1])
    assert bytes(right[2]) == bytes(data[150:250]) and bytes(left[2]) == bytes(data[140:150][::-1]) + bytes(58)


def test_loser_tree():
    rng = random.Random(5)
    for _ in range(30):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
        shared = [[0] + [len(_common(x, y)) for x, y in zip(r, r[1:], strict=False)] for r in runs]
        run, at, common = suffix_dedup.LoserTree(runs, shared).merged()
        merged = [runs[a][b] for a, b in zip(run, at, strict=True)]
        assert merged == sorted(x for r in runs for x in r)
        assert common[1:] == [len(_common(x, y)) for x, y in zip(merged, merged[1:], strict=False)]


def _common(x, y):
    n = 0
    while n < len(x) and x[n] == y[n]:
        n += 1
    return x[:n]


ODD = ["", "  a  b ", "Ünï <|endoftext|>x <|startoftext|> y", "it's 123 '' ́ foo\n\n bar", "İstanbul ΣΑΣ", "<|endoftext|>", "x ", "\x1c a\x0b", "👍🏽 ok", " "]


def test_bpe_equals_the_library(spark):
    texts = [t for _, t in awkward()] + ODD
    library = Tokenizer.from_file(WORD)
    coded = bpe.encode_decode(table(spark, list(enumerate(texts))), WORD)
    for r in bpe.decode(coded, WORD, out="again").collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == r["again"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_odd_tables(spark, empty):
    assert bpe.encode_decode(empty, WORD).collect() == []
    found = bpe.encode_decode(table(spark, [(None, "a"), (1, "a"), (1, "a")]), WORD).collect()
    assert len(found) == 3 and {r["n_tokens"] for r in found} == {1}


def test_trie_states_are_computed_once():
    vocab = {c: k for k, c in enumerate(["a", "b", "c", "a</w>", "b</w>", "c</w>", "ab", "abc</w>"])}
    trie = bpe.TrieBpe(vocab, [("a", "b"), ("ab", "c</w>")], "</w>")
    assert trie.encode_words(["abc", "abb", "ab", "c"]) == {"abc": [7], "abb": [6, 4], "ab": [0, 4], "c": [5]}


def test_token_files(spark, tmp_path):
    texts = [t for _, t in awkward()] + ODD
    library = Tokenizer.from_file(BYTE)
    path = f"file://{tmp_path}/tokens"
    manifest = token_output.write_tokens(table(spark, list(enumerate(texts))), path, BYTE, file_bytes=5_000)
    assert manifest.count() > 1
    start = 0
    found = {r["doc_id"]: r for r in token_output.read_tokens(spark, path).collect()}
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(found[i]["ids"], "<u4").tolist() == ids and found[i]["start"] == start
        start += len(ids)
    some = token_output.read_tokens(spark, path, wanted=[3, 41, 999]).collect()
    assert sorted(r["doc_id"] for r in some) == [3, 41] and all(r == found[r["doc_id"]] for r in some)


def test_only_asked_frames_are_read(tmp_path):
    with open(tmp_path / "x", "wb") as stream:
        file = token_output.FrameFile(stream)
        for k in range(5):
            file.add(k if k else None, np.arange(k * 100, dtype=np.uint32))
        file.close()
    data = bytearray((tmp_path / "x").read_bytes())
    with pa.OSFile(str(tmp_path / "x")) as handle:
        entries, docs = token_output.read_tail(handle, len(data))
    assert docs == [None, 1, 2, 3, 4]
    at = int(entries[:2, 0].sum())
    data[at + 8] ^= 255  # frame 2 is damaged
    handle = pa.BufferReader(bytes(data))
    assert [len(x) for _, x in token_output.read_frames(handle, entries, [1, 4])] == [400, 1600]
    with pytest.raises(Exception):
        list(token_output.read_frames(handle, entries, [2]))


def test_token_files_of_odd_tables(spark, empty, tmp_path):
    token_output.write_tokens(empty, f"{tmp_path}/none", BYTE)
    assert token_output.read_tokens(spark, f"{tmp_path}/none").collect() == []
    token_output.write_tokens(table(spark, [(5, "b"), (None, "c"), (5, "a"), (-2, None)]), f"{tmp_path}/odd", BYTE)
    found = sorted(token_output.read_tokens(spark, f"{tmp_path}/odd").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, -2, 5, 5]


def brute_table(names, slots):
    """The plain turn-taking rule, slot by slot."""
    orders = [[(s + k * d) % slots for k in range(slots)] for s, d in (sharding.preference(n, slots) for n in names)]
    table = {}
    while len(table) < slots:
        for shard, order in enumerate(orders):
            free = next((x for x in order if x not in table), None)
            if free is not None:
                table[free] = shard
    return [table[k] for k in range(slots)]


def test_sharding(spark, docs, empty):
    names = [f"n{k}" for k in range(7)]
    assert sharding.fill(names, 211) == brute_table(names, 211)
    counts = collections.Counter(sharding.fill([f"s{k}" for k in range(64)]))
    assert max(counts.values()) - min(counts.values()) <= 1
    placed = sharding.place(docs, F.col("doc_id"), names, 211)
    assert placed.columns == [c for c in docs.columns if c != "shard"] + ["shard"]
    for r in placed.collect():
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % 211
        assert r["shard"] == sharding.fill(names, 211)[slot]
    nulls = sharding.place(table(spark, [(None, "a"), (None, "b")]), F.col("doc_id"), names).collect()
    assert len({r["shard"] for r in nulls}) == 1 and sharding.place(empty, F.col("doc_id"), names).count() == 0
    fewer = sharding.fill(names[:-1], 211)
    moved = sum(a != b for a, b in zip(sharding.fill(names, 211), fewer, strict=True) if a != 6)
    assert moved < 211 / 4
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(wrong)
    with pytest.raises(ValueError):
        sharding.fill(names, 210)


def test_write_shards(docs, tmp_path):
    placed = sharding.place(docs.select("doc_id", "text"), F.col("doc_id"), ["a", "b", "c"])
    sharding.write_shards(placed, f"{tmp_path}/out")
    again = docs.sparkSession.read.parquet(f"{tmp_path}/out")
    assert again.count() == docs.count() and zlib.crc32(b"") == 0

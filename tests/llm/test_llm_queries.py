"""The numbered queries over the smallest tables: columns, SQL where there is one, library results."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

duckdb = pytest.importorskip("duckdb")

from docengine.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_exact_dedup_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cursor = con.execute(queries.ORACLES["op5_exact_dedup"])
    names = [c[0] for c in cursor.description]
    found = queries.QUERIES["op5_exact_dedup"](spark, FOLDER).select(*names)
    assert sorted(map(tuple, found.collect())) == sorted(cursor.fetchall())


def test_encodings_equal_the_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in queries.QUERIES["op3_bpe"](spark, FOLDER).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected


def test_token_files_equal_the_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = sorted(queries.QUERIES["op9_token_output"](spark, FOLDER).collect())
    start = 0
    for r, i in zip(found, sorted(texts), strict=True):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_katz_query_equals_brute_force(spark, texts):
    from test_models import brute_katz

    scores = brute_katz(list(texts.items()), [i for i in texts if crc(i, 7) != 2])[0]
    found = queries.QUERIES["op1_katz"](spark, FOLDER).collect()
    assert len(found) == len(texts)
    for r in found:
        expected = scores[r["doc_id"]]
        assert r["held_out"] == (crc(r["doc_id"], 7) == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == expected[:3]
        assert (r["base_score"], r["score"]) == pytest.approx(expected[3:])


def test_decontamination_query_finds_exact_passages(spark, texts):
    from docengine.llm.decontamination import normal

    items = {r["item_id"]: normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.QUERIES["op2_decontamination"](spark, FOLDER).collect()}
    exact = {(i, k) for i, t in texts.items() for k, body in items.items() if body and body in normal(t)}
    assert exact <= found.keys() and {p for p, distance in found.items() if distance == 0} == exact


def test_ngram_query_equals_brute_force(spark, texts):
    from helpers import linked_components, shingles

    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op4_ngram_join"](spark, FOLDER).collect()}
    expected = linked_components(texts)
    assert found == {i: (len(shingles(t)), expected[i]) for i, t in texts.items()}


def test_toxicity_query(spark, texts):
    found = queries.QUERIES["op6_toxicity"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in found} == set(texts) and len(found) == len(texts)
    for r in found:
        assert r["held_out"] == (crc(r["doc_id"], 3) == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_personal_data_query_equals_brute_force(spark, texts):
    from test_models import brute_spans

    for r in queries.QUERIES["op7_pii"](spark, FOLDER).collect():
        spans = brute_spans(texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))


def test_suffix_query_equals_brute_force(spark, texts):
    from helpers import removed

    flags = removed(texts)
    found = queries.QUERIES["op8_suffix_dedup"](spark, FOLDER).collect()
    assert len(found) == len(texts)
    for r in found:
        body, gone = texts[r["doc_id"]].encode(), flags[r["doc_id"]]
        kept = bytes(c for c, g in zip(body, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert tuple(r) == (r["doc_id"], len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_sharding_query_equals_the_filled_table(spark, texts):
    from docengine.llm import sharding

    table = sharding.fill(queries.SHARDS)
    for r in queries.QUERIES["op10_sharding"](spark, FOLDER).collect():
        slot = (int.from_bytes(hashlib.md5(str(r["doc_id"]).encode()).digest()[:8], "big") >> 4) % sharding.SLOTS
        assert r["shard"] == table[slot]


def test_placing_keeps_columns_of_any_name(spark):
    from docengine.llm import sharding

    df = spark.createDataFrame([(1, "a", 9, "old")], "id long, _slot string, slot0 int, shard string")
    [row] = sharding.place(df, df["id"], ["x", "y"]).collect()
    assert (row["id"], row["_slot"], row["slot0"]) == (1, "a", 9) and row["shard"] in (0, 1)

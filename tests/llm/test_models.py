"""Language model, toxicity, personal data, decontamination, pipeline."""

import collections
import math
import os
import random
import re

import pytest
from helpers import SCHEMA, awkward, prose, table
from pyspark.sql import functions as F

from docengine.llm import decontamination, katz, pii, toxicity
from docengine.llm.common import bucket_of_id

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_katz(texts, training):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts}
    words, pairs, contexts = collections.Counter(), collections.Counter(), collections.Counter()
    for i in training:
        before = "start"
        for w in tokens[i]:
            words[w] += 1
            pairs[before, w] += 1
            contexts[before] += 1
            before = w
    total = sum(words.values())
    of = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.CUTOFF + 2)]
    word_worth, pair_worth = katz.discounted(of(words)), katz.discounted(of(pairs))
    value = lambda worth, c: worth[c] if c <= katz.CUTOFF else c - katz.RESERVE
    single = {w: value(word_worth, c) / total for w, c in words.items()}
    unknown = 1 - sum(single.values())
    seen, lower = collections.defaultdict(float), collections.defaultdict(float)
    for (h, w), c in pairs.items():
        seen[h] += value(pair_worth, c) / contexts[h]
        lower[h] += single[w]

    def share(h, w):
        if (h, w) in pairs:
            return value(pair_worth, pairs[h, w]) / contexts[h]
        back = (1 - seen[h]) / (1 - lower[h]) if h in contexts else 1.0
        return back * single.get(w, unknown)

    scores = {}
    for i, found in tokens.items():
        score, before = 0.0, "start"
        for w in found:
            score += math.log10(share(before, w))
            before = w
        base = sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in found)
        scores[i] = (len(found), sum(words[w] > 0 for w in found), total, base, score)
    return scores, share, words, contexts


def test_katz(spark):
    texts = awkward()
    training = [i for i, _ in texts if i % 4]
    scores, share, words, contexts = brute_katz(texts, training)
    for h in list(contexts)[:25]:
        assert sum(share(h, w) for w in words) + share(h, "unheard of") == pytest.approx(1)
    for r in katz.katz_scores(table(spark, texts), F.col("doc_id") % 4 != 0).collect():
        expected = scores[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == expected[:3]
        assert (r["base_score"], r["score"]) == pytest.approx(expected[3:])


def test_katz_of_odd_tables(spark, empty):
    assert katz.katz_scores(empty, F.lit(True)).collect() == []
    found = katz.katz_scores(table(spark, [(1, "a b"), (1, "a b"), (None, None)]), F.lit(False)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["score"]) for r in found) == [(0, 1, 0, 0.0), (1, 6, 0, 0.0)]


def labelled(spark, n=400):
    rng = random.Random(4)
    toxic = [k % 4 == 0 for k in range(n)]
    texts = [prose(rng, 40) + (" you stupid moron " if t else " ") + prose(rng, 40) for t in toxic]
    return table(spark, list(enumerate(texts))), spark.createDataFrame([(k, None, int(t)) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int"), toxic


def test_toxicity(spark, empty):
    docs, labels, toxic = labelled(spark)
    usable = bucket_of_id("doc_id", 3) != 1
    found = toxicity.toxic_scores(docs, labels, usable).collect()
    assert len(found) == len(toxic) and all(0 <= r["score"] <= 1 for r in found)
    assert sum(bool(r["predicted"]) == toxic[r["doc_id"]] for r in found) >= 0.98 * len(found)
    stay = toxicity.accepted(docs, labels)
    assert stay.columns == docs.columns and abs(stay.count() - 300) <= 5
    none = spark.createDataFrame([], labels.schema)
    assert toxicity.toxic_scores(empty, labels).count() == 0
    odd = toxicity.toxic_scores(table(spark, [(1, None), (1, None), (None, "a" * 9000)]), none).collect()
    assert len(odd) == 3 and len({r["score"] for r in odd}) == 1


def brute_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    return [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if pii.right_form(k, m[0])]


def test_base_spans():
    rng = random.Random(1)
    parts = ["1", "22", "333", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "%", "4111111111111111", "é", "+1 ", "555", "_"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text) == brute_spans(text)


def test_personal_data(spark, empty):
    rng = random.Random(2)
    texts = [f"{prose(rng, 9)} +1 (375) 555-{rng.randint(1000, 9999)} or 4111111111111111 and 10.0.{k}.7 at ab.{k}@mail.example.com {prose(rng, 5)}" for k in range(200)]
    joined = "see 12 4111111111111111 soon"
    texts += [None, "", joined, "no 2024-10-12 10:20:30 or 1 2 3 4 5 6 7"]
    found = {r["doc_id"]: r["spans"] for r in pii.find(table(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in found[i] if s["base"]] == brute_spans(text or "")
    assert [(s["kind"], joined[s["start"] : s["end"]], s["base"]) for s in found[202]] == [("card", "4111111111111111", False)]
    assert found[200] == found[201] == found[203] == []
    assert pii.find(empty).collect() == [] and len(pii.find(table(spark, [(None, "x"), (1, "y"), (1, "y")])).collect()) == 3


def test_segmentation_is_the_best_one():
    """Dynamic programming against all segmentations of short texts."""
    weights = {"shape=|d": [0, 6.0, 5.5, 1.0], "digits=|d|4": [0, 0.5, 0, 0], "shape=-|d": [0, 0, 4.9, 0]}

    def best(cuts, arcs, j):
        if j == 0:
            return 0.0
        tops = [best(cuts, arcs, j - 1)]
        tops += [best(cuts, arcs, i) + max(pii._score(weights, f)) for i, f in arcs.get(j, ())]
        return max(tops)

    for text in ("1234-5678", "12 3456 789012", "1234567", "99-1234 5678"):
        cuts, arcs = pii.candidates(text, 0, len(text))
        got = sum(max(pii._score(weights, pii.segment_features(text, s, e))) for _, s, e in pii.best_segments(text, 0, len(text), weights))
        assert got == pytest.approx(best(cuts, arcs, len(cuts) - 1))


def test_leaks(spark, empty):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(14, 50))) for k in range(30)] + [(90, None), (91, ""), (92, "short one")]
    docs, expected = [], set()
    for k, (item, text) in enumerate(items[:30]):
        edited = list(text)
        for _ in range(int(0.08 * len(text)) if k % 2 else 0):
            edited[rng.randrange(len(edited))] = rng.choice("abcdefg ")
        docs.append((k, prose(rng, 60) + "\n" + "".join(edited) + " " + prose(rng, 30)))
        expected.add((k, item))
    docs += [(100 + k, prose(rng, 150)) for k in range(40)] + [(200, "a Short\n one it is"), (300, None), (301, "")]
    expected.add((200, 92))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_leaks(table(spark, docs), benchmark)
    pairs = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert pairs == expected
    assert all(r["distance"] == 0 for r in found.filter("doc_id % 2 = 0").collect())
    stay = decontamination.clean(table(spark, docs), benchmark)
    assert {r["doc_id"] for r in stay.collect()} == {i for i, _ in docs} - {i for i, _ in expected}
    assert decontamination.find_leaks(empty, benchmark).collect() == []
    assert decontamination.find_leaks(table(spark, docs), benchmark.limit(0)).collect() == []


def test_recall_of_edited_items():
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randint(14, 60)).encode()) for k in range(60)]
    matcher = decontamination.Matcher(items)
    hits = 0
    for k, body in items:
        edited = bytearray(body)
        for _ in range(int(0.1 * len(body))):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randint(0, 1)] = bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(0, 1)))
        host = prose(rng, 80).encode()
        hits += any(m[1] == k for m in matcher.matches([host + b" " + bytes(edited) + b" " + host]))
    assert hits >= 0.9 * len(items)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as pipeline
    from helpers import linked_components

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [decontamination.normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    accepted = pipeline.toxicity_filter(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    left = {r["doc_id"]: docs[r["doc_id"]] for r in accepted.collect()}
    first = {}
    for i in sorted(left):
        first.setdefault(left[i], i)
    left = {i: left[i] for i in first.values()}
    groups = linked_components(left)
    left = {i: t for i, t in left.items() if groups[i] == i}
    exact = {i for i, t in left.items() if any(x in decontamination.normal(t) for x in items)}
    found = {r["doc_id"] for r in pipeline.run(spark, FOLDER).collect()}
    assert found <= left.keys() - exact and len(left.keys() - exact - found) <= 2

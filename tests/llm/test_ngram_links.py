"""No link is lost: short sets, sets that fall into few segments, hot passages, repeated and null ids."""

import random

import pyarrow as pa

from helpers import linked_components, prose, table

from docengine.llm import ngram_join


def components_of(spark, texts):
    return {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(table(spark, texts)).collect()}


def test_sets_that_fall_into_one_segment(spark):
    """All shingles of the shorter text lie in one of its segments, so the two share no coarse subset."""
    first = "w4878 w2444 w2543 w3308 w1785 w4006 w2153 w2647"
    assert components_of(spark, [(1, first), (2, first + " w1529")]) == {1: 1, 2: 1}
    rng, texts = random.Random(6), []
    while len(texts) < 60:
        words = [f"w{rng.randrange(5000)}" for _ in range(9)]
        [tokens] = ngram_join.shingle_sets(pa.array([" ".join(words[:8])]))
        if ngram_join.filled(tokens, *[(b, ngram_join.COARSE) for b, _ in ngram_join.roles(len(tokens))][0]) <= 2:
            texts += [(len(texts), " ".join(words[:8])), (len(texts) + 1, " ".join(words))]
    assert components_of(spark, texts) == linked_components(dict(texts))


def test_short_sets(spark):
    rng, texts = random.Random(7), []
    for _ in range(60):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randint(1, 16))]
        for _ in range(3):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.choice([0, 1])] = [f"v{rng.randrange(400)}"] * rng.choice([0, 1])
            texts.append((len(texts), " ".join(words)))
    assert components_of(spark, texts) == linked_components(dict(texts))


def test_passages_of_all_weights(spark, monkeypatch):
    """Texts around one passage that takes from a third to nearly all of each, and near copies of some."""
    rng = random.Random(8)
    passage = prose(rng, 80)
    texts = [passage + " " + prose(rng, rng.randint(2, 160)) for _ in range(90)]
    for t in texts[:30]:
        words = t.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts = list(enumerate(texts))
    expected = linked_components(dict(texts))
    assert components_of(spark, texts) == expected
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "KEPT_SHARE", 100)
    assert components_of(spark, texts) == expected


def test_rows_of_one_id(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 60) for _ in range(3))
    texts = [(7, a), (7, b), (7, b), (8, a + " end"), (9, b), (None, c), (None, c + " end"), (None, a), (3, None), (3, "")]
    found = sorted(((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in ngram_join.near_duplicates(table(spark, texts)).collect()), key=str)
    assert found == sorted([(7, True, 7)] * 3 + [(8, True, 7), (9, True, 7), (None, True, 7)] + [(None, True, None)] * 2 + [(3, False, 3)] * 2, key=str)
    docs = table(spark, texts)
    stay = ngram_join.one_of_each(docs)
    assert stay.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in stay.collect()]
    assert len(kept) == 5 and kept.count((3, None)) == kept.count((3, "")) == 1
    assert sum(i == 7 and t == a for i, t in kept) == sum(i == 7 and t == b for i, t in kept) == 1


def test_near_copies_outside_a_component(spark, monkeypatch):
    """Variants of one text of which many link with nothing are not compared each with each, and no link among them is lost."""
    rng = random.Random(3)
    base = [f"b{rng.randrange(10**6)}" for _ in range(160)]
    pool = [(rng.randrange(160), rng.choice("rid")) for _ in range(25)]
    texts = []
    for k in range(130):
        words = [[w] for w in base]
        for _ in range(rng.randint(0, 11)):
            at, how = rng.choice(pool) if rng.random() < 0.4 else (rng.randrange(160), rng.choice("rid"))
            words[at] = {"r": [f"e{at}"], "i": [*words[at], f"c{rng.randrange(10**6)}"], "d": []}[how]
        texts.append((k, " ".join(w for x in words for w in x)))
    compared, verified = [], ngram_join.verified

    def counted(docs, pairs):
        compared.append(pairs.count())
        return verified(docs, pairs)

    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    monkeypatch.setattr(ngram_join, "verified", counted)
    expected = linked_components(dict(texts))
    assert 40 < len(set(expected.values())) < 120
    assert components_of(spark, texts) == expected
    assert sum(compared) < 8 * len(texts)

"""No benchmark passage within the allowed edits is missed: every item length, edits at random or evenly spaced."""

import random

import pytest
from helpers import prose

from docengine.llm import decontamination as D


def edited(rng: random.Random, body: str, edits: int, evenly: bool = False) -> str:
    places = [(2 * k + 1) * len(body) // (2 * edits) for k in range(edits)] if evenly else rng.sample(range(len(body)), edits)
    out = list(body)
    for at in places:
        kind = "swap" if evenly else rng.choice(["swap", "drop", "add"])
        out[at] = {"swap": "#", "drop": "", "add": out[at] + "#"}[kind]
    return "".join(out)


def item_text(rng: random.Random, length: int) -> str:
    return "i" + "".join(rng.choice("abcdefgh") for _ in range(length - 2)) + "j"


def fit(item: bytes, text: bytes) -> tuple[int, int]:
    """The whole distance table."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != c)))
        row = new
    return min(row), row.index(min(row))


def brute(items, texts):
    found = []
    for row, text in enumerate(texts):
        for number, body in items:
            distance, end = fit(body, text)
            if distance <= int(D.MOST_EDITS * len(body)):
                found.append((row, number, distance, max(0, end - len(body))))
    return sorted(found)


def test_best_fit_is_the_whole_table():
    rng = random.Random(1)
    for _ in range(400):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 80))).encode() for _ in range(2))
        assert D.best_fit(item, text) == fit(item, text)


@pytest.mark.parametrize("evenly", [False, True])
def test_recall_is_whole_by_length(evenly):
    rng = random.Random(2)
    missed = {}
    for length in [*range(12, 60), 81, 100, 173, 394, 1000]:
        items = [(k, item_text(rng, length).encode()) for k in range(8)]
        most = int(D.MOST_EDITS * length)
        counts = sorted({1, max(1, most // 2), most})
        cases = [(k, edited(rng, body.decode(), n, evenly)) for k, body in items for n in counts]
        texts = [f"{prose(rng, 20)} {text} {prose(rng, 20)}".encode() for _, text in cases]
        wanted = {(row, k) for row, (k, _) in enumerate(cases)}
        found = {r[:2] for r in D.Matcher(items).matches(texts)}
        missed[length] = len(wanted - found)
    assert not any(missed.values()), missed


@pytest.mark.parametrize("pairs", [500_000, 50])
def test_equals_brute_force(pairs, monkeypatch):
    monkeypatch.setattr(D, "PAIRS", pairs)
    rng = random.Random(3)
    items = [(k, "".join(rng.choice("ab ") for _ in range(rng.randint(12, 60))).strip().encode().ljust(12, b"x")) for k in range(25)]
    items += [(100, b"x" * 40), (101, b"twelve bytes")]
    texts = [b"", b"x", b"x" * 300, b"ab" * 90, b"twelve bytes", b"twelve byte", b"telve bytes", b"xtwelve bytesx"]
    texts += [edited(rng, body.decode(), int(D.MOST_EDITS * len(body))).encode() for _, body in items for _ in range(2)]
    texts += ["".join(rng.choice("ab ") for _ in range(200)).encode() for _ in range(20)]
    assert D.Matcher(items).matches(texts) == brute(items, texts)
    assert D.Matcher(items).matches(texts[::-1]) == brute(items, texts[::-1])


def test_find_leaks_of_twelve_bytes_and_evenly_spaced_edits(spark):
    rng = random.Random(4)
    long = item_text(rng, 240)
    docs = spark.createDataFrame([(1, "so Twelve  Bytes go"), (2, "x " + edited(rng, long, 20, True)), (3, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "twelve bytes"), (11, long)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in D.find_leaks(docs, items).collect()}
    assert found == {(1, 10, 0), (2, 11, 20)}

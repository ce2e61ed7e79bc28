"""Small tables with the awkward cases every operator has to take, and brute-force counterparts."""

from __future__ import annotations

import collections
import itertools
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, run long, shard string, at string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "en", "ing", "s"]) for _ in range(n))


def rows(texts: list[tuple[int | None, str | None]]) -> list[tuple]:
    """Rows with extra columns whose names clash with names used inside operators; all but the text may be null."""
    return [(i, t, None if k % 3 else "en", "src0", None, "b", 7, "s", "x") for k, (i, t) in enumerate(texts)]


def table(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def awkward(seed: int = 7) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    long = prose(rng, 4000)
    base = prose(rng, 120)
    edited = base.split()
    edited[40] = "CHANGED"
    texts = [None, "", "  \t\n ", "one two", "One two", "one two three four", base, base, " ".join(edited), base.upper(), long, long + " end"]
    texts += [prose(rng, rng.randint(5, 300)) for _ in range(40)]
    texts += [texts[20] + "\n" + texts[21], "é ü ñ 日本語 🙂 " * 30, "x" * 5000, base + " " + texts[25], "a  b c\x0b d"]
    return list(enumerate(texts))


def shingles(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def linked_components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def removed(texts: dict[int, str | None], window: int = 100) -> dict[int, bytearray]:
    """Per document a flag for each byte that a string seen before covers."""
    seen, flags = set(), {}
    for i in sorted(texts):
        body = (texts[i] or "").encode()
        flags[i] = bytearray(len(body))
        for s in range(len(body) - window + 1):
            piece = body[s : s + window]
            if piece in seen:
                flags[i][s : s + window] = b"\1" * window
            else:
                seen.add(piece)
    return flags


def group_by_text(texts):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    return groups

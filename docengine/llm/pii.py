"""Personal data: fixed patterns, and a semi-Markov conditional random field over what they leave.

Fixed patterns give the base spans. Some data escapes them, as when a number runs on into the next one
and the longer match fails its test. So every stretch of text outside base spans that could hold an address
or number is cut into tokens, and a semi-Markov model chooses boundaries and kinds together: a whole segment
of up to ``MAX_TOKENS`` tokens has features (digits, groups, separators, checks, neighbours), single tokens
outside segments have none, and dynamic programming finds the best segmentation. The model is a
conditional random field trained on the base spans of ``TRAIN_DOCS`` documents at most (smallest hash of
the id) and ``TRAIN_REGIONS`` stretches of them, by stochastic gradient with the forward-backward algorithm.
"""

from __future__ import annotations

import json
import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import id_and_text

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
TRAIN_DOCS, TRAIN_REGIONS = 3_000, 4_000
PRIOR = -4.0  # of any segment, so that shapes never seen in training stay out
# The base patterns. Possessive forms match the same text without backtracking.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBERS = re.compile(r"[+(]?[0-9][0-9 ().+-]{5,}[0-9]")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
ADDRESS_END = re.compile(r"[A-Za-z0-9._%+@-]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def right_form(kind: str, text: str) -> bool:
    """Whether a match of the base pattern of ``kind`` also passes its test."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in text.split("."))
    digits = only_digits(text)
    return 8 <= len(digits) <= 15 if kind == "phone" else 16 <= len(digits) <= 19 and luhn(digits)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that hold every base match and every candidate, in order of kind, then start."""
    found, at = [], text.find("@")
    while at >= 0:
        start, floor = at, found[-1][1] if found else 0
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        end = ADDRESS_END.match(text, at).end()
        found.append((start, end))
        at = text.find("@", end)
    return found + [m.span() for m in NUMBERS.finditer(text)]


def base_spans(text: str, where: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """kind, start, end of all base matches by kind, then start."""
    found: dict[str, list] = {kind: [] for kind in KINDS}
    for start, end in regions(text) if where is None else where:
        at = text.find("@", start, end)
        if at >= 0:
            done = start
            while at >= 0:
                left = at
                while left > done and text[left - 1] in LOCAL:
                    left -= 1
                domain = DOMAIN.match(text, at + 1) if left < at else None
                done = domain.end() if domain else at + 1
                if domain:
                    found["email"].append(("email", left, done))
                at = text.find("@", done, end)
            continue
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            for m in pattern.finditer(text, start, end):
                if right_form(kind, m[0]):
                    found[kind].append((kind, *m.span()))
    return [x for kind in KINDS for x in found[kind]]


def left_over(text: str, where: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Parts of the regions outside all spans that could still hold an entity."""
    taken, parts, k = sorted((s, e) for _, s, e in spans), [], 0
    for start, end in sorted(where):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        j = k
        while start < end:
            stop = min(end, taken[j][0]) if j < len(taken) else end
            if start < stop:
                parts.append((start, stop))
            start = max(start, taken[j][1]) if j < len(taken) else end
            j += 1
    return [(s, e) for s, e in parts if "@" in text[s:e] or len(only_digits(text[s:e])) >= 4]


def segment_features(text: str, start: int, end: int) -> list[str]:
    """Features of one candidate as a whole, without its kind."""
    body = text[start:end]
    digits, separators = only_digits(body), "".join(sorted({c for c in body if not c.isalnum()}))
    before, after = text[start - 1 : start], text[end : end + 1]
    if any(c.isalpha() for c in body):
        separators += "letters"
    shape = f"{separators}|{'d' if body[0].isdigit() else 'a' if body[0].isalpha() else body[0]}"
    found = [f"shape={shape}", f"digits={shape}|{len(digits)}", f"before={shape}|{_class(before)}", f"after={shape}|{_class(after)}"]
    if body.count(".") == 3 and separators == ".":
        found.append(f"quad={not any(c.isalpha() for c in body) and all(body.split('.')) and right_form('ip', body)}")
    if 16 <= len(digits) <= 19:
        found.append(f"luhn={luhn(digits)}")
    if body[0] == "+":
        found.append(f"plus={8 <= len(digits) <= 15}")
    if "@" in body:
        name, _, domain = body.partition("@")
        found.append(f"address={bool(name) and set(name) <= LOCAL and bool(DOMAIN.fullmatch(domain))}")
    return found


def _class(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def candidates(text: str, start: int, end: int) -> tuple[list[int], dict[int, list[tuple[int, list[str]]]]]:
    """Token boundaries, and for each end boundary the candidates (start boundary, features)."""
    cuts = [start] + [m.end() for m in TOKEN.finditer(text, start, end)]
    number = [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        number.append(number[-1] + (b - a if "0" <= text[a] <= "9" else 0))
    address = [0]
    for a in cuts[:-1]:
        address.append(address[-1] + (text[a] == "@"))
    found: dict[int, list] = {}
    for j in range(1, len(cuts)):
        if not text[cuts[j] - 1].isalnum():
            continue
        for i in range(max(0, j - MAX_TOKENS), j):
            digits, ats = number[j] - number[i], address[j] - address[i]
            if not (text[cuts[i]].isalnum() or text[cuts[i]] in "+(") or ats > 1 or not (ats or 4 <= digits <= 19):
                continue
            if i and text[cuts[i]].isalnum() and text[cuts[i] - 1] == "+":
                continue
            found.setdefault(j, []).append((i, segment_features(text, cuts[i], cuts[j])))
    return cuts, found


def _score(weights: dict[str, list[float]], features: list[str]) -> list[float]:
    total = [PRIOR] * len(KINDS)
    for f in features:
        w = weights.get(f)
        if w:
            total = [a + b for a, b in zip(total, w, strict=True)]
    return total


def best_segments(text: str, start: int, end: int, weights: dict[str, list[float]]) -> list[tuple[str, int, int]]:
    """Entities of the best segmentation; a token outside entities scores 0, and of ties the first found wins."""
    cuts, found = candidates(text, start, end)
    if not found:
        return []
    best, back = [0.0] * len(cuts), [None] * len(cuts)
    for j in range(1, len(cuts)):
        best[j] = best[j - 1]
        for i, features in found.get(j, ()):
            for kind, s in enumerate(_score(weights, features)):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
    spans, j = [], len(cuts) - 1
    while j:
        if back[j]:
            i, kind = back[j]
            spans.append((KINDS[kind], cuts[i], cuts[j]))
            j = i
        else:
            j -= 1
    return spans[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 4, rate: float = 0.3) -> dict[str, list[float]]:
    """Weights per feature and kind from texts (one region each, with a margin) and their spans.

    Each step follows the gradient of a text's log-likelihood: features of the true segments less their
    expectation. With no examples no weight is set and nothing is ever added.
    """
    weights: dict[str, list[float]] = {}
    lattices = []
    for text, spans in examples:
        cuts, found = candidates(text, 0, len(text))
        where = {c: k for k, c in enumerate(cuts)}
        true = {(where[s], where[e], KINDS.index(k)) for k, s, e in spans if s in where and e in where}
        if found:
            lattices.append((len(cuts), found, true))
    for turn in range(rounds):
        step = rate / (1 + turn)
        for size, found, true in lattices:
            scores = {(i, j): _score(weights, f) for j, arcs in found.items() for i, f in arcs}
            ahead = [0.0] * size
            for j in range(1, size):
                ahead[j] = ahead[j - 1]
                for i, _ in found.get(j, ()):
                    for s in scores[i, j]:
                        ahead[j] = _log_add(ahead[j], ahead[i] + s)
            behind = [0.0] * size
            leaving: dict[int, list[int]] = {}
            for i, j in scores:
                leaving.setdefault(i, []).append(j)
            for i in range(size - 2, -1, -1):
                behind[i] = behind[i + 1]
                for j in leaving.get(i, ()):
                    for s in scores[i, j]:
                        behind[i] = _log_add(behind[i], behind[j] + s)
            for j, arcs in found.items():
                for i, features in arcs:
                    for kind, s in enumerate(scores[i, j]):
                        slope = ((i, j, kind) in true) - math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[-1]))
                        if abs(slope) > 1e-4:
                            for f in features:
                                weights.setdefault(f, [0.0] * len(KINDS))[kind] += step * slope
    return weights


def shuffled(example: tuple[str, list]) -> tuple[int, str]:
    """An order that does not follow the text."""
    return zlib.crc32(example[0].encode()), example[0]


def train(docs: DataFrame, limit: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> dict[str, list[float]]:
    """Weights learned from the base spans of at most ``limit`` documents; an empty table gives no weights."""
    rows = id_and_text(docs, id_col, text_col)
    chosen = rows.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = rows.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("text")

    def extract(batches):
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                where = regions(text)
                spans = base_spans(text, where)
                for start, end in where:
                    if end - start > 300:
                        continue
                    lead = max(0, start - 1)
                    inside = [(k, s - lead, e - lead) for k, s, e in spans if start <= s and e <= end]
                    found.append(json.dumps([text[lead : end + 1], inside]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["example"])

    def learn(batches):
        examples = []
        for batch in batches:
            for x in batch.column(0).to_pylist():
                text, spans = json.loads(x)
                examples.append((text, [tuple(s) for s in spans]))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fit(sorted(examples, key=shuffled)[:TRAIN_REGIONS]))])], names=["model"])

    found = sample.mapInArrow(extract, "example string").repartition(1)
    learned = found.mapInArrow(learn, "model string").first()  # none where an empty sample leaves no task
    return json.loads(learned["model"]) if learned else {}


def find(docs: DataFrame, weights: dict[str, list[float]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end in code points, base) by kind, then start; one row per input row.

    Null and empty texts have no spans. Without ``weights`` the model is trained on ``docs``.
    """
    model = train(docs, id_col=id_col, text_col=text_col) if weights is None else weights

    def run(batches):
        for batch in batches:
            column = []
            for text in batch.column(1).to_pylist():
                where = regions(text)
                base = base_spans(text, where)
                rows = [(k, s, e, True) for k, s, e in base]
                for start, end in left_over(text, where, base):
                    rows += [(k, s, e, False) for k, s, e in best_segments(text, start, end, model)]
                rows.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                column.append([dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(column, spans_type)], names=["doc_id", "spans"])

    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)

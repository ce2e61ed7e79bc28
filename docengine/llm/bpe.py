"""BPE encoding over a trie of distinct words, and decoding.

A word is a sequence of symbols, the last one with the end-of-word mark. Of every prefix the state is
the last token of its encoding: the one suffix token that forms a valid pair with the last token of what
stands before it (a pair is valid if merging its symbols gives back the pair). So a prefix's state follows
from the states above it in the trie, and the states of shared prefixes are computed once. Distinct words
in sorted order are the trie in depth-first order: the stack of states is cut back to the common prefix and
grown from there. A word's tokens are read backwards from its last state.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import gather, id_and_text, kept_in_worker, slices, split_words

CACHE_PIECES, CACHE_WORDS = 800_000, 200_000


class TrieBpe:
    """Encodes words (strings of byte-level characters) with the merges and vocabulary of a tokenizer file."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        marked = {t[: -len(end)]: i for t, i in vocab.items() if end and t.endswith(end)}
        self.inner = {t: i for t, i in vocab.items() if not (end and t.endswith(end))}
        self.final = marked if end else self.inner
        self.longest = max(map(len, self.inner), default=0)
        self.longest_final = max(map(len, self.final), default=0)
        self.symbols: dict[int, list[int]] = {}
        for text, i in self.inner.items():
            self.symbols[i] = [vocab.get(c, -1) for c in text]
        for text, i in self.final.items():
            self.symbols[i] = [vocab.get(c, -1) for c in text[:-1]] + [vocab.get(text[-1:] + end, -1)]
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """Plain merging, for the few symbols of a token or a pair."""
        symbols = list(symbols)
        while len(symbols) > 1:
            found = [(*self.merge[p], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.merge]
            if not found:
                break
            _, token, at = min(found, key=lambda x: (x[0], x[2]))
            symbols[at : at + 2] = [token]
        return symbols

    def valid(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.merged(self.symbols[left] + self.symbols[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def _state(self, word: str, stop: int, states: list[int], tokens: dict[str, int], longest: int) -> int:
        """Last token of the encoding of ``word[:stop]``; ``states[k]`` belongs to ``word[:k]``."""
        for start in range(max(0, stop - longest), stop):
            token = tokens.get(word[start:stop])
            if token is None:
                continue
            if start == 0:
                if self.merged(self.symbols[token]) == [token]:
                    return token
            elif states[start] >= 0 and self.valid(states[start], token):
                return token
        return -1

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words."""
        found: dict[str, list[int]] = {}
        states, path = [0], ""
        for word in sorted(words):
            if not word:
                found[word] = []
                continue
            shared, most = 0, min(len(path), len(word) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for stop in range(shared + 1, len(word)):
                states.append(self._state(word, stop, states, self.inner, self.longest))
            path = word[:-1]
            last = self._state(word, len(word), states, self.final, self.longest_final)
            ids, at = [], len(word)
            while at > 0:
                if last < 0:
                    raise ValueError(f"the vocabulary can't spell {word!r}")
                ids.append(last)
                at -= len(self.symbols[last])
                last = states[at] if at else -1
            found[word] = ids[::-1]
        return found


class Codec:
    """Texts to ids and back, as the tokenizer file defines them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.tokenizer = Tokenizer.from_file(path)
        merges = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"]]
        self.trie = TrieBpe(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.plain = re.compile(r"([A-Za-z]+)([.,;:!?]*)")
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.words: dict[str, list[int]] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _cut(self, piece: str) -> list[str | int]:
        """Words of a piece without white space, normalised and in byte-level characters; special tokens as ids."""
        plain = self.plain.fullmatch(piece)
        if plain:
            return [plain[1].lower(), plain[2]] if plain[2] else [plain[1].lower()]
        if "<|" in piece:
            parts = self.specials.split(piece)
            return [x for k, p in enumerate(parts) for x in ([self.special[p]] if k % 2 else self._words(p) if p else [])]
        return self._words(piece)

    def _words(self, piece: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(piece)
        return [word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of each piece; what has been met before is kept, up to a bound."""
        if len(self.known) + len(pieces) > CACHE_PIECES:
            self.known.clear()
        new = [x for x in pieces if x not in self.known]
        cut = [self._cut(x) for x in new]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        wanted = {w for words in cut for w in words if isinstance(w, str)}
        self.words |= self.trie.encode_words(list(wanted - self.words.keys()))
        words = self.words
        for piece, parts in zip(new, cut, strict=True):
            self.known[piece] = tuple(i for w in parts for i in (words[w] if isinstance(w, str) else (w,)))
        return [self.known[x] for x in pieces]

    def texts(self, texts: pa.Array) -> tuple[list[bytes], pa.Array]:
        """Packed ids and decoded text of each row."""
        offsets, codes, words = split_words(texts)
        ids = self.pieces(words.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        stream, each = gather(flat, np.cumsum(sizes) - sizes, sizes, codes)
        at = np.concatenate([[0], np.cumsum(each)])[offsets]
        data = stream.astype("<u4").tobytes()
        packed = [data[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return packed, self.decoded(stream, at)

    def decoded(self, stream: np.ndarray, at: np.ndarray) -> pa.Array:
        """Decoding has no rule of its own in such a file: the tokens, separated by blanks."""
        tokens = pa.array(self.tokens, pa.string()).take(pa.array(stream))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), tokens), " ")


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, packed), decoded; one row per input row.

    Null text is empty and encodes to no ids. Repeated rows stay; a null id is passed on.
    """

    def encode(batches):
        codec = kept_in_worker(("codec", tokenizer), lambda: Codec(tokenizer))
        for batch in batches:
            for part in slices(batch):
                packed, decoded = codec.texts(part.column(1))
                sizes = pa.array([len(x) // 4 for x in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(packed, pa.binary()), decoded], names=names)

    names = ["doc_id", "n_tokens", "ids", "decoded"]
    return id_and_text(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n_tokens long, ids binary, decoded string")


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the text of its packed ids in a column ``out``."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def texts(packed):
        import pandas as pd

        codec = kept_in_worker(("codec", tokenizer), lambda: Codec(tokenizer))
        arrays = [np.frombuffer(x or b"", "<u4") for x in packed]
        at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int64)
        stream = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
        return pd.Series(codec.decoded(stream, at).to_pylist())

    return encoded.withColumn(out, texts(F.col(ids_col)))

"""Language of a text by compression: the language whose dictionary makes the text smallest.

Per language a zstandard raw-content dictionary holds pieces of training texts. A text (lower-cased, all but letters
and marks squeezed to blanks) is compressed block by block with each dictionary, so that every block of a long
text meets the dictionary afresh; the sizes of all blocks add up. The smallest sum wins; where the next one is within
``LEAST_MARGIN`` the operator rejects.

Only the dictionaries are built from a sample: of every language at most ``PIECES`` documents (smallest hash of their id)
give one stretch of ``PIECE_CHARS`` characters each, at a place their id's hash chooses. At most ``MOST_LANGUAGES``
languages are learned, so what is collected and sent out stays below 40 MB whatever the input.

Null text and text without a letter get ``und`` and score 0; a tie between sizes goes to the language with more training
rows, then to the smaller name. Each input row gives one row, repeated and null ids included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import id_and_text, slices

UNKNOWN = "und"
PIECES = 200
PIECE_CHARS = 600
MOST_LANGUAGES = 64
BLOCK_BYTES = 16_384
LEAST_MARGIN = 0.005
BYTES_PER_E = 4.0
ONLY_LETTERS = r"[^\p{L}\p{M}]+"


def letters(texts: pa.Array) -> pa.Array:
    """Lower-cased texts, each run of characters that are neither letter nor mark one blank."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), ONLY_LETTERS, " "), " ")


def blocks(text: bytes, size: int = BLOCK_BYTES) -> list[bytes]:
    """Consecutive blocks of at most ``size`` bytes; an empty text is one empty block."""
    return [text[k : k + size] for k in range(0, max(len(text), 1), size)]


def compressors(dictionaries: list[bytes]) -> list:
    """One zstandard compressor for each raw-content dictionary; matches of four bytes count."""
    import zstandard

    made = []
    for content in dictionaries:
        parameters = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=16, search_log=3, min_match=4, strategy=zstandard.STRATEGY_LAZY,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        made.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary))
    return made


def choose(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of sizes: place of the least (the first of equals), relative distance of the next, share of the least.

    The share weighs every size by e to the minus size over ``BYTES_PER_E``.
    """
    best = sizes.argmin(axis=1)
    least = sizes[np.arange(len(sizes)), best].astype(float)
    ordered = np.sort(sizes, axis=1).astype(float)
    following = ordered[:, 1] if sizes.shape[1] > 1 else np.full(len(sizes), np.inf)
    margin = np.where(np.isinf(following), 1.0, (following - least) / np.maximum(following, 1))
    share = 1 / np.exp((least[:, None] - sizes) / BYTES_PER_E).sum(axis=1)
    return best, margin, share


def train(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          pieces: int = PIECES) -> dict[str, bytes]:
    """Language -> dictionary, by falling number of training rows.

    ``usable`` says, on column ``doc_id``, which rows may be learned from; rows with null language, text or id teach nothing.
    Languages whose sample holds no letter are left out. An empty table gives no dictionaries.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if usable is not None:
        rows = rows.filter(usable)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages; raise MOST_LANGUAGES or group them")
    if not counts:
        return {}
    place = F.xxhash64("doc_id")
    # A share of each language's rows that holds some four times the pieces wanted, then the smallest hashes of that.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * pieces / n))])[F.col("lang")]
    near = rows.select("lang", "doc_id", place.alias("place")).filter(F.pmod("place", F.lit(1_000_003)) < share * 1_000_003)
    ranked = near.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id")))
    chosen = ranked.filter(F.col("rank") <= pieces).select("lang", "doc_id")
    start = F.pmod(place, F.greatest(F.lit(1), F.char_length("text") - PIECE_CHARS + 1)) + 1
    cut = rows.select("lang", "doc_id", F.substring("text", start.cast("int"), F.lit(PIECE_CHARS)).alias("piece"))
    found = cut.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("piece").alias("piece")).collect()
    model = {}
    for lang in sorted(counts, key=lambda name: (-counts[name], name)):
        own = [r["piece"] for r in sorted(found, key=lambda r: r["doc_id"]) if r["lang"] == lang]
        content = " ".join(filter(None, letters(pa.array(own, pa.string())).to_pylist())).encode()
        if content:
            model[lang] = content.ljust(8)
    return model


def identify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             least_margin: float = LEAST_MARGIN) -> DataFrame:
    """doc_id, best, lang, margin, score: one row per input row, texts of any length taken whole.

    ``best`` is the language of the smallest size, ``lang`` the same or ``und`` where the margin is narrow, ``margin`` the
    distance to the next size relative to it, ``score`` the share of the best (0 to 1).
    """
    names, dictionaries = [*model, UNKNOWN], list(model.values())

    def run(batches):
        squeezers = compressors(dictionaries)
        for batch in batches:
            for part in slices(batch):
                texts = letters(part.column(1))
                has = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False) & bool(dictionaries)
                sizes = np.zeros((part.num_rows, max(len(dictionaries), 1)), np.int64)
                for k in np.flatnonzero(has):
                    for block in blocks(texts[int(k)].as_py().encode()):
                        sizes[k] += [len(c.compress(block)) for c in squeezers]
                best, margin, share = choose(sizes)
                best = np.where(has, best, len(names) - 1)
                margin, share = np.where(has, margin, 0.0), np.where(has, share, 0.0)
                of = pa.array(names, pa.string())
                lang = np.where(margin >= least_margin, best, len(names) - 1)
                columns = [part.column(0), of.take(pa.array(best)), of.take(pa.array(lang)), pa.array(margin), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "best", "lang", "margin", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, best string, lang string, margin double, score double")

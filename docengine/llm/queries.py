"""The numbered queries over the given tables and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docengine.functions.folding import let
from docengine.llm import (
    bpe, decontamination, exact_dedup, katz, language, ngram_join, periodic_runs, pii, prefix_trie, sharding, suffix_dedup, token_output, toxicity,
)
from docengine.llm.common import bucket_of_id, table

QUERIES, ORACLES = {}, {}
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return run

    return keep


@query(
    "op5_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
 count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents""",
)
def op5(spark, d):
    return exact_dedup.exact_dedup(table(spark, d, "documents"), keep="largest")


@query("op10_sharding")
def op10(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return sharding.place(docs, F.col("doc_id"), SHARDS).select("doc_id", "shard")


@query("op3_bpe")
def op3(spark, d):
    coded = bpe.encode_decode(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op9_token_output")
def op9(spark, d):
    read = token_output.token_files(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return read.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op6_toxicity")
def op6(spark, d):
    usable = bucket_of_id("doc_id", 3) != 1
    scored = toxicity.toxic_scores(table(spark, d, "documents"), table(spark, d, "labels"), usable)
    return scored.select("doc_id", (bucket_of_id("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op7_pii")
def op7(spark, d):
    """Counts and ``base_sha256`` are of base spans; ``spans`` lists those and what the model adds."""
    found = pii.find(table(spark, d, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op4_ngram_join")
def op4(spark, d):
    return ngram_join.near_duplicates(table(spark, d, "documents"))


@query("op2_decontamination")
def op2(spark, d):
    return decontamination.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op1_katz")
def op1(spark, d):
    scored = katz.katz_scores(table(spark, d, "documents"), bucket_of_id("doc_id", 7) != 2)
    held_out = (bucket_of_id("doc_id", 7) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_suffix_dedup")
def op8(spark, d):
    cut = suffix_dedup.remove_repeats(table(spark, d, "documents"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op11_language")
def op11(spark, d):
    """The choice of the smallest size is returned for every text; ``reliable`` says that its margin is not narrow."""
    docs = table(spark, d, "documents")
    found = language.identify(docs, language.train(docs, bucket_of_id("doc_id", 4) != 2))
    held_out = (bucket_of_id("doc_id", 4) == 2).alias("held_out")
    reliable = F.col("lang") != language.UNKNOWN
    return found.select("doc_id", held_out, F.col("best").alias("lang_pred"), "score", "margin", reliable.alias("reliable"))


def planted_period(text, h):
    """The text of a tenth of the documents, whose words repeat from word ``a`` on with a period that follows from ``h``."""
    g = F.floor(h / 10)

    def repeat(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        at = F.struct(words.alias("words"), a.alias("a"), p.alias("p"))
        places = lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x["words"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])))
        return F.when(n > 0, F.array_join(let(at, places), " ")).otherwise("")

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(prefix_trie.WORD), F.lit(0))
    return F.when(h % 10 == 0, let(words, repeat)).otherwise(text)


@query("op12_periodic_runs")
def op12(spark, d):
    docs = table(spark, d, "documents")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = periodic_runs.find_runs(docs.select("doc_id", planted_period(F.col("text"), h).alias("text")))
    longer = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    top = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | longer(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op13_prefix_trie",
    """WITH turns AS (
 SELECT conv_id, coalesce(role, '') AS role, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, id) AS pos FROM turns),
convs AS (
 SELECT conv_id, xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295)) % 4 AS h
 FROM (SELECT DISTINCT conv_id FROM numbered)),
lent AS (SELECT c.conv_id, t.pos AS depth, t.id, t.words FROM convs c JOIN numbered t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h),
steps AS (
 SELECT * FROM lent UNION ALL
 SELECT t.conv_id, t.pos - c.h + (SELECT count(*) FROM lent l WHERE l.conv_id = t.conv_id), t.id, t.words
 FROM numbered t JOIN convs c USING (conv_id) WHERE t.pos > c.h),
paths AS (
 SELECT conv_id, depth, words, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM steps
 UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT path, max(depth) AS depth, max(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY path),
children AS (SELECT left(path, len(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
subtrees AS (
 SELECT a.path, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
 FROM nodes n LEFT JOIN children c USING (path) JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.path),
ends AS (
 SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
 FROM (SELECT conv_id, max_by(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
 s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN subtrees s USING (path) LEFT JOIN children c USING (path) LEFT JOIN ends e USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, len(n.path) - 32)""",
)
def op13(spark, d):
    """Every conversation takes its first 0 to 3 turns from the first of its twenty."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return prefix_trie.prefix_trie(table(spark, d, "conversations"), h, F.col("conv_id") - F.col("conv_id") % 20, most=3)

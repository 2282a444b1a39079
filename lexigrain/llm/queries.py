"""The queries of this subpackage, each with the SQL that must give the same rows.

A query applies its operator with production parameters to the whole table and
derives digest columns from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lexigrain.llm import (
    chat,
    compression,
    grid_codes,
    hash_tree,
    jaccard_join,
    languages,
    packing,
    prefix_trie,
    rule_ensemble,
    string_tiling,
    token_counts,
    training_order,
    turn_repair,
)
from lexigrain.llm.common import table
from lexigrain.session import shared_path

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_language_evidence")
def op1_language_evidence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return languages.identify(languages.document_records(docs, "doc_id"), languages.learn(docs))


@query("language_evidence_pages")
def language_evidence_pages(spark, sf_dir):
    """The same over raw pages, with markup, address suffix, domain and host."""
    model = languages.learn(table(spark, sf_dir, "documents"))
    return languages.identify(
        languages.page_records(table(spark, sf_dir, "pages"), "page_id"), model)


@query("op2_compression_bands")
def op2_compression_bands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compression.judge(docs).drop("text", "n_bytes")


@query("op3_rule_ensemble")
def op3_rule_ensemble(spark, sf_dir):
    return rule_ensemble.classify(table(spark, sf_dir, "documents"),
                                  spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Four regions of two racks of five shards.
SHARDS = hash_tree.Tree.regular(4, 2, 5)


@query("op4_hash_tree_shards")
def op4_hash_tree_shards(spark, sf_dir):
    return hash_tree.shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)


@query("op5_jaccard_components")
def op5_jaccard_components(spark, sf_dir):
    return jaccard_join.join_components(table(spark, sf_dir, "documents")).drop("root")


@query("op6_greedy_string_tiling")
def op6_greedy_string_tiling(spark, sf_dir):
    return string_tiling.decontaminated(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))


@query("op7_overlap_token_counts")
def op7_overlap_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(
        docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@query("op8_training_order")
def op8_training_order(spark, sf_dir):
    folder = shared_path(spark, "shards")
    folder = folder if "://" in folder else f"file://{folder}"
    tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents")
    rows = training_order.sequences(docs, *tokenizer)
    counts = training_order.sequence_counts(docs, *tokenizer)
    return training_order.materialise(rows, counts, folder, key=2026)


@query("op9_power_of_two_packing")
def op9_power_of_two_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op10_chat_layouts", r"""
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    measured AS (
        SELECT *, length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text,
            '[<\[]\\*(\|start\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>'
            || '|\|im_start\|>|\|im_end\|>|\|endoftext\|>)')) + 9 + 8 + 7 AS chars FROM said)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
            AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
            FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(chars)::BIGINT AS formatted_chars
    FROM measured GROUP BY conv_id""")
def op10_chat_layouts(spark, sf_dir):
    template = chat.Template()
    probe = F.lit("</s>[INST] ok [/INST]").alias("text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), probe)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").unionByName(added)

    def measured(said):
        """Parts of conversations: what their formatted text holds when read back."""
        turns = chat.with_direct(chat.canonical_turns(chat.as_records(said)))
        read = chat.format_turns(turns, template).select(
            "conv_id", "part", "formatted", template.turns(F.col("formatted")).alias("turns"),
            F.array_join(chat.learned_texts(template), "").alias("learned"))
        lines = F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n")))
        return read.select(
            "conv_id", "part", F.size("turns").cast("long").alias("n_turns"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            F.array_join(lines, "").alias("lines"), "learned")

    def joined(name):
        return F.array_join(F.transform("_parts", lambda p: p[name]), "").alias(name)

    known = measured(chat.parts(chat.known_conversations(rows))).groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("part", "lines", "learned"))).alias("_parts")).select(
        "conv_id", "n_turns", "formatted_chars", joined("lines"), joined("learned"))
    alone = measured(chat.parts(chat.lone_rows(rows))).drop("part")
    return known.unionByName(alone).select(
        "conv_id", "n_turns", F.sha2(F.col("lines").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


@query("op13_grid_codes", r"""
    WITH kept AS (
        SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding,
            len(embedding) // 16 AS width
        FROM embeddings WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cells AS (
        SELECT r, i // width AS part, i % width AS place,
            floor(256 * embedding[i + 1]::DOUBLE)::BIGINT AS x
        FROM (SELECT *, unnest(range(len(embedding))) AS i FROM kept)),
    book0 AS (SELECT part, r AS entry, place, x AS c FROM cells WHERE r < 64),
    near1 AS (
        SELECT r, part, min(far) % 64 AS entry FROM (
            SELECT r, part, sum((x - c) * (x - c)) * 64 + entry AS far
            FROM cells JOIN book0 USING (part, place) GROUP BY r, part, entry) GROUP BY r, part),
    sums1 AS (
        SELECT part, entry, place, sum(x) AS s, count(*) AS n
        FROM cells JOIN near1 USING (r, part) GROUP BY part, entry, place),
    book1 AS (
        SELECT part, entry, place, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c
        FROM book0 LEFT JOIN sums1 USING (part, entry, place)),
    near2 AS (
        SELECT r, part, min(far) % 64 AS entry FROM (
            SELECT r, part, sum((x - c) * (x - c)) * 64 + entry AS far
            FROM cells JOIN book1 USING (part, place) GROUP BY r, part, entry) GROUP BY r, part),
    sums2 AS (
        SELECT part, entry, place, sum(x) AS s, count(*) AS n
        FROM cells JOIN near2 USING (r, part) GROUP BY part, entry, place),
    book2 AS (
        SELECT part, entry, place, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c
        FROM book1 LEFT JOIN sums2 USING (part, entry, place)),
    near3 AS (
        SELECT r, part, min(far) % 64 AS entry, min(far) // 64 AS lost FROM (
            SELECT r, part, sum((x - c) * (x - c)) * 64 + entry AS far
            FROM cells JOIN book2 USING (part, place) GROUP BY r, part, entry) GROUP BY r, part),
    coded AS (
        SELECT r, string_agg(format('{:02x}', entry::BIGINT), '' ORDER BY part) AS code,
            sum(lost)::BIGINT AS error
        FROM near3 GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM book2)
            AS codebooks_sha256
    FROM kept JOIN coded USING (r)""")
def op13_grid_codes(spark, sf_dir):
    coded, books = grid_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
                        F.lit(grid_codes.books_digest(books)).alias("codebooks_sha256"))


@query("op12_prefix_trie_codec")
def op12_prefix_trie_codec(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = prefix_trie.encode(table(spark, sf_dir, "documents"), path)
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    decoded = prefix_trie.decode(encoded.withColumn("ids_sha256", digest), path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op11_turn_repair")
def op11_turn_repair(spark, sf_dir):
    rows = turn_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return turn_repair.summarise(turn_repair.repair(rows, copies="copies"))

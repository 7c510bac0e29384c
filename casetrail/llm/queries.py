"""One query per operator: it applies the operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, ann, bpe, chat, imatch, mixing, oracles, packing, pii, sharding, simhash, suffix, toxicity,
               whitening)
from .common import hex_sha256, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shards(sharding.measured(docs), 24).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix.without_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), hex_sha256(F.col("kept")).alias("kept_sha256"))


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans: str) -> Column:
        text = F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(text, ",").alias(spans)

    pairs = chat.format_pairs(chat.pairs_of_replies(table(spark, sf_dir, "conversations")))
    return pairs.select("conv_id", "partner_id", "prompt_turns", "prompt", "chosen", "rejected",
                        joined("chosen_spans"), joined("rejected_spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def of(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(kind) for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, hex_sha256(pii.joined(base)).alias("base_sha256"),
                        pii.joined(F.col("pii")).alias("spans"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
    return found.withColumnRenamed("id", "vec_id")


def vocabulary() -> tuple[str, str]:
    """The rank file and the splitting pattern of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_digests(tokens: DataFrame) -> DataFrame:
    """Counts and digests of (doc_id, token_ids, decoded)."""
    return tokens.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        hex_sha256(F.concat_ws(" ", F.col("token_ids").cast("array<string>"))).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(table(spark, sf_dir, "documents"), *vocabulary())
    return token_digests(bpe.decode(tokens, *vocabulary()))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.against_edits(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (~F.coalesce(toxicity.training_row(), F.lit(True))).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut.drop("ids"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*map(F.lit, model["explained"])).cast("array<double>")
    of = F.arrays_zip(F.col("whitened"), explained.alias("explained"))
    return rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode(of).alias("at", "of")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"), F.col("of.whitened").alias("whitened"),
        F.col("of.explained").alias("explained"), F.lit(model["identity_error"]).alias("identity_error"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    sizes = alignment.vocabulary_sizes(*files)
    counted = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = {name: batch.column(name) for name in ("a_ids", "b_ids", "a_cuts", "b_cuts", "link_a")}
        texts = alignment.group_texts(*list(lists.values())[:4], sizes)
        hashes = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
        lengths = [lists[name].value_lengths().cast(pa.int64()) for name in ("a_ids", "b_ids", "b_cuts", "link_a")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *lengths, pa.array(hashes, pa.string()),
                                           batch.column("pairs"), batch.column("times")], [*counted, "pairs", "times"])

    aligned = alignment.align(table(spark, sf_dir, "documents"), *files, finish=digests, schema=(
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, "
        "times array<int>"))
    return alignment.with_counts(aligned, sizes[1], counted)


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_suffix_dedup, op3_preference, op4_pii, op5_ann, op6_bpe, op7_imatch, op8_simhash,
    op9_toxicity, op10_mixing, op11_packing, op12_whitening, op13_alignment)}
ORACLES = {"op3_preference": oracles.PREFERENCE, "op10_mixing": oracles.MIXING}

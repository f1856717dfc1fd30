"""The queries opN_<name> over the synthetic tables; each derives its digest columns from an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, jaccard, licenses, lm, minhash, mixing, secrets, toxicity
from .common import crc_mod, table

#: What a tokenizer folder's rank file for many languages is called.
RANKS = "byte_bpe_multi_50k.tiktoken"


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents; labels whose id's crc32 is a multiple of 5 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~apart)
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id and its record (JSON), turns in order (nulls first; ties by role, text).

    A conversation is one record, so its turns meet in one row, as its formatted text must.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    messages = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.groupBy("conv_id").agg(messages.alias("messages")).select("conv_id", F.to_json(F.struct("messages")).alias("record"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    df = chat.format_chat(conversation_records(rows))
    df = df.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss_runs")), ""))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(turns).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return minhash.edit_check(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ids whose crc32 is 2 modulo 7 are held out."""
    apart = crc_mod(F.col("doc_id"), 7) == 2
    scored = lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~apart)
    return scored.select("doc_id", apart.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    docs = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return docs.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), sha(said(base)).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest of each row whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.index(vectors), vectors.where(F.col("vec_id") % 100 == 0))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: three-word shingles, links at a Jaccard similarity of 0.9."""
    return jaccard.join_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, num=90, den=100)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, ranks_path(), split_pattern()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for all documents."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}

"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir), docs with the columns of `documents` (doc_id, text, lang, source, n_chars),
and return the same columns, but for the last, which returns the encoded mix. A document is named by its
doc_id and text together, so rows that share an id but not their text stay apart; repeated rows are copies.
Null and empty texts are kept by every stage (they are neither toxic nor near-duplicates of one another).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm import bpe, jaccard, mixing, secrets, toxicity
from tarn.llm.common import crc_mod, small_batches, table, word_count, written
from tarn.llm.queries import ranks_path, split_pattern

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """docs + key: what names a document; it orders by doc_id first."""
    return docs.select(*COLUMNS).withColumn("key", F.struct("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that op1 may learn from, rejects go."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, model, out="toxicity").where("toxicity < 0.5").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by five-word shingles at a similarity of 0.8, the one of least doc_id stays."""
    small_batches(spark)
    docs = keyed(docs)
    classes = jaccard.join_classes(docs.select(F.col("key").alias("doc_id"), "text"), k=5, num=4, den=5)
    heads = classes.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("head")).distinct()
    kept = docs.join(heads, F.col("key") == F.col("head"), "left_semi")
    # Rows with id and text alike have one key: one of them stays.
    one = Window.partitionBy("key").orderBy(F.lit(0))
    return kept.withColumn("copy", F.row_number().over(one)).where("copy = 1").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark of its kind; n_chars follows the text; all documents stay."""
    small_batches(spark)
    cleaned = secrets.scan(docs.select(*COLUMNS), redacted="cleaned")
    changed = F.col("cleaned") != F.col("text")
    return cleaned.withColumn("n_chars", F.when(changed, F.length("cleaned").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("cleaned")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands in the mix as often as the schedule takes its words, rounded: 0, 1 or 2 times; one without words, once."""
    docs = keyed(docs)
    sized = docs.select(F.col("key").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    taken = mixing.mix(sized, size=F.col("size")).select(F.col("doc_id").alias("of"), F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times"))
    # The stage before leaves one row for each key; were there more, each would get its own share.
    one = Window.partitionBy("key").orderBy(F.lit(0))
    taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy("of").orderBy("times")))
    mixed = docs.withColumn("nth_row", F.row_number().over(one)).join(taken, (F.col("key") == F.col("of")) & (F.col("nth_row") == F.col("nth")))
    return mixed.where("times > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids, each text's decoded again and compared: doc_id, source, n_tokens, ids, decodes."""
    small_batches(spark)
    coded = bpe.encode_texts(docs.select("doc_id", "source", "text"), ranks_path(), split_pattern(), check="decodes")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]
#: The classifier, the secret rules and the merges have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

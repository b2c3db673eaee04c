"""From raw documents to packed sequences; every stage works on what its predecessor kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last returns the pieces
of the kept documents with their places in sequences. Texts go to Python in batches of ``BATCH`` rows, since an executor holds a batch several
times over and the stages share its workers. The first two stages set this for the session, as their rows are made when the caller writes them; ``run``
puts the old value back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import near_dedup, packing, quality_classifier, quality_rules, suffix_dedup
from ledgerline.llm.queries import BYTE_BPE
from ledgerline.llm.stages import BATCH_ROWS, materialize, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH = 1_000


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the divergence rules."""
    spark.conf.set(BATCH_ROWS, str(BATCH))
    return quality_rules.judge_documents(docs, columns=COLUMNS, kept_only=True).select(*COLUMNS)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more. The model learns from the labelled rows of the raw table, since
    the rules have removed most bad examples; word vectors come from the raw table as well."""
    spark.conf.set(BATCH_ROWS, str(BATCH))
    raw = table(spark, sf_dir, "documents")
    model = quality_classifier.fit_quality(raw, table(spark, sf_dir, "labels"))
    return quality_classifier.score_documents(docs, model, columns=COLUMNS, kept_only=True).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): that of the smallest id, then of
    the smallest text hash. Different texts stay, also under one id; of rows equal in id and text the first by
    language, source and length stays. Rows without an id all stay."""
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))
    kept = near_dedup.near_duplicates(marked, size=5, percent=80, carried=("_hash",)).where("kept AND doc_id IS NOT NULL")
    grouped = kept.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "_hash")).alias("r")).select("r.*")
    chosen = grouped.unionByName(kept.where("root IS NULL").select("doc_id", "_hash").distinct())
    first = Window.partitionBy("doc_id", "_hash").orderBy("lang", "source", "n_chars")
    rows = marked.where("doc_id IS NOT NULL").join(chosen, ["doc_id", "_hash"], "left_semi")
    single = rows.withColumn("_at", F.row_number().over(first)).where("_at = 1").select(*COLUMNS)
    return single.unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that earlier documents hold, those of rows without an id
    included. A character cut in half goes as a whole."""
    kept = suffix_dedup.remove_repeats(docs, texts=True).select("doc_id", "input_hash", "kept", "n_removed")
    cut = kept.where("n_removed > 0").mapInArrow(_decoded, "_id long, _hash long, _text string")
    # rows equal in id and text are cut alike, so one cut text serves them all
    cut = materialize(cut.dropDuplicates(["_id", "_hash"]), "cut_texts")
    joined = docs.join(cut, docs["doc_id"].eqNullSafe(cut["_id"]) & (F.xxhash64(docs["text"]) == cut["_hash"]), "left")
    text = F.coalesce("_text", "text")
    n_chars = F.when(F.col("_text").isNotNull(), F.char_length("_text").cast("long")).otherwise(F.col("n_chars"))
    return joined.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.decode("utf-8", errors="ignore") for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["_id", "_hash", "_text"])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens."""
    out = packing.pack_documents(spark, docs, BYTE_BPE)
    return out.withColumn("length", F.col("length").cast("long"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]
# shares, network scores and the suffix order are not SQL; tests hold single stages and operators, not the whole run
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark, BATCH):
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)

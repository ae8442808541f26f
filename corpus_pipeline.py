"""From raw documents to packed sequences: language ID, quality rules, near duplicates, source mix, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import language, mixing, ngram_join, packing, quality
from orderloom.llm.common import materialise


def _apart(docs: DataFrame) -> DataFrame:
    """docs with `src_` before each name but doc_id, text, lang and source, so that no stage's output takes the place of an input column."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text", "lang", "source") else f"src_{c}") for c in docs.columns])


def _back(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs, as _apart named them, under their own names; `new` in place of those of its names."""
    return df.select(*[new.get(c, F.col(f"`{c}`" if c in ("doc_id", "text", "lang", "source") else f"`src_{c}`")).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (null text, no letters, or unlike every language learned) go. Equal rows get equal results; an empty table stays empty; other columns stay as they are."""
    return _back(language.identify(_apart(docs), language.fit_on(docs)).filter(~F.col("rejected")), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines leave the texts; documents that fail the base rules or are little but such lines go.

    Near copies count as one document here, so that a group of them reaches the next stage, which keeps one. The limit is a
    count of documents alone (no share of the host), so that a line leaves whatever the size of its host. Null texts fail the
    base rules; a null source is a host of its own; other columns stay as they are, but for text and n_chars.
    """
    kept = quality.quality_rules(_apart(docs), max_share=0.0, near_once=True).filter("kept")
    return _back(kept, docs, text=F.col("clean_text"), n_chars=F.length("clean_text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, and one row of each id; texts without words are in no group. Other columns stay as they are."""
    return ngram_join.keep_one(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (once or twice, or not at all). Null texts have no words; a null source is a source. Other columns stay as they are."""
    taken = mixing.mix_sources(_apart(docs)).filter("epochs_taken > 0")
    return _back(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("epochs_taken")))), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence. A null text is its end token alone; repeated rows are packed as often as they come."""
    return packing.pack_documents(docs.select("doc_id", "text")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packed)]

#: The models, the shuffle hash and the tokenizer are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs

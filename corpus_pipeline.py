"""Corpus pipeline: from raw documents to packed training pieces, in five stored stages."""

from pyspark.sql import DataFrame, SparkSession

from scenegrade.llm import language_id, near_dedup, packing, quality_rules
from scenegrade.llm.common import configure, open_row, pick, shared_folder, stored, table, with_row
from scenegrade.llm.exact_dedup import drop_exact_duplicates


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised, by a model of the labelled ones among them.

    Rejected are texts that are null or without a letter, and those that need more bits a byte than the cutoff of
    their best language, which is learned from its own labelled texts: other languages, encoded data, gibberish.
    Without any labelled text there is no model, and all documents with a letter stay.
    """
    model = language_id.fit(pick(docs, text="text", lang="lang"), cutoffs=True)
    rows = language_id.identify(with_row(docs, text="text"), model) if model else with_row(docs, text="text")
    keep = (rows["lang_pred"] != language_id.UNKNOWN) & rows["recognised"] if model else rows["text"].rlike(r"\p{L}")
    return open_row(rows.filter(keep), docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and the certified cutoffs."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id stays."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the document with the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins, as `packing.pack` returns them."""
    return packing.pack_texts(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("best_fit_packing", pack_documents),
]

#: Model fits, exact bounds and best-fit search have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet to the shared folder and read again for the next."""
    configure(spark)
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = stored(stage(configure(spark), docs, sf_dir), name, f"{folder}/{name}")
    return docs

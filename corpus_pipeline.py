"""A corpus pipeline in five stages, each an operator of spendloom.llm whose decisions take effect.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of
documents, and columns beyond those pass through them, whatever their names.
Null texts and texts without letters go in the first stage; empty tables pass
through; repeated rows fall to one in the second. No result depends on the order
of rows: ties go to the smallest doc_id, then to a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm import language, mixing, near_dedup, packing, pii
from spendloom.llm.common import Tables, free_name, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no text or no letters); the others get the predicted one where their own is missing.

    Where nothing can be learned, as no document has a language, all that have a letter stay, as they are.
    """
    model, names = language.train(docs), (free_name(docs, "lang_pred"), free_name(docs, "score"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = language.predict(docs, model, names).where(F.col(names[0]) != language.UND)
    return kept.withColumn("lang", F.coalesce("lang", names[0])).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (0.8 or more of their shingles); documents without an id of their own stay."""
    return near_dedup.keep_one(docs, threshold=80)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars, if there, follows the text. Null and empty texts stay."""
    out = pii.redact(docs, pii.fit(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops whole documents so that each source comes near its target. A null source is one of its own; copies have the row's columns."""
    return mixing.mixture(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of 2048 tokens. Null texts count as empty; rows that share a doc_id are packed each; other columns don't matter."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Trees, code lengths, MinHash and tokens aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark)
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
        tables.drop_but(docs)
        tables.rest()
    return STAGES[-1][1](spark, docs, sf_dir)

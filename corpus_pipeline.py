"""A corpus pipeline: quality rules, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents.  `run` writes each stage in the shared folder and reads it
again, so a lost executor costs one stage at most.

Defined cases, for every stage: a null text counts as empty and is carried as it is; empty texts are
rejected by the quality rules; texts of any length are taken whole; rows that share an id, or have
none, are judged one by one; repeated rows are near duplicates, of which one stays; an empty table
gives an empty table; other columns pass through, whatever their names.
"""
from pyspark.sql import functions as F

from foretide.llm import bpe_pieces, jaccard_join, mixing, pii, quality
from foretide.llm._common import documents, table
from foretide.llm.queries import MULTI_RANKS, PATTERN


def _measured(docs):
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark, docs, sf_dir):
    """Kept documents, without their failing lines."""
    return _measured(quality.clean(docs))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked ones: that with the smallest id."""
    return jaccard_join.first_of_each(docs)


def personal_data(spark, docs, sf_dir):
    """Every span of personal data replaced by its kind."""
    return _measured(pii.redact(docs))


def mix(spark, docs, sf_dir):
    """Each row as often as the mix takes it."""
    return mixing.repeated(docs)


def byte_bpe(spark, docs, sf_dir):
    """doc_id, source, ids, their number, and whether decoding them gives the text again."""
    coded = bpe_pieces.round_trip(docs.select("doc_id", "source", "text"), MULTI_RANKS, PATTERN)
    return coded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("byte_bpe", byte_bpe)]

#: Tokenizers, soft labels and rounding are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

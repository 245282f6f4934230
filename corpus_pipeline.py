"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, PII, best-fit packing.

Each stage gets the session, the documents its predecessor kept and the data folder, and returns a DataFrame
that is written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkrelief.llm import langid, neardup, packing, pii, suffixes
from sparkrelief.llm.common import read, staged

STAGES = [
    ("language_id", lambda spark, docs, sf_dir: langid.keep_identified(docs)),
    ("minhash_near_dedup", lambda spark, docs, sf_dir: neardup.one_of_each(docs)),
    ("suffix_array_dedup", lambda spark, docs, sf_dir: suffixes.without_repeats(docs)),
    ("pii", lambda spark, docs, sf_dir: pii.redact(docs)),
    ("best_fit_packing", lambda spark, docs, sf_dir: packing.pack(docs)),
]

#: No SQL form: learned models, MinHash and byte-pair encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: the pieces of what is left, with their places in sequences.

    Documents with a null or empty text, or without a letter, go in the first stage; a null id is kept through all
    stages. Repeated rows become one in the second. Extra columns may have any names. No documents: no pieces.
    """
    docs = read(spark, sf_dir, "documents", "*")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs

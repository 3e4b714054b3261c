"""The corpus pipeline: language ID, exact dedup, near dedup, packing.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next stage's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripcast.llm import exact_dedup, langid, minhash, packing
from tripcast.llm.common import set_aside, table
from tripcast.llm.queries import held_out
from tripcast.session import written

NEAR_PERCENT = 80  # of the five-word shingles of two texts, for near copies; op5 alone has 85


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected."""
    model = langid.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    safe, back = set_aside(docs, ["lang_pred", "score", "rejected"])
    kept = langid.predict(safe, model).where("not rejected")
    return kept.drop("lang_pred", "score", "rejected").withColumnsRenamed(back)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return minhash.drop_near_copies(docs, percent=NEAR_PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: Language prediction, sketches and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs

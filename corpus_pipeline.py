"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents, and further ones that docs has, whatever their names.

Cases, for every stage: an empty table gives an empty table; texts of any length are
worked on whole. A null text is an empty one: it is not toxic, holds nothing repeated, is a
near duplicate of the other texts without words, has no tokens to mix (so it is drawn
once), and packs as the single end token. Rows with a null id stay up to mixing, as
documents of their own, and are packed. Repeated rows of one id are scored alike, lose what they repeat, and
are one document for near dedup. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import linededup, minhash, mixing, packing, toxicity
from codeloom.llm._spark import new_path, table
from codeloom.llm.queries import LINE_WORDS, MIXED_SHARE, id_class
from codeloom.ship import shipped

#: No stage can be written in SQL: learned lexicon, winnowing, sampling hashes, bisection, tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from labels outside of the held-out fifth, does not reject."""
    known = table(spark, sf_dir, "labels").where(id_class("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, toxicity.fit(docs, known))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that documents of smaller ids, or they themselves, hold already."""
    return linededup.dedup(docs, within=True, line_words=LINE_WORDS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources draws them: less of the sources that hold most, more of those that hold least."""
    return mixing.mix(docs, budget_share=MIXED_SHARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 1024 tokens."""
    return packing.pack(docs, added=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", shipped(drop_toxic)),
    ("line dedup", shipped(drop_repeated_passages)),
    ("near dedup", shipped(drop_near_duplicates)),
    ("mixing", shipped(mix_sources)),
    ("packing", shipped(pack_sequences)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after another."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs

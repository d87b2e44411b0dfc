"""A corpus from raw documents: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import jaccard_join, language_id, packing, quality_rules
from orbweave.llm.common import written
from orbweave.llm.queries import documents, held_out, tokenizer

#: At most so many ids, of 8 bytes, are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1 << 22


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; the rest go.

    The dictionaries are learnt from the labelled documents that are not held out;
    without any, all go.  Null texts, texts without a letter and narrow margins go;
    ties are margins of 0.  Every row is judged by its own text, whatever its id.
    """
    return language_id.accepted(docs, language_id.fit(docs.where(~held_out())))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy over the rules' ledger keeps.

    Null and short texts go; every row is judged by its own text, whatever its id.
    """
    return quality_rules.accepted(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group linked by five-word shingles
    at a similarity of 0.8 or more.

    Of rows with one id that stays, the one of least text, then of least hash of
    all columns, stays; rows with a null id all stay, and so do texts without words.
    """
    found = written(jaccard_join.jaccard_components(docs, words=5, percent=80).where("doc_id is not null"), "components")
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    several = written(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(_ids(gone), "doc_id", "left_anti").select(*columns)
    if several.isEmpty():
        return kept
    rows = docs.join(_ids(several), "doc_id", "left_semi").select(F.struct(*columns).alias("row"))
    first = F.min_by("row", F.struct("row.text", F.xxhash64("row")))
    return kept.join(_ids(several), "doc_id", "left_anti").select(*columns).union(rows.groupBy("row.doc_id").agg(first.alias("row")).select("row.*"))


def _ids(ids: DataFrame) -> DataFrame:
    """Ids to join whole documents with: by broadcast, without moving a text, where they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences, with what identifies their ids.

    A null text is just the end's id; rows of one id, or without, are documents of their own.
    """
    pieces = packing.pack_documents(docs, tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", known_language), ("quality_rules", good_quality), ("ngram_jaccard_join", without_near_duplicates), ("packing", packed)]

#: Compression and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, name)
    return docs

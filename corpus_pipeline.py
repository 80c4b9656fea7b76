"""The corpus pipeline: language ID, toxicity, exact dedup, near-dedup, packing, one after the other.

Every stage but the last returns rows of its input with all their columns, whatever further columns there are and
whatever their names; none reads a column but ``doc_id`` and ``text`` to decide.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, langid, minhash, packing, queries, toxicity
from tidemark.llm.common import Scratch, documents, fresh

#: The least share of a document's words that its language must have.
LANGUAGE_FROM = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and so null and empty texts, or of no language that has a fair share of the words, go.

    Rows that repeat an id, or have none, are judged each by its own text; a very long text is judged whole.
    """
    model = langid.fit(documents(spark, sf_dir).filter(queries.fold("doc_id", 5) != 0))
    lang, share = (fresh(name, docs.columns) for name in ("_lang", "_share"))
    out = langid.identify(docs, model, keep=docs.columns, names=(lang, share))
    return out.filter((F.col(lang) != "und") & (F.col(share) >= LANGUAGE_FROM)).drop(lang, share)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than the threshold go; null and wordless texts stay.

    Rows that repeat an id, or have none, are judged each by its own text; of a very long text the worst window counts.
    Where labels teach nothing, all stay.
    """
    net = queries.toxicity_network(spark, documents(spark, sf_dir), sf_dir)
    score = fresh("_score", docs.columns)
    return toxicity.score(docs, net, keep=docs.columns, name=score).filter(F.col(score) < queries.TOXIC_FROM).drop(score)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside; null counts as empty) the document with the smallest id stays.

    Where that id repeats with the text, one such row stays; a row without an id stays only where no equal one has an id.
    """
    return exact_dedup.keep_first(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by sets of five-word shingles at 0.8 or more, the smallest id stays.

    Null and wordless texts are linked with nothing and stay; rows of a group that share the id that stays, stay with it; a row
    without an id goes only where its group has one.
    """
    return minhash.keep_one(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's token ids, packed into sequences of several permitted lengths: one row a piece, with its
    place.  A document longer than the largest sequence is several pieces; a null or empty text is its end id."""
    return packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("exact dedup", dedup_exact),
    ("near-dedup", dedup_near),
    ("packing", pack),
]

#: Language, toxicity, sketches and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's input goes once its output is written."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(before)
    return docs

"""A corpus pipeline of five stages, each calling one of the training-data operators.

Documents with a letter stay, and null languages are predicted; of each group of near duplicates one document stays; secrets are
blanked out of the texts; sources are mixed to their target weights; the mix is encoded.

Edge cases: null texts and texts without a letter go in the first stage, so later stages see none; a null doc_id, lang or source
stays as it is (but for a null lang, which is predicted) and its rows go through every stage like the others; of rows with the
same doc_id and text one stays, texts that share a doc_id are told apart; very long texts are taken whole; columns of documents
other than COLUMNS are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe_automaton, common, jaccard_join, lang_id, mixing, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Language prediction, similarity groups and token ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; a null lang becomes the predicted one.  Only texts without a letter (or null) go: no
    text is rejected by its phrases.  If nothing is labelled there is no prediction, and lang stays null."""
    model = lang_id.train(docs)
    told = lang_id.annotate(docs.select(*COLUMNS), model)
    kept = told.filter(F.col("lang_pred") != "und" if model.langs else F.col("text").rlike(r"\p{L}"))
    return kept.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit("und")))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, with the group's least doc_id; equal rows are one document, other texts with
    the same doc_id stay, and so do documents without a doc_id unless they repeat another's text."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blanked out and n_chars counted again."""
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, a row for each time one is taken; rows with a null doc_id are drawn like the others
    and keep their columns."""
    drawn = mixing.mix(docs.select(*COLUMNS), carry=COLUMNS)
    return drawn.select("row", F.explode("draws")).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, and the text's token ids."""
    return bpe_automaton.bpe_append(docs.select("doc_id", "source", "text"))


STAGES = [
    ("language identification", languages),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", secrets),
    ("mixing sources", mixing_weights),
    ("BPE encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each stage's rows are written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.saved(docs)
    return docs

"""A corpus pipeline of four stages: quality rules, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from neuroloom.llm import ngram_join, packing, pii, quality
from neuroloom.llm.common import read, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them.

    Null and empty texts have no words and go.  Rows are judged apart: repeated rows and rows with a null
    doc_id stay if their text does.  Texts of any length are judged whole.  An empty table gives none.
    Columns that the table lacks are null, further ones are left out (as in all stages but the last).
    """
    return quality.cleaned(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word n-grams have a Jaccard similarity of 0.8 or more: that of least doc_id.

    Null doc_ids come last in that order; of wholly equal rows one stays.  Rows without words (null or
    empty text) have no copies but wholly equal ones.  An empty table gives none.
    """
    return ngram_join.one_of_each(docs, width=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data replaced by its kind.

    Null texts stay null.  Rows are changed apart: repeats, null doc_ids and long texts need no rule.
    An empty table gives none.
    """
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids; few words are kept, as other stages share the workers' memory.

    Null and empty texts are the end id alone.  Repeated rows are packed as often as they occur, null
    doc_ids stay null, and a long document becomes several pieces.  An empty table gives none.
    """
    import public_tokenizers as P

    return packing.pack(docs, P.path("byte_bpe_50k.json"), with_ids=True, entries=100_000, block=4_000_000)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("pii", pii_stage), ("packing", packing_stage)]
ORACLE_SQL = None  # personal data's local parsers and the tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

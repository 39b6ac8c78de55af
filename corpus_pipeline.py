"""A training corpus from raw documents: rules, near copies, repeated passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Stages return the columns of
documents, and any further ones that docs has, the last one doc_id, lang, source, n_tokens and ids. A document has as
many rows after the mixture as passes of the mixture take something of it. run() writes each stage's rows to the shared
folder before the next one reads them, and deletes the rows before those.

Defined results, for every stage: null texts count as empty, texts of any length are taken whole, an empty table gives
an empty table, null ids are ids like others, and no column name clashes with a working one. Ties and repeated rows are
defined stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.jaccard import one_of_each
from lodestone.llm.mixing import mix_texts
from lodestone.llm.queries import tokenizer
from lodestone.llm.rules import quality_filter
from lodestone.llm.sentencepieces import encode_documents
from lodestone.llm.shared import drop_path, fresh_path
from lodestone.llm.suffixes import drop_repeats

MODEL = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go, null and empty texts among them; repeated rows go or stay together."""
    return quality_filter(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id stays, null after all others; of rows equal in id and text, one."""
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that occur twice are taken out of the texts; all rows stay, and repeated rows lose the same."""
    return drop_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture takes them: a row a pass, with the words that the pass takes. Texts without words go; a null source is a source; repeated rows take their own parts."""
    return mix_texts(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row's text, with begin and end; repeated rows have equal ids."""
    return encode_documents(docs, tokenizer(MODEL), keep=("doc_id", "lang", "source")).drop("decoded")


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Neither the mixture's permutations nor the model's merges can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        kept, path = stage(spark, docs, sf_dir), fresh_path(spark, name)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

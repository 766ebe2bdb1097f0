"""A training corpus from `documents`: quality rules, near-dedup, decontamination, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result
is written as Parquet and read again as the next one's docs. Columns beside those of documents
go through the first four stages as they are, whatever their names, but for the two of ORDER:
`run` adds them, source_mix fills them and token_output writes the documents in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlume.llm import decontaminate, mixing, quality, queries, simhash, tokenfiles
from ledgerlume.llm.shared import new_folder

#: Slot and place of a document in the mix, null before source_mix. Those of the table are replaced.
ORDER = ("mix_slot", "mix_place")


def ordered(docs: DataFrame) -> bool:
    return set(ORDER) <= set(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others lose the lines that are above the limits of
    their host, and n_chars is set anew with the text.

    A null or empty text has no words and goes. Rows that share an id are judged each by its
    text; equal rows all stay or go. A null source is the host "". An empty table gives none.
    """
    return quality.clean_documents(docs, size_col="n_chars" if "n_chars" in docs.columns else None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays, null last; of rows of one
    id the one with the smallest hash of the text.

    Groups are of texts, so different texts stay although they share an id or have none. Texts
    that are null, empty or without words are one group. An empty table gives none.
    """
    return simhash.first_of_groups(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go.

    A null or empty text shares none and stays, and so does every row if the benchmark is empty.
    Each row is judged by its own text, whatever its id.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix. The target weights are the sources' shares, so all stay, and
    where docs have the columns of ORDER these hold the places at which training meets them.

    A null source is the source "". Rows of one id, or of none, have places by their texts; rows
    equal in id, text and source share one. Without the columns of ORDER texts are not looked at.
    """
    return mixing.ordered_documents(docs, order=ORDER) if ordered(docs) else mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards; a row for each document that the files hold, in the columns doc_id,
    start, n_tokens and ids_crc32. The files hold the documents in the order of the mix where docs
    have the columns of ORDER, else in that of the ids.

    A null or empty text has the end id alone. Null ids come first, and so do null places; rows that share an id each
    have an entry. An empty table gives no rows.
    """
    folder = new_folder(spark, "corpus-tokens")
    shards = tokenfiles.write_shards(docs, folder, queries.tokenizer_path(), order=ORDER if ordered(docs) else ())
    return tokenfiles.read_shards(shards, folder, digest=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: Fingerprints by XXH64 and tokens by a vocabulary file are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(None).cast("long") for c in ORDER})
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_folder(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

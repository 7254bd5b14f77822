"""A training corpus from raw documents, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``docs``; the last returns one row per document of the token shards.  ``run`` writes each stage's rows as
Parquet in the shared folder and reads them again for the next.

Null, empty and repeated rows, ties, empty tables and further columns have the results that the operators' modules
define: a text without a letter is rejected by the first stage; of repeated rows one stays after the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import decontaminate, jaccard, language, mixing, tokens
from shardloom.llm.common import table, written
from shardloom.llm.entry import END_ID, vocabulary_path

#: Bits a byte that a language's code may take at most: those of the uniform code over its symbols.  A text that no
#: learned language codes more shortly than that shows no evidence of any of them.
MOST_BITS = float(language.BITS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter, or that no language codes better than chance, go."""
    model = language.fit(docs)
    found = language.predict(docs, model, carry=tuple(docs.columns))
    return found.where((found["lang_pred"] != language.UNDETERMINED) & (found["bits_per_byte"] <= MOST_BITS)).select("carried.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links (five-word shingles, Jaccard similarity 0.8 or more)."""
    return jaccard.keep_one(docs, width=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window (ten words, or a whole shorter item) of the benchmark."""
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"), width=10, carry=tuple(docs.columns))
    return found.where("size(hits) = 0").select("carried.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the tempered source, language and topic shares."""
    return mixing.mix(docs, carry=tuple(docs.columns)).where("kept").select("carried.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the documents; their rows as read back: doc_id, shard, start, n_tokens, ids_crc32."""
    rows = tokens.read_shards(tokens.write_shards(docs, vocabulary_path(), END_ID))
    return rows.select("doc_id", "shard", rows["at"].alias("start"), "n_tokens", "ids_crc32")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Code lengths, sampling by IPF over them and a subword vocabulary are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

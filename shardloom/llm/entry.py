"""The thin registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, licenses, mixing, neighbours, secrets, sql, tokens, toxicity, urls
from .common import in_training, table

END_ID = 2


def vocabulary_path() -> str:
    """Where the public byte-level vocabulary lies (the folder's own lookup; nothing is copied here)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs.where(in_training()), table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (~in_training()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.link(table(spark, sf_dir, "embeddings"), least=0.93)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(in_training()))
    return language.predict(docs, model).select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_shards(table(spark, sf_dir, "documents"), vocabulary_path(), END_ID)
    rows = tokens.read_shards(manifest)
    return rows.select("doc_id", rows["at"].alias("start"), "n_tokens", "ids_crc32")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return decontaminate.report(found)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time: they carry none, so page k is taken as fetched k * 7919 mod 1,051,200 minutes into 2023 (two years)."""
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(1_051_200))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_672_531_200) + minutes * 60).cast("timestamp_ntz").alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages, by rule: about one registered domain in five is added to a category
    on a day of its own and removed 200 days later, one in fifteen is added again after another 100; hosts that
    start with ``m.`` are listed by their full name."""
    host = urls.host_of(F.col("url"))
    parts = F.split(host, r"\.")
    domain = F.when(host.startswith("m."), host).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), "."))
    listed = pages.select(domain.alias("pattern")).where("pattern is not null").distinct()
    digest = F.conv(F.substring(F.md5("pattern"), 1, 8), 16, 10).cast("long")
    listed = listed.withColumn("h", digest).where("h % 5 = 0")
    day = lambda n: F.timestamp_seconds(F.lit(1_672_531_200) + (F.col("h") % 400 + n) * 86_400).cast("timestamp_ntz")
    category = F.element_at(F.array(F.lit("spam"), F.lit("malware"), F.lit("adult")), (F.col("h") % 3 + 1).cast("int"))
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day(0).alias("at")),
        F.struct(F.lit("remove").alias("action"), day(200).alias("at")),
        F.struct(F.when(F.col("h") % 15 == 0, "add").alias("action"), day(300).alias("at")),
    )
    return listed.select("pattern", category.alias("category"), F.inline(steps)).where("action is not null")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = urls.judge(captures(pages), list_entries(pages))
    return judged.select("page_id", "host", F.date_format("fetched", "yyyy-MM-dd HH:mm").alias("fetched"), F.array_join("categories", ",").alias("categories"), "pattern", "blocked")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the query's SQL defines eight passes; where they do not reach the targets, mix warns and records the rest
    mixed = mixing.mix(table(spark, sf_dir, "documents"), most=8)
    return mixed.withColumn("probability", F.round("probability", 9))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_token_shards": op3_token_shards,
    "op4_decontaminate": op4_decontaminate,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_language": op6_language,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_url_filter": op8_url_filter,
    "op9_license_scan": op9_license_scan,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL

"""One query for each operator, over its whole table, and SQL where that can express it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import (
    chat,
    counterparts,
    decontaminate,
    hnsw,
    langid,
    licenses,
    main_text,
    mixing,
    near_join,
    negatives,
    repair,
    repeats,
    secrets,
    sharding,
)
from paceline.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    asked = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(asked, model).drop("text")


def similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    return near_join.near_join(table(spark, folder, "documents"))


def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.formatted(table(spark, folder, "conversations"))


def repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    kept = repeats.without_repeats(table(spark, folder, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return hnsw.neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: a directory for each source, and one below it for 50 ids."""
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 50).cast("string"), F.col("doc_id").cast("string"))
    return licenses.licensed(docs.select("doc_id", path.alias("path"), "text"))


def mixing_rates(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.rates(table(spark, folder, "documents"), table(spark, folder, "labels"))


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


def benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contamination(docs, items).drop("spans")


def mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh label is moved on by one, components are whole 256ths."""
    moved = F.when(
        F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10
    ).otherwise(F.col("label"))
    items = (
        table(spark, folder, "embeddings")
        .where(negatives.usable(F.col("embedding")))
        .select("vec_id", moved.alias("label"), negatives.whole_numbers(F.col("embedding")).alias("vector"))
    )
    return negatives.hard_negatives(items, items.where("vec_id % 100 = 0"))


def repaired_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repairs(repair.damaged(table(spark, folder, "conversations")))


def document_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.document_shards(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id,
    "op2_near_join": similar_documents,
    "op3_chat_format": chat_format,
    "op4_repeated_bytes": repeated_bytes,
    "op5_secret_scan": secret_scan,
    "op6_nearest_vectors": nearest_vectors,
    "op7_license_scan": license_scan,
    "op8_mixing_rates": mixing_rates,
    "op9_main_text": page_text,
    "op10_decontaminate": benchmark_hits,
    "op11_hard_negatives": mined_negatives,
    "op12_conversation_repair": repaired_conversations,
    "op13_shards": document_shards,
}

SQL: dict[str, str] = {
    "op2_near_join": counterparts.SIMILAR,
    "op3_chat_format": counterparts.CHAT,
    "op4_repeated_bytes": counterparts.REPEATED,
    "op5_secret_scan": counterparts.secrets_sql(
        secrets.PATTERNS, secrets.Entropy(), secrets.MARK, secrets.SPARE
    ),
    "op7_license_scan": counterparts.licenses_sql(
        licenses.TEMPLATES, licenses.Settings().anchors, licenses.TERMS
    ),
    "op10_decontaminate": counterparts.BENCHMARK,
    "op11_hard_negatives": counterparts.NEGATIVES,
    "op12_conversation_repair": counterparts.REPAIR,
    "op13_shards": counterparts.shards_sql(16, sharding.Slots().copies, sharding.Slots().digits),
}

"""From raw documents to a weighted training corpus, one operator a stage.

Each stage takes all documents that the one before it kept. A stage's function takes
(spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
documents of the next one. All but the last return the columns of documents; the last adds
n_tokens, domains, rate and copies. Columns that documents has beside its own pass through under
any name; only those with the names of what the last stage adds are replaced there.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm import decontaminate, langid, mixing, near_join, secrets
from paceline.session import prepare, run_dir

#: The columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least posterior of a language.
SURE = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def beside(stage: Stage) -> Stage:
    """Hand a stage the columns of documents and all others as one, so that no name can clash."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c for c in docs.columns if c in COLUMNS]
        if len(own) == len(docs.columns):
            return stage(spark, docs, sf_dir)
        others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS))
        out = stage(spark, docs.select(*own, others.alias("others")), sf_dir)
        new = [c for c in out.columns if c not in (*own, "others")]
        kept = (
            F.col(c) if c in own else F.col("others").getField(c).alias(c)
            for c in docs.columns
            if c not in new
        )
        return out.select(*kept, *new)

    return run


@beside
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; lang becomes the predicted one.

    Texts without a letter and those that no language is sure of go.
    """
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs, model).where(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)
    )
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


@beside
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar ones.

    A document is an id with a text: rows that share both are one, of which one row stays, and
    different texts under one id stand for themselves. Rows without an id stay.
    """
    key = F.struct("doc_id", F.coalesce(F.md5("text"), F.lit("")).alias("written"))
    named = docs.where("doc_id is not null").withColumn("_key", key)
    groups = near_join.near_join(named.select(F.col("_key").alias("doc_id"), "text"))
    kept = groups.where("doc_id = class_id").select(F.col("doc_id").alias("_key")).distinct()
    order = [F.col(c) for c in COLUMNS if c in docs.columns and c not in ("doc_id", "text")]
    first = Window.partitionBy("_key").orderBy(*order, F.lit(0))
    one = (
        named.join(kept, "_key", "left_semi")
        .withColumn("_rank", F.row_number().over(first))
        .where("_rank = 1")
    )
    return one.select(docs.columns).union(docs.where("doc_id is null"))


@beside
def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@beside
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a notice; n_chars follows the text."""
    out = secrets.redact(secrets.scan(docs)).withColumn(
        "n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    )
    return out.select(docs.columns)


@beside
def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the rate at which to take each for the target mix of domains."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", weighted),
]

#: The stages' classifiers and signatures have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{run_dir(spark)}/documents"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

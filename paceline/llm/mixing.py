"""Mixing documents to target weights by soft membership in domains.

A naive Bayes classifier, learned from a table of labels, gives every document its chance of
belonging to each domain. Projected-gradient least squares then finds a rate for each document, not
below 0, so that the expected tokens of every domain match the targets. Documents are scored by
column functions; a step of the gradient is one aggregate over a narrow table.
"""

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.session import saved


@dataclass(frozen=True)
class Settings:
    """targets: share of the tokens for each domain; a domain that is not named gets none.

    labelled bounds the rows the classifier learns from, and with them what is broadcast: those
    with the smallest hashes of their ids. Everything else covers all documents.
    """

    targets: dict[str, float] = field(
        default_factory=lambda: {"good": 0.8, "poor": 0.15, "toxic": 0.05}
    )
    labelled: int = 20_000
    buckets: int = 16_384
    smoothing: float = 0.5
    max_domains: int = 64
    steps: int = 40
    tolerance: float = 1e-4


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): ``toxic``, otherwise ``good`` or ``poor`` by quality.

    Rows with a null in doc_id or toxic, or in quality unless toxic is 1, have no domain.
    """
    domain = F.when(F.col("toxic") == 1, "toxic").when(
        F.col("toxic").isNotNull() & F.col("quality").isNotNull(),
        F.when(F.col("quality") == 1, "good").otherwise("poor"),
    )
    return labels.select("doc_id", domain.alias("domain")).where(
        "doc_id is not null and domain is not null"
    )


def tokens(text: Column, buckets: int) -> Column:
    """The hashed words of a text; none for a null."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+")
    return F.transform(
        F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")
    )


@dataclass(frozen=True)
class Model:
    """Names of the domains in order, their log priors, and log-likelihoods of every bucket."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]


def learn(docs: DataFrame, labels: DataFrame, settings: Settings) -> Model:
    """Count hashed words per domain; labels is (doc_id, domain). No labels give no domains."""
    sample = (
        labels.orderBy(F.xxhash64(F.col("doc_id")), "doc_id", "domain").limit(settings.labelled)
    )
    counts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .select(
            "domain",
            F.explode(F.concat(F.array(F.lit(-1)), tokens(F.col("text"), settings.buckets))).alias("b"),
        )
        .groupBy("domain", "b")
        .agg(F.count("*").alias("n"))
        .where("domain is not null")
    )
    names = [r.domain for r in sample.select("domain").distinct().limit(settings.max_domains + 1).collect()]
    if len(names) > settings.max_domains:
        raise ValueError(f"over {settings.max_domains} domains")
    found: dict[str, list[float]] = {}
    for r in counts.collect():
        found.setdefault(r.domain, [0.0] * (settings.buckets + 1))[r.b] = float(r.n)
    domains = tuple(sorted(found))
    rows = sum(found[d][-1] for d in domains)
    weights = []
    for d in domains:
        total = sum(found[d][:-1]) + settings.smoothing * settings.buckets
        weights.append(
            tuple(math.log((n + settings.smoothing) / total) for n in found[d][:-1])
        )
    return Model(domains, tuple(math.log(found[d][-1] / rows) for d in domains), tuple(weights))


def constants(values: tuple[float, ...]) -> Column:
    """A long array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def log_likelihood(words: str, prior: float, weights: Column) -> Column:
    return F.aggregate(words, F.lit(prior), lambda acc, b: acc + F.get(weights, b))


def free(name: str, rows: DataFrame) -> str:
    """The name, made longer until no column of the rows has it in any case."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name = "_" + name
    return name


def with_posteriors(docs: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """The documents with n_tokens and domains, an array of the chances in order of the names."""
    words, sums = free("_words", docs), free("_scores", docs)
    counted = docs.withColumn(words, tokens(F.col("text"), settings.buckets))
    scores = [
        log_likelihood(words, prior, constants(weights))
        for prior, weights in zip(model.prior, model.weights, strict=True)
    ]
    scored = counted.withColumn(sums, F.array(*scores) if scores else F.array(F.lit(0.0)))
    odds = F.transform(sums, lambda s: F.exp(s - F.array_max(sums)))
    share = F.transform(
        odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda acc, y: acc + y)
    )
    return (
        scored.withColumn("n_tokens", F.size(words).cast("long"))
        .withColumn("domains", share)
        .drop(words, sums)
    )


def stepped(steps: list[list[float]]) -> Column:
    """The rate of a document after the given steps, projected to 0 and above each time."""
    rate = F.lit(1.0)
    for step in steps:
        move = F.lit(0.0)
        for k, x in enumerate(step):
            move = move + F.get("domains", F.lit(k)) * F.lit(x)
        rate = F.greatest(F.lit(0.0), rate - F.col("n_tokens") * move)
    return rate


def solve(scored: DataFrame, wanted: list[float], settings: Settings) -> list[list[float]]:
    """Steps of the projected gradient; scored is (n_tokens, domains), wanted the tokens.

    The error is measured in the metric of the inverse Gram matrix of the expected tokens: there
    a step of size 1 is safe and, without the bound at 0, exact. The matrix is that of the
    documents off the bound, which takes few steps, until a step once fails to lower the error;
    from then on it is that of all documents. It stops when no domain is off by more than the
    tolerance's share of all tokens, or nothing moves any more.
    """
    size, free = len(wanted), True
    steps: list[list[float]] = []
    before = whole = None
    for _ in range(settings.steps + 1):
        rate = stepped(steps)
        parts = [F.col("n_tokens") * F.get("domains", F.lit(k)) for k in range(size)]
        rated = scored.select(rate.alias("rate"), *(p.alias(f"p{k}") for k, p in enumerate(parts)))
        kept = F.when(F.col("rate") > 0, 1.0).otherwise(0.0)
        sums = rated.agg(
            *(F.sum(F.col(f"p{k}") * F.col("rate")).alias(f"t{k}") for k in range(size)),
            *(
                F.sum(F.col(f"p{i}") * F.col(f"p{j}") * kept).alias(f"g{i}_{j}")
                for i in range(size)
                for j in range(i + 1)
            ),
        ).first()
        gram = np.zeros((size, size))
        for i in range(size):
            for j in range(i + 1):
                gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"] or 0.0
        whole = gram if whole is None else whole
        error = np.array([sums[f"t{k}"] or 0.0 for k in range(size)]) - np.array(wanted)
        off = float(np.abs(error).max()) if size else 0.0
        if off <= settings.tolerance * sum(wanted):
            break
        if before is not None and off >= before * (1 - 1e-9):
            if not free:
                break
            free = False
            steps.pop()
            error = last
        else:
            before, last = off, error
        if len(steps) == settings.steps:
            break
        inverse = np.linalg.pinv(gram if free else whole, hermitian=True)
        steps.append([float(x) for x in inverse @ error])
    return steps


@dataclass(frozen=True)
class Mix:
    """What turns a document into its rate."""

    model: Model
    steps: list[list[float]]
    settings: Settings


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[Mix, DataFrame]:
    """The mix, and the narrow table (doc_id, n_tokens, domains) it was found on."""
    model = learn(docs, domain_of_labels(labels), settings)
    narrow = docs.select("doc_id", "text")
    scored = saved(
        with_posteriors(narrow, model, settings).select("doc_id", "n_tokens", "domains")
    )
    total = scored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    wanted = [settings.targets.get(d, 0.0) * total for d in model.domains] or [float(total)]
    return Mix(model, solve(scored, wanted, settings), settings), scored


def with_rates(scored: DataFrame, mix: Mix) -> DataFrame:
    """rate and copies beside n_tokens and domains; copies rounds the rate up by a hash of doc_id
    as often as its fraction says, so that the expected copies are the rate."""
    rated = scored.withColumn("rate", stepped(mix.steps))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 52)) / float(1 << 52)
    up = (chance < F.col("rate") - F.floor("rate")).cast("long")
    return rated.withColumn("copies", F.floor("rate") + up)


def mixed_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All columns of the documents, and n_tokens, domains, rate and copies."""
    mix, _ = fitted(docs, labels, settings)
    clean = docs.drop("n_tokens", "domains", "rate", "copies")
    return with_rates(with_posteriors(clean, mix.model, settings), mix)


def rates(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, a chance p_<domain> for each domain, rate and copies of every document.

    docs is (doc_id, text), labels (doc_id, quality, toxic). A null or empty text has no tokens,
    the chances of the labels and rate 1. Rows that repeat are documents of their own; labels
    that contradict each other all count. Without usable labels there is one domain, all
    documents, with no target but its size, and every rate is 1.
    """
    mix, scored = fitted(docs, labels, settings)
    out = with_rates(scored, mix)
    return out.select(
        "doc_id",
        "n_tokens",
        *(F.get("domains", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(mix.model.domains)),
        "rate",
        "copies",
    )

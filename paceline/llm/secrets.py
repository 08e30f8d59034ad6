"""Secret scans: fixed patterns, and windows of high Shannon entropy in candidate strings.

Spans are in code points of the text, end exclusive. Everything is built of column functions.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.arrays import once, slices, starts

#: Stands around a match; where a text holds it itself, another character takes its place.
MARK, SPARE = "\ue000", "\ue001"


@dataclass(frozen=True)
class Pattern:
    """A kind of secret. The secret itself, ``group`` of ``regex``, has ``least`` characters."""

    kind: str
    regex: str
    group: int
    least: int


#: The patterns that every scan looks for, in the order of their kinds.
PATTERNS = (
    Pattern(
        "assign",
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
        r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
    ),
    Pattern("access", "AKIA[A-Z0-9]+", 0, 20),
    Pattern("hex", "[0-9a-f]+", 0, 24),
)


@dataclass(frozen=True)
class CharClass:
    """Candidate strings of one alphabet; ``bits`` a character in a window make a secret."""

    name: str
    regex: str
    bits: float


@dataclass(frozen=True)
class Entropy:
    """Windows of ``window`` characters over the candidates, runs of base-64 or URL characters.

    A candidate belongs to the first class whose regex it matches as a whole and to none
    otherwise; one that an ``allowed`` regex matches as a whole is no secret.
    """

    window: int = 20
    candidate: str = "[A-Za-z0-9+/_=-]{20,}"
    classes: tuple[CharClass, ...] = (
        CharClass("hex", "[0-9a-fA-F]+", 3.0),
        CharClass("mixed", "(?=.*[0-9])(?=.*[A-Za-z]).*", 3.6),
        CharClass("letters", "[A-Za-z+/_=-]+", 4.0),
    )
    allowed: tuple[str, ...] = (
        "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
        "[0-9]+",  # numbers
        # words, also run together, paths and numbered names; possessive, as a plain repeat of a
        # group is a recursion over the text
        "(?:[A-Z]*+[a-z]{2,}+|[A-Z]{2,}+|[_/=+-]++)*+[0-9]{0,4}",
        "(?:[A-Za-z]{1,3}[_/=+-]++)*+[A-Za-z]{1,3}",  # short parts of paths
        "(.)\\1+",  # rulers
    )
    block: int = 256
    kind: str = "entropy"


def matches(text: Column, regex: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, value).

    Marks are set around the matches and the text is cut there, so every second piece is a
    match and the lengths of the pieces add up to its place.
    """
    marked = F.regexp_replace(
        F.translate(text, MARK, SPARE), F.lit(f"({regex})"), F.lit(f"{MARK}$1{MARK}")
    )
    empty = F.array().cast("array<struct<start:int,value:string>>")

    def placed(pieces: Column) -> Column:
        whole = F.arrays_zip(
            starts(F.transform(pieces, lambda p: F.length(p))).alias("start"), pieces.alias("value")
        )
        return F.filter(whole, lambda p, i: i % 2 == 1)

    found = once(F.split(marked, F.lit(MARK)), placed)
    return F.when(F.regexp_like(text, F.lit(regex)), found).otherwise(empty)


def span(start: Column, order: int, kind: str, end: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        F.lit(order).alias("order"),
        F.lit(kind).alias("kind"),
        end.cast("int").alias("end"),
    )


def pattern_spans(text: Column, pattern: Pattern, order: int) -> Column:
    """Spans of one fixed pattern; matches with too short a secret are dropped afterwards."""
    regex = pattern.regex
    if pattern.group == 0:  # within a run of such characters no other match is as long
        head, _, _ = regex.rpartition("+")
        regex = f"{head}{{{pattern.least - (4 if head.startswith('AKIA') else 0)},}}"
    found = matches(text, regex)
    if pattern.group:
        found = F.filter(
            found,
            lambda m: F.length(F.regexp_extract(m["value"], pattern.regex, pattern.group))
            >= pattern.least,
        )
    return F.transform(
        found, lambda m: span(m["start"], order, pattern.kind, m["start"] + F.length(m["value"]))
    )


#: The first code of the candidates' alphabet, and how many codes there are from it on.
FIRST_CODE, CODES = 43, 80


def high_windows(codes: Column, rule: Entropy, limit: Column) -> Column:
    """(first, last): where the first and the last window of high entropy begin, nulls if none does.

    The codes of a candidate are taken in blocks of windows. In a block one character enters the
    window and one leaves it at a time, so a step changes two counts, and the sum of n*log2(n)
    over the counts follows by its differences.
    """
    window, size = rule.window, F.size(codes)

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def changed(counts: Column, code: Column, by: int) -> Column:
        return F.concat(
            F.slice(counts, F.lit(1), code),
            F.array(F.element_at(counts, code + 1) + by),
            F.slice(counts, code + 2, F.lit(CODES)),
        )

    most = window * (F.log2(F.lit(float(window))) - limit)
    nothing = F.lit(None).cast("int")

    def block(part: Column, at: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), CODES).alias("counts"),
            F.lit(0.0).alias("sum"),
            F.lit(0).alias("i"),
            nothing.alias("first"),
            nothing.alias("last"),
        )

        def step(acc: Column, code: Column) -> Column:
            full = acc["i"] >= window
            gone = F.when(full, F.element_at(part, F.greatest(acc["i"] - window + 1, F.lit(1))))
            n_gone = F.element_at(acc["counts"], gone + 1)
            left = F.when(full, changed(acc["counts"], gone, -1)).otherwise(acc["counts"])
            less = F.when(full, weight(n_gone - 1) - weight(n_gone)).otherwise(F.lit(0.0))

            def enter(left: Column) -> Column:
                n = F.element_at(left, code + 1)
                total = acc["sum"] + less + weight(n + 1) - weight(n)
                place = at + acc["i"] - window + 1
                high = (acc["i"] >= window - 1) & (total <= most)
                return F.struct(
                    changed(left, code, 1).alias("counts"),
                    total.alias("sum"),
                    (acc["i"] + 1).alias("i"),
                    F.coalesce(acc["first"], F.when(high, place)).alias("first"),
                    F.when(high, place).otherwise(acc["last"]).alias("last"),
                )

            return once(left, enter)

        return F.aggregate(
            part, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))
        )

    each = F.transform(
        slices(size - window + 1, rule.block),
        lambda k: once(
            F.slice(codes, k * rule.block + 1, rule.block + window - 1),
            lambda part: block(part, k * rule.block),
        ),
    )
    return once(
        each,
        lambda each: F.struct(
            F.array_min(F.transform(each, lambda e: e["first"])).alias("first"),
            F.array_max(F.transform(each, lambda e: e["last"])).alias("last"),
        ),
    )


def entropy_spans(text: Column, rule: Entropy, order: int) -> Column:
    """The part of each candidate that its windows of high entropy cover, from first to last."""
    allowed = "^(?:" + "|".join(f"(?:{x})" for x in rule.allowed) + ")$"
    suspects = F.filter(matches(text, rule.candidate), lambda m: ~m["value"].rlike(allowed))

    def high(m: Column) -> Column:
        limit = F.lit(None).cast("double")
        for kind in reversed(rule.classes):
            limit = F.when(m["value"].rlike(f"^(?:{kind.regex})$"), F.lit(kind.bits)).otherwise(
                limit
            )
        codes = F.transform(F.split(m["value"], ""), lambda c: F.ascii(c) - FIRST_CODE)
        return once(
            F.struct(codes.alias("codes"), limit.alias("limit")),
            lambda x: once(
                high_windows(x["codes"], rule, x["limit"]),
                lambda w: F.struct(
                    (m["start"] + w["first"]).alias("start"),
                    (m["start"] + w["last"] + rule.window).alias("end"),
                ),
            ),
        )

    found = F.filter(F.transform(suspects, high), lambda s: s["start"].isNotNull())
    return F.transform(found, lambda s: span(s["start"], order, rule.kind, s["end"]))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, entropy: Entropy = Entropy(), text: str = "text") -> DataFrame:
    """All columns of the documents, and ``base`` and ``secrets``, arrays of spans.

    base has the spans of the fixed patterns, secrets also those of high entropy; a span of high
    entropy inside a base span is left out, as it adds nothing. Both are in order of (start, kind).
    A null or empty text has no spans; columns of these names are replaced.
    """
    docs = docs.drop("base", "secrets")
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*(pattern_spans(whole, p, i) for i, p in enumerate(PATTERNS)))
    found = docs.withColumn("base", F.array_sort(base)).withColumn(
        "secrets", entropy_spans(whole, entropy, len(PATTERNS))
    )
    fresh = F.filter(
        F.col("secrets"),
        lambda s: ~F.exists(
            F.col("base"), lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])
        ),
    )
    return found.withColumn("secrets", F.array_sort(F.concat("base", fresh)))


def redact(docs: DataFrame, text: str = "text", notice: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by a notice; overlapping spans become one.

    Needs the column ``secrets`` of :func:`scan` and drops it and ``base``. Texts without
    secrets, null ones included, stay as they are.
    """
    out = F.aggregate(
        F.col("secrets"),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(
                s["start"] >= acc["at"],
                F.concat(
                    acc["text"],
                    F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]),
                    F.lit(notice),
                ),
            )
            .otherwise(acc["text"])
            .alias("text"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["text"], F.substring(F.col(text), acc["at"] + 1, F.lit(2**31 - 1))),
    )
    return docs.withColumn(text, F.when(F.size("secrets") > 0, out).otherwise(F.col(text))).drop(
        "base", "secrets"
    )


def digest(found: DataFrame) -> DataFrame:
    """Per document the counts of each kind, the hash of the base spans and the list of all."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(p.kind).alias(f"n_{p.kind}") for p in PATTERNS),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )

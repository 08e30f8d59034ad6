"""Metric trees: JSON objects of any depth ↔ one row per leaf."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from paceline.session import rounds


#: Levels that are opened before and after the first look at what is still closed.
FIRST, MORE = 6, 64


def is_object(node: Column) -> Column:
    """Whether a variant is an object; looks no deeper. Null if the variant is."""
    return F.when(
        node.isNotNull(), F.try_variant_get(node, F.lit("$"), "struct<>").isNotNull()
    )


def reject_reason(json_text: Column) -> Column:
    """Why a text cannot be flattened, null if it can. Every parser reads objects only.

    The JSON reader takes up to 1000 levels; a text that nests deeper is malformed.
    """
    node = F.try_parse_json(json_text)
    return (
        F.when(json_text.isNull(), "missing")
        .when(is_object(node), F.lit(None))
        .when(node.isNotNull() | ~json_text.rlike(r"^\s*\{"), "no object")
        .when(F.json_object_keys(json_text).isNotNull(), "duplicate key")
        .otherwise("malformed")
    )


def split_trees(rows: DataFrame, json_text: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is a JSON object, the others with a ``reason``)."""
    told = rows.withColumn("reason", reject_reason(F.col(json_text)))
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")


def flatten_tree(
    rows: DataFrame,
    json_text: str,
    keys: list[str],
    *,
    depth: int | None = None,
    empty_groups: bool = False,
) -> DataFrame:
    """JSON objects → (keys, path, name, value), one row per leaf.

    The path stays an array because names may contain dots. A JSON null stays null. With
    ``empty_groups`` an object without members gives a row with a null name. A bounded number of
    levels is opened at a time; what still holds objects after them is written and goes on from
    there, so no plan grows with the depth of a tree, and usual trees are opened in one pass. With
    ``depth``, as streams need it, that many levels are opened and nothing is written; what lies
    below them comes as the text of its object. Texts that are no objects give no rows:
    :func:`split_trees` tells them apart.
    """
    names = ["path", "name", "value", "_open"]
    start = rows.filter(F.col(json_text).rlike(r"^\s*\{")).select(
        *keys, F.array().cast("array<string>").alias("path"), F.try_parse_json(json_text).alias("_open")
    )
    if depth is not None:
        return _opened(start, keys, depth, empty_groups, last=True).select(*keys, *names[:3])
    found = rounds(
        _opened(start, keys, FIRST, empty_groups).select(*keys, *names),
        lambda closed: _opened(closed, keys, MORE, empty_groups).select(*keys, *names),
        F.col("_open").isNotNull(),
    )
    return found.drop("_open")


def _opened(
    level: DataFrame, keys: list[str], levels: int, empty_groups: bool, *, last: bool = False
) -> DataFrame:
    """(keys, path, name, value, _open): rows of (keys, path, _open) after so many levels.

    An object that is still closed keeps its whole path and has no name; the last levels give its text.
    """
    spark = level.sparkSession
    level = level.select(*keys, F.col("path").alias("_path"), F.col("_open").alias("_node"))
    for _ in range(levels):
        # The outer form hands a leaf on unchanged, with a null key. Members of a list
        # have a position but no key; the list as a whole is a leaf.
        opened = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("_node").outer()))
        has_child = F.col("key").isNotNull()
        opened = opened.filter(has_child | F.col("pos").isNull() | (F.col("pos") == 0))
        level = opened.select(
            *keys,
            F.when(has_child, F.concat("_path", F.array("key")))
            .otherwise(F.col("_path"))
            .alias("_path"),
            F.when(has_child, F.col("value")).otherwise(F.col("_node")).alias("_node"),
        )
    node = F.col("_node")
    members = F.try_variant_get(node, F.lit("$"), "map<string,variant>")
    is_empty = is_object(node) & (F.size(members) == 0)
    closed = F.lit(False) if last else is_object(node) & ~is_empty
    group, text = is_empty | closed, node.cast("string")
    level = level.filter(F.col("_node").isNotNull())
    if not empty_groups:
        level = level.filter(~is_empty)
    inner = F.slice("_path", F.lit(1), F.greatest(F.size("_path") - 1, F.lit(0)))
    return level.select(
        *keys,
        F.when(group, F.col("_path")).otherwise(inner).alias("path"),
        F.when(~group, F.try_element_at("_path", F.lit(-1))).alias("name"),
        F.when(~group, text).alias("value"),
        F.when(closed, F.col("_node")).alias("_open"),
    )


def split_clashes(leaves: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(leaves that can stand in one tree, metrics that cannot).

    A group wins over a metric of the same name, and of metrics that share path and name the
    greatest value does. A metric clashes exactly if the row after it, in order of full paths,
    begins with its own.
    """
    told = _told(leaves, keys).drop("_full", "_group")
    return told.filter("not _clash").drop("_clash"), told.filter("_clash").drop("_clash")


def _told(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves with their full path, whether they are a group only, and whether they clash.

    The number of tasks is named because adaptive execution merges tasks by compressed bytes, and
    leaves, whose names repeat from key to key, take a multiple of these in memory.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = F.when(F.col("name").isNull(), F.array()).otherwise(F.array("name"))
    rows = leaves.repartition(parts, *keys).withColumns(
        {"_full": F.concat("path", names.cast("array<string>")), "_group": F.col("name").isNull()}
    )
    after = F.lead("_full").over(_document_order(keys))
    clash = ~F.col("_group") & F.coalesce(
        F.slice(after, 1, F.size("_full")) == F.col("_full"), F.lit(False)
    )
    return rows.withColumn("_clash", clash)


def _document_order(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("_full", "_group", "value")


def _quoted(name: Column) -> Column:
    """A JSON string literal."""
    pair = F.to_json(F.create_map(F.lit("k"), F.coalesce(name, F.lit(""))))
    return F.regexp_replace(pair, r'^\{"k":|\}$', "")


def build_tree(leaves: DataFrame, keys: list[str], out: str = "tree") -> DataFrame:
    """(keys, path, name, value) → one JSON object per key, members in name order.

    A row with a null name only says that the group at ``path`` exists. Metrics that clash
    with a group or with each other are left out as :func:`split_clashes` says. Rows sorted by
    their full path are already in document order: each row only has to close the groups
    it leaves and open the groups it enters, which follows from the row before it, so the
    depth of the tree costs nothing. One sort serves the clashes and the text.
    """
    kept = _told(leaves, keys).filter("not _clash")
    inner = F.slice("_full", F.lit(1), F.greatest(F.size("_full") - 1, F.lit(0)))
    rows = kept.select(
        *keys,
        *["_full", "_group", "value"],
        F.when(F.col("_group"), F.col("_full")).otherwise(inner).alias("path"),
    )
    order = _document_order(keys)
    rows = rows.withColumns(
        {
            "_place": F.row_number().over(order),
            "_came": F.lag("path").over(order),
            "_came_empty": F.lag("_group").over(order),
        }
    )
    before = F.coalesce("_came", F.array().cast("array<string>"))
    differ = F.array_position(
        F.zip_with("path", before, lambda a, b: a.eqNullSafe(b)), F.lit(False)
    ).cast("int")
    shared = F.when(differ == 0, F.size("path")).otherwise(differ - 1)
    rows = rows.withColumn("_shared", shared).withColumns(
        {
            "_left": F.size(before) - F.col("_shared"),
            "_entered": F.slice("path", F.col("_shared") + 1, F.size("path") - F.col("_shared")),
        }
    )
    # No comma right after a brace: at the start, and inside a group opened by the row before.
    is_first = F.col("_came").isNull() | (F.col("_came_empty") & (F.col("_left") == 0))
    text = F.when(F.col("value").isNull(), F.lit("null")).otherwise(_quoted(F.col("value")))
    piece = F.concat(
        F.expr("repeat('}', _left)"),
        F.when(is_first, F.lit("")).otherwise(F.lit(",")),
        F.array_join(F.transform("_entered", lambda g: F.concat(_quoted(g), F.lit(":{"))), ""),
        F.when(F.col("_group"), F.lit("")).otherwise(
            F.concat(_quoted(F.try_element_at("_full", F.lit(-1))), F.lit(":"), text)
        ),
    )
    pieces = F.array_sort(F.collect_list(F.struct("_place", "_piece", F.size("path").alias("open"))))
    merged = rows.withColumn("_piece", piece).groupBy(*keys).agg(pieces.alias("_pieces"))
    return (
        merged.withColumns(
            {
                "_body": F.array_join(F.transform("_pieces", lambda p: p["_piece"]), ""),
                "_open": F.element_at("_pieces", -1)["open"],
            }
        )
        .withColumn(out, F.expr("concat('{', _body, repeat('}', _open), '}')"))
        .select(*keys, out)
    )

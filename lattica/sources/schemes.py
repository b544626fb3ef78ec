"""Class schemes as tables of nodes: node_id, parent_id, depth, code, name, path (codes from the root)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE = "node_id int, parent_id int, depth int, code string, name string, path array<string>"


def scheme_from_tree(spark: SparkSession, text: str) -> DataFrame:
    """Nodes of a JSON scheme, an object with ``tree`` or a bare list; a scheme is a small document."""
    whole = json.loads(text)
    tree = whole.get("tree") if isinstance(whole, dict) else whole
    if not isinstance(tree, list):
        raise ValueError("a scheme needs a tree")
    rows: list[tuple] = []
    todo = [(x, None, 0, []) for x in reversed(tree)]
    while todo:
        node, parent, depth, above = todo.pop()
        code, name = node.get("code") or "", node.get("name") or ""
        path = [*above, code]
        rows.append((len(rows), parent, depth, code, name, path))
        todo += [(x, rows[-1][0], depth + 1, path) for x in reversed(node.get("children") or [])]
    return spark.createDataFrame(rows, NODE)


def scheme_from_lines(lines: DataFrame, scheme: str | None = None) -> DataFrame:
    """Nodes of indented texts (line_no, value): four spaces or a tab a level, an optional code before the name.

    A node's parent is the last line before it that is less deep. ``scheme`` names a column
    that tells the lines of several texts apart.
    """
    keys = [scheme] if scheme else []
    text = F.replace("value", F.lit("\t"), F.lit("    "))
    content = F.trim(text)
    coded = r"(?i)^([a-z]\w*)\s+(.+)$"
    rows = lines.where(F.trim(text) != "").select(
        *keys,
        F.col("line_no").cast("int").alias("node_id"),
        F.floor((F.length(text) - F.length(F.ltrim(text))) / 4).cast("int").alias("level"),
        F.when(content.rlike(coded), F.lower(F.regexp_extract(content, coded, 1))).otherwise("").alias("code"),
        F.when(content.rlike(coded), F.regexp_extract(content, coded, 2)).otherwise(content).alias("name"),
    )
    before = F.collect_list(F.struct("node_id", "level")).over(Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1))
    held = rows.withColumn("before", before)  # a scheme has some hundreds of lines
    less = F.filter("before", lambda x: x["level"] < F.col("level"))
    return held.select(*keys, "node_id", F.try_element_at(less, F.lit(-1))["node_id"].alias("parent_id"), "level", "code", "name")


def with_paths(nodes: DataFrame, deepest: int, scheme: str | None = None) -> DataFrame:
    """Adds path: the codes from the root to the node, after the scheme's own name; ``deepest`` levels below the root at most."""
    keys = [scheme] if scheme else []
    up = nodes.select(*(F.col(k).alias("__" + k) for k in keys), F.col("node_id").alias("__id"), F.col("parent_id").alias("__up"), F.col("code").alias("__code"))
    out = nodes.withColumns({"path": F.array("code"), "__at": F.col("parent_id")})
    for _ in range(deepest):
        same = [F.col(k).eqNullSafe(F.col("__" + k)) for k in keys]
        joined = out.join(up, [F.col("__at") == F.col("__id"), *same], "left")
        above = F.when(F.col("__code").isNotNull(), F.concat(F.array("__code"), "path")).otherwise(F.col("path"))
        out = joined.select(*nodes.columns, above.alias("path"), F.col("__up").alias("__at"))
    return out.drop("__at") if not keys else out.withColumn("path", F.concat(F.array(*(F.col(k).cast("string") for k in keys)), "path")).drop("__at")


def filter_scheme(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose code or name holds a text in any case, and the nodes above them."""
    wanted = text.lower()
    hits = nodes.where(F.lower("code").contains(wanted) | F.lower("name").contains(wanted)) if wanted else nodes
    prefixes = hits.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("path")).distinct()
    return nodes.join(prefixes, "path", "left_semi")

"""Nested columns as values with definition and repetition levels, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lamella.schema.columns import ColumnTree
from lamella.schema.dsl import Node
from lamella.schema.sparktypes import to_struct_type


def _steps(tree: ColumnTree, path: str) -> tuple[list[Node], int, int]:
    leaf = tree.find(path)
    if leaf is None or not leaf.is_leaf:
        raise ValueError(f"{path} isn't a leaf")
    nodes, at = [], tree.schema.root
    for p in leaf.path:
        at = at.child(p)
        nodes.append(at)
    return nodes, leaf.max_definition, leaf.max_repetition


def shred(df: DataFrame, tree: ColumnTree, path: str, key: str) -> DataFrame:
    """key, seq (from 0 in the record), value, d and r of a leaf.

    Repeated ancestors are exploded one after another. d counts the optional and repeated steps that are there; r is the
    depth of the innermost repeated step whose position isn't 0. An absent or empty step leaves one null.
    """
    nodes, _, _ = _steps(tree, path)
    d, r = F.lit(0), F.lit(0)
    value: Column = F.col(f"`{nodes[0].name}`")
    out = df.select(F.col(key).alias("key"), value.alias("value"), d.alias("d"), r.alias("r"), F.lit(True).alias("there"))
    places: list[str] = []
    container = None  # what the next node is reached by: a field, or nothing inside a list or map
    for k, node in enumerate(nodes):
        if k and container == "field":
            out = out.withColumn("value", F.col("value").getField(node.name))
        kept = ["key", "d", "r", "there", *places]
        if node.repetition == "optional":
            here = F.col("there") & F.col("value").isNotNull()
            out = out.withColumn("d", F.col("d") + here.cast("int")).withColumn("there", here)
        if node.repetition == "repeated":
            name = f"p{len(places)}"
            inside = F.when(F.col("there"), F.col("value"))
            out = out.select(*kept, F.posexplode_outer(inside).alias(name, "value"))
            here = F.col("there") & F.col(name).isNotNull()
            deep = len(places) + 1
            out = out.withColumn("d", F.col("d") + here.cast("int")).withColumn("r", F.when(F.coalesce(F.col(name), F.lit(0)) > 0, F.lit(deep)).otherwise(F.col("r"))).withColumn("there", here)
            places.append(name)
        container = "field"
        if node.annotated("LIST"):
            container = "list"
        elif node.annotated("MAP", "MAP_KEY_VALUE"):
            out = out.withColumn("value", F.map_entries("value"))
            container = "list"
        elif node.repetition == "repeated" and k and nodes[k - 1].annotated("LIST"):
            container = "element"  # the one child is the element itself
    if places:
        seq = F.row_number().over(Window.partitionBy("key").orderBy(*[F.col(p).asc_nulls_first() for p in places])) - 1  # a record's own values
    else:
        seq = F.lit(0)
    return out.select("key", seq.cast("int").alias("seq"), "value", F.col("d").cast("int").alias("d"), F.col("r").cast("int").alias("r"))


def nulls_as_levels(df: DataFrame, column: str, key: str) -> DataFrame:
    """The levels of an optional leaf at the top: d is 1 where there is a value."""
    return df.select(F.col(key).alias("key"), F.col(column).alias("value"), F.col(column).isNotNull().cast("int").alias("d"), F.lit(0).alias("r"))


def assemble_list(shredded: DataFrame, max_definition: int) -> DataFrame:
    """key and value, an array, from the levels of one repeated leaf (a list of optional or required elements). A record
    whose only level says that the list is absent has null, one whose list is empty an empty array.

    max_definition counts the list's own optional step, the repeated one and the element's."""
    items = F.sort_array(F.collect_list(F.struct("seq", F.col("d").alias("d"), F.col("value").alias("value"))))
    grouped = shredded.groupBy("key").agg(items.alias("items"), F.max("d").alias("top"))
    present = F.filter("items", lambda x: x["d"] >= F.lit(max_definition - 1 if max_definition > 2 else max_definition))
    empty = 1 if max_definition >= 2 else 0
    return grouped.select("key", F.when(F.col("top") >= F.lit(empty), F.transform(present, lambda x: x["value"])).alias("value"))


def assemble(leaves: dict[str, DataFrame], tree: ColumnTree) -> DataFrame:
    """key and the top-level columns of the records whose leaves were shredded: the inverse of shred.

    The levels of a record come together by its key; a small automaton then rebuilds it, in batches.
    """
    paths = list(leaves)
    joined = None
    for k, p in enumerate(paths):
        side = leaves[p].groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "d", "r", "value"))).alias(f"l{k}"))
        joined = side if joined is None else joined.join(side, "key", "full")
    chains = [_steps(tree, p)[0] for p in paths]
    struct = to_struct_type(tree.schema)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in struct.fields)
    key_type = joined.schema["key"].dataType
    kinds = [to_arrow_type(f.dataType) for f in struct.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records: list[dict] = [{} for _ in range(batch.num_rows)]
            for k, chain in enumerate(chains):
                for record, levels in zip(records, batch[f"l{k}"].to_pylist()):
                    _rebuild(record, chain, levels or [])
            tops = [pa.array([_shape(c, r.get(c.name), c.repetition == "repeated") for r in records], t) for c, t in zip(tree.schema.root.children, kinds)]
            yield pa.RecordBatch.from_arrays([batch["key"], *tops], names=["key", *[f.name for f in struct.fields]])

    return joined.mapInArrow(run, f"key {key_type.simpleString()}, {fields}")


def _rebuild(record: dict, chain: list[Node], levels: list[dict]) -> None:
    """Adds the values of a leaf to a record. A value of repetition level r begins the next item of the r-th repeated step
    and the first of all deeper ones; steps that its definition level doesn't reach stay absent."""
    item = [0] * (sum(n.repetition == "repeated" for n in chain) + 1)
    for x in levels:
        if x["r"]:
            item[x["r"]] += 1
        item[x["r"] + 1 :] = [0] * (len(item) - x["r"] - 1)
        at, depth, level = record, 0, 0
        for k, node in enumerate(chain):
            level += node.repetition != "required"
            many = node.repetition == "repeated"
            if x["d"] < level:
                at.setdefault(node.name, [] if many else None)
                break
            if many:
                depth += 1
                items = at.setdefault(node.name, [])
                items.extend({} for _ in range(item[depth] + 1 - len(items)))
                if k == len(chain) - 1:
                    items[item[depth]] = x["value"]
                else:
                    at = items[item[depth]]
            elif k == len(chain) - 1:
                at[node.name] = x["value"]
            else:
                at = at.setdefault(node.name, {})


def _shape(node: Node, v: object, many: bool) -> object:
    if many:
        return [_shape(node, x, False) for x in v or []]
    if v is None or not node.is_group:
        return v
    if node.annotated("LIST"):
        middle = node.children[0]
        items = v.get(middle.name) or []
        if middle.is_group and len(middle.children) == 1:
            return [_shape(middle.children[0], x.get(middle.children[0].name), False) for x in items]
        return [_shape(middle, x, False) for x in items]
    if node.annotated("MAP", "MAP_KEY_VALUE"):
        key, value = node.children[0].children
        return [(x.get(key.name), _shape(value, x.get(value.name), False)) for x in v.get(node.children[0].name) or []]
    return {c.name: _shape(c, v.get(c.name), c.repetition == "repeated") for c in node.children}

"""Strict shapes of JSON documents.

A shape is a small tree: for each path its JSON types, known keys, bounds of lists, texts and numbers, choices and
patterns.  ``shape_issues`` walks the documents level by level with ``variant_explode`` and checks every node where it is;
nothing is shuffled, and the result is one row per fault: ``keys…, path, kind``.  Kinds are ``type``, ``unknown``,
``missing``, ``length``, ``range``, ``choice`` and ``pattern``.  The path of an unknown key is that of its object, so the
key itself, which may hold anything, is never repeated.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from threadspark.functions.text import trim


@dataclass(frozen=True)
class Shape:
    kinds: tuple[str, ...]
    fields: dict[str, Shape] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    strict: bool = True
    item: Shape | None = None
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] | None = None
    pattern: str | None = None
    bare: bool = False

    def or_null(self) -> Shape:
        return replace(self, kinds=(*self.kinds, "null"))


def text(most: int | None = None, least: int = 0, pattern: str | None = None, choices: tuple[str, ...] | None = None, bare: bool = False) -> Shape:
    """Lengths, choices and patterns hold for the trimmed text, or if ``bare`` for the text as it is."""
    return Shape(("string",), least=least, most=most, pattern=pattern, choices=choices, bare=bare)


def number(least: float | None = None, most: float | None = None, whole: bool = False) -> Shape:
    return Shape(("integer",) if whole else ("integer", "number"), least=least, most=most)


def listed(item: Shape, most: int | None = None, least: int = 0) -> Shape:
    return Shape(("array",), item=item, least=least, most=most)


def record(fields: dict[str, Shape], optional: tuple[str, ...] = (), strict: bool = True) -> Shape:
    return Shape(("object",), fields=fields, required=tuple(name for name in fields if name not in optional), strict=strict)


def _levels(shape: Shape) -> list[dict[str, Shape]]:
    """Shapes by path, one dictionary per depth."""
    levels, level = [], {"": shape}
    while level:
        levels.append(level)
        below = {f"{path}.{name}": one for path, own in level.items() for name, one in own.fields.items()}
        below |= {f"{path}[]": own.item for path, own in level.items() if own.item is not None}
        level = below
    return levels


def _kind(node: Column) -> Column:
    name = F.schema_of_variant(node)
    value = F.try_variant_get(node, "$", "double")
    whole = (value == F.floor(value)) & (F.abs(value) <= 9007199254740991)
    return (
        F.when(F.is_variant_null(node), "null").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(whole, "integer").otherwise("number")
    )


def _faults(shape: Shape, kind: Column, node: Column) -> Column:
    """Kinds of fault of a node of this shape; a wrong type is the only fault told of a node."""
    found: list[Column] = []

    def fault(when: Column, name: str) -> None:
        found.append(F.when(F.coalesce(when, F.lit(False)), F.lit(name)))

    def bounds(size: Column, name: str) -> None:
        if shape.least or shape.most is not None:
            low = size < shape.least if shape.least else F.lit(False)
            fault(low | (size > shape.most) if shape.most is not None else low, name)

    if "array" in shape.kinds:
        bounds(F.when(kind == "array", F.size(F.try_variant_get(node, "$", "array<variant>"))), "length")
    if "string" in shape.kinds:
        value = F.when(kind == "string", F.try_variant_get(node, "$", "string"))
        value = value if shape.bare else trim(value)
        bounds(F.length(value), "length")
        if shape.choices is not None:
            fault(~value.isin(*shape.choices), "choice")
        if shape.pattern is not None:
            fault(~value.rlike(shape.pattern), "pattern")
    if "integer" in shape.kinds and (shape.least is not None or shape.most is not None):
        value = F.when(kind.isin("integer", "number"), F.try_variant_get(node, "$", "double"))
        fault((value < shape.least if shape.least is not None else F.lit(False)) | (value > shape.most if shape.most is not None else F.lit(False)), "range")
    if "object" in shape.kinds:
        names = F.when(kind == "object", F.map_keys(F.try_variant_get(node, "$", "map<string,variant>")))
        if shape.required:
            fault(F.size(F.array_except(F.array(*map(F.lit, shape.required)), names)) > 0, "missing")
        if shape.strict:
            known = F.array(*map(F.lit, shape.fields)) if shape.fields else F.array().cast("array<string>")
            fault(F.size(F.array_except(names, known)) > 0, "unknown")
    rest = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return F.when(~kind.isin(*shape.kinds), F.array(F.lit("type"))).otherwise(rest)


def shape_issues(documents: DataFrame, keys: list[str], value: Column, shape: Shape) -> DataFrame:
    """``keys…, path, kind``: a row per fault of the variant ``value``; null values have none.

    One walk: at each depth a node gives way to its faults and its children, and the faults found so far pass by.
    """
    # exploded, so that a document is parsed once and not in every check
    rows = documents.select(*keys, F.lit("").alias("_path"), F.lit("").alias("_at"), F.explode(F.array(value)).alias("_node"), F.lit(None).cast("string").alias("_fault"))
    rows, levels = rows.filter(F.col("_node").isNotNull()), _levels(shape)
    no_node = F.lit(None).cast("variant")

    def row(path, at, node, fault):
        return F.struct(path.alias("_path"), at.alias("_at"), node.alias("_node"), fault.cast("string").alias("_fault"))

    def step(parent, below, node):
        return row(F.concat("_path", parent), F.concat("_at", below), node, F.lit(None))

    for depth, shapes in enumerate(levels):
        active = F.col("_fault").isNull()
        rows = rows.withColumn("_kind", F.when(active, _kind(F.col("_node"))))
        faults = F.array().cast("array<string>")
        for path, own in shapes.items():
            faults = F.when(F.col("_path") == path, _faults(own, F.col("_kind"), F.col("_node"))).otherwise(faults)
        parts = [F.transform(faults, lambda fault: row(F.col("_path"), F.col("_at"), no_node, fault))]
        following = levels[depth + 1] if depth + 1 < len(levels) else {}
        records = [path for path, own in shapes.items() if own.fields]
        arrays = [path for path, own in shapes.items() if own.item is not None]
        none = F.array().cast("array<struct<_path:string,_at:string,_node:variant,_fault:string>>")
        if records:
            entries = F.map_entries(F.try_variant_get("_node", "$", "map<string,variant>"))
            known = F.filter(entries, lambda e: F.concat("_path", F.lit("."), e["key"]).isin(*following))
            inside = F.transform(known, lambda e: step(F.concat(F.lit("."), e["key"]), F.concat(F.lit("."), e["key"]), e["value"]))
            parts.append(F.when((F.col("_kind") == "object") & F.col("_path").isin(*records), inside).otherwise(none))
        if arrays:
            items = F.try_variant_get("_node", "$", "array<variant>")
            inside = F.transform(items, lambda v, i: step(F.lit("[]"), F.concat(F.lit("["), i, F.lit("]")), v))
            parts.append(F.when((F.col("_kind") == "array") & F.col("_path").isin(*arrays), inside).otherwise(none))
        told = F.array(row(F.col("_path"), F.col("_at"), no_node, F.col("_fault")))
        after = F.when(active, F.concat(*parts)).otherwise(told)
        rows = rows.select(*keys, F.explode(after).alias("_next")).select(*keys, "_next.*")
    return rows.select(*keys, F.regexp_replace("_at", r"^\.", "").alias("path"), F.col("_fault").alias("kind"))


def gathered_issues(issues: DataFrame, keys: list[str], name: str = "issues") -> DataFrame:
    """``keys…, issues``: ``path(kind)`` in order; a document's faults are bounded by the document."""
    one = F.concat("path", F.lit("("), "kind", F.lit(")"))
    return issues.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias(name))

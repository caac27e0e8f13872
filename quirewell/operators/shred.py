"""Relational shredding of nested records by shared inlining.

Nested records (JSON in a string column) become flat tables with
parent-child links:

1. ``analyse`` scans the records once and returns the *schema graph*: the
   elements that occur, the edges between them and how often a child stands
   below one parent. Only the graph (its size is that of the schema, not of
   the data) reaches the driver.
2. ``plan_tables`` applies shared inlining: an element gets a table of its
   own if it is the root of a delivery, repeated, shared by several parents
   or recursive; every other (singleton) element is inlined into the nearest
   ancestor that has a table, its scalars becoming prefixed columns.
3. ``shred`` walks every record and emits one row per table element with its
   key, the key and table of its parent (the foreign key), its role, its
   position below the parent and the inlined columns.

The walk itself is Python behind Arrow batches: recursion of any depth and
JSON encoded inside JSON strings can't be expressed with built-in functions.

Defined results for odd input: null, empty, or incomplete payloads give no
rows; an empty list gives no rows; null list entries keep their position but
give no row; a lone value in place of a list has position 0; repeated records
are kept apart by their record key; extra columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

ROOT = "$"
EDGE_DDL = "parent string, child string, objects long, arrays long, scalars long, encoded long, most long"
ROW_DDL = (
    "record_key string, table_name string, row_id string, parent_table string, parent_id string, role string, "
    "position long, parent_position long, inherited map<string,string>, columns map<string,string>"
)


@dataclass(frozen=True)
class Naming:
    """How field names map to elements.

    ``elements`` maps a field (or ``parent.field``) to the element it stands
    for; other fields keep their name in snake case. ``roles`` names the role
    a child plays below its parent. ``signatures`` recognises an element by
    a field that only it has, wherever the object stands. ``inherit`` lists,
    per element, the scalar that its descendants repeat as a natural key.
    ``tables`` are elements that get a table even where the records at hand
    hold but one of them each.
    """

    elements: dict[str, str] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)
    signatures: dict[str, str] = field(default_factory=dict)
    inherit: dict[str, str] = field(default_factory=dict)
    tables: tuple[str, ...] = ()

    def element(self, parent: str, name: str) -> str:
        return self.elements.get(f"{parent}.{name}") or self.elements.get(name) or snake(name)

    def role(self, parent: str, name: str, above: str | None) -> str | None:
        return self.roles.get(f"{parent}.{name}") or self.roles.get(name) or above

    def sign(self, value: dict, otherwise: str) -> str:
        for key, element in self.signatures.items():
            if key in value:
                return element
        return otherwise


@dataclass(frozen=True)
class TablePlan:
    """The outcome of the analysis: which elements are tables, which strings hold JSON."""

    tables: frozenset[str]
    encoded: frozenset[str]
    reasons: dict[str, str]


@functools.lru_cache(1 << 16)
def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1], name).lower()


def _refuse(token: str):
    raise ValueError(token)


def parse(text: str | None):
    """The parsed payload, or None if it is null, empty or no complete JSON."""
    if not text or text.isspace():
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def _decoded(value):
    if isinstance(value, str) and value[:1] in "[{":
        inner = parse(value)
        if isinstance(inner, (dict, list)):
            return inner
    return None


def _edges(value, element: str, naming: Naming, out: dict) -> None:
    """Adds the edges below ``value`` to ``out``: (parent, child) -> [objects, arrays, scalars, encoded, most]."""
    stack = [(value, element, ROOT)]
    while stack:
        value, element, parent = stack.pop()
        items = value if isinstance(value, list) else [value]
        kinds = [naming.sign(x, element) if isinstance(x, dict) else element for x in items]
        each: dict[str, int] = {}
        for kind in kinds or [element]:
            each[kind] = each.get(kind, 0) + 1
        for kind, n in each.items():  # a list may mix kinds: an edge for each
            counts = out.setdefault((parent, kind), [0, 0, 0, 0, 0])
            counts[1] += isinstance(value, list)
            counts[4] = max(counts[4], n if kinds else 0)
        for x, kind in zip(items, kinds):
            if isinstance(x, dict):
                out[(parent, kind)][0] += 1
                for k, y in x.items():
                    if y is None:
                        continue
                    child = naming.element(kind, k)
                    if isinstance(y, (dict, list)) or isinstance(y, str) and y[:1] in ("[", "{"):
                        stack.append((y, child, kind))
                    else:  # a plain value: counted where it stands
                        counts = out.setdefault((kind, child), [0, 0, 0, 0, 0])
                        counts[2] += 1
                        counts[4] = max(counts[4], 1)
            elif isinstance(x, list):
                stack.append((x, kind, parent))
            elif x is not None:
                inner = _decoded(x)
                out[(parent, kind)][2 if inner is None else 3] += 1
                if inner is not None:
                    stack.append((inner, kind, parent))


def analyse(df: DataFrame, payload: str, naming: Naming) -> dict[tuple[str, str], dict[str, int]]:
    """The schema graph of the records: edge -> how its child occurs. One pass, partial aggregation per partition."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict = {}
        for batch in batches:
            for text in batch["payload"]:
                if (value := parse(text)) is not None:
                    _edges(value, ROOT, naming, out)
        yield pd.DataFrame([[*k, *v] for k, v in out.items()], columns=[x.split()[0] for x in EDGE_DDL.split(", ")])

    sums = [F.sum(c).alias(c) for c in ("objects", "arrays", "scalars", "encoded")]
    rows = df.select(F.col(payload).alias("payload")).mapInPandas(scan, EDGE_DDL).groupBy("parent", "child").agg(*sums, F.max("most").alias("most")).collect()
    return {(r.parent, r.child): r.asDict() for r in rows}


def plan_tables(graph: dict[tuple[str, str], dict[str, int]], always: tuple[str, ...] = ()) -> TablePlan:
    """Shared inlining: tables for root, repeated, shared and recursive elements; all others are inlined."""
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    complex_, reasons, encoded = set(), {}, set()
    for (parent, child), x in graph.items():
        parents.setdefault(child, set()).add(parent)
        children.setdefault(parent, set()).add(child)
        if x["objects"] or x["encoded"]:
            complex_.add(child)
        if x["encoded"] and not x["scalars"]:
            encoded.add(child)

    def reaches(a: str, b: str) -> bool:
        seen, todo = set(), list(children.get(a, ()))
        while todo:
            if (c := todo.pop()) == b:
                return True
            if c not in seen:
                seen.add(c)
                todo.extend(children.get(c, ()))
        return False

    for (parent, child), x in sorted(graph.items()):
        if child == ROOT:
            continue
        if x["arrays"] or x["most"] > 1:
            reasons.setdefault(child, "repeated")
        elif child in complex_ and len(parents[child] - {ROOT}) > 1:
            reasons.setdefault(child, "shared")
        elif child in complex_ and reaches(child, child):
            reasons.setdefault(child, "recursive")
    for child in children.get(ROOT, ()):
        if child in complex_ and child != ROOT:
            reasons.setdefault(child, "root")
    for child in always:
        reasons.setdefault(child, "named")
    return TablePlan(frozenset(reasons), frozenset(encoded), reasons)


def _walk(key: str, value, naming: Naming, plan: TablePlan, out: list) -> None:
    """Appends the rows of one record. An explicit stack: nesting depth isn't bounded by Python's."""
    #: value, element, parent table, parent id, parent position, role, inherited keys, columns of the nearest table, prefix, id stem
    stack = [(value, ROOT, None, None, None, None, {}, None, "", key)]
    number: dict[str, int] = {}
    while stack:
        value, element, ptable, pid, ppos, role, inherited, columns, prefix, stem = stack.pop()
        if element in plan.encoded and (inner := _decoded(value)) is not None:
            value = inner
        items = value if isinstance(value, list) else [value]
        for position, x in enumerate(items):
            if x is None:
                continue
            kind = naming.sign(x, element) if isinstance(x, dict) else element
            if isinstance(x, list):
                stack.append((x, kind, ptable, pid, ppos, role, inherited, columns, prefix, f"{stem}.{position}"))
                continue
            table, name = kind in plan.tables, prefix
            below_table, below_id, below_pos, below, cols = ptable, pid, ppos, inherited, columns
            if table:
                base = f"{stem}/{kind}{'' if role is None else ':' + role}{position}"
                n = number[base] = number.get(base, -1) + 1
                below_table, below_id, below_pos, cols, name = kind, base if not n else f"{base}~{n}", position, {}, ""
                out.append((key, kind, below_id, ptable, pid, role, position, ppos, inherited, cols))
            if not isinstance(x, dict):
                if cols is not None:
                    cols[name.rstrip("_") or "value"] = x if isinstance(x, str) else json.dumps(x)
                continue
            if (natural := naming.inherit.get(kind)) and isinstance(x.get(natural), (str, int)):
                below = inherited | {natural: str(x[natural])}
            for k, y in reversed(x.items()):
                child = naming.element(kind, k)
                if isinstance(y, (dict, list)) or child in plan.tables or child in plan.encoded:
                    inner = f"{name}{child}_" if child not in plan.tables else ""
                    stack.append((y, child, below_table, below_id, below_pos, naming.role(kind, k, role), below, cols, inner, below_id if table else stem))
                elif y is not None and cols is not None:
                    cols[name + child] = y if isinstance(y, str) else json.dumps(y)


def shred(df: DataFrame, key: str, payload: str, naming: Naming, plan: TablePlan | None = None) -> DataFrame:
    """All rows of all tables (``table_name`` tells which); ``as_table`` picks one.

    ``plan`` may be given when the schema graph is known; otherwise the records
    are analysed first.
    """
    plan = plan or plan_tables(analyse(df, payload, naming), naming.tables)
    names = [x.split()[0] for x in ROW_DDL.replace("map<string,string>", "map").split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list = []
            for k, text in zip(batch["k"], batch["payload"]):
                if (value := parse(text)) is not None:
                    _walk(k, value, naming, plan, out)
            yield pd.DataFrame(out, columns=names)

    return df.select(F.col(key).cast("string").alias("k"), F.col(payload).alias("payload")).mapInPandas(walk, ROW_DDL)


def as_table(rows: DataFrame, name: str, columns: list[str], inherited: list[str] = ()) -> DataFrame:
    """One flat table out of the rows: keys, foreign key, the named inlined columns."""
    picked = [F.col("columns")[c].alias(c) for c in columns]
    above = [F.col("inherited")[c].alias(f"parent_{c}") for c in inherited]
    return rows.where(F.col("table_name") == name).select("record_key", "row_id", "parent_table", "parent_id", "role", "position", "parent_position", *above, *picked)


def typed_tables(df: DataFrame, row_id: str, root: str, names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Shared inlining of nested *columns*: their types are the schema graph, so no scan is needed and all of it stays in the JVM.

    Structs are inlined (prefixed columns), every array becomes a table: row_id,
    parent_id, position and the columns of its elements (``value`` for plain
    ones). ``names`` names the tables of arrays, by field. Null arrays give no
    rows; null elements keep their position but give none.
    """
    names = names or {}
    out: dict[str, DataFrame] = {}

    def inline(kind: DataType, value: Column, prefix: str, flat: list, arrays: list) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                inline(f.dataType, value[f.name], f"{prefix}_{f.name}" if prefix else f.name, flat, arrays)
        elif isinstance(kind, ArrayType):
            arrays.append((names.get(prefix, prefix), kind.elementType, value))
        else:
            flat.append(value.alias(prefix or "value"))

    def visit(name: str, frame: DataFrame, keys: list[str], kind: DataType) -> None:
        flat: list = []
        arrays: list = []
        inline(kind, F.col("_v"), "", flat, arrays)
        out[name] = frame.select(*keys, *flat)
        for child, element, value in arrays:
            t = frame.select(F.col("row_id").alias("parent_id"), F.posexplode(value).alias("position", "_v")).where(F.col("_v").isNotNull())
            visit(child, t.withColumn("row_id", F.concat("parent_id", F.lit(f"/{child}"), "position")), ["row_id", "parent_id", "position"], element)

    whole = F.struct(*[F.col(c) for c in df.columns if c != row_id])
    rows = df.select(F.col(row_id).alias("row_id"), whole.alias("_v"))
    visit(root, rows, ["row_id"], rows.schema["_v"].dataType)
    return out

"""Deeply nested records as related flat tables (problem 3).

1. *Read.*  Array fields that hold JSON text, a single object or mixed elements
   are brought to one form: an array of objects, with null for what is none.
2. *Infer.*  The array levels that occur anywhere are merged into one schema
   (its size follows the schema, not the data; that is all the driver sees).
3. *Explode.*  With that schema every array level is exploded into child rows
   that carry the parent's key and their ordinal.

The schema has ``LEVELS`` array levels.  Records nested deeper are flattened below
that while they are read, so plans stay bounded and no depth is too deep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridrome.functions.deepjson import dumps, loads

#: Fields that hold child records.
ARRAYS = ("violations", "evidence", "spans", "related", "reviews", "comments", "replies")
#: Array levels that one expression unrolls.
LEVELS = 6
NODE = "table_name string, record_id string, node_path string, parent_path string, level string, ordinal int, attributes string"
#: Where a record in the unified form keeps its own attributes, and the rows of all records below the last level.
OWN, BELOW = "@", "~"


def _held(v):
    """What a value in place of an array holds: a list of elements, or none."""
    while isinstance(v, str):
        try:
            v = loads(v)
        except ValueError:
            return None
    return [v] if isinstance(v, dict) else v if isinstance(v, list) else None


def _parts(x: dict) -> tuple[dict, dict[str, list]]:
    """A record's own attributes, and its child arrays by the path of field names to them."""
    own, kids = {}, {}
    todo = [("", x)]
    while todo:
        prefix, part = todo.pop()
        for k, v in part.items():
            if k in ARRAYS:
                held = _held(v)
                if held is not None:
                    kids[prefix + k] = held
                    continue
            if prefix == "":
                own[k] = v
            if isinstance(v, dict) and k not in ARRAYS:
                todo.append((f"{prefix}{k}.", v))
    return own, kids


def _flat(x: dict) -> tuple[dict, list[dict]]:
    """A record's own attributes, and rows for all records below it, with paths from it."""
    own, kids = _parts(x)
    rows, todo = [], [("", kids)]
    while todo:
        path, kids = todo.pop()
        for f, elements in kids.items():
            for i, e in enumerate(elements, 1):
                if isinstance(e, dict):
                    mine, below = _parts(e)
                    at = f"{path}.{f}[{i}]"
                    rows.append({"p": at, "q": path, "l": f.rpartition(".")[2], "o": i, "a": dumps(mine)})
                    todo.append((at, below))
    return own, rows


def _node(x, level: int):
    """A child record in the unified form, or null for what is none."""
    if not isinstance(x, dict):
        return None
    if level == LEVELS:
        own, rows = _flat(x)
        return {OWN: dumps(own)} | ({BELOW: rows} if rows else {})
    own, kids = _parts(x)
    return {OWN: dumps(own)} | {k: [_node(e, level + 1) for e in v] for k, v in kids.items()}


def elements(text: str | None, native: bool = False) -> list | None:
    """The elements of a root field; null if it holds no array.

    Null, empty and unreadable texts, and plain values, hold none.
    """
    kids = _held(text) if isinstance(text, str) else None
    if kids and native:  # struct elements whose field ``context`` may hold JSON with child records
        for e in kids:
            if isinstance(e, dict) and isinstance(e.get("context"), str):
                inner = e["context"]
                while isinstance(inner, str):
                    try:
                        inner = loads(inner)
                    except ValueError:
                        inner = None
                if isinstance(inner, dict):
                    e.update({k: v for k, v in inner.items() if k in ARRAYS})
    return kids


def unify(text: str | None, native: bool = False) -> str | None:
    """The unified JSON array of a root field; null if it holds no record."""
    kids = elements(text, native)
    return None if kids is None else dumps([_node(e, 1) for e in kids])


@F.pandas_udf(T.StringType())
def _unified(raw: pd.Series, native: pd.Series) -> pd.Series:
    return pd.Series([unify(t, n) for t, n in zip(raw, native)], dtype=object)


def roots(df: DataFrame, table_name: str, key: str, fields: dict[str, Column], native: tuple[str, ...] = ()) -> DataFrame:
    """Root fields as they are stored: (table_name, record_id, root, raw, native).

    ``fields`` maps a root's name to a text column, or for a name in ``native``
    to an array of structs.  Null and blank fields give no row.
    """
    picked = []
    for name, c in fields.items():
        text = F.to_json(c, {"ignoreNullFields": "false"}) if name in native else c
        picked.append(F.struct(F.lit(name).alias("root"), text.alias("raw"), F.lit(name in native).alias("native")))
    long = df.select(F.lit(table_name).alias("table_name"), F.col(key).alias("record_id"), F.explode(F.array(*picked)).alias("f")).select("table_name", "record_id", "f.*")
    return long.where(F.col("raw").isNotNull() & (F.trim("raw") != ""))


def _levels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[str] = set()
    for pdf in frames:
        fresh: set[str] = set()
        for root, raw, native in zip(pdf["root"], pdf["raw"], pdf["native"]):
            todo = [(root, 1, x) for x in elements(raw, native) or () if isinstance(x, dict)]
            while todo:
                path, level, x = todo.pop()
                fresh.add(path)
                kids = _parts(x)[1]
                if level == LEVELS:
                    if kids:
                        fresh.add(f"{path}/{BELOW}")
                    continue
                for k, v in kids.items():
                    todo += [(f"{path}/{k}", level + 1, e) for e in v if isinstance(e, dict)]
        fresh -= seen
        seen |= fresh
        if fresh:
            yield pd.DataFrame({"path": sorted(fresh)})


def merged_schema(docs: DataFrame) -> list[str]:
    """Every array level that holds a record, such as ``violations/evidence/spans``.

    One job; the result is the size of the schema.
    """
    return sorted(r.path for r in docs.select("root", "raw", "native").mapInPandas(_levels, "path string").distinct().collect())


FLAT = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n == "o" else T.StringType()) for n in ("p", "q", "l", "o", "a")]))
ROWS = "array<struct<node_path:string,parent_path:string,level:string,ordinal:int,attributes:string>>"


def _type(paths: set[str], at: str) -> T.ArrayType:
    fields = [T.StructField(OWN, T.StringType())]
    for p in sorted(paths):
        name = p[len(at) + 1 :]
        if p.startswith(f"{at}/") and "/" not in name:
            fields.append(T.StructField(name, FLAT if name == BELOW else _type(paths, p)))
    return T.ArrayType(T.StructType(fields))


def _row(path: Column, parent: Column, level: Column, ordinal: Column, attributes: Column) -> Column:
    return F.struct(path.alias("node_path"), parent.alias("parent_path"), level.alias("level"), ordinal.cast("int").alias("ordinal"), attributes.alias("attributes"))


def _explode(arr: Column, kind: T.ArrayType, at: str, base: Column, parent: Column) -> Column:
    """The rows of one array level (``at`` in the merged schema) and of all below it, as an array of structs."""

    def element(x: Column, i: Column) -> Column:
        path = F.concat(base, F.lit("["), (i + 1).cast("string"), F.lit("]"))
        parts = [F.array(_row(path, parent, F.lit(at.rpartition("/")[2].rpartition(".")[2]), i + 1, x[OWN]))]
        for f in kind.elementType.fields:
            child = x.getField(f.name)
            if f.name == BELOW:
                rows = F.transform(child, lambda r: _row(F.concat(path, r["p"]), F.concat(path, r["q"]), r["l"], r["o"], r["a"]))
                parts.append(F.coalesce(rows, F.array().cast(ROWS)))
            elif f.name != OWN:
                parts.append(_explode(child, f.dataType, f"{at}/{f.name}", F.concat(path, F.lit(f".{f.name}")), path))
        return F.when(x.isNotNull(), F.concat(*parts)).otherwise(F.array().cast(ROWS))

    return F.coalesce(F.flatten(F.transform(arr, element)), F.array().cast(ROWS))


def explode_levels(docs: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """All child records of :func:`roots`, one row each, in the columns of ``NODE``.

    ``paths`` is the merged schema (inferred if not given).  ``parent_path`` is
    null for elements of a root.  Elements that are no object keep their ordinal
    but give no row; empty objects give one.  Repeated deliveries of a record
    give equal rows, which are unified.
    """
    paths = merged_schema(docs) if paths is None else paths
    if not paths:
        return docs.sparkSession.createDataFrame([], NODE)
    read = docs.select("table_name", "record_id", "root", _unified("raw", "native").alias("doc")).where(F.col("doc").isNotNull())
    rows = F.array().cast(ROWS)
    for root in sorted({p.split("/")[0] for p in paths}):
        kind = _type(set(paths), root)
        rows = F.when(F.col("root") == root, _explode(F.from_json("doc", kind), kind, root, F.col("root"), F.lit(None).cast("string"))).otherwise(rows)
    made = read.select("table_name", "record_id", F.explode(rows).alias("r"))
    return made.select("table_name", "record_id", "r.*").distinct()


def level_table(nodes: DataFrame, level: str, columns: dict[str, str], attributes: bool = False) -> DataFrame:
    """One flat table of a level: keys, parent link, ordinal and typed columns.

    ``columns`` maps attribute names to SQL types; an attribute that is absent
    or of another type is null.  With ``attributes`` their JSON text stays beside them.
    """
    typed = [F.get_json_object("attributes", f"$.{k}").try_cast(t).alias(k) for k, t in columns.items()]
    return nodes.where(F.col("level") == level).select("table_name", "record_id", "node_path", "parent_path", "ordinal", *typed, *(["attributes"] if attributes else []))


def compliance_roots(audit: DataFrame, events: DataFrame) -> DataFrame:
    """The roots of audit entries and compliance events."""
    a = roots(audit, "audit_entries", "entry_id", {"violations": F.col("violations"), "reviews": F.element_at("metadata", F.lit("reviews"))}, native=("violations",))
    return a.unionByName(roots(events, "compliance_events", "id", {"violations": F.col("violations")}))

"""View definitions: declarative JSON that flattens documents into rows, compiled to one DataFrame plan.

An iteration is a generator over a collection and its columns are plain expressions after it; sibling iterations follow one
another, which multiplies their rows. A union, and a whole view whose rows are numbered inside the document, is an
expression for the rows of one context, an array of structs, with one generator at the end. Recursion loops over levels
with `aggregate`. So a view needs no join and no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import EngineError
from docloom.functions.paths import Scope, Temporal, Value, bound, evaluate, parse

MAX_DEPTH = 64
#: Columns that the engine adds to a materialised view (fixed values).
RESERVED = ("practice_id", "row_index", "version_id", "last_updated")
#: Spark types of declared column types; every other type is canonical JSON text (fixed values).
TYPES = {"boolean": T.BooleanType(), "integer": T.IntegerType(), "positiveInt": T.IntegerType(), "unsignedInt": T.IntegerType()}
TEXT_TYPES = ("decimal", "date", "dateTime", "instant", "time", "id", "string", "code", "uri", "url", "canonical", "oid", "uuid", "markdown", "base64Binary")
CONSTANT_KINDS = ("Base64Binary", "Boolean", "Canonical", "Code", "Date", "DateTime", "Decimal", "Id", "Instant", "Integer", "Oid", "PositiveInt", "String", "Time", "UnsignedInt", "Uri", "Url", "Uuid")
#: Constants of these kinds are compared as dates and times (fixed values).
TEMPORAL_KINDS = ("Date", "DateTime", "Instant", "Time")


@dataclass(frozen=True)
class ViewColumn:
    name: str
    path: str
    type: str | None = None
    collection: bool = False

    @property
    def spark_type(self) -> T.DataType:
        return T.StringType() if self.collection else TYPES.get(self.type or "", T.StringType())

    @property
    def as_json(self) -> bool:
        return self.collection or (self.type not in TYPES and self.type not in TEXT_TYPES)


@dataclass(frozen=True)
class View:
    definition: dict
    resource: str
    columns: tuple[ViewColumn, ...]
    constants: dict

    @property
    def name(self) -> str | None:
        return self.definition.get("name")


def _require(condition: bool, code: str, message: str) -> None:
    if not condition:
        raise EngineError(code, message)


def _columns_of(node: dict) -> list[ViewColumn]:
    out = [ViewColumn(c["name"], c["path"], c.get("type"), bool(c.get("collection"))) for c in node.get("column", [])]
    for child in node.get("select", []):
        out += _columns_of(child)
    branches = node.get("unionAll") or []
    if branches:
        lists = [_columns_of(b) for b in branches]
        for other in lists[1:]:
            _require([c.name for c in other] == [c.name for c in lists[0]], "VD_UNION_MISMATCH", "union branches must have the same columns in the same order")
        out += lists[0]
    return out


def _check_node(node: object, where: str, check_path: Callable[[str, str], None]) -> None:
    _require(isinstance(node, dict), "VD_INVALID", f"{where} must be an object")
    for column in node.get("column", []):
        _require(isinstance(column, dict) and isinstance(column.get("name"), str) and isinstance(column.get("path"), str), "VD_INVALID", f"{where}.column needs name and path")
        check_path(column["path"], f"{where}.column.{column['name']}")
    for key in ("forEach", "forEachOrNull"):
        if key in node:
            _require(isinstance(node[key], str), "VD_INVALID", f"{where}.{key} must be a path")
            check_path(node[key], f"{where}.{key}")
    if "repeat" in node:
        _require(isinstance(node["repeat"], list) and all(isinstance(p, str) for p in node["repeat"]) and node["repeat"], "VD_INVALID", f"{where}.repeat must be a list of paths")
        for path in node["repeat"]:
            check_path(path, f"{where}.repeat")
    for key in ("select", "unionAll"):
        _require(isinstance(node.get(key, []), list), "VD_INVALID", f"{where}.{key} must be a list")
        for k, child in enumerate(node.get(key, [])):
            _check_node(child, f"{where}.{key}[{k}]", check_path)


def _constants(definition: dict) -> dict:
    out = {}
    for constant in definition.get("constant", []):
        _require(isinstance(constant, dict) and isinstance(constant.get("name"), str), "VD_INVALID", "a constant needs a name")
        given = [k for k in constant if k.startswith("value")]
        _require(len(given) == 1 and given[0].removeprefix("value") in CONSTANT_KINDS, "VD_CONSTANT_INVALID", f"constant {constant['name']} needs exactly one value")
        value = constant[given[0]]
        _require(not isinstance(value, (dict, list)) and value is not None, "VD_CONSTANT_INVALID", f"constant {constant['name']} needs a scalar")
        out[constant["name"]] = Temporal(value) if given[0].removeprefix("value") in TEMPORAL_KINDS and isinstance(value, str) else value
    return out


def parse_view(definition: dict | str) -> View:
    """Check a definition and all of its paths, without data."""
    definition = json.loads(definition) if isinstance(definition, str) else definition
    _require(isinstance(definition, dict), "VD_INVALID", "a view must be an object")
    _require(isinstance(definition.get("resource"), str) and bool(definition["resource"]), "VD_INVALID", "a view needs a resource")
    _require(isinstance(definition.get("select"), list) and bool(definition["select"]), "VD_INVALID", "a view needs select nodes")
    constants = _constants(definition)
    scope = Scope(F.array(), F.lit(0), constants, definition["resource"])

    def check_path(path: str, where: str) -> None:
        parse(path)
        evaluate(path, scope)  # unknown functions and constants fail here, with or without rows

    for k, node in enumerate(definition["select"]):
        _check_node(node, f"select[{k}]", check_path)
    _require(isinstance(definition.get("where", []), list), "VD_INVALID", "where must be a list")
    for clause in definition.get("where", []):
        _require(isinstance(clause, dict) and isinstance(clause.get("path"), str), "VD_INVALID", "a where clause needs a path")
        check_path(clause["path"], "where")
    columns: dict[str, ViewColumn] = {}
    for node in definition["select"]:
        for column in _columns_of(node):
            columns[column.name] = column  # of equal names the last factor's value stands, at the first one's place
    return View(definition, definition["resource"], tuple(columns.values()), constants)


def parse_materialisable(definition: dict | str) -> View:
    """The strict tier: named, with a key, without reserved or repeated columns."""
    view = parse_view(definition)
    _require(isinstance(view.name, str) and re.fullmatch(r"[a-z][a-z0-9_]{0,50}", view.name) is not None, "VD_NAME_INVALID", "a materialised view needs a lower-case name")
    names = [c.name for node in view.definition["select"] for c in _columns_of(node)]
    _require(len(names) == len(set(names)), "VD_COLUMN_DUPLICATE", "columns must be distinct")
    _require(not set(names) & set(RESERVED), "VD_COLUMN_RESERVED", f"{RESERVED} are reserved")
    _require(all(re.fullmatch(r"[a-z][a-z0-9_]{0,62}", n) for n in names), "VD_COLUMN_INVALID", "column names must be lower-case identifiers")
    plain = [n for n in view.definition["select"] if not {"forEach", "forEachOrNull", "repeat", "unionAll"} & set(n)]
    keys = [c for n in plain for c in n.get("column", []) if c["path"].replace(" ", "") == "getResourceKey()" and not c.get("collection")]
    _require(bool(keys), "VD_KEY_MISSING", "a materialised view needs a top-level getResourceKey() column")
    return view


def view_schema(view: View) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.spark_type) for c in view.columns])


def _scalar(column: ViewColumn, value: Value) -> Column:
    kind = column.spark_type
    if column.collection:
        return F.to_json(F.to_variant_object(value.items()))
    if value.kind != "items" and not column.as_json:  # one value at most, of a known type
        text = F.to_json(value.column.cast("variant")) if value.kind in ("num", "bool") else value.column
        return F.when(value.column.isNotNull(), text) if isinstance(kind, T.StringType) else value.column.try_cast(kind)
    error = F.raise_error(F.lit(f"VD_COLUMN_MULTIPLE_VALUES: {column.name}"))

    def read(items: Column) -> Column:
        one = F.get(items, F.lit(0))
        if column.as_json:
            found = F.to_json(one).cast("string")
        elif isinstance(kind, T.StringType):
            found = F.when(F.schema_of_variant(one) == "STRING", F.try_variant_get(one, "$", "string")).otherwise(F.to_json(one))
        else:
            found = F.try_variant_get(one, "$", kind.simpleString())
        return F.when(F.size(items) == 0, F.lit(None)).when(F.size(items) == 1, found).otherwise(error.cast(kind))

    return bound(value.items(), read)


def read_type(column: ViewColumn) -> T.DataType:
    return column.spark_type


def _row_type(columns: list[ViewColumn]) -> str:
    return "array<struct<" + ",".join(f"`{c.name}`:{c.spark_type.simpleString()}" for c in columns) + ">>"


def _unique(columns: list[ViewColumn]) -> list[ViewColumn]:
    return list({c.name: c for c in columns}.values())


def _levels(scope: Scope, paths: list[str]) -> Column:
    """All nodes below the focus by the paths, in the order of a depth-first walk, as array<variant>."""

    def children(v: Column) -> Column:
        inner = Scope(F.array(v), scope.row_index, scope.constants, scope.resource)
        found = [evaluate(p, inner).items() for p in paths]
        return found[0] if len(found) == 1 else F.concat(*found)

    def below(parent: Column, place: Column) -> Column:
        return F.transform(children(parent), lambda c, i: F.struct(F.concat(place, F.lpad(i.cast("string"), 8, "0")).alias("p"), c.alias("v")))

    kind = "array<struct<p:string,v:variant>>"
    first = F.flatten(F.transform(scope.focus, lambda v: below(v, F.lit("")))).cast(kind)
    start = F.struct(first.alias("done"), first.alias("front"))

    def step(state: Column, _: Column) -> Column:
        front = F.flatten(F.transform(state["front"], lambda n: below(n["v"], n["p"]))).cast(kind)
        deeper = bound(front, lambda f: F.struct(F.concat(state["done"], f).alias("done"), f.alias("front")))
        return F.when(F.size(state["front"]) == 0, state).otherwise(deeper)  # nothing below: the state stands as it is

    def in_order(state: Column) -> Column:
        too_deep = F.exists(state["front"], lambda n: F.length(n["p"]) > 8 * MAX_DEPTH)
        ordered = F.array_sort(state["done"], lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))
        nodes = F.transform(ordered, lambda n: n["v"])
        return F.when(too_deep, F.raise_error(F.lit("VD_REPEAT_DEPTH_EXCEEDED")).cast("array<variant>")).otherwise(nodes)

    return bound(F.aggregate(F.sequence(F.lit(2), F.lit(MAX_DEPTH + 1)), start, step), in_order)


def _node_rows(node: dict, scope: Scope) -> Column:
    """The rows of a node in a scope."""
    kind = _row_type(_unique(_columns_of(node)))

    def over(items: Column) -> Column:
        return F.flatten(F.transform(items, lambda v, i: _body_rows(node, Scope(F.array(v), i, scope.constants, scope.resource)))).cast(kind)

    if "forEach" in node:
        return over(evaluate(node["forEach"], scope).items())
    if "forEachOrNull" in node:
        items = evaluate(node["forEachOrNull"], scope).items()
        blank = Scope(F.array().cast("array<variant>"), F.lit(0), scope.constants, scope.resource)
        return F.when(F.size(items) > 0, over(items)).otherwise(_body_rows(node, blank).cast(kind))
    if "repeat" in node:
        return over(_levels(scope, node["repeat"]))
    return _body_rows(node, scope)


def _body_rows(node: dict, scope: Scope) -> Column:
    factors: list[tuple[list[ViewColumn], Column]] = []
    own = [ViewColumn(c["name"], c["path"], c.get("type"), bool(c.get("collection"))) for c in node.get("column", [])]
    if own:
        fields = {c.name: _scalar(c, evaluate(c.path, scope)).alias(c.name) for c in own}
        factors.append((_unique(own), F.array(F.struct(*fields.values()))))
    for child in node.get("select", []):
        factors.append((_unique(_columns_of(child)), _node_rows(child, scope)))
    if "unionAll" in node:
        branches = node["unionAll"]
        columns = _unique(_columns_of(branches[0])) if branches else []
        rows = [_node_rows(b, scope).cast(_row_type(columns)) for b in branches]
        factors.append((columns, F.concat(*rows) if rows else None))
    if any(rows is None for _, rows in factors):  # a union without branches has no rows, so neither has the node
        return F.array().cast(_row_type(_unique(_columns_of(node))))
    if not factors:
        return F.array(F.struct())
    return _product(factors)


def _product(factors: list[tuple[list[ViewColumn], Column]]) -> Column:
    """The cross product of the factors' rows; of equal names the right-most factor's value stands."""
    factors = [f for f in factors if f[0]]
    if len(factors) == 1:
        return factors[0][1]
    owner = {c.name: k for k, (columns, _) in enumerate(factors) for c in columns}

    def nested(k: int, held: list[Column]) -> Column:
        if k == len(factors):
            return F.struct(*[held[i][name].alias(name) for name, i in owner.items()])
        inner = F.transform(factors[k][1], lambda row: nested(k + 1, [*held, row]))
        return inner if k == len(factors) - 1 else F.flatten(inner)

    return nested(0, [])


def _where(view: View, scope: Scope) -> Column | None:
    """All clauses in order; a later clause is not looked at where an earlier one fails."""
    condition: Column | None = None
    for clause in reversed(view.definition.get("where", [])):
        value = evaluate(clause["path"], scope)
        if value.kind == "bool":
            own = F.coalesce(value.column, F.lit(False))
        else:
            items = value.items()
            text = F.to_json(F.get(items, F.lit(0)))
            error = F.raise_error(F.lit(f"VD_WHERE_NOT_BOOLEAN: {clause['path']}")).cast("boolean")
            own = F.when(F.size(items) == 0, F.lit(False)).when((F.size(items) == 1) & text.isin("true", "false"), text == "true").otherwise(error)
        condition = own if condition is None else F.when(own, condition).otherwise(F.lit(False))
    return condition


def _spread(frame: DataFrame, node: dict, scope: Scope, made: dict[str, str]) -> DataFrame:
    """frame with the node's columns (made: view column -> frame column) and a row for each of the node's rows.

    An iteration is a generator and the values after it plain columns, so they are compiled code. A union becomes one
    generator over its rows."""
    iteration = next((k for k in ("forEach", "forEachOrNull", "repeat") if k in node), None)
    if iteration:
        place, value = f"__i{len(frame.columns)}", f"__v{len(frame.columns)}"
        items = _levels(scope, node[iteration]) if iteration == "repeat" else evaluate(node[iteration], scope).items()
        generator = F.posexplode_outer(items) if iteration == "forEachOrNull" else F.posexplode(items)
        frame = frame.select("*", generator.alias(place, value))
        inside, index = F.array(F.col(value)), F.col(place)
        if iteration == "forEachOrNull":
            inside, index = F.when(F.col(place).isNull(), F.array().cast("array<variant>")).otherwise(inside), F.coalesce(index, F.lit(0))
        scope = Scope(inside, index, scope.constants, scope.resource)

    def add(frame: DataFrame, values: dict[str, Column]) -> DataFrame:
        names = {name: f"__c{len(frame.columns) + k}" for k, name in enumerate(values)}
        made.update(names)
        return frame.select("*", *[v.alias(names[name]) for name, v in values.items()])

    own = [ViewColumn(c["name"], c["path"], c.get("type"), bool(c.get("collection"))) for c in node.get("column", [])]
    if own:
        frame = add(frame, {c.name: _scalar(c, evaluate(c.path, scope)) for c in own})
    for child in node.get("select", []):
        frame = _spread(frame, child, scope, made)
    if "unionAll" in node:
        columns = _unique(_columns_of({"unionAll": node["unionAll"]}))
        row = f"__u{len(frame.columns)}"
        frame = frame.select("*", F.explode(_body_rows({"unionAll": node["unionAll"]}, scope)).alias(row))
        frame = add(frame, {c.name: F.col(row)[c.name] for c in columns})
    return frame


def evaluate_view(view: View | dict | str, documents: DataFrame, content: str = "content", type_column: str | None = "type", keep: tuple[str, ...] = (), row_index: bool = False) -> DataFrame:
    """Rows of a view over documents with a variant column; `keep` columns pass through. `row_index` adds the row's
    number inside its document."""
    view = view if isinstance(view, View) else parse_view(view)
    kind = F.col(type_column) if type_column else F.try_variant_get(content, "$.resourceType", "string")
    scope = Scope(F.array(F.col(content)), F.lit(0), view.constants, view.resource)
    frame = documents.filter(kind == view.resource)
    condition = _where(view, scope)
    if condition is not None:
        frame = frame.filter(condition)
    kept = [F.col(c) for c in keep]
    if not row_index and view.columns:
        made: dict[str, str] = {}
        for node in view.definition["select"]:
            frame = _spread(frame, node, scope, made)
        return frame.select(*kept, *[F.col(made[c.name]).alias(c.name) for c in view.columns])
    rows = _product([(_unique(_columns_of(n)), _node_rows(n, scope)) for n in view.definition["select"]])
    if not view.columns:
        return frame.select(*kept)
    exploded = frame.select(*kept, F.posexplode(rows).alias("__pos", "__row")) if row_index else frame.select(*kept, F.explode(rows).alias("__row"))
    position = [F.col("__pos").cast("int").alias("row_index")] if row_index else []
    return exploded.select(*[F.col(c) for c in keep], *position, *[F.col("__row")[c.name].alias(c.name) for c in view.columns])


def validate_view(view: dict | str) -> list[str]:
    """The view's column names; raises where the view is not well formed."""
    return [c.name for c in parse_view(view).columns]

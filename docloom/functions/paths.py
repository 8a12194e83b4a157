"""Path expressions over documents, compiled to Spark columns.

An expression denotes a collection. Members and functions work on `array<variant>` columns with higher-order
functions, logic on nullable booleans (null is the empty collection), so plans stay inside the JVM. Names that an
element may spell with its type (value -> valueQuantity) are resolved when the path is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.errors import EngineError

_TOKEN = re.compile(
    r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*')|(?P<date>@[0-9T:.Z+\-]+)|(?P<const>%(?:\w+|`[^`]+`))"
    r"|(?P<name>\$this|[A-Za-z_]\w*|`[^`]+`)|(?P<op>!=|<=|>=|[=<>+\-*/().,\[\]|&{}]))"
)


class Temporal(str):
    """The text of a date, date-time, instant or time."""


@dataclass(frozen=True)
class Node:
    """kind: literal, const, this, member, index, call or binary."""

    kind: str
    value: object = None
    parts: tuple[Node, ...] = ()


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise EngineError("VD_PATH_INVALID", f"cannot read {text!r} at {at}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return [*out, ("end", "")]


#: Binding strength of binary operators, loosest first.
_LEVELS = [{"implies"}, {"or", "xor"}, {"and"}, {"=", "!="}, {"<", ">", "<=", ">="}, {"|"}, {"+", "-", "&"}, {"*", "/"}]


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.text = _tokens(text), 0, text

    def peek(self) -> str:
        return self.tokens[self.at][1]

    def take(self, expected: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if expected is not None and token[1] != expected:
            raise EngineError("VD_PATH_INVALID", f"expected {expected!r} in {self.text!r}")
        self.at += 1
        return token

    def whole(self) -> Node:
        node = self.binary(0)
        if self.tokens[self.at][0] != "end":
            raise EngineError("VD_PATH_INVALID", f"unexpected {self.peek()!r} in {self.text!r}")
        return node

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.tokens[self.at][0] in ("op", "name") and self.peek() in _LEVELS[level]:
            op = self.take()[1]
            left = Node("binary", op, (left, self.binary(level + 1)))
        return left

    def unary(self) -> Node:
        if self.peek() in ("+", "-"):
            op = self.take()[1]
            return Node("binary", op, (Node("literal", 0), self.unary()))
        node = self.primary()
        while True:
            if self.peek() == ".":
                self.take()
                node = self.step(node)
            elif self.peek() == "[":
                self.take()
                node = Node("index", None, (node, self.binary(0)))
                self.take("]")
            else:
                return node

    def step(self, focus: Node) -> Node:
        kind, name = self.take()
        if kind != "name":
            raise EngineError("VD_PATH_INVALID", f"expected a name, got {name!r} in {self.text!r}")
        if self.peek() != "(":
            return Node("member", name.strip("`"), (focus,))
        self.take("(")
        arguments = []
        while self.peek() != ")":
            arguments.append(self.binary(0))
            if self.peek() == ",":
                self.take()
            elif self.peek() != ")":
                raise EngineError("VD_PATH_INVALID", f"unexpected {self.peek()!r} in {self.text!r}")
        self.take(")")
        return Node("call", name, (focus, *arguments))

    def primary(self) -> Node:
        kind, text = self.tokens[self.at]
        if kind == "num":
            self.take()
            return Node("literal", float(text) if "." in text else int(text))
        if kind == "str":
            self.take()
            return Node("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1]))
        if kind == "date":
            self.take()
            return Node("literal", Temporal(text[1:].removeprefix("T")))
        if kind == "const":
            self.take()
            return Node("const", text[1:].strip("`"))
        if text == "(":
            self.take()
            node = self.binary(0)
            self.take(")")
            return node
        if text == "{":
            self.take()
            self.take("}")
            return Node("empty")
        if text in ("true", "false") and self.tokens[self.at + 1][1] != "(":
            self.take()
            return Node("literal", text == "true")
        if text == "$this":
            self.take()
            return Node("this")
        return self.step(Node("this"))


@lru_cache(maxsize=4096)
def parse(text: str) -> Node:
    if not isinstance(text, str) or not text.strip():
        raise EngineError("VD_PATH_INVALID", "a path must be a non-empty string")
    return _Parser(text).whole()


@dataclass(frozen=True)
class Value:
    """A compiled collection. kind: items (array<variant>), bool, num (double), text or temporal (text); a null scalar is
    empty."""

    kind: str
    column: Column

    def items(self) -> Column:
        if self.kind == "items":
            return self.column
        return bound(self.column, lambda v: F.when(v.isNull(), _none()).otherwise(F.array(v.cast("variant"))))


def _none() -> Column:
    return F.array().cast("array<variant>")


@dataclass(frozen=True)
class Scope:
    """What an expression sees: the focus, the position of the nearest iteration, and the view's constants."""

    focus: Column
    row_index: Column
    constants: dict = field(default_factory=dict)
    resource: str | None = None


#: Elements whose name carries their type in documents (fixed values of the document model).
CHOICES = ("value", "deceased", "effective", "onset", "abatement", "performed", "medication", "multipleBirth", "occurrence", "identified")
#: Types that may follow those names where a path reads them without naming one.
CHOICE_TYPES = ("Boolean", "Code", "Date", "DateTime", "Decimal", "Instant", "Integer", "String", "Time", "Uri", "Quantity", "CodeableConcept", "Range", "Period", "Age", "Reference")
UNSUPPORTED = ("join", "lowBoundary", "highBoundary")


def _quoted(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def member(items: Column, *names: str) -> Column:
    """What the elements hold under the names, arrays flattened by one level."""

    def under(v: Column, path: str) -> Column:
        one = F.filter(F.array(F.try_variant_get(v, path, "variant")), lambda e: e.isNotNull() & ~F.is_variant_null(e))
        return F.coalesce(F.try_variant_get(v, path, "array<variant>"), one)

    def of(v: Column) -> Column:
        found = [under(v, _quoted(n)) for n in names]
        return found[0] if len(found) == 1 else F.concat(*found)

    return F.flatten(F.transform(items, of))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    """The string of a variant that is a string, else null."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(~_kind(v).rlike("^(STRING|ARRAY|OBJECT|BOOLEAN)"), F.try_variant_get(v, "$", "double"))


def _only(value: Value, read: Callable[[Column], Column]) -> Column:
    return bound(value.column, lambda items: F.when(F.size(items) == 1, read(F.get(items, F.lit(0)))))


def as_bool(value: Value) -> Column:
    if value.kind == "bool":
        return value.column
    if value.kind == "items":
        return _only(value, lambda v: F.coalesce(F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")), F.lit(True)))
    return F.when(value.column.isNotNull(), F.lit(True))


def as_number(value: Value) -> Column:
    if value.kind == "num":
        return value.column
    return _only(value, _number) if value.kind == "items" else F.lit(None).cast("double")


def as_text(value: Value) -> Column:
    if value.kind == "text":
        return value.column
    return _only(value, _text) if value.kind == "items" else F.lit(None).cast("string")


def literal(value: object) -> Value:
    if isinstance(value, bool):
        return Value("bool", F.lit(value))
    if isinstance(value, (int, float)):
        return Value("num", F.lit(float(value)))
    return Value("temporal" if isinstance(value, Temporal) else "text", F.lit(str(value)))


def _equal(a: Value, b: Value) -> Column:
    kinds = {a.kind, b.kind}
    if kinds == {"items"}:
        texts = [F.transform(v.column, lambda x: F.to_json(x)) for v in (a, b)]
        return bound(F.struct(texts[0].alias("x"), texts[1].alias("y")), lambda s: F.when((F.size(s["x"]) > 0) & (F.size(s["y"]) > 0), s["x"] == s["y"]))
    if "temporal" in kinds:
        return temporal_order(a, b, "=")
    if "bool" in kinds:
        return as_bool(a) == as_bool(b)
    read = as_number if "num" in kinds else as_text
    if "items" not in kinds:
        return F.when(a.column.isNotNull() & b.column.isNotNull(), F.coalesce(read(a) == read(b), F.lit(False)))
    items, other = (a, b) if a.kind == "items" else (b, a)
    one = _number if read is as_number else _text
    same = bound(items.column, lambda x: F.when(F.size(x) > 0, F.when(F.size(x) == 1, F.struct(one(F.get(x, F.lit(0))).alias("v"))).otherwise(F.struct(F.lit(None).alias("v")))))
    return bound(same, lambda s: F.when(s.isNotNull() & other.column.isNotNull(), F.coalesce(s["v"] == other.column, F.lit(False))))


def _ordered(op: str, a: Value, b: Value) -> Column:
    compare = {"<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}[op]
    kinds = {a.kind, b.kind}
    if "temporal" in kinds:
        return temporal_order(a, b, op)
    if "num" in kinds:
        return compare(as_number(a), as_number(b))
    if "text" in kinds:
        return compare(as_text(a), as_text(b))
    return F.coalesce(compare(as_number(a), as_number(b)), compare(as_text(a), as_text(b)))


#: Shapes of dates, date-times and times; a temporal value of fewer parts is less precise.
_DATE = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"
_TIME = r"^\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?$"


def temporal_parts(text: Column) -> Column:
    """Year, month, day, then hour, minute and second as decimals, of a date or date-time; a zone moves all to UTC. Null for
    other text. A time has its parts after three zeros."""
    zoned = text.rlike(r"T.*(Z|[+-]\d{2}:\d{2})$")
    whole = F.when(zoned & text.rlike(r"T\d{2}:\d{2}"), F.date_format(F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(text, r"T(\d{2}:\d{2})(Z|[+-])", "T$1:00$2")), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    plain = F.coalesce(whole, F.regexp_replace(text, "Z$", ""))
    dated = F.transform(F.split(plain, "[-T:]"), lambda p: p.cast("decimal(20,9)"))
    timed = F.concat(F.array(*[F.lit(0).cast("decimal(20,9)")] * 3), F.transform(F.split(text, ":"), lambda p: p.cast("decimal(20,9)")))
    return F.when(text.rlike(_DATE), dated).when(text.rlike(_TIME), timed)


def temporal_order(a: Value, b: Value, op: str) -> Column:
    """Comparison of typed temporals. Where one is less precise and the shared parts are equal, the answer is empty; a plain
    text constant never equals a temporal one."""
    if {a.kind, b.kind} & {"num", "bool"} or {a.kind, b.kind} == {"temporal", "text"}:
        return F.lit(False) if op == "=" else F.lit(None).cast("boolean")
    parts = [temporal_parts(v.column if v.kind == "temporal" else as_text(v)) for v in (a, b)]

    def compared(s: Column) -> Column:
        x, y = s["x"], s["y"]
        shared = F.least(F.size(x), F.size(y))
        p, q = F.slice(x, 1, shared), F.slice(y, 1, shared)
        answer = {"=": p == q, "<": p < q, ">": p > q, "<=": p <= q, ">=": p >= q}[op]
        sure = (F.size(x) == F.size(y)) | (p != q) | ((F.size(x) >= 5) & (F.size(y) >= 5))
        here = x.isNotNull() & y.isNotNull()
        return F.when(here & sure, answer).when(~here & s["both"], F.lit(False) if op == "=" else F.lit(None).cast("boolean"))

    filled = [F.size(v.column) > 0 if v.kind == "items" else v.column.isNotNull() for v in (a, b)]
    return bound(F.struct(parts[0].alias("x"), parts[1].alias("y"), (filled[0] & filled[1]).alias("both")), compared)


def _binary(op: str, node: Node, scope: Scope) -> Value:
    a, b = (compiled(p, scope) for p in node.parts)
    if op == "and":
        return Value("bool", as_bool(a) & as_bool(b))
    if op == "or":
        return Value("bool", as_bool(a) | as_bool(b))
    if op == "xor":
        return Value("bool", as_bool(a) != as_bool(b))
    if op == "implies":
        return Value("bool", ~as_bool(a) | as_bool(b))
    if op in ("=", "!="):
        same = _equal(a, b)
        return Value("bool", same if op == "=" else ~same)
    if op in ("<", ">", "<=", ">="):
        return Value("bool", _ordered(op, a, b))
    if op == "|":
        every = F.concat(a.items(), b.items())
        texts = F.transform(every, lambda v: F.to_json(v))
        return Value("items", F.filter(every, lambda v, i: F.array_position(texts, F.to_json(v)) == i + 1))
    if op == "&":
        return Value("text", F.concat(F.coalesce(as_text(a), F.lit("")), F.coalesce(as_text(b), F.lit(""))))
    if op == "+" and "text" in (a.kind, b.kind):
        return Value("text", F.concat(as_text(a), as_text(b)))
    x, y = as_number(a), as_number(b)
    return Value("num", {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op]())


def _reference_key(items: Column, wanted: str | None) -> Column:
    def key(v: Column) -> Column:
        parts = F.filter(F.split(_text(F.try_variant_get(v, "$.reference", "variant")), "/"), lambda s: s != "")
        fits = F.size(parts) >= 2
        if wanted is not None:
            fits = fits & (F.try_element_at(parts, F.lit(-2)) == wanted)
        return F.when(fits, F.try_element_at(parts, F.lit(-1)).cast("variant"))

    return F.filter(F.transform(items, key), lambda e: e.isNotNull())


def _type_name(node: Node) -> str:
    if node.kind != "member":
        raise EngineError("VD_PATH_INVALID", "expected a type name")
    return str(node.value)


def _call(name: str, node: Node, scope: Scope) -> Value:
    if name in UNSUPPORTED:
        raise EngineError("VD_FUNCTION_UNSUPPORTED", f"{name}() is not supported")
    focus_node, *arguments = node.parts
    if name == "ofType":
        wanted = _type_name(arguments[0])
        if focus_node.kind == "member":
            parent = compiled(focus_node.parts[0], scope).items()
            return Value("items", member(parent, str(focus_node.value) + wanted[0].upper() + wanted[1:]))
        raise EngineError("VD_FUNCTION_UNSUPPORTED", "ofType() needs an element whose name carries its type")
    focus = compiled(focus_node, scope)
    items = focus.items()

    def criterion(v: Column) -> Column:
        return F.coalesce(as_bool(compiled(arguments[0], Scope(F.array(v), scope.row_index, scope.constants, scope.resource))), F.lit(False))

    if name == "where":
        return Value("items", F.filter(items, criterion))
    if name == "exists":
        return Value("bool", F.exists(items, criterion) if arguments else F.size(items) > 0)
    if name == "all":
        return Value("bool", F.forall(items, criterion))
    if name == "empty":
        return Value("bool", F.size(items) == 0)
    if name == "not":
        return Value("bool", ~as_bool(focus))
    if name == "count":
        return Value("num", F.size(items).cast("double"))
    if name == "first":
        return Value("items", F.slice(items, 1, 1))
    if name == "last":
        return Value("items", F.when(F.size(items) > 0, F.slice(items, -1, 1)).otherwise(_none()))
    if name == "tail":
        return Value("items", F.filter(items, lambda v, i: i > 0))
    if name in ("skip", "take"):
        bound = as_number(compiled(arguments[0], scope)).cast("int")
        return Value("items", F.filter(items, lambda v, i: i >= bound if name == "skip" else i < bound))
    if name == "select":
        return Value("items", F.flatten(F.transform(items, lambda v: compiled(arguments[0], Scope(F.array(v), scope.row_index, scope.constants, scope.resource)).items())))
    if name == "extension":
        url = as_text(compiled(arguments[0], scope))
        return Value("items", F.filter(member(items, "extension"), lambda v: _text(F.try_variant_get(v, "$.url", "variant")) == url))
    if name == "getResourceKey":
        return Value("items", member(items, "id"))
    if name == "getReferenceKey":
        return Value("items", _reference_key(items, _type_name(arguments[0]) if arguments else None))
    raise EngineError("VD_FUNCTION_UNKNOWN", f"{name}() is unknown")


#: User functions: name -> (focus items, compiled arguments) -> array<variant> column.
REGISTERED: dict[str, Callable[[Column, list[Value]], Column]] = {}


def compiled(node: Node, scope: Scope) -> Value:
    if node.kind == "literal":
        return literal(node.value)
    if node.kind == "empty":
        return Value("items", _none())
    if node.kind == "const":
        if node.value == "rowIndex":
            return Value("num", scope.row_index.cast("double"))
        if node.value not in scope.constants:
            raise EngineError("VD_CONSTANT_UNDEFINED", f"%{node.value} is not defined")
        return literal(scope.constants[node.value])
    if node.kind == "this":
        return Value("items", scope.focus)
    if node.kind == "member":
        if node.parts[0].kind == "this" and node.value == scope.resource:
            return Value("items", scope.focus)
        parent, name = compiled(node.parts[0], scope).items(), str(node.value)
        return Value("items", member(parent, name, *([name + t for t in CHOICE_TYPES] if name in CHOICES else [])))
    if node.kind == "index":
        items = compiled(node.parts[0], scope).items()
        position = as_number(compiled(node.parts[1], scope)).cast("int")
        return Value("items", F.filter(items, lambda v, i: i == position))
    if node.kind == "call":
        if node.value in REGISTERED:
            focus, *arguments = (compiled(p, scope) for p in node.parts)
            return Value("items", REGISTERED[node.value](focus.items(), arguments))
        return _call(str(node.value), node, scope)
    return _binary(str(node.value), node, scope)


def evaluate(path: str, scope: Scope) -> Value:
    return compiled(parse(path), scope)

"""Text templates as one Column: `{{ value }}`, `{% if %}`, `{% for %}`, `{% set %}` and filters, planned by Catalyst.

A template is read once on the driver and becomes an expression over a DataFrame's columns, so a layout that a user
replaces costs no Python per row. Values are Python expressions: names with dots, text and numbers, comparisons, `in`,
`is defined`, `and`, `or`, `not`, `a if c else b`, `x.endswith(".pdf")`, and filters after `|`. Empty text, zero, empty
arrays and null count as false. A name that is no column, and null, print as nothing. The line break after a block and
the spaces before one at the start of a line belong to the block.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECES = re.compile(r"(?s)(\{\{.*?\}\}|[ \t]*\{%.*?%\}\n?|\{#.*?#\}\n?)")
_COMPARED = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


class TemplateError(ValueError):
    pass


@dataclass
class Value:
    """A Column with its type; no column: a name that is not defined."""

    column: Column | None
    kind: T.DataType

    def true(self) -> Column:
        if self.column is None:
            return F.lit(False)
        c, k = self.column, self.kind
        if isinstance(k, T.BooleanType):
            out = c
        elif isinstance(k, T.StringType):
            out = c != ""
        elif isinstance(k, (T.ArrayType, T.MapType)):
            out = F.size(c) > 0
        elif isinstance(k, T.NumericType):
            out = c != 0
        else:
            out = c.isNotNull()
        return F.coalesce(out, F.lit(False))

    def text(self) -> Column:
        if self.column is None:
            return F.lit("")
        c = self.column
        if isinstance(self.kind, T.BooleanType):
            c = F.when(c, "True").when(~c, "False")
        elif isinstance(self.kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            c = json_text(c, self.kind)
        return F.coalesce(c.cast("string"), F.lit(""))

    def get(self, name: str) -> Value:
        if self.column is None:
            return Value(None, T.NullType())
        if isinstance(self.kind, T.StructType):
            return Value(self.column[name], self.kind[name].dataType) if name in self.kind.fieldNames() else Value(None, T.NullType())
        if isinstance(self.kind, T.MapType):
            return Value(F.try_element_at(self.column, F.lit(name)), self.kind.valueType)
        if isinstance(self.kind, T.VariantType):
            return Value(F.try_variant_get(self.column, f"$.{name}", "string"), T.StringType())
        raise TemplateError(f"{name}: a {self.kind.simpleString()} has no fields")


def json_text(column: Column, kind: T.DataType) -> Column:
    """JSON with a space after commas and colons, letters as they are; null is null."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    if isinstance(kind, T.StringType):
        out = quoted(column)
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: json_text(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(": "), json_text(e["value"], kind.valueType))), ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f'"{f.name}": '), json_text(column[f.name], f.dataType)) for f in kind]
        out = F.when(column.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    elif isinstance(kind, T.VariantType):
        out = F.to_json(column)
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        out = F.concat(F.lit('"'), column.cast("string"), F.lit('"'))
    else:
        out = column.cast("string")
    return F.coalesce(out, F.lit("null"))


def _text(value: Value, f: Callable[[Column], Column]) -> Value:
    return Value(f(value.text()), T.StringType())


def _default(value: Value, other: Value) -> Value:
    """What is not defined, or null, gets the other value."""
    return other if value.column is None else Value(F.coalesce(value.column, other.column.cast(value.kind)), value.kind)


def _join(value: Value, by: Value | None = None) -> Value:
    if value.column is None:
        return Value(F.lit(""), T.StringType())
    parts = F.transform(value.column, lambda x: Value(x, value.kind.elementType).text())
    return Value(F.call_function("array_join", parts, by.column if by else F.lit("")), T.StringType())


def _format(value: Value, given: Value) -> Value:
    return Value(F.call_function("format_string", value.column, given.column), T.StringType())


def _length(value: Value) -> Value:
    size = F.lit(0) if value.column is None else F.size(value.column) if isinstance(value.kind, (T.ArrayType, T.MapType)) else F.length(value.text())
    return Value(F.coalesce(size, F.lit(0)), T.IntegerType())


def _first(value: Value) -> Value:
    return value if value.column is None else Value(F.try_element_at(value.column, F.lit(1)), value.kind.elementType)


def _json(value: Value) -> Value:
    return Value(F.lit("[]") if value.column is None else json_text(value.column, value.kind), T.StringType())


#: Filters by name; `filters` of compiled() adds to them or replaces some.
FILTERS: dict[str, Callable[..., Value]] = {
    "default": _default, "join": _join, "format": _format, "length": _length, "first": _first, "tojson": _json, "tojson_raw": _json,
    "upper": lambda v: _text(v, F.upper), "lower": lambda v: _text(v, F.lower), "trim": lambda v: _text(v, F.trim), "title": lambda v: _text(v, F.initcap),
    "escaped": lambda v: _text(v, lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))),
    "replace": lambda v, a, b: _text(v, lambda c: F.replace(c, a.column, b.column)), "string": lambda v: _text(v, lambda c: c),
}


class _Compiler:
    def __init__(self, text: str, filters: dict[str, Callable[..., Value]]):
        self.filters = filters
        self.pieces = [p for p in _PIECES.split(self._spaces(text)) if p]
        self.at = 0

    @staticmethod
    def _spaces(text: str) -> str:
        """Spaces before a block that are not at the start of a line stay text."""
        return re.sub(r"(?m)(?<=[^\s])([ \t]+)(?=\{%)", lambda m: "{{'" + m[1].replace("\t", "\\t") + "'}}", text)

    def body(self, names: dict[str, Value], until: tuple[str, ...] = ()) -> tuple[Column, str]:
        """Text up to one of the blocks `until`, and that block."""
        out: list[Column] = []
        names = dict(names)
        while self.at < len(self.pieces):
            piece = self.pieces[self.at]
            self.at += 1
            if piece.startswith("{{"):
                out.append(self.value(piece[2:-2], names).text())
            elif piece.lstrip(" \t").startswith("{%"):
                block = piece.strip()[2:-2].strip()
                word = block.split(None, 1)[0]
                if word in until:
                    return self._joined(out), block
                if word == "if":
                    out.append(self.choice(block[2:], names))
                elif word == "for":
                    out.append(self.loop(block[3:], names))
                elif word == "set":
                    name, _, given = block[3:].partition("=")
                    names[name.strip()] = self.value(given, names)
                else:
                    raise TemplateError(f"{block}: no block to begin or end here")
            elif not piece.startswith("{#"):
                out.append(F.lit(piece))
        if until:
            raise TemplateError(f"a block is not closed: {' or '.join(until)} is missing")
        return self._joined(out), ""

    @staticmethod
    def _joined(parts: list[Column]) -> Column:
        return F.concat(*parts) if parts else F.lit("")

    def choice(self, condition: str, names: dict[str, Value]) -> Column:
        out, test = None, self.value(condition, names).true()
        while True:
            text, block = self.body(names, ("elif", "else", "endif"))
            out = F.when(test, text) if out is None else out.when(test, text)
            word, _, rest = block.partition(" ")
            if word == "elif":
                test = self.value(rest, names).true()
            elif word == "else":
                return out.otherwise(self.body(names, ("endif",))[0])
            else:
                return out.otherwise("")

    def loop(self, head: str, names: dict[str, Value]) -> Column:
        name, _, given = head.strip().partition(" in ")
        items = self.value(given, names)
        if items.column is None:
            items = Value(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
        if not isinstance(items.kind, T.ArrayType):
            raise TemplateError(f"{given}: no array")
        begun = self.at

        def one(x: Column, i: Column) -> Column:
            self.at = begun
            inner = names | {name.strip(): Value(x, items.kind.elementType), "index": Value(i + 1, T.IntegerType())}
            return self.body(inner, ("endfor",))[0]

        return F.coalesce(F.array_join(F.transform(items.column, one), ""), F.lit(""))

    def value(self, text: str, names: dict[str, Value]) -> Value:
        try:
            tree = ast.parse(text.strip(), mode="eval").body
        except SyntaxError as e:
            raise TemplateError(f"{text.strip()}: {e.msg}") from None
        return self._value(tree, names)

    def _value(self, node: ast.AST, names: dict[str, Value]) -> Value:
        of = lambda n: self._value(n, names)
        match node:
            case ast.Constant(value=bool() as v):
                return Value(F.lit(v), T.BooleanType())
            case ast.Constant(value=int() as v):
                return Value(F.lit(v), T.LongType())
            case ast.Constant(value=float() as v):
                return Value(F.lit(v), T.DoubleType())
            case ast.Constant(value=str() as v):
                return Value(F.lit(v), T.StringType())
            case ast.Constant(value=None):
                return Value(None, T.NullType())
            case ast.Name(id=name):
                return names.get(name, Value(None, T.NullType()))
            case ast.List(elts=items):
                made = [of(x) for x in items]
                kind = made[0].kind if made else T.StringType()
                return Value(F.array(*(x.column for x in made)).cast(T.ArrayType(kind)), T.ArrayType(kind))
            case ast.Attribute(value=inner, attr=name):
                return of(inner).get(name)
            case ast.Subscript(value=inner, slice=ast.Constant(value=str() as name)):
                return of(inner).get(name)
            case ast.BinOp(left=left, op=ast.BitOr(), right=ast.Name(id=name)):
                return self._filter(name)(of(left))
            case ast.BinOp(left=left, op=ast.BitOr(), right=ast.Call(func=ast.Name(id=name), args=args)):
                return self._filter(name)(of(left), *(of(a) for a in args))
            case ast.BinOp(left=left, op=ast.Add(), right=right):
                a, b = of(left), of(right)
                if isinstance(a.kind, T.StringType) or isinstance(b.kind, T.StringType):
                    return Value(F.concat(a.text(), b.text()), T.StringType())
                return Value(a.column + b.column, a.kind)
            case ast.BoolOp(op=op, values=parts):
                made = [of(p) for p in parts]
                out = made[0]
                for part in made[1:]:
                    # like Python: the value that decides; of different types, whether it does
                    if out.column is not None and part.column is not None and out.kind == part.kind:
                        out = Value(F.when(out.true(), out.column if isinstance(op, ast.Or) else part.column).otherwise(part.column if isinstance(op, ast.Or) else out.column), out.kind)
                    else:
                        out = Value(out.true() | part.true() if isinstance(op, ast.Or) else out.true() & part.true(), T.BooleanType())
                return out
            case ast.UnaryOp(op=ast.Not(), operand=inner):
                return Value(~of(inner).true(), T.BooleanType())
            case ast.IfExp(test=test, body=yes, orelse=no):
                a, b = of(yes), of(no)
                if a.column is None or b.column is None or a.kind != b.kind:
                    return Value(F.when(of(test).true(), a.text()).otherwise(b.text()), T.StringType())
                return Value(F.when(of(test).true(), a.column).otherwise(b.column), a.kind)
            case ast.Compare(left=left, ops=[ast.Is() | ast.IsNot() as op], comparators=[right]):
                a = of(left)
                there = F.lit(False) if a.column is None else a.column.isNotNull()
                plain = {"defined": there, "none": ~there}.get(getattr(right, "id", "none" if isinstance(right, ast.Constant) and right.value is None else ""))
                if plain is None:
                    raise TemplateError("`is` goes with defined or none")
                return Value(plain if isinstance(op, ast.Is) else ~plain, T.BooleanType())
            case ast.Compare(left=left, ops=[ast.In() | ast.NotIn() as op], comparators=[right]):
                a, b = of(left), of(right)
                found = F.lit(False) if b.column is None else F.array_contains(b.column, a.column) if isinstance(b.kind, T.ArrayType) else F.contains(b.text(), a.text())
                found = F.coalesce(found, F.lit(False))
                return Value(found if isinstance(op, ast.In) else ~found, T.BooleanType())
            case ast.Compare(left=left, ops=[op], comparators=[right]) if type(op) in _COMPARED:
                a, b = of(left), of(right)
                if a.column is None or b.column is None:
                    return Value(F.lit(isinstance(op, ast.NotEq)), T.BooleanType())
                return Value(F.coalesce(_COMPARED[type(op)](a.column, b.column), F.lit(False)), T.BooleanType())
            case ast.Call(func=ast.Attribute(value=inner, attr="endswith" | "startswith" as how), args=[given]):
                return Value(getattr(of(inner).text(), how)(of(given).column), T.BooleanType())
        raise TemplateError(f"{ast.unparse(node)}: not known in templates")

    def _filter(self, name: str) -> Callable[..., Value]:
        if name not in self.filters:
            raise TemplateError(f"{name}: no filter of this name")
        return self.filters[name]


def compiled(text: str, rows: DataFrame, filters: dict[str, Callable[..., Value]] | None = None) -> Column:
    """The template's text for each of rows."""
    names = {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema}
    return _Compiler(text, FILTERS | (filters or {})).body(names)[0]

"""Metavariable conditions as Column expressions over the bindings map."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comparison words and symbols.
OPERATORS = {"==": "eq", "!=": "ne", ">": "gt", "<": "lt", ">=": "ge", "<=": "le", "eq": "eq", "ne": "ne", "gt": "gt", "lt": "lt", "ge": "ge", "le": "le", "contains": "contains", "starts_with": "starts_with", "ends_with": "ends_with", "matches": "matches"}


def bound(name: str, bindings: str = "bindings") -> Column:
    return F.col(bindings)[F.lit(name)]


def regex_condition(value: Column, regex: str) -> Column:
    """Unanchored search; a missing binding is false."""
    return F.coalesce(F.regexp(value, F.lit(regex)), F.lit(False))


def compare(value: Column, op: str, other: str) -> Column:
    """Numeric where both sides read as numbers, else by string order; a missing binding is false."""
    kind = OPERATORS[op]
    right = F.lit(other)
    if kind in ("contains", "starts_with", "ends_with", "matches"):
        test = {"contains": F.contains(value, right), "starts_with": F.startswith(value, right), "ends_with": F.endswith(value, right), "matches": F.regexp(value, right)}[kind]
        return F.coalesce(test, F.lit(False))
    a, b = value.try_cast("double"), right.try_cast("double")
    sign = {"eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "gt": lambda x, y: x > y, "lt": lambda x, y: x < y, "ge": lambda x, y: x >= y, "le": lambda x, y: x <= y}[kind]
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), sign(a, b)).otherwise(sign(value, right)), F.lit(False))


def name_condition(value: Column, pattern: str) -> Column:
    """Equality, or an unanchored glob where the pattern holds a star (only dots are escaped)."""
    if "*" not in pattern:
        return F.coalesce(value == pattern, F.lit(False))
    return regex_condition(value, pattern.replace(".", r"\.").replace("*", ".*"))


def entropy(value: Column) -> Column:
    """Shannon bits: characters are counted, and the counts divided by the number of bytes; empty: 0."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.octet_length(value)
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n == 0, 0.0).otherwise(-F.aggregate(counts, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


def charset(value: Column, name: str) -> Column:
    """alphanumeric, alphabetic, numeric (Unicode) or ascii; an unknown name is true."""
    tests = {"alphanumeric": r"^[\p{L}\p{N}]*$", "alphabetic": r"^\p{L}*$", "numeric": r"^\p{N}*$"}
    if name in tests:
        return F.regexp(value, F.lit(tests[name]))
    return F.octet_length(value) == F.char_length(value) if name == "ascii" else F.lit(True)


def type_condition(value: Column, expected: list[str] = (), forbidden: list[str] = ()) -> Column:
    """Any expected type and no forbidden one: string, number, integer, boolean, null."""
    is_ = {"string": F.lit(True), "number": value.try_cast("double").isNotNull(), "integer": F.regexp(value, F.lit(r"^[+-]?[0-9]+$")), "boolean": value.isin("true", "false"), "null": value.isin("null", "None", "nil", "undefined")}
    ok = F.lit(not expected)
    for t in expected:
        ok = ok | is_.get(t, F.lit(False))
    for t in forbidden:
        ok = ok & ~is_.get(t, F.lit(False))
    return ok


def max_lines(value: Column, most: int) -> Column:
    """Lines as text editors count them: an ending newline opens no line."""
    return F.regexp_count(value, F.lit("\n")) + F.when(F.endswith(value, F.lit("\n")) | (value == ""), 0).otherwise(1) <= most


def expression(text: str, bindings: str = "bindings") -> Column:
    """A comparison expression over metavariables, compiled from a whitelist of Python syntax: int float str len,
    today strptime (dates as yyyy-MM-dd), arithmetic, comparisons, in, and or not, re.match. Anything else raises ValueError."""
    import ast

    names: dict[str, str] = {}
    plain = re.sub(r"\$(\w+)", lambda m: names.setdefault(f"$v_{m[1]}", f"v_{m[1]}"), text)

    def go(n) -> Column:
        if isinstance(n, ast.Expression):
            return go(n.body)
        if isinstance(n, ast.Constant):
            return F.lit(n.value)
        if isinstance(n, ast.Name) and n.id.startswith("v_"):
            return bound("$" + n.id[2:], bindings)
        if isinstance(n, ast.Call):
            f = n.func.id if isinstance(n.func, ast.Name) else f"{n.func.value.id}.{n.func.attr}" if isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) else "?"
            a = [go(x) for x in n.args]
            if f == "today":
                return F.date_format(F.current_date(), "yyyy-MM-dd")
            if f == "strptime":
                return F.date_format(F.try_to_timestamp(a[0], F.lit("yyyy-MM-dd")), "yyyy-MM-dd")
            if f == "len":
                return F.char_length(a[0])
            if f in ("int", "float", "str"):
                return a[0].cast("string") if f == "str" else a[0].try_cast("long" if f == "int" else "double")
            if f == "re.match":
                return F.regexp(a[1], F.concat(F.lit("^(?:"), a[0], F.lit(")")))
            raise ValueError(f"function {f}")
        if isinstance(n, ast.BoolOp):
            parts = [go(v) for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(n.op, ast.And) else out | p
            return out
        if isinstance(n, ast.UnaryOp):
            return ~go(n.operand) if isinstance(n.op, ast.Not) else -go(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = _number(n.left, go), _number(n.right, go)
            ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Mod: lambda: a % b, ast.Div: lambda: F.try_divide(a, b)}
            if type(n.op) in ops:
                return ops[type(n.op)]()
        if isinstance(n, ast.Compare) and len(n.ops) == 1:
            op, right = n.ops[0], n.comparators[0]
            if isinstance(op, (ast.In, ast.NotIn)):
                hit = go(n.left).isin([str(c.value) for c in right.elts]) if isinstance(right, (ast.List, ast.Tuple)) else F.contains(go(right), go(n.left))
                return ~hit if isinstance(op, ast.NotIn) else hit
            numeric = any(isinstance(x, ast.Constant) and isinstance(x.value, (int, float)) for x in (n.left, right))
            a, b = (_number(n.left, go), _number(right, go)) if numeric else (go(n.left), go(right))
            signs = {ast.Eq: a == b, ast.NotEq: a != b, ast.Gt: a > b, ast.Lt: a < b, ast.GtE: a >= b, ast.LtE: a <= b}
            return signs[type(op)]
        raise ValueError(f"expression {ast.dump(n)[:60]}")

    def _number(n, go):
        return go(n).try_cast("double") if isinstance(n, ast.Name) else go(n)

    return F.coalesce(go(ast.parse(plain.strip(), mode="eval")), F.lit(False))


def node_attribute(name: str, value: str) -> Column:
    """A node's type, text or number of children equals a value; a missing text and an unknown attribute are false."""
    if name == "type":
        return F.coalesce(F.col("node_type") == value, F.lit(False))
    if name == "text":
        return F.coalesce(F.col("text") == value, F.lit(False))
    if name == "child_count" and value.isdigit():
        return F.coalesce(F.col("child_count") == int(value), F.lit(False))
    return F.lit(False)


def text_holds(value: str) -> Column:
    """The rule executor's reading of a node condition: the node's text contains the value."""
    return F.coalesce(F.contains("text", F.lit(value)), F.lit(False))


def every(tests: list[Column]) -> Column:
    """All conditions hold; true where there are none."""
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def some(tests: list[Column]) -> Column:
    """Any condition holds; false where there are none."""
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def context_is(key: str, value: str, column: str = "context") -> Column:
    """Rows whose context map has a value under a key; a missing key is false."""
    return F.coalesce(F.col(column)[F.lit(key)] == value, F.lit(False))


def clause_column(clause: dict, extensions=None) -> Column:
    """A rule's metavariable clause as a boolean Column; a `custom-condition` is looked up by its name in the run's extensions."""
    spec = clause["spec"]
    kind = clause["kind"]
    value = bound(spec["metavariable"]) if isinstance(spec, dict) and "metavariable" in spec else None
    if kind == "custom-condition":
        if extensions is None or spec["name"] not in extensions.conditions:
            raise KeyError(f"no condition {spec['name']!r} among the run's extensions")
        return extensions.condition(spec["name"], F.col("matched") if value is None else value)
    if kind == "metavariable-regex":
        return regex_condition(value, spec["regex"])
    if kind == "metavariable-name":
        return name_condition(value, spec.get("name") or spec["pattern"])
    if kind == "metavariable-comparison":
        return compare(value, spec["operator"], str(spec["value"])) if "operator" in spec else expression(spec["comparison"])
    if kind == "where":
        return expression(spec)
    if kind == "metavariable-pattern":
        return F.coalesce(F.contains(value, F.lit(spec["pattern"])), F.lit(False))
    ok = F.lit(True)
    if e := spec.get("entropy"):
        h = entropy(value)
        ok = ok & (h >= e.get("min", 0.0)) & (h <= e.get("max", 64.0)) & charset(value, e.get("charset", "any"))
    if t := spec.get("type"):
        ok = ok & type_condition(value, t.get("expected", []), t.get("forbidden", []))
    if c := spec.get("complexity"):
        ok = ok & max_lines(value, c["max_lines"])
    return F.coalesce(ok, F.lit(False))

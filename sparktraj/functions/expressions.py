"""Expressions of computed properties and selections, as Spark columns.

The surface syntax has ``^``, ``&&``, ``||`` and ``?:`` besides what Python writes alike; these are respelt and Python's own ``ast`` does the
parsing.  All values are doubles; comparisons give 0 or 1, and what isn't 0 counts as true.  Division, logarithms and roots follow
IEEE rules instead of failing or giving null.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _truth(c: Column) -> Column:
    return c.cast("double")


def divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))


def _log(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x > 0, fn(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def _total(*xs: Column) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "ln": _log(F.log), "log": _log(F.log), "log10": _log(F.log10), "log2": _log(F.log2), "rint": lambda x: F.floor(x + 0.5).cast("double"), "sign": F.signum,
    "fmod": lambda a, b: F.when(b != 0, F.try_mod(a, b)).otherwise(F.lit(NAN)),
    "min": lambda *x: F.least(*x) if len(x) > 1 else x[0], "max": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
    "sum": _total, "avg": lambda *x: _total(*x) / len(x),
}

_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: divide, ast.Pow: F.pow,
}
_COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}


def variable_name(property_: str) -> str:
    """The name of a property in expressions: letters, digits, underscores and dots only, with an underscore before a leading digit."""
    name = re.sub(r"[^0-9A-Za-z_.]", "", property_)
    return f"_{name}" if name[:1].isdigit() else name


def _conditional(text: str) -> str:
    """``a ? b : c`` as Python has it, from the outermost one inwards."""
    depth, at = 0, -1
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "?" and depth == 0:
            at = k
            break
    if at < 0:
        return re.sub(r"\(([^()]*\?[^()]*)\)", lambda m: f"({_conditional(m[1])})", text) if "?" in text else text
    depth = 0
    for k in range(at + 1, len(text)):
        c = text[k]
        depth += (c in "(?") - (c == ")") - (c == ":" and depth > 0)
        if c == ":" and depth == 0:
            return f"(({_conditional(text[at + 1 : k])}) if ({_conditional(text[:at])}) else ({_conditional(text[k + 1 :])}))"
    raise ValueError(f"no ':' for '?' in {text!r}")


def compiled(text: str, variables: Mapping[str, Column]) -> Column:
    """The expression over named columns; an empty one, an unknown name or a lone ``=`` is a ValueError."""
    if not text.strip():
        raise ValueError("an expression is empty")
    if re.search(r"(?<![=!<>])=(?!=)", text):
        raise ValueError(f"'=' is no comparison; write '==': {text!r}")
    spelt = text.strip().replace("^", "**").replace("&&", " and ").replace("||", " or ")
    spelt = re.sub(r"!(?!=)", " not ", spelt).strip()
    try:
        tree = ast.parse(_conditional(spelt), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e
    names = {variable_name(k): v for k, v in reversed(list(variables.items()))}

    def name_of(n: ast.AST) -> str:
        return n.id if isinstance(n, ast.Name) else f"{name_of(n.value)}.{n.attr}" if isinstance(n, ast.Attribute) else ""

    def walk(n: ast.AST) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return F.lit(float(n.value))
        if isinstance(n, (ast.Name, ast.Attribute)):
            name = name_of(n)
            if name == "pi":
                return F.lit(math.pi)
            if name not in names:
                raise ValueError(f"unknown variable {name!r} in {text!r}")
            return names[name].cast("double")
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return _BINARY[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.UnaryOp):
            x = walk(n.operand)
            return -x if isinstance(n.op, ast.USub) else _truth(x == 0) if isinstance(n.op, ast.Not) else x
        if isinstance(n, ast.BoolOp):
            parts = [walk(x) != 0 for x in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(n.op, ast.And) else out | p
            return _truth(out)
        if isinstance(n, ast.Compare):
            # A chain goes from left to right over 0 and 1, not as Python's chains.
            out = walk(n.left)
            for op, x in zip(n.ops, n.comparators):
                out = _truth(_COMPARE[type(op)](out, walk(x)))
            return out
        if isinstance(n, ast.IfExp):
            return F.when(walk(n.test) != 0, walk(n.body)).otherwise(walk(n.orelse))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and not n.keywords:
            return FUNCTIONS[n.func.id](*map(walk, n.args))
        raise ValueError(f"not an expression: {text!r}")

    return walk(tree)

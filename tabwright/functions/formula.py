"""Row formulas such as ``[Unit Price] * [Quantity]`` as Spark expressions."""

from __future__ import annotations

import ast
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import parse_number
from .text import typed

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def formula(df: DataFrame, text: str | float, decimal: str = ".") -> Column:
    """A double column. Division by zero and unreadable cells give NULL ("could not check").

    Allowed: column names in brackets, numbers, ``+ - * /`` and parentheses.
    """
    if isinstance(text, (int, float)):
        return F.lit(float(text))
    names: list[str] = []

    def placeholder(found: re.Match) -> str:
        if found[1] not in df.columns:
            raise ValueError(f"formula {text!r}: no column {found[1]!r}; columns: {df.columns}")
        names.append(found[1])
        return f" _{len(names) - 1} "

    body = re.sub(r"\[([^\]]+)\]", placeholder, str(text))
    try:
        tree = ast.parse(body.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"formula {text!r} is not valid: {e}") from None

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
            value = build(node.operand)
            return -value if isinstance(node.op, ast.USub) else value
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and re.fullmatch(r"_\d+", node.id):
            return parse_number(*typed(df, names[int(node.id[1:])]), decimal)
        raise ValueError(f"formula {text!r}: only [Column names], numbers and + - * / ( ) are allowed")

    return build(tree)

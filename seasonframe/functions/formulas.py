"""Arithmetic formulas over allow-listed columns, turned into a (value, status) pair of columns.

Status is null for a usable value, `zero` when a denominator is zero and `invalid` for a null
input or a result that is not finite. The first failure met from left to right decides.
"""

from __future__ import annotations

import ast
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed limits of the formula language.
MAX_LENGTH = 160
MAX_DEPTH = 8

ZERO = "zero"
INVALID = "invalid"


class FormulaError(ValueError):
    """The formula is not an arithmetic expression over the allowed columns."""


@dataclass(frozen=True)
class Formula:
    text: str
    fields: tuple[str, ...]
    value: Column
    status: Column


_OPERATIONS = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
}


def compile_formula(text: str, allowed: set[str] | list[str], prefix: str = "") -> Formula:
    """Check the text and build its columns. `prefix` names a table alias such as "t."."""
    text = text.strip()
    if not text or len(text) > MAX_LENGTH:
        raise FormulaError(f"a formula needs 1 to {MAX_LENGTH} characters")
    try:
        body = ast.parse(text, mode="eval").body
    except SyntaxError as error:
        raise FormulaError("not an arithmetic expression") from error
    names: set[str] = set()
    no_failure = F.lit(None).cast("string")

    def build(node: ast.AST, depth: int) -> tuple[Column, Column]:
        if depth > MAX_DEPTH:
            raise FormulaError(f"nested deeper than {MAX_DEPTH}")
        match node:
            case ast.Name(id=name) if name in allowed:
                names.add(name)
                column = F.col(prefix + name).cast("double")
                return column, F.when(column.isNull(), INVALID)
            case ast.Constant(value=number) if type(number) in (int, float) and math.isfinite(number):
                return F.lit(float(number)), no_failure
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                value, status = build(inner, depth + 1)
                return -value, status
            case ast.UnaryOp(op=ast.UAdd(), operand=inner):
                return build(inner, depth + 1)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _OPERATIONS:
                a, a_status = build(left, depth + 1)
                b, b_status = build(right, depth + 1)
                checks = [a_status, b_status]
                if isinstance(op, ast.Div):
                    checks.append(F.when(b == 0, ZERO))
                return _OPERATIONS[type(op)](a, b), F.coalesce(*checks)
            case ast.Name(id=name):
                raise FormulaError(f"column {name!r} is not allowed")
            case _:
                raise FormulaError(f"{type(node).__name__} is not allowed")

    value, status = build(body, 1)
    if not names:
        raise FormulaError("a formula must use at least one column")
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    status = F.coalesce(status, F.when(~F.coalesce(finite, F.lit(False)), INVALID))
    return Formula(
        ast.unparse(body), tuple(sorted(names)), F.when(status.isNull(), value), status
    )

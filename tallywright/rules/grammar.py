"""A small language of predicates over one entity, compiled to columns of two-valued logic."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("eq", "neq", "in", "notIn", "isNull", "isNotNull", "gt", "lt", "gte", "lte", "between", "matches")
MAX_OPERANDS, MAX_CHILDREN = 8, 16
_NUMBER = r"^-?\d+(\.\d+)?$"
_UNSAFE = re.compile(r"(?i)(--|;|/\*|\b(select|insert|update|delete|drop|alter|union|exec)\b)")


class GrammarError(ValueError):
    pass


def _operand(x, kinds: Mapping[str, str]) -> tuple[Column, str]:
    """A literal, or {"field": name}; with its kind: number, boolean, string or null."""
    if isinstance(x, Mapping):
        name = x["field"]
        if name not in kinds:
            raise GrammarError(f"unknown field: {name}")
        return F.col(name), kinds[name]
    if isinstance(x, str) and _UNSAFE.search(x):
        raise GrammarError(f"operand looks like code: {x!r}")
    kind = "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, int | float) else "string"
    return F.lit(x), kind


def _text(c: Column, kind: str) -> Column:
    """Numbers print without a needless fraction."""
    if kind == "number":
        whole = c.cast("double") == F.floor(c.cast("double"))
        return F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def _eq(a: Column, ka: str, b: Column, kb: str) -> Column:
    """Both null; numbers and texts that look like numbers by value; else by text without regard to case."""
    both_null = a.isNull() & b.isNull()
    if "null" in (ka, kb):
        return both_null
    same = F.lower(_text(a, ka)) == F.lower(_text(b, kb))
    if {ka, kb} == {"number"}:
        same = a.cast("double") == b.cast("double")
    elif {ka, kb} == {"number", "string"}:
        s, n = (a, b) if ka == "string" else (b, a)
        same = F.when(s.rlike(_NUMBER), s.try_cast("double") == n.cast("double")).otherwise(same)
    return both_null | F.coalesce(same, F.lit(False))


def _cmp(a: Column, ka: str, b: Column, kb: str, op: str) -> Column:
    """By value if both are numbers; else by text, null as the empty one."""
    test = {"gt": lambda x, y: x > y, "lt": lambda x, y: x < y, "gte": lambda x, y: x >= y, "lte": lambda x, y: x <= y}[op]
    x, y = (F.coalesce(_text(c, k), F.lit("")) for c, k in ((a, ka), (b, kb)))
    text = test(x, y)
    if ka == kb == "number":
        return F.when(a.isNotNull() & b.isNotNull(), test(a.cast("double"), b.cast("double"))).otherwise(text)
    return text


def compile_rule(ast: Mapping, kinds: Mapping[str, str]) -> Column:
    """The column of an AST: {"op", "field", "operands"}, {"and": [..]}, {"or": [..]} or {"not": ..}. Never null.

    kinds names the entity's fields as number, boolean or string.
    """
    for word in ("and", "or"):
        if word in ast:
            parts = ast[word]
            if not 1 <= len(parts) <= MAX_CHILDREN:
                raise GrammarError(f"{word} takes 1 to {MAX_CHILDREN} clauses")
            out = compile_rule(parts[0], kinds)
            for p in parts[1:]:
                out = out & compile_rule(p, kinds) if word == "and" else out | compile_rule(p, kinds)
            return out
    if "not" in ast:
        return ~compile_rule(ast["not"], kinds)
    op, operands = ast.get("op"), list(ast.get("operands", []))
    if op not in OPS:
        raise GrammarError(f"unknown op: {op}")
    if len(operands) > MAX_OPERANDS:
        raise GrammarError(f"more than {MAX_OPERANDS} operands")
    a, ka = _operand({"field": ast["field"]}, kinds)
    rest = [_operand(x, kinds) for x in operands]
    if op in ("isNull", "isNotNull"):
        empty = a.isNull() | (F.coalesce(a.cast("string"), F.lit("")) == "")
        return empty if op == "isNull" else ~empty
    need = {"between": 2, "in": None, "notIn": None}.get(op, 1)
    if need is not None and len(rest) != need or not rest:
        raise GrammarError(f"{op} takes {need or 'some'} operands")
    if op in ("eq", "neq"):
        test = _eq(a, ka, *rest[0])
        return test if op == "eq" else ~test
    if op in ("in", "notIn"):
        test = F.lit(False)
        for b, kb in rest:
            test = test | _eq(a, ka, b, kb)
        return test if op == "in" else ~test
    if op == "between":
        return _cmp(a, ka, *rest[0], "gte") & _cmp(a, ka, *rest[1], "lte")
    if op == "matches":
        try:
            re.compile(str(operands[0]))
        except re.error:
            return F.lit(False)
        return F.coalesce(a.rlike(str(operands[0])), F.lit(False)) if ka == "string" else F.lit(False)
    return _cmp(a, ka, *rest[0], op)

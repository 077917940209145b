"""The filter language: parsing to a small tree, merging and negation."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from brindle.errors import InvalidRequest

COMPARISONS = {"$eq": "eq", "$ne": "ne", "$gt": "gt", "$gte": "ge", "$lt": "lt", "$lte": "le"}
FLIPPED = {"eq": "ne", "ne": "eq", "gt": "le", "le": "gt", "ge": "lt", "lt": "ge"}
FIELD_OPERATORS = {*COMPARISONS, "$in", "$nin", "$exists", "$type", "$size", "$all", "$elemMatch"}
#: Codes and names of types: fixed values of the language.
TYPE_CODES = {
    1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 7: "objectId", 8: "bool",
    9: "date", 10: "null", 16: "int", 17: "timestamp", 18: "long", 19: "decimal",
}
TYPE_NAMES = {*TYPE_CODES.values(), "number"}


@dataclass(frozen=True)
class Compare:
    op: str
    value: Any


@dataclass(frozen=True)
class Member:
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    wanted: bool


@dataclass(frozen=True)
class HasType:
    name: str
    negated: bool = False


@dataclass(frozen=True)
class HasSize:
    size: int
    negated: bool = False


@dataclass(frozen=True)
class HasAll:
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class ElemMatch:
    """``body`` is a tuple of predicates on the element, or a filter on its fields."""

    body: Any
    negated: bool = False


@dataclass(frozen=True)
class Field:
    path: tuple[str, ...]
    tests: tuple


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


ALWAYS = And(())
NEVER = Or(())


def check_name(name: str) -> None:
    if not name:
        raise InvalidRequest("Field names cannot be empty")
    if name.startswith("$"):
        raise InvalidRequest(f"Field names cannot start with '$': {name}")
    if "\0" in name:
        raise InvalidRequest("Field names cannot contain a null character")
    if len(name.encode()) > 255:
        raise InvalidRequest("Field names cannot be longer than 255 bytes")


def parse_path(path: Any) -> tuple[str, ...]:
    if not isinstance(path, str):
        raise InvalidRequest("Field names must be strings")
    parts = tuple(path.split("."))
    if "$" in parts:
        raise InvalidRequest(f"The positional operator is not supported here: {path}")
    for p in parts:
        check_name(p)
    return parts


def parse_filter(doc: Any) -> Any:
    """A filter document as a tree without Not and Nor: negation is pushed to the predicates."""
    if not isinstance(doc, dict):
        raise InvalidRequest("A filter must be a document")
    parts = []
    for key, arg in doc.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(arg, list | tuple):
                raise InvalidRequest(f"{key} needs an array of documents")
            branches = tuple(parse_filter(x) for x in arg)
            parts.append(_conjunction(branches) if key == "$and" else Or(branches) if key == "$or" else negate(Or(branches)))
        elif key == "$not":
            if not isinstance(arg, dict):
                raise InvalidRequest("$not needs a document")
            parts.append(negate(parse_filter(arg)))
        else:
            tests = parse_tests(arg) if isinstance(arg, dict) else (Compare("eq", arg),)
            parts.append(Field(parse_path(key), tests))
    return parts[0] if len(parts) == 1 else _conjunction(tuple(parts))


def parse_tests(operators: dict) -> tuple:
    return tuple(_test(op, arg) for op, arg in operators.items())


def _test(op: str, arg: Any):
    if op in COMPARISONS:
        return Compare(COMPARISONS[op], arg)
    if op not in FIELD_OPERATORS:
        raise InvalidRequest(f"Unknown operator: {op}")
    if op in ("$in", "$nin", "$all"):
        if not isinstance(arg, list | tuple):
            raise InvalidRequest(f"{op} needs an array")
        return HasAll(tuple(arg)) if op == "$all" else Member(tuple(arg), op == "$nin")
    if op == "$exists":
        if not isinstance(arg, bool):
            raise InvalidRequest("$exists needs a boolean")
        return Exists(arg)
    if op == "$type":
        name = TYPE_CODES.get(arg) if isinstance(arg, int) and not isinstance(arg, bool) else arg
        if name not in TYPE_NAMES:
            raise InvalidRequest(f"Unknown type: {arg}")
        return HasType(name)
    if op == "$size":
        if not isinstance(arg, int) or isinstance(arg, bool):
            raise InvalidRequest("$size needs an integer")
        return HasSize(arg)
    if not isinstance(arg, dict):
        raise InvalidRequest("$elemMatch needs a document")
    return ElemMatch(parse_tests(arg) if all(k in FIELD_OPERATORS for k in arg) else parse_filter(arg))


def _conjunction(parts: tuple):
    """One And; the tests of one field stand together, as one element of an array must pass all its bounds."""
    flat: list = []
    for p in parts:
        flat += p.parts if isinstance(p, And) else (p,)
    by_path: dict[tuple, int] = {}
    out: list = []
    for p in flat:
        if isinstance(p, Field) and p.path in by_path:
            at = by_path[p.path]
            out[at] = Field(p.path, out[at].tests + p.tests)
        else:
            if isinstance(p, Field):
                by_path[p.path] = len(out)
            out.append(p)
    return And(tuple(out))


def negate(node):
    """The opposite, as the language has it: comparisons flip, so a missing field passes neither a range nor its opposite."""
    match node:
        case And(parts):
            return Or(tuple(negate(p) for p in parts))
        case Or(parts):
            return And(tuple(negate(p) for p in parts))
        case Field(path, tests):
            flipped = tuple(Field(path, (negate(t),)) for t in tests)
            return flipped[0] if len(flipped) == 1 else Or(flipped)
        case Compare(op, value):
            return Compare(FLIPPED[op], value)
        case Exists(wanted):
            return Exists(not wanted)
        case _:
            return replace(node, negated=not node.negated)


def equalities(node, out: dict | None = None) -> dict[tuple[str, ...], Any]:
    """Values that an upsert's new document starts with: equality tests that must all hold."""
    out = {} if out is None else out
    if isinstance(node, And):
        for p in node.parts:
            equalities(p, out)
    elif isinstance(node, Field):
        for t in node.tests:
            if isinstance(t, Compare) and t.op == "eq":
                out[node.path] = t.value
    return out

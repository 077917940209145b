"""Update documents: parsing and validation of operators, paths and array filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from brindle.errors import InvalidRequest
from brindle.plans.filters import check_name, parse_filter, parse_tests

OPERATORS = (
    "$set", "$setOnInsert", "$unset", "$inc", "$mul", "$min", "$max", "$rename", "$currentDate",
    "$addToSet", "$push", "$pop", "$pull", "$pullAll", "$bit",
)
IDENTIFIER = re.compile(r"[a-z][A-Za-z0-9]*\Z")


@dataclass(frozen=True)
class Step:
    """One operator on one path; ``arg`` is what its parser made of the argument."""

    op: str
    path: tuple[str, ...]
    arg: Any


@dataclass(frozen=True)
class Push:
    values: tuple
    position: int | None = None
    slice: int | None = None
    sort: Any = None


@dataclass
class Update:
    steps: list[Step]
    filters: dict[str, Any] = field(default_factory=dict)


def update_path(text: str) -> tuple[str, ...]:
    parts = tuple(text.split("."))
    for i, p in enumerate(parts):
        if p == "$":
            raise InvalidRequest("The positional operator '$' is not supported")
        if p.startswith("$[") and p.endswith("]"):
            if i == 0:
                raise InvalidRequest(f"A path cannot start with {p}")
            if p != "$[]" and not IDENTIFIER.match(p[2:-1]):
                raise InvalidRequest(f"Bad array filter identifier: {p}")
            continue
        check_name(p)
    if parts[0] == "_id":
        raise InvalidRequest("_id cannot be changed")
    return parts


def _number(op: str, value: Any) -> Any:
    if isinstance(value, bool) or not isinstance(value, int | float) and type(value).__name__ != "Decimal":
        raise InvalidRequest(f"{op} needs a number")
    return value


def _each(op: str, arg: Any) -> tuple:
    if isinstance(arg, dict) and "$each" in arg:
        if not isinstance(arg["$each"], list | tuple):
            raise InvalidRequest("$each needs an array")
        return tuple(arg["$each"])
    return (arg,)


def _push(arg: Any) -> Push:
    known = {"$each", "$position", "$slice", "$sort"}
    if not isinstance(arg, dict) or not arg or not set(arg) <= known:
        return Push((arg,))
    if "$each" not in arg:
        raise InvalidRequest("$push modifiers need $each")
    for name in ("$position", "$slice"):
        if name in arg and (not isinstance(arg[name], int) or isinstance(arg[name], bool)):
            raise InvalidRequest(f"{name} needs an integer")
    order = arg.get("$sort")
    if isinstance(order, dict):
        if not order or any(v not in (1, -1) for v in order.values()):
            raise InvalidRequest("$sort needs 1 or -1")
        order = sorted(order.items())
    elif order not in (None, 1, -1):
        raise InvalidRequest("$sort needs 1 or -1")
    return Push(_each("$push", arg), arg.get("$position"), arg.get("$slice"), order)


def _pull(arg: Any) -> Any:
    """A criterion: None for a literal, tests on scalars, or a filter on documents."""
    if not isinstance(arg, dict):
        return ("value", arg)
    if arg and all(k.startswith("$") and k not in ("$and", "$or", "$nor", "$not") for k in arg):
        return ("tests", parse_tests(arg))
    return ("filter", parse_filter(arg))


def _argument(op: str, arg: Any) -> Any:
    if op in ("$inc", "$mul"):
        return _number(op, arg)
    if op == "$rename":
        if not isinstance(arg, str):
            raise InvalidRequest("$rename needs a field name")
        return update_path(arg)
    if op == "$currentDate":
        kind = arg.get("$type") if isinstance(arg, dict) else "date" if arg is True else None
        if kind not in ("date", "timestamp"):
            raise InvalidRequest("$currentDate needs true, or a $type of date or timestamp")
        return kind
    if op == "$addToSet":
        return _each(op, arg)
    if op == "$push":
        return _push(arg)
    if op == "$pop":
        if isinstance(arg, bool) or arg not in (1, -1):
            raise InvalidRequest("$pop needs 1 or -1")
        return arg
    if op == "$pull":
        return _pull(arg)
    if op == "$pullAll":
        if not isinstance(arg, list | tuple):
            raise InvalidRequest("$pullAll needs an array")
        return tuple(arg)
    if op == "$bit":
        if not isinstance(arg, dict) or not arg or not set(arg) <= {"and", "or", "xor"}:
            raise InvalidRequest("$bit needs and, or, or xor")
        if any(isinstance(v, bool) or not isinstance(v, int) for v in arg.values()):
            raise InvalidRequest("$bit needs integers")
        return dict(arg)
    return arg


def parse_update(doc: Any, array_filters: list[dict] | None = None) -> Update:
    if not isinstance(doc, dict) or not doc:
        raise InvalidRequest("An update must have operators")
    steps: list[Step] = []
    for op, fields in doc.items():
        if not op.startswith("$"):
            raise InvalidRequest(f"An update holds operators only, not the field {op}")
        if op not in OPERATORS:
            raise InvalidRequest(f"Unknown update operator: {op}")
        if not isinstance(fields, dict):
            raise InvalidRequest(f"{op} needs a document")
        for path, arg in fields.items():
            steps.append(Step(op, update_path(path), _argument(op, arg)))
    if not steps:
        raise InvalidRequest("An update must change a field")
    touched = [s.path for s in steps] + [s.arg for s in steps if s.op == "$rename"]
    for i, a in enumerate(touched):
        for b in touched[i + 1 :]:
            n = min(len(a), len(b))
            if a[:n] == b[:n]:
                raise InvalidRequest(f"Paths conflict: {'.'.join(a)} and {'.'.join(b)}")
    for s in steps:
        if s.op == "$rename" and any(p.startswith("$[") or p.isdigit() for p in s.path + s.arg):
            raise InvalidRequest("$rename does not go through arrays")
    return Update(steps, _array_filters(array_filters or [], steps))


def _array_filters(filters: list[dict], steps: list[Step]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for f in filters:
        names = {k.split(".")[0] for k in f}
        if len(names) != 1:
            raise InvalidRequest("An array filter names one identifier")
        name = names.pop()
        if not IDENTIFIER.match(name):
            raise InvalidRequest(f"Bad array filter identifier: {name}")
        if name in out:
            raise InvalidRequest(f"Array filter {name} is given twice")
        if set(f) == {name}:
            arg = f[name]
            scalar = not isinstance(arg, dict) or all(k.startswith("$") for k in arg)
            out[name] = parse_tests(arg if isinstance(arg, dict) else {"$eq": arg}) if scalar else parse_filter(arg)
        else:
            out[name] = parse_filter({k[len(name) + 1 :]: v for k, v in f.items()})
    used = {p[2:-1] for s in steps for p in s.path if p.startswith("$[") and p != "$[]"}
    if used - set(out):
        raise InvalidRequest(f"No array filter for {sorted(used - set(out))}")
    if set(out) - used:
        raise InvalidRequest(f"Unused array filters: {sorted(set(out) - used)}")
    return out


def check_replacement(doc: Any) -> None:
    if not isinstance(doc, dict):
        raise InvalidRequest("A replacement must be a document")
    for key in doc:
        if "." in key:
            raise InvalidRequest(f"A replacement cannot have the dotted field {key}")
        check_name(key)

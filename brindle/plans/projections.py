"""Projection documents: parsing to a tree of what to keep or drop."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from brindle.errors import InvalidRequest
from brindle.plans.filters import FIELD_OPERATORS, parse_filter, parse_path, parse_tests


@dataclass(frozen=True)
class Slice:
    skip: int
    limit: int


@dataclass(frozen=True)
class Match:
    body: Any


@dataclass
class Projection:
    include: bool
    tree: dict = field(default_factory=dict)
    with_id: bool = True


def _flag(value: Any) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and value in (0, 1) else None


def _slice(arg: Any) -> Slice:
    if isinstance(arg, int) and not isinstance(arg, bool):
        if arg == 0:
            raise InvalidRequest("$slice cannot be 0")
        return Slice(0, arg)
    if isinstance(arg, list | tuple) and len(arg) == 2 and all(isinstance(x, int) for x in arg):
        skip, limit = arg
        if skip < 0 or limit == 0 or (limit < 0 and skip):
            raise InvalidRequest("$slice needs a skip of 0 or more and a limit")
        return Slice(skip, limit)
    raise InvalidRequest("$slice needs a number or [skip, limit]")


def parse_projection(doc: Any) -> Projection:
    if not isinstance(doc, dict) or not doc:
        raise InvalidRequest("A projection must be a document with fields")
    kinds, leaves, with_id = set(), [], None
    for key, arg in doc.items():
        path = parse_path(key)
        if isinstance(arg, dict):
            if len(arg) != 1:
                raise InvalidRequest(f"One projection operator is allowed for {key}")
            (op, value), kind = next(iter(arg.items())), 1
            if op == "$slice":
                leaf: Any = _slice(value)
            elif op == "$elemMatch":
                if not isinstance(value, dict):
                    raise InvalidRequest("$elemMatch needs a document")
                leaf = Match(parse_tests(value) if all(k in FIELD_OPERATORS for k in value) else parse_filter(value))
            else:
                raise InvalidRequest(f"Unknown projection operator: {op}")
        else:
            kind = _flag(arg)
            if kind is None:
                raise InvalidRequest(f"A projection of {key} must be 0 or 1")
            leaf = True
        if path == ("_id",) and leaf is True:
            with_id = bool(kind)
            continue
        kinds.add(kind)
        leaves.append((path, leaf))
    if len(kinds) > 1:
        raise InvalidRequest("A projection cannot mix inclusion and exclusion")
    include = kinds == {1} or (not kinds and bool(with_id))
    out = Projection(include, with_id=with_id if with_id is not None else True)
    if not include and with_id is True and kinds:
        raise InvalidRequest("A projection cannot mix inclusion and exclusion")
    for path, leaf in leaves:
        at = out.tree
        for step in path[:-1]:
            at = at.setdefault(step, {})
            if not isinstance(at, dict):
                raise InvalidRequest(f"Paths collide at {'.'.join(path)}")
        if path[-1] in at:
            raise InvalidRequest(f"Paths collide at {'.'.join(path)}")
        at[path[-1]] = leaf
    return out


def parse_sort(doc: Any) -> list[tuple[tuple[str, ...], int]]:
    if not isinstance(doc, dict):
        raise InvalidRequest("A sort must be a document")
    for key, way in doc.items():
        if isinstance(way, bool) or way not in (1, -1):
            raise InvalidRequest(f"The sort order of {key} must be 1 or -1")
    return [(parse_path(k), v) for k, v in doc.items()]

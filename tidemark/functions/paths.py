"""Projection of JSON by a path that is known when the plan is built, as one expression over VARIANT."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[^.\[\]{}, ]+"
_STEP = re.compile(rf"\s*(?:(?P<all>\.\*|\[\s*\*?\s*\])|\.?\[\s*(?P<inner>[^\]]+?)\s*\]|\.?(?P<pick>\{{)|\.(?P<key>{_NAME})|(?P<first>\*|{_NAME}))")

#: Arrays right inside arrays that a key is looked up through; deeper ones give null.
NESTED = 2


def parse(path: str) -> list[tuple]:
    """Steps of a path: ``$`` (may be left out), ``.k``, ``["k"]``, ``[n]`` (negative: from the end), ``[a:b]``, ``[*]``
    or ``.*``, and ``{a, b.c}``. Anything else is a ValueError."""
    steps, end = _steps(path.strip(), 1 if path.strip().startswith("$") else 0, False)
    if end != len(path.strip()):
        raise ValueError(f"unexpected {path.strip()[end]!r} at {end} of {path!r}")
    return steps


def _steps(p: str, i: int, inner: bool) -> tuple[list[tuple], int]:
    out: list[tuple] = []
    while i < len(p) and p[i:].strip() and not (inner and re.match(r"\s*[,}]", p[i:])):
        m = _STEP.match(p, i)
        if not m or (m["first"] and out):
            raise ValueError(f"unexpected {p[i]!r} at {i} of {p!r}")
        i = m.end()
        if m["all"] or m["first"] == "*":
            out.append(("all",))
        elif m["pick"]:
            fields, i = _pick(p, i)
            out.append(("pick", fields))
        elif m["inner"]:
            out.append(_bracket(m["inner"]))
        else:
            out.append(("key", m["key"] or m["first"]))
    return out, i


def _bracket(x: str) -> tuple:
    quoted = re.fullmatch(r"([\"'])(.*)\1", x)
    if quoted:
        return ("key", quoted[2])
    if re.fullmatch(r"[+-]?\d+", x):
        return ("at", int(x))
    ends = re.fullmatch(r"([+-]?\d*)\s*:\s*([+-]?\d*)", x)
    if ends:
        return ("slice", *[int(e) if e else None for e in ends.groups()])
    if ":" in x:
        raise ValueError(f"{x!r} is no slice")
    return ("key", x)


def _pick(p: str, i: int) -> tuple[list[tuple[str, list]], int]:
    fields = []
    while True:
        steps, end = _steps(p, i, True)
        if steps:
            fields.append((p[i:end].strip(), steps))
        end += len(p[end:]) - len(p[end:].lstrip())
        if end >= len(p):
            raise ValueError(f"a brace is never closed in {p!r}")
        i = end + 1
        if p[end] == "}":
            break
    if not fields:
        raise ValueError("braces pick nothing")
    return fields, i


#: Keys that a VARIANT path can spell; others are looked up in the object as a map.
_PLAIN = re.compile(r"[^\s.\[][^.\[]*")


def _json(x: Column) -> Column:
    return F.call_function("to_variant_object", x)


def _as(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``x`` as a variable: evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _apply(v: Column, steps: list[tuple], nested: int = NESTED) -> Column:
    """The value after all steps. Each step names its input once, as a variable, so that work stays linear in the steps."""
    if not steps:
        return v
    return _as(v, lambda x: _step(x, steps, nested))


def _step(v: Column, steps: list[tuple], nested: int) -> Column:
    """The shape of a value is told by what can be had of it, not by its schema, which is made of all that it holds."""
    (kind, *arg), rest = steps[0], steps[1:]
    items, entries = v.try_cast("array<variant>"), v.try_cast("map<string,variant>")

    def each(arr: Column, todo: list[tuple], deep: int = NESTED) -> Column:
        return _json(F.transform(arr, lambda x: _apply(x, todo, deep)))

    if kind in ("key", "pick"):
        if kind == "key":
            here = F.try_variant_get(v, f"$.{arg[0]}", "variant") if _PLAIN.fullmatch(arg[0]) else F.try_element_at(entries, F.lit(arg[0]))
        else:
            here = F.when(entries.isNotNull(), _json(F.struct(*[_apply(v, s).alias(name) for name, s in arg[0]])))
        if not nested:
            return _apply(here, rest)
        return _as(here, lambda x: F.when(x.isNotNull(), _apply(x, rest)).otherwise(_as(items, lambda y: F.when(y.isNotNull(), each(y, steps, nested - 1)))))
    if kind == "at":
        if arg[0] < 0:
            return _apply(F.try_element_at(items, F.lit(arg[0])), rest)
        return _apply(F.try_variant_get(v, f"$[{arg[0]}]", "variant"), rest)
    if kind == "all":
        return each(F.coalesce(items, F.map_values(entries)), rest)

    def cut(arr: Column) -> Column:
        size = F.size(arr)
        low, high = (F.lit(d) if e is None else (F.least(F.lit(e), size) if e >= 0 else F.greatest(size + e, F.lit(0))) for e, d in zip(arg, (0, None), strict=True))
        high = size if arg[1] is None else high
        return each(F.slice(arr, low + 1, F.greatest(high - low, F.lit(0))), rest)

    return _as(items, cut)


def variant_project(v: Column, path: str) -> Column:
    """:func:`json_project` of a VARIANT, so that several paths read one parse."""
    out = F.to_json(_apply(v, parse(path)))
    return F.get(F.filter(F.array(out), lambda o: o != "null"), F.lit(0))


def json_project(x: Column, path: str) -> Column:
    """What ``path`` selects of a JSON text, as JSON; null where it selects nothing or the text is no JSON.

    A key or a pick on an array is taken from each of its items, where a missing one is null.
    """
    return variant_project(F.try_parse_json(x), path)

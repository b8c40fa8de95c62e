"""Documents held against a JSON-schema contract, down to nested fields and array elements."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from .documents import once, type_name
from .slicing import col

_FOUND = "array<struct<path: string, rule: string, found: string>>"
# The types that the contract's word "number" stands for.
_NUMBERS = ("int", "long", "double", "decimal")
#: Levels of nested rules a contract may have; each is part of one expression.
DEPTH = 12


def contract_violations(docs: DataFrame, contract: Mapping[str, Any], id_column: Column, doc: str = "doc") -> DataFrame:
    """``id, path, rule, found`` of everything in ``doc`` (a VARIANT) that breaks ``contract``.

    The contract is walked once, here, and becomes one expression over the
    document, so rows are checked where they are.  Rules: ``bsonType`` (a name
    or several; "number" is any of them), ``enum``, ``required``, ``properties``
    of objects, ``items`` of arrays.  Rules inside a field apply where it is
    there; a null is a value of type null.  ``path`` is dotted, elements are
    counted from 0, and ``$`` is the document.  ``found`` is the type or value
    that is there, null for what is missing.  A null document has no violations.
    """
    found = _walk(col(doc), contract, F.lit("$"), 0)
    # An inner explode is given a filter on what it explodes, which would be computed again for it.
    rows = docs.select(id_column.alias("id"), F.explode_outer(found).alias("v")).filter("v IS NOT NULL")
    return rows.select("id", "v.path", "v.rule", "v.found")


def _none() -> Column:
    return F.array().cast(_FOUND)


def _broken(when: Column, path: Column, rule: str, found: Column) -> Column:
    one = F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"), found.cast("string").alias("found"))).cast(_FOUND)
    return F.when(when, one).otherwise(_none())


def _field(value: Column, name: str) -> Column:
    quote = "'" if "'" not in name else '"'
    if quote in name:
        raise SpecError(f"the field name {name!r} holds both kinds of quotes, which no path can say")
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def _inside(path: Column, name: str) -> Column:
    return F.when(path == "$", F.lit(name)).otherwise(F.concat(path, F.lit("." + name)))


def _walk(value: Column, rule: Mapping[str, Any], path: Column, depth: int) -> Column:
    """Violations of one value; empty where there is no value.

    The value, its type and its path are bound before the rules name them: each
    level would else repeat all above it, and the work grow by powers.
    """
    if depth > DEPTH:
        raise SpecError(f"the contract nests deeper than {DEPTH} levels")
    return once(value, lambda v: F.when(v.isNotNull(), once(type_name(v), lambda kind: once(
        path, lambda at: _rules(v, kind, rule, at, depth)))).otherwise(_none()))


def _rules(value: Column, kind: Column, rule: Mapping[str, Any], path: Column, depth: int) -> Column:
    """Violations of a value that is there and has the type ``kind``."""
    parts = []
    given = rule.get("bsonType")
    allowed = [given] if isinstance(given, str) else list(given or ())
    if "number" in allowed:
        allowed = [*allowed, *_NUMBERS]
    if allowed:
        parts.append(_broken(~kind.isin(*allowed), path, "bsonType", kind))
    if "enum" in rule:
        labels = [_label(v) for v in rule["enum"]]
        said = F.to_json(value)
        parts.append(_broken(~said.isin(*labels), path, "enum", said))
    is_object = kind == "object"
    for name in rule.get("required") or ():
        parts.append(_broken(is_object & _field(value, name).isNull(), _inside(path, name), "required", F.lit(None)))
    for name, inner in (rule.get("properties") or {}).items():
        parts.append(_walk(_field(value, name), inner, _inside(path, name), depth + 1))
    if rule.get("items"):
        elements = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(
            F.coalesce(elements, F.array().cast("array<variant>")),
            lambda x, i: _walk(x, rule["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1))
        parts.append(F.when(kind == "array", F.flatten(each)).otherwise(_none()))
    return F.concat(*parts) if parts else _none()


def _label(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))

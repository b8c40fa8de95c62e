"""JSON text: validity, canonical form, and escaping.

The canonical form sorts keys and keeps every number's source digits.  Spark's
variant type sorts keys but re-renders some numbers (``1.50`` as ``1.5``), so
documents holding such numbers, and only those, pass through a small Arrow
function; the rest stay in the JVM.
"""

from __future__ import annotations

import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Arrow function below travels with its helpers, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Numbers whose digits a variant may change: fractions, exponents, long ones.
_DIGITS_AT_RISK = r"[0-9][.eE]|[0-9]{16}"

# JSON's two-character escapes.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"),
            ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
_NEEDS_ESCAPE = r'[\x00-\x1f"\\]'




class _Digits(str):
    """A number kept as its source digits."""


def _dump(value, indent: int | None, depth: int = 0) -> str:
    if isinstance(value, _Digits):
        return str(value)
    if not isinstance(value, (dict, list)) or not value:
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        colon = ":" if indent is None else ": "
        items = [
            json.dumps(k, ensure_ascii=False) + colon + _dump(value[k], indent, depth + 1)
            for k in sorted(value, key=lambda s: s.encode("utf-8", "surrogatepass"))
        ]
        left, right = "{", "}"
    else:
        items = [_dump(v, indent, depth + 1) for v in value]
        left, right = "[", "]"
    if indent is None:
        return left + ",".join(items) + right
    gap = "\n" + " " * indent * (depth + 1)
    return left + gap + ("," + gap).join(items) + "\n" + " " * indent * depth + right


def _refuse(name):
    raise ValueError(name)


def render_json(text: str, indent: int | None = None, depth: int = 0) -> str | None:
    """Sorted keys, source digits; None when the text is no JSON."""
    try:
        value = json.loads(text, parse_float=_Digits, parse_int=_Digits, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return _dump(value, indent, depth)


@F.arrow_udf(T.StringType())
def _exact(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), pa.string())
    return pa.array(
        [None if t is None else render_json(t) for t in texts.to_pylist()], pa.string())


def is_json(c: Column) -> Column:
    """True where the text is one valid JSON value (NULL text gives NULL).

    The variant parser refuses an object that repeats a key, which is JSON all
    the same; only what it refuses is looked at again.
    """
    parsed = F.try_parse_json(c).isNotNull()
    return F.when(c.isNotNull(), parsed | _exact(F.when(~parsed, c)).isNotNull())


def canonical_json(c: Column, exact: bool = True) -> Column:
    """Sorted-key JSON; text that is no JSON is returned as it is.

    ``exact=False`` skips the digit-preserving step, for documents known to
    hold no fractions, exponents or very long integers.
    """
    fast = F.to_json(F.try_parse_json(c))
    if not exact:
        return F.coalesce(fast, c)
    # A document the variant parser refuses (duplicate keys) goes the slow way
    # too.  Rows on the fast way reach Python as NULL.
    slow = c.rlike(_DIGITS_AT_RISK) | F.try_parse_json(c).isNull()
    return F.coalesce(_exact(F.when(slow, c)), F.when(~slow, fast), c)


def escape(c: Column) -> Column:
    """Body of a JSON string literal: only what must be escaped is."""
    out = c
    for plain, escaped in _ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    for code in range(0x20):
        if chr(code) not in "\n\r\t\b\f":
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(c.rlike(_NEEDS_ESCAPE), out).otherwise(c)


def quote(c: Column) -> Column:
    return F.concat(F.lit('"'), escape(c), F.lit('"'))


def is_container(c: Column) -> Column:
    """Whether JSON text is an object or an array, by its first character."""
    return F.ltrim(c, F.lit(" \t\r\n")).rlike(r"^[\[{]")


def embed(c: Column, mode: str = "unroll") -> Column:
    """A JSON column inside a JSON row.

    ``unroll`` nests objects and arrays canonically and leaves bare scalars as
    a quoted string, so a JSON ``null`` cannot be taken for SQL NULL;
    ``string`` keeps the source text as a quoted string.
    """
    if mode == "string":
        return quote(c)
    return F.when(is_container(c), canonical_json(c)).otherwise(quote(c))

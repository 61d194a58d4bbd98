"""Canonical JSON text and its SHA-256.

Canonical means: keys sorted at every level, no white space, raw UTF-8, nulls kept.
``canonical_struct`` builds it inside the JVM from typed columns.  Text that arrives as
arbitrary JSON, and rows with extreme doubles, go through one Arrow-batched function
instead: key order inside an unknown document and the shortest digits of a double cannot
be expressed as columns.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Java prints doubles of this magnitude without an exponent, like JSON does.
PLAIN_LOW, PLAIN_HIGH = 1e-3, 1e7


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _sorted_value(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        built = F.struct(
            *[_sorted_value(value[f.name], f.dataType).alias(f.name) for f in fields]
        )
        return F.when(value.isNotNull(), built)
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
            return F.transform(value, lambda v: _sorted_value(v, dtype.elementType))
    return value


def plain_doubles(*values: Column) -> Column:
    """True where every double is null, zero or printed without an exponent."""
    ok = F.lit(True)
    for v in values:
        size = F.abs(v)
        ok = ok & (v.isNull() | (v == 0) | ((size >= PLAIN_LOW) & (size < PLAIN_HIGH)))
    return ok


def _canonical_or_none(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        made = json.dumps(
            json.loads(text), sort_keys=True, ensure_ascii=False,
            separators=(",", ":"), allow_nan=False,
        )
        made.encode("utf-8")  # a lone surrogate has no UTF-8 form
        return made
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """Canonical form of arbitrary JSON texts.

    Null where the text is not finite JSON, nests too deeply or holds a lone surrogate.
    """
    return texts.map(_canonical_or_none)


def canonical_struct(schema: T.StructType, columns: dict[str, Column] | None = None) -> Column:
    """Canonical JSON of one row given as typed columns; null if a double is not finite.

    Without doubles this is one native conversion.  With doubles, the rare rows holding
    one that Java prints with an exponent are reprinted by ``canonical_text``; all other
    rows only pass a null to it.
    """
    columns = columns or {f.name: F.col(f.name) for f in schema.fields}
    fields = sorted(schema.fields, key=lambda f: f.name)
    native = F.to_json(
        F.struct(*[_sorted_value(columns[f.name], f.dataType).alias(f.name) for f in fields]),
        {"ignoreNullFields": "false"},
    )
    doubles = [columns[f.name] for f in fields if isinstance(f.dataType, T.DoubleType)]
    if not doubles:
        return native
    plain, finite = plain_doubles(*doubles), F.lit(True)
    for v in doubles:
        finite = finite & (v.isNull() | (~F.isnan(v) & (F.abs(v) != float("inf"))))
    return F.when(plain, native).otherwise(canonical_text(F.when(finite & ~plain, native)))


def derived_id(agent: Column, upstream_ids: Column, payload_hash: Column) -> Column:
    """26-character message id that is a function of the content.

    The first 26 upper-case hex digits of a SHA-256 all lie in the id alphabet, so a
    retried message gets the same id and its second insert is a no-op.
    """
    seed = F.concat_ws("|", agent, F.array_join(upstream_ids, ","), payload_hash)
    return F.upper(F.substring(sha256_hex(seed), 1, 26))

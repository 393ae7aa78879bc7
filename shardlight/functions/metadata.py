"""Equality filters on JSON metadata.

All given keys must match at the top level. Numbers compare across integer and floating point, and true and false count as 1
and 0; strings never equal numbers; None matches a missing key or a JSON null; lists and objects compare deeply, objects
without regard to key order. Metadata that is null or no valid JSON object has no keys.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(key: str) -> str:
    """Path of a top-level key; dots in it mean nothing."""
    if "'" not in key:
        return f"$['{key}']"
    if '"' not in key:
        return f'$["{key}"]'
    raise ValueError(f"a key with both kinds of quotes can't be filtered on: {key!r}")


def _matches(doc: Column, key: str, value: Any) -> Column:
    path = _path(key)
    item = F.try_variant_get(doc, path, "variant")
    kind = F.schema_of_variant(item)
    if value is None:
        return item.isNull() | F.is_variant_null(item)
    if isinstance(value, (bool, int, float)):
        numeric = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")
        return numeric & (F.try_variant_get(doc, path, "double") == float(value))
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(doc, path, "string") == value)
    wanted = F.to_json(F.parse_json(F.lit(json.dumps(value))))
    return (kind.startswith("ARRAY") | kind.startswith("OBJECT")) & (F.to_json(item) == wanted)


def metadata_filter(metadata: Column, wanted: dict[str, Any] | None) -> Column:
    """Whether a JSON string column matches all of ``wanted``; no filter matches every row."""
    result = F.lit(True)
    doc = F.try_parse_json(metadata)
    for key, value in (wanted or {}).items():
        result = result & F.coalesce(_matches(doc, key, value), F.lit(value is None))
    return result

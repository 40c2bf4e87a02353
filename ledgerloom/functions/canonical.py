"""Strict JSON, canonical bytes and identity hashes. What Spark has no expression for runs in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Refused(ValueError):
    """Carries an error code."""


def _no_constant(_: str):
    raise Refused("PX_E_4009")


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Refused("PX_E_4007")
    return out


def load_strict(data: bytes | str) -> object:
    """A JSON value, or Refused: 4006 no JSON, 4007 repeated key, 4009 NaN or Infinity, 4010 no UTF-8. Integers keep all digits."""
    if isinstance(data, bytes):
        try:
            data = data.decode("utf-8")
        except UnicodeDecodeError:
            raise Refused("PX_E_4010") from None
    try:
        return json.loads(data, object_pairs_hook=_unique, parse_constant=_no_constant)
    except Refused:
        raise
    except (ValueError, RecursionError):
        raise Refused("PX_E_4006") from None


def nfc_value(v: object, keys=_unique) -> object:  # noqa: ANN001
    """All strings in NFC; keys that become equal are refused, or left to ``keys``."""
    if isinstance(v, str):
        return unicodedata.normalize("NFC", v)
    if isinstance(v, list):
        return [nfc_value(x, keys) for x in v]
    if isinstance(v, dict):
        return keys([(unicodedata.normalize("NFC", k), nfc_value(x, keys)) for k, x in v.items()])
    return v


def _has_float(v: object) -> bool:
    if isinstance(v, float):
        return True
    return any(map(_has_float, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else False


def canonical_text(v: object) -> str:
    """Canonical JSON: NFC, keys by code point, no blanks, no floats, one line feed at the end."""
    v = nfc_value(v)
    if _has_float(v):
        raise Refused("PX_E_4008")
    return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n"


def jcs_bytes(v: object) -> bytes:
    """JSON with keys ordered by UTF-16 code units, no line feed."""

    def ordered(x):
        if isinstance(x, dict):
            return {k: ordered(x[k]) for k in sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
        return [ordered(y) for y in x] if isinstance(x, list) else x

    return json.dumps(ordered(v), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")


# The fields that make up a claim's identity.
IDENTITY = ("annotations", "author", "author_uri", "confidence", "labels", "locale", "object", "predicate", "source", "state", "subject", "tags", "type")


def identity(payload: dict) -> dict:
    """The identity projection: its fields alone, in NFC (of keys that become equal the last counts), tags sorted."""
    kept = {k: nfc_value(v, dict) for k, v in payload.items() if k in IDENTITY}
    if isinstance(kept.get("tags"), list):
        kept["tags"] = sorted(kept["tags"])
    return kept


def content_hash(payload: dict) -> str:
    return hashlib.sha256(jcs_bytes(identity(payload))).hexdigest()


def _checked(f, s: pd.Series) -> pd.DataFrame:
    rows = []
    for x in s:
        try:
            rows.append((None, None) if x is None else (f(x), None))
        except Refused as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["value", "code"])


def canonical_json(c: Column) -> Column:
    """struct<value, code> of JSON texts: the canonical text, or the code of what is wrong. Null gives nulls."""

    @F.pandas_udf("value string, code string")
    def run(s: pd.Series) -> pd.DataFrame:
        return _checked(lambda x: canonical_text(load_strict(x)), s)

    return run(c)


def identity_hash(c: Column) -> Column:
    """struct<value, code> of JSON objects: the content hash."""

    @F.pandas_udf("value string, code string")
    def run(s: pd.Series) -> pd.DataFrame:
        def one(x: str) -> str:
            v = load_strict(x)
            if not isinstance(v, dict):
                raise Refused("PX_E_1001")
            return content_hash(v)

        return _checked(one, s)

    return run(c)


def nfc(c: Column) -> Column:
    """NFC of a text; ASCII texts pass as they are."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    return run(c)


def three_places(x: float) -> str:
    """A confidence on the wire, rounded half to even on its binary value; outside [0, 1] it is refused before rounding."""
    if not 0 <= x <= 1:
        raise Refused("PX_E_4102")
    return format(round(x, 3), ".3f")


KINDS = {bool: "boolean", str: "string", dict: "object", list: "array", int: "number", float: "number", type(None): "null"}
PART = "struct<kind:string,text:string>"
SHAPE = f"code string, kind string, fields map<string,{PART}>, items array<{PART}>"


def _part(v: object) -> dict:
    return {"kind": KINDS[type(v)], "text": v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)}


def shape(c: Column) -> Column:
    """struct<code, kind, fields, items> of JSON texts under the strict reader: what is wrong with it, or the value's kind and
    its parts, each with kind and text (strings as they are, other values as JSON). Null gives nulls."""

    @F.pandas_udf(SHAPE)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                v = None if x is None else load_strict(x)
            except Refused as e:
                rows.append((str(e), None, None, None))
                continue
            fields = {k: _part(y) for k, y in v.items()} if isinstance(v, dict) else None
            rows.append((None, None if x is None else KINDS[type(v)], fields, [_part(y) for y in v] if isinstance(v, list) else None))
        return pd.DataFrame(rows, columns=["code", "kind", "fields", "items"])

    return run(c)

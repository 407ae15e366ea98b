"""Credential-like values in text: key blocks, service tokens, and assigned secrets."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of key material.
PEM = r"(?i)-----BEGIN(?: [A-Z0-9]+){0,4} PRIVATE KEY-----"
SERVICE = r"(?:^|[^A-Za-z0-9_])(?:gh[pousr]_?[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{20,}|githubpat[A-Za-z0-9]{20,})(?=$|[^A-Za-z0-9_])"
COMMON = r"\b(?:AKIA[0-9A-Z]{16}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[baprs]-[A-Za-z0-9-]{16,})\b"
KEYS = r"(?:password|passphrase|passwd|pwd|secret|token|api[-_ ]?key|access[-_ ]?token|auth(?:orization)?|client[-_ ]?secret|private[-_ ]?key)"
ASSIGNED = rf"(?i)(?:\\?[\"'])?{KEYS}(?:\\?[\"'])?\s*[=:]\s*(?:bearer\s+)?[\"']?([^\s\"',;}}\]]+)"
#: Values that documentation puts in place of a secret.
PLACEHOLDER = r"(?i)^(?:[<$%{\[(].*|.*[>}\])]|x+|\*+|\.+|(?:your|my|the|example|sample|test|dummy|fake|placeholder|changeme|redacted|none|null|true|false|string|boolean|required|optional|process\.env.*|os\.environ.*|env\..*)(?:[-_ .].*)?)$"


def has_service_token(text: Column) -> Column:
    return text.rlike(PEM) | text.rlike(SERVICE) | text.rlike(COMMON)


def assigned_values(text: Column) -> Column:
    """Values assigned to credential keys, without placeholders: eight characters or more with a digit or mixed case."""
    values = F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(1))
    return F.filter(values, lambda v: (F.length(v) >= 8) & ~v.rlike(PLACEHOLDER) & (v.rlike("[0-9]") | (v.rlike("[a-z]") & v.rlike("[A-Z]"))))


def has_credential(text: Column) -> Column:
    return F.coalesce(has_service_token(text) | (F.size(assigned_values(text)) > 0), F.lit(False))


#: Words that documentation writes where a secret would stand.
DOCUMENTATION = frozenset(
    "a an the and or of to in is are it no not never none null nil true false your my user users name example examples sample placeholder placeholders string text boolean object type types value values variable field format optional required "
    "default defaults empty unset enabled disabled managed generated provided documented configuration config settings environment env header parameter property schema reference docs documentation guide policy rotation rotate storage store stores "
    "stored secure securely encrypted hashed hash salted masked opaque scoped token tokens secret secrets password passwords passphrase key keys bearer basic authentication authorization oauth api access client server application app login account "
    "changeme change me here redacted hidden xxx process os environ".split()
)
PART = re.compile(rf"""(?i)(?<![A-Za-z0-9])(?P<quote>\\?["'])?(?P<key>{KEYS})(?:\\?["'])?\s*(?P<sign>:=|=>|[=:])\s*(?:bearer\s+|basic\s+)?(?P<value>\\?"[^"\n]*"?|'[^'\n]*'?|`[^`\n]*`?|[^\s,;]+)""")
EXACT = re.compile(rf"(?i)^{KEYS}$")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})")
MAX_JSON = 64


def unescaped(text: str) -> str:
    """Text with JSON's four-digit escapes put in place."""
    return ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)


def says_nothing(value: str) -> bool:
    """Whether an assigned value is documentation: words of prose about secrets, or marks only."""
    words = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", value).lower())
    return all(w in DOCUMENTATION or len(set(w)) == 1 for w in words)


def _json_values(text: str) -> Iterator[object]:
    """JSON objects and lists that stand in a text, at most 64 starts are tried."""
    decoder, at = json.JSONDecoder(), 0
    for _ in range(MAX_JSON):
        found = re.compile(r"[{\[]").search(text, at)
        if not found:
            return
        try:
            value, at = decoder.raw_decode(text, found.start())
            yield value
        except (ValueError, RecursionError):
            at = found.end()


def _json_secret(value: object, depth: int = 0) -> bool:
    if depth > 64:
        return True
    if isinstance(value, dict):
        own = any(EXACT.match(str(k)) and (isinstance(v, str) and not says_nothing(v) or isinstance(v, (int, float)) and not isinstance(v, bool)) for k, v in value.items())
        return own or any(_json_secret(v, depth + 1) for v in value.values())
    if isinstance(value, list):
        return any(_json_secret(v, depth + 1) for v in value)
    return isinstance(value, str) and looks_secret(value, depth + 1)


def looks_secret(text: str, depth: int = 0) -> bool:
    """Whether a text holds a key block, a service token, an assignment to a credential's name, or JSON with one; nested encodings are opened."""
    if re.search(PEM, text) or re.search(SERVICE, text) or re.search(COMMON, text):
        return True
    for m in PART.finditer(text):
        value = m["value"].strip("\\\"'`")
        prose = m["sign"] == ":" and not m["quote"] and m["value"] == value and not re.search(r"[0-9]|[a-z][A-Z]", value)
        if value and not says_nothing(value) and not prose:
            return True
    if depth <= 8 and ESCAPE.search(text) and looks_secret(unescaped(text), depth + 1):
        return True
    return any(_json_secret(v, depth) for v in _json_values(text))


@F.pandas_udf(T.BooleanType())
def text_has_secret(text: pd.Series) -> pd.Series:
    """looks_secret of each text; null has none."""
    return pd.Series([t is not None and looks_secret(t) for t in text], dtype="bool")

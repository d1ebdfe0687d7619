"""PII detection and masking over whole texts (documented in the reference, no code there).

Plain ``regexp_replace`` / ``regexp_count`` expressions: they run per row inside
codegen over the full text, never a prefix.  Patterns avoid ``\\b`` and
look-arounds so that they mean the same in Java regex and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is detected, in masking order, and its replacement token.
PII_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("card", r"[0-9]{13,19}", "[CARD]"),
    ("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]"),
)


def pii_counts(text: Column) -> dict:
    """``{n_<kind>: count}`` of each kind, counted on the text as masked so far
    (so a card number inside an e-mail is not counted twice)."""
    out, cur = {}, text
    for kind, pattern, token in PII_PATTERNS:
        out[f"n_{kind}"] = F.regexp_count(cur, F.lit(pattern)).cast("bigint")
        cur = F.regexp_replace(cur, pattern, token)
    return out


def mask_pii(text: Column) -> Column:
    """The text with every detected item replaced by its token."""
    cur = text
    for _, pattern, token in PII_PATTERNS:
        cur = F.regexp_replace(cur, pattern, token)
    return cur

"""Row-level projection and validation.

Everything is a per-row expression (``array_compact`` of ``when`` checks), so it
runs inside whole-stage codegen and never shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align_columns(df: DataFrame, features: Sequence[str], fill=0) -> DataFrame:
    """Project to the model's feature list in order; absent columns become ``fill``."""
    present = set(df.columns)
    return df.select(*[F.col(f"`{f}`") if f in present else F.lit(fill).alias(f) for f in features])


def select_features(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Keep the named features (default: all)."""
    return df.select(*names) if names else df


@dataclass
class RowRule:
    """A row check: ``ok`` is true for valid rows; ``reason`` is recorded otherwise."""

    reason: str
    ok: Callable[[], Column]


def range_rule(column: str, lo: float | None = None, hi: float | None = None) -> RowRule:
    def ok():
        c = F.col(column)
        cond = c.isNotNull()
        if lo is not None:
            cond = cond & (c >= lo)
        if hi is not None:
            cond = cond & (c <= hi)
        return cond
    return RowRule(f"{column} out of range", ok)


def enum_rule(column: str, values: Sequence[str]) -> RowRule:
    return RowRule(f"{column} not allowed", lambda: F.col(column).isin(list(values)))


def regex_rule(column: str, pattern: str) -> RowRule:
    """Full match, as a pydantic ``^...$`` pattern."""
    return RowRule(f"{column} bad format", lambda: F.col(column).cast("string").rlike(pattern))


def not_null_rule(column: str) -> RowRule:
    return RowRule(f"{column} is null", lambda: F.col(column).isNotNull())


def with_reasons(df: DataFrame, rules: Sequence[RowRule], col: str = "reasons") -> DataFrame:
    """Adds ``reasons``: the reasons of every failed rule (NULL counts as failed)."""
    checks = [F.when(~F.coalesce(r.ok(), F.lit(False)), F.lit(r.reason)) for r in rules]
    return df.withColumn(col, F.array_compact(F.array(*checks)))


def quarantine_rows(df: DataFrame, rules: Sequence[RowRule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reasons): two filters over one projection."""
    tagged = with_reasons(df, rules)
    return tagged.where(F.size("reasons") == 0).drop("reasons"), tagged.where(F.size("reasons") > 0)


# Error texts of prediction input/output validation.
MSG_MISSING_REQUIRED = "Missing required features: "
MSG_SHOULD_BE = {"number": "should be numeric", "string": "should be string", "integer": "should be integer"}
MSG_MISSING_PREDICTION = "Missing 'prediction' field in output"


def _json_kind(v: Column) -> Column:
    """number / integer / string / other for a variant value."""
    t = F.schema_of_variant(v)
    return (F.when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number")
            .when(t == "STRING", "string").otherwise("other"))


def validate_input(df: DataFrame, json_col: str, required: Sequence[str], properties: Mapping[str, str],
                   out: str = "errors") -> DataFrame:
    """Per record: required features that are missing, and values of the wrong JSON type."""
    doc = F.parse_json(F.col(json_col))
    keys = F.json_object_keys(F.col(json_col))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), keys))
    checks = [F.when(F.size(missing) > 0, F.concat(F.lit(MSG_MISSING_REQUIRED), F.array_join(missing, ", ")))]
    for name, typ in properties.items():
        v = F.variant_get(doc, f"$.{name}", "variant")
        kind = _json_kind(v)
        ok = (kind.isin("integer", "number") if typ == "number" else kind == typ)
        checks.append(F.when(v.isNotNull() & ~ok, F.lit(f"Feature '{name}' {MSG_SHOULD_BE[typ]}")))
    return df.withColumn(out, F.array_compact(F.array(*checks)))


def validate_output(df: DataFrame, prediction: str = "prediction", probability: str = "probability",
                    out: str = "errors") -> DataFrame:
    """``prediction`` present; ``probability`` (when given) within [0, 1]."""
    p = F.col(probability)
    checks = [F.when(F.col(prediction).isNull(), F.lit(MSG_MISSING_PREDICTION)),
              F.when(p.isNotNull() & ~p.between(0, 1),
                     F.concat(F.lit("Probability "), p.cast("string"), F.lit(" not in valid range [0, 1]")))]
    return df.withColumn(out, F.array_compact(F.array(*checks)))


def missing_keys(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` with no match in ``right`` (set difference by key, ``left_anti``)."""
    return left.join(right, on, "left_anti")


def difference(left: DataFrame, right: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Set difference of whole rows: ``subtract`` (distinct) or ``exceptAll`` (multiset)."""
    return left.exceptAll(right) if keep_duplicates else left.subtract(right)

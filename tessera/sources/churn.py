"""Customer churn data (S16) and its rule score.

Rows are generated from the keys of an input DataFrame (e.g. the customer
table), so the work grows with that table and is spread like it.  Every random
draw is a hash of (key, draw number, seed) -- never ``rand()`` -- so a row's
values do not depend on partitioning or on which executor computes it, and a
recomputed partition after executor loss is identical.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.transforms import uniform

# Categories and their probabilities.
CONTRACTS = ("Month-to-month", "One year", "Two year")
CONTRACT_P = (0.55, 0.25, 0.20)
CONTRACT_P_DRIFT = (0.70, 0.20, 0.10)
PAYMENTS = ("Electronic check", "Mailed check", "Bank transfer", "Credit card")
PAYMENT_P = (0.35, 0.20, 0.25, 0.20)
INTERNET = ("DSL", "Fiber optic", "No")
INTERNET_P = (0.45, 0.40, 0.15)
ADDON_YES_P = {"online_security": 0.35, "online_backup": 0.40, "device_protection": 0.35,
               "tech_support": 0.30, "streaming_tv": 0.45, "streaming_movies": 0.45}
PHONE_YES_P = 0.90
MULTIPLE_LINES_YES_P = 0.45
SENIOR_P = 0.15
PARTNER_YES_P = 0.50
DEPENDENTS_YES_P = 0.30
PAPERLESS_YES_P = 0.60
TENURE_MEAN, TENURE_MIN, TENURE_MAX = 24.0, 1, 72
CHARGE_MEAN, CHARGE_SD, CHARGE_MIN, CHARGE_MAX = 65.0, 30.0, 20.0, 120.0
DRIFT_CHARGE_FACTOR = 1.3
DRIFT_CHURN_FACTOR = 1.5
# What each trait adds to the churn probability, and the bounds of the sum.
MONTH_TO_MONTH, ELECTRONIC_CHECK, FIBER = 0.25, 0.15, 0.10
LONG_TENURE, LONG_TENURE_WEIGHT = 24, -0.15
LONGER_TENURE, LONGER_TENURE_WEIGHT = 48, -0.10
TECH_SUPPORT, ONLINE_SECURITY, SENIOR = -0.10, -0.08, 0.05
HIGH_CHARGES, HIGH_CHARGES_WEIGHT = 80, 0.10
LEAST_CHURN, MOST_CHURN = 0.05, 0.95


def choice(u: Column, values: Sequence[str], probs: Sequence[float]) -> Column:
    """Categorical draw by cumulative thresholds on one uniform."""
    expr = None
    acc = 0.0
    for v, p in zip(values[:-1], probs[:-1]):
        acc += p
        expr = (F.when(u < acc, F.lit(v)) if expr is None else expr.when(u < acc, F.lit(v)))
    return expr.otherwise(F.lit(values[-1])) if expr is not None else F.lit(values[-1])


def yes_no(u: Column, p_yes: float) -> Column:
    return F.when(u < p_yes, "Yes").otherwise("No")


def churn_rule_score(contract: Column, payment: Column, internet: Column, tenure: Column, tech_support: Column,
                     online_security: Column, senior: Column, monthly_charges: Column, drift: bool = False
                     ) -> Column:
    """Additive churn probability, clipped to [0.05, 0.95] (×1.5 and capped at 0.95 under drift)."""
    add = lambda cond, weight: F.when(cond, weight).otherwise(0.0)
    score = (add(contract == "Month-to-month", MONTH_TO_MONTH) + add(payment == "Electronic check", ELECTRONIC_CHECK)
             + add(internet == "Fiber optic", FIBER) + add(tenure > LONG_TENURE, LONG_TENURE_WEIGHT)
             + add(tenure > LONGER_TENURE, LONGER_TENURE_WEIGHT) + add(tech_support == "Yes", TECH_SUPPORT)
             + add(online_security == "Yes", ONLINE_SECURITY) + senior.cast("double") * SENIOR
             + add(monthly_charges > HIGH_CHARGES, HIGH_CHARGES_WEIGHT))
    p = F.least(F.greatest(score, F.lit(LEAST_CHURN)), F.lit(MOST_CHURN))
    if drift:
        p = F.least(F.greatest(p * DRIFT_CHURN_FACTOR, F.lit(0.0)), F.lit(MOST_CHURN))
    return p


def generate_churn(keys: DataFrame, key_col: str, seed: int = 42, drift: bool = False) -> DataFrame:
    """21-column churn table, one row per key of ``keys``."""
    k = F.col(key_col)

    def u(i: int) -> Column:
        return uniform(seed, k, F.lit(i))

    tenure = F.least(F.greatest((-TENURE_MEAN * F.log(1 - u(1))).cast("int"), F.lit(TENURE_MIN)),
                     F.lit(TENURE_MAX))
    # Box–Muller normal from two uniforms
    z = F.sqrt(-2.0 * F.log(1 - u(2))) * F.cos(2 * math.pi * u(3))
    base = F.least(F.greatest(F.lit(CHARGE_MEAN) + CHARGE_SD * z, F.lit(CHARGE_MIN)), F.lit(CHARGE_MAX))
    if drift:
        base = base * DRIFT_CHARGE_FACTOR
    internet = choice(u(6), INTERNET, INTERNET_P)
    phone = yes_no(u(13), PHONE_YES_P)
    cols = {
        "customer_id": F.format_string("CUST_%06d", k.cast("bigint")),
        "gender": F.when(u(15) < 0.5, "Male").otherwise("Female"),
        "senior_citizen": (u(16) < SENIOR_P).cast("int"),
        "partner": yes_no(u(17), PARTNER_YES_P),
        "dependents": yes_no(u(18), DEPENDENTS_YES_P),
        "tenure": tenure,
        "phone_service": phone,
        "multiple_lines": F.when(phone == "No", "No phone service").otherwise(yes_no(u(14), MULTIPLE_LINES_YES_P)),
        "internet_service": internet,
    }
    for i, (name, p) in enumerate(ADDON_YES_P.items()):
        cols[name] = F.when(internet == "No", "No internet service").otherwise(yes_no(u(7 + i), p))
    cols["contract"] = choice(u(4), CONTRACTS, CONTRACT_P_DRIFT if drift else CONTRACT_P)
    cols["paperless_billing"] = yes_no(u(19), PAPERLESS_YES_P)
    cols["payment_method"] = choice(u(5), PAYMENTS, PAYMENT_P)
    cols["monthly_charges"] = F.round(base, 2)
    out = keys.select(k).select(*[v.alias(n) for n, v in cols.items()], k.alias("__k"))
    out = out.withColumn("total_charges", F.round(F.col("monthly_charges") * F.col("tenure")
                                                 * (0.9 + 0.2 * uniform(seed, F.col("__k"), F.lit(20))), 2))
    prob = churn_rule_score(F.col("contract"), F.col("payment_method"), F.col("internet_service"), F.col("tenure"),
                            F.col("tech_support"), F.col("online_security"), F.col("senior_citizen"),
                            F.col("monthly_charges"), drift)
    out = out.withColumn("churn", (uniform(seed, F.col("__k"), F.lit(21)) < prob).cast("int"))
    return out.drop("__k")

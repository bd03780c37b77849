"""Thresholds of the analyses, and their overrides by scope."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Coefficients:
    # The defaults of the analyses.
    easy: float = 0.8
    hard: float = 0.3
    discrimination_strong: float = 0.4
    discrimination_medium: float = 0.2
    low_correlation: float = 0.12
    systemic_average: float = 50.0
    spot_minimum: float = 20.0
    pass_mark: float = 60.0
    default_maximum: float = 100.0
    min_students: int = 9
    min_token_length: int = 2
    duplicate: float = 0.85
    rejected_duplicate: float = 0.7
    text_weight: float = 0.6
    semantic_weight: float = 0.4
    alignment_low: float = 0.15
    alignment_medium: float = 0.4
    coverage_medium: float = 0.33
    coverage_high: float = 0.67
    validation_low: float = 0.3
    validation_high: float = 0.95
    validation_attempts: int = 5
    complete_students: int = 10
    similar_row: float = 35.0
    similar_alert: float = 55.0

    def with_values(self, **values) -> Coefficients:
        return replace(self, **values)


DEFAULT = Coefficients()


def resolve_overrides(overrides: DataFrame, subjects: DataFrame) -> DataFrame:
    """The coefficient of each row of subjects (``discipline, specialty, category, coef_key``).

    The discipline's override wins over the specialty's, that over the global one; without any it is
    0. overrides: ``scope_type, scope_value, category, coef_key, coef_value``, of one scope and key
    the greatest value counts.
    """
    keys = ["category", "coef_key"]
    out = subjects
    for scope, column in (("discipline", "discipline"), ("specialty", "specialty"), ("global", None)):
        own = overrides.where(F.col("scope_type") == scope)
        own = own.groupBy(*keys, "scope_value").agg(F.max("coef_value").alias(f"__{scope}"))
        if column:
            out = out.join(own.withColumnRenamed("scope_value", column), [*keys, column], "left")
        else:
            own = own.groupBy(*keys).agg(F.max(f"__{scope}").alias(f"__{scope}"))
            out = out.join(own, keys, "left")
    value = F.coalesce("__discipline", "__specialty", "__global", F.lit(0.0))
    return out.select(*subjects.columns, value.alias("coef_value"))

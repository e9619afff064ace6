"""Bounds on parameter profiles, checked as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile_problems(outcome: str = "outcome_window_s", ring: str = "ring_seconds") -> Column:
    """Names of the violated rules of a profile row, in rule order."""
    c = F.col

    def unit(name: str) -> Column:
        return F.when(~c(name).between(0.0, 1.0), name)

    rules = F.array(
        unit("imb15_min"),
        F.when(~c(outcome).between(60, 300), outcome),
        F.when(c(ring) < c(outcome) + 60, ring),
        F.when(
            ~((c("bound_low") > 0) & (c("bound_low") <= 1.0) & (c("bound_high") >= 1.0)), "bounds"
        ),
        F.when((c("min_labels") < 1) | (c("efficacy_min_labels") < 1), "min_labels"),
        unit("prob_gate_min"),
        unit("efficacy_prob_gate_min"),
    )
    return F.array_compact(rules)


def check_profiles(profiles: DataFrame) -> DataFrame:
    problems = profile_problems()
    return profiles.withColumn("problems", problems).withColumn("valid", F.size(problems) == 0)

"""Validation of a stream of rows, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators import keys
from rowsmith.operators.checks import compile_checks
from rowsmith.operators.validate import Settings, Sheet, _key_rows, evaluated, row_issues
from rowsmith.plans.model import Plan, uniqueness_rules


def stream_issues(sheet: Sheet, plan: Plan, settings: Settings = Settings()) -> DataFrame:
    """Row-local issues of a streaming sheet; a plain projection, so it runs in append mode without state."""
    checks, _ = compile_checks(plan.table)
    return row_issues(evaluated(sheet, plan, settings.options), plan, checks).select(F.explode("issues").alias("i")).select("i.*")


def first_seen(stream: DataFrame, key: list[str], event_time: str, delay: str) -> DataFrame:
    """Rows of a stream whose key is new within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def against_target(sheet_of: Callable[[DataFrame], Sheet], plan: Plan, target: DataFrame, sink: Callable[[DataFrame, int], None], settings: Settings = Settings()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch's keys which the target has to a sink."""

    def run(batch: DataFrame, number: int) -> None:
        rows = evaluated(sheet_of(batch), plan, settings.options).persist()  # read by every rule, and an end to the lineage that joins would be planned through
        try:
            for rule in uniqueness_rules(plan.table):
                df = _key_rows(rows, plan, rule.columns)
                if df is not None:
                    known = target.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rule.columns])
                    sink(keys.existing(df, [f"k_{j}" for j in range(len(rule.columns))], known, list(rule.columns)).withColumn("rule", F.lit(rule.name)), number)
        finally:
            rows.unpersist()

    return run

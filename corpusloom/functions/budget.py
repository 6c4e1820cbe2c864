"""Token estimates and budget decisions, all in whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import int_div


def bytes_per_token_tenths(languages: Column) -> Column:
    """Ten times the bytes-per-token ratio for a list of languages; the first rule that matches wins."""
    rules = None
    for names, tenths in fv.BYTES_PER_TOKEN_TENTHS:
        hit = F.arrays_overlap(languages, F.array(*[F.lit(n) for n in names]))
        rules = F.when(hit, tenths) if rules is None else rules.when(hit, tenths)
    return rules.otherwise(fv.DEFAULT_BYTES_PER_TOKEN_TENTHS).cast("bigint")


def base_tokens(lines: Column, languages: Column) -> Column:
    return int_div(lines.cast("bigint") * (fv.BYTES_PER_LINE * 10), bytes_per_token_tenths(languages))


def analysis_tokens(base: Column) -> Column:
    return int_div(base * fv.ANALYSIS_INPUT_PERCENT, 100) + fv.ANALYSIS_OUTPUT_TOKENS


def estimate_tokens(lines: Column, languages: Column, profile: str = "standard") -> Column:
    """(structural, analysis, generation, review) token estimate as one struct."""
    zero = F.lit(0).cast("bigint")
    return F.struct(
        zero.alias("structural"),
        analysis_tokens(base_tokens(lines, languages)).alias("analysis"),
        F.lit(fv.GENERATION_TOKENS).cast("bigint").alias("generation"),
        F.lit(fv.REVIEW_TOKENS[profile]).cast("bigint").alias("review"),
    )


def pass_total(passes: Column) -> Column:
    return passes["structural"] + passes["analysis"] + passes["generation"] + passes["review"]


def chunk_tokens(lines: Column) -> Column:
    return int_div(lines.cast("bigint") * 400, 35)


def resolve_preset(preset: str = "balanced", profile: str | None = None, **limits: int | None) -> dict:
    """Preset values, each replaced by an explicit one where given (``max``, ``warn``, ``auto``)."""
    chosen = dict(fv.BUDGET_PRESETS.get(preset, fv.BUDGET_PRESETS["balanced"]))
    chosen.update({k: v for k, v in limits.items() if v is not None})
    if profile:
        chosen["profile"] = profile
    return chosen


def budget_decision(total: Column, preset: str = "balanced", budget: int | None = None, **limits: int | None) -> Column:
    """ABORT above the ceiling, WARN above the warning level, else SILENT; a hard budget has no warning level."""
    if budget is not None:
        return F.when(total > budget, "ABORT").otherwise("SILENT")
    rule = resolve_preset(preset, **limits)
    ceiling = F.lit(rule["max"]).cast("bigint")
    return F.when(F.coalesce(total > ceiling, F.lit(False)), "ABORT").when(total > rule["warn"], "WARN").otherwise("SILENT")

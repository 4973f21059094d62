"""Forecast intervals and the choice of the value to show."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillcast import config


def interval(prediction: str | Column, level: str) -> tuple[Column, Column]:
    """Lower and upper bound of a confidence level, to 2 decimals."""
    value = F.col(prediction) if isinstance(prediction, str) else prediction
    margin = F.lit(config.Z_SCORES[level]) * (value * F.lit(config.RELATIVE_DEVIATION))
    return F.round(value - margin, 2), F.round(value + margin, 2)


def interval_columns(prediction: str) -> dict[str, Column]:
    out = {}
    for level in config.Z_SCORES:
        low, high = interval(prediction, level)
        suffix = level.split(".")[1].ljust(2, "0")
        out[f"lower_{suffix}"] = low
        out[f"upper_{suffix}"] = high
    return out


def interval_map(prediction: str | Column) -> Column:
    """Map of ``confidence_<level>`` to [lower, upper]."""
    entries = []
    for level in config.Z_SCORES:
        entries += [F.lit(f"confidence_{level}"), F.array(*interval(prediction, level))]
    return F.create_map(*entries)


def forecast_pick(
    predictions: str, intervals: str, preference: list[str], level: str = "0.95"
) -> dict[str, Column]:
    """Prediction and bounds of the first model present, else 0.

    ``predictions`` maps model to value, ``intervals`` maps model to interval_map.
    """
    bounds = F.coalesce(
        *[F.try_element_at(F.col(intervals), F.lit(m))[f"confidence_{level}"] for m in preference]
    )
    return {
        "prediction": F.coalesce(
            *[F.try_element_at(F.col(predictions), F.lit(m)) for m in preference], F.lit(0.0)
        ),
        "lower": F.coalesce(bounds[0], F.lit(0.0)),
        "upper": F.coalesce(bounds[1], F.lit(0.0)),
    }

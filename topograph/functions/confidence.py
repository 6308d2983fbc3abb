"""Confidence tiers of a result set, and the gate on what is forwarded."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENT = ("high", "medium")


@dataclass(frozen=True)
class Thresholds:
    #: The default thresholds.
    high_single: float = 0.78
    high_combo: float = 0.68
    high_combo_second: float = 0.55
    medium_min: float = 0.58

    def to_json(self) -> dict[str, Any]:
        """Nested by tier; the descriptions are for people and aren't read again."""
        own = asdict(self)
        medium = {"description": "the best score reaches medium_min", "medium_min": own.pop("medium_min")}
        high = {"description": "the best score reaches high_single, or the best two reach high_combo and high_combo_second"} | own
        return {"high": high, "medium": medium, "low": {"description": "results, but under medium"}, "none": {"description": "nothing was found"}}

    @classmethod
    def from_json(cls, found: dict[str, Any]) -> Thresholds:
        flat = {k: v for part in ("high", "medium") for k, v in (found.get(part) or {}).items()}
        return cls(**{f.name: float(flat[f.name]) for f in fields(cls) if f.name in flat})


def tier(top: Column, second: Column, count: Column, t: Thresholds = Thresholds()) -> Column:
    """none, low, medium or high; all comparisons hold at equality, a missing second score is 0."""
    combo = (top >= t.high_combo) & (F.coalesce(second, F.lit(0.0)) >= t.high_combo_second)
    return F.when(count == 0, "none").when((top >= t.high_single) | combo, "high").when(top >= t.medium_min, "medium").otherwise("low")


def should_answer(executed: Column, confidence: Column, count: Column) -> Column:
    return executed & confidence.isin(*CONFIDENT) & (count > 0)


def forwarded(confidence: Column, amount: Column) -> Column:
    """What passes the gate: all for a confident tier, else nothing."""
    return F.when(confidence.isin(*CONFIDENT), amount).otherwise(F.lit(0))

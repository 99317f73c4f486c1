"""Fixed points of the memory model: the reference clock, enumerations, and the row filters that all queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ages are counted to this moment, so results don't depend on when a query runs.
NOW = "2024-02-01 00:00:00"

# Block types, their aliases and the tier bounds in days.
BLOCK_TYPES = ("knowledge", "attitude", "skill", "general")
BLOCK_TYPE_ALIASES = {"insight": "knowledge", "achievement": "knowledge", "technical": "knowledge", "decision": "knowledge", "skill_knowledge": "knowledge", "pattern": "knowledge", "preference": "attitude"}
TIER_DAYS = {"hot": 14, "warm": 180, "cold": 1095}


def live(df: DataFrame) -> DataFrame:
    """Rows that aren't soft-deleted."""
    return df.where(~F.col("is_deleted"))


def valid(df: DataFrame) -> DataFrame:
    """Live rows that still hold."""
    return live(df).where(~F.col("is_invalid"))


def tier(age_days: Column) -> Column:
    """Tier by age: hot up to 14 days, warm to 180, cold to 1095, then frozen."""
    out = F.when(age_days <= TIER_DAYS["hot"], "hot").when(age_days <= TIER_DAYS["warm"], "warm")
    return out.when(age_days <= TIER_DAYS["cold"], "cold").otherwise("frozen")

"""Contracts over streams: row checks are stateless, uniqueness holds within a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from sparkpact.operators.contracts import check_violations, foreign_key_orphans


def stream_check_violations(stream: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows of a stream that fail a check, as they come."""
    return check_violations(stream, checks)


def stream_orphans(stream: DataFrame, parent: DataFrame, columns: Sequence[str], ref_columns: Sequence[str]) -> DataFrame:
    """Rows of a stream without a parent in a static table."""
    return foreign_key_orphans(stream, parent, columns, ref_columns)


def stream_unique(stream: DataFrame, keys: Sequence[str], time_column: str, delay: str) -> DataFrame:
    """The first row of each key, with state only as old as the watermark."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(list(keys))

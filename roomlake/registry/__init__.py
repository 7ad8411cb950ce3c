"""Registered queries of the scene operators and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    from . import assets, detections, labels, points, rooms, scenes

    return {k: q for m in (detections, labels, points, rooms, assets, scenes) for k, q in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    from . import assets, detections, labels, points, rooms, scenes

    return {k: q for m in (detections, labels, points, rooms, assets, scenes) for k, q in m.ORACLES.items()}

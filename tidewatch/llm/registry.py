"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    compression_quality,
    decontamination,
    minhash_dedup,
    packing,
    quotations,
    rendezvous,
    secret_scan,
    substring_dedup,
    token_attribution,
    weak_rules,
)

MODULES = (
    quotations,
    compression_quality,
    rendezvous,
    packing,
    minhash_dedup,
    secret_scan,
    weak_rules,
    decontamination,
    token_attribution,
    substring_dedup,
)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}

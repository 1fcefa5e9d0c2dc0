"""Sinks: the register and its side tables as Parquet, and one JSON bundle for publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON line per row of each table, named: (table, json)."""
    parts = [df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("json")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sealed(c: Column, key: Column) -> Column:
    """AES-GCM under a key of 16, 24 or 32 bytes, in base 64; deriving the key is the caller's."""
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM")))

"""Settings with their defaults, overridable in the session's configuration under ``kinora.``."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    group_k: int = 20
    group_threshold: float = 0.55
    search_limit: int = 50
    max_detect_side: int = 1600
    embedding_dimension: int = 512
    block_size: int = 2048
    batch_size: int | None = None

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"kinora.{f.name}", None)
            if value is not None:
                found[f.name] = float(value) if f.name == "group_threshold" else int(value)
        return cls(**found)

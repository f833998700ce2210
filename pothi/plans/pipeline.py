"""Typed configuration and the driver of the stages."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pothi.plans.store import exists


@dataclass(frozen=True)
class RunConfig:
    """One configuration of an evaluation."""

    config_id: int
    retriever: str
    generator: str
    prompt_type: str = "grounded"

    def __post_init__(self) -> None:
        if self.prompt_type not in ("grounded", "open"):
            raise ValueError(f"prompt_type {self.prompt_type!r} is neither grounded nor open")


@dataclass(frozen=True)
class Settings:
    """What the stages read; values are checked where they are given."""

    books: str
    output: str
    service_key: str | None = None
    calls_per_minute: float = 500.0
    attempts: int = 4
    chunk_size: int = 1000
    chunk_overlap: int = 200
    least_chunk: int = 50
    pairs_per_chunk: int = 2
    dedup_cosine: float = 0.97
    gold_size: int = 200
    configs: tuple[RunConfig, ...] = field(default=())

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be below chunk_size")
        if not 0 < self.dedup_cosine <= 1:
            raise ValueError("dedup_cosine must lie in (0, 1]")
        if self.calls_per_minute <= 0 or self.attempts < 1 or self.pairs_per_chunk < 1 or self.gold_size < 0:
            raise ValueError("rates, attempts and numbers must be positive")
        ids = [c.config_id for c in self.configs]
        if len(ids) != len(set(ids)):
            raise ValueError("config_id stands twice")

    @classmethod
    def of(cls, values: dict[str, Any]) -> Settings:
        """Settings of plain values; unknown names are refused."""
        known = {f.name for f in dataclasses.fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        configs = tuple(c if isinstance(c, RunConfig) else RunConfig(**c) for c in values.get("configs", ()))
        return cls(**values | {"configs": configs})

    @classmethod
    def read(cls, path: str) -> Settings:
        """Settings of a JSON file."""
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))


def validate(spark: SparkSession, settings: Settings, needs_service: bool = True) -> None:
    """Raises where the service key is absent or the folder of the books does not exist."""
    if needs_service and not settings.service_key:
        raise OSError("no service key is configured")
    if not exists(spark, settings.books):
        raise FileNotFoundError(settings.books)


#: A stage gets the session, the settings and the tables of the stages before it by name.
Stage = Callable[[SparkSession, Settings, dict[str, DataFrame]], DataFrame]


def run_stages(spark: SparkSession, settings: Settings, stages: dict[str, Stage], again: frozenset[str] = frozenset()) -> dict[str, DataFrame]:
    """Tables of all stages, in order, each written once under ``output``.

    A stage whose table is complete is not run again, unless it is named in
    ``again`` or one before it was run; the first that fails ends the run, and
    what was written before it stays.
    """
    tables: dict[str, DataFrame] = {}
    stale = False
    for name, stage in stages.items():
        path = f"{settings.output.rstrip('/')}/{name}"
        if stale or name in again or not exists(spark, f"{path}/_SUCCESS"):
            stage(spark, settings, dict(tables)).write.mode("overwrite").parquet(path)
            stale = True
        tables[name] = spark.read.parquet(path)
    return tables

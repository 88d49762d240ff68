"""Experiments: what to synthesise."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

ANNUAL = (0.8, 1.5)
DECADAL = (8.0, 20.0)
SCHEMA = "name string, description string, n_years int, n_members int, seed int, band_scales array<struct<pmin:double,pmax:double,factor:double>>, seasonal_scale double"


@dataclass(frozen=True)
class Experiment:
    n_years: int = 1000
    n_members: int = 30
    seed: int = 0
    band_scales: tuple[tuple[float, float, float], ...] | None = None
    name: str = "baseline"
    description: str = ""
    seasonal_scale: float = 1.0

    def __post_init__(self):
        if self.n_years <= 0 or self.n_members <= 0:
            raise ValueError("years and members must be above 0")
        if self.seed < 0:
            raise ValueError("the seed must not be negative")
        if self.seasonal_scale < 0:
            raise ValueError("the seasonal scale must not be negative")
        for band in self.band_scales or ():
            if len(band) != 3 or not 0 < band[0] < band[1] or band[2] < 0:
                raise ValueError(f"not a band: {band}")

    @property
    def n_months(self) -> int:
        return 12 * self.n_years

    @property
    def has_band_scaling(self) -> bool:
        return bool(self.band_scales)

    @property
    def seasonal_amplitude(self) -> float:
        return float(np.sqrt(self.seasonal_scale))

    def rng(self) -> np.random.Generator:
        """A fresh generator at each call."""
        return np.random.default_rng(self.seed)

    @classmethod
    def baseline(cls, **sizes) -> Experiment:
        return cls(name="baseline", description="observed spectrum", **sizes)

    @classmethod
    def scaled(cls, name: str, band: tuple[float, float], factor: float, seasonal: bool = False, **sizes) -> Experiment:
        return cls(name=name, description=f"periods {band[0]} to {band[1]} years times {factor}", band_scales=((*band, factor),), seasonal_scale=factor if seasonal else 1.0, **sizes)

    @classmethod
    def annual_enhanced(cls, factor: float = 10.0, **sizes) -> Experiment:
        return cls.scaled("annual_enhanced", ANNUAL, factor, True, **sizes)

    @classmethod
    def annual_suppressed(cls, factor: float = 0.1, **sizes) -> Experiment:
        return cls.scaled("annual_suppressed", ANNUAL, factor, True, **sizes)

    @classmethod
    def decadal_enhanced(cls, factor: float = 10.0, **sizes) -> Experiment:
        return cls.scaled("decadal_enhanced", DECADAL, factor, **sizes)

    @classmethod
    def decadal_suppressed(cls, factor: float = 0.1, **sizes) -> Experiment:
        return cls.scaled("decadal_suppressed", DECADAL, factor, **sizes)

    @classmethod
    def standard_suite(cls, **sizes) -> list[Experiment]:
        return [cls.baseline(**sizes), cls.annual_enhanced(**sizes), cls.annual_suppressed(**sizes), cls.decadal_enhanced(**sizes), cls.decadal_suppressed(**sizes)]

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Experiment:
        bands = d.get("band_scales")
        return cls(**{**d, "band_scales": tuple(tuple(b) for b in bands) if bands else None})

    def with_(self, **changes) -> Experiment:
        return replace(self, **changes)


def experiments_table(spark: SparkSession, suite: list[Experiment]) -> DataFrame:
    rows = [(e.name, e.description, e.n_years, e.n_members, e.seed, [tuple(map(float, b)) for b in e.band_scales] if e.band_scales else None, float(e.seasonal_scale)) for e in suite]
    return spark.createDataFrame(rows, SCHEMA)

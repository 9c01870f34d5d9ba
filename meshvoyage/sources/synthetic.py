"""Synthetic fields and meshes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CELL_FIELDS


def frequencies(size: int) -> np.ndarray:
    """Coordinates (2, size, size) in frequency space, zero first."""
    steps = np.fft.fftshift(np.arange(size) - (size + 1) // 2)
    return np.stack(np.meshgrid(steps, steps, indexing="ij"))


def gaussian_field(size: int, alpha: float = 3.0, seed: int | None = None) -> np.ndarray:
    """A random field whose power falls with frequency as a power law, scaled to 0 to 1."""
    rng = np.random.default_rng(seed)
    kx, ky = frequencies(size).astype(float)
    amplitude = (kx * kx + ky * ky + 1e-10) ** (-alpha / 4.0)
    amplitude[0, 0] = 0.0
    noise = rng.normal(size=(size, size)) + 1j * rng.normal(size=(size, size))
    field = np.fft.ifft2(noise * amplitude).real
    return (field - field.min()) / (field.max() - field.min())


def field_table(spark: SparkSession, field: np.ndarray, name: str = "value") -> DataFrame:
    """A field as rows (i, j, value)."""
    i, j = np.indices(field.shape)
    rows = list(zip(i.ravel().tolist(), j.ravel().tolist(), field.ravel().tolist(), strict=True))
    return spark.createDataFrame(rows, f"i int, j int, {name} double")


def regular_cells(spark: SparkSession, columns: int, rows: int, west: float, south: float, width: float, height: float) -> DataFrame:
    """A mesh of equal cells, numbered by rows from the south west, without data."""
    n = F.col("n")
    cells = spark.range(columns * rows).withColumnRenamed("id", "n")
    return cells.select(
        n.cast("string").alias("id"),
        (F.lit(west) + (n % columns) * width + width / 2).alias("cx"),
        (F.lit(south) + F.floor(n / columns) * height + height / 2).alias("cy"),
        F.lit(width / 2).alias("dcx"),
        F.lit(height / 2).alias("dcy"),
        *[F.lit(None).cast("double").alias(c) for c in CELL_FIELDS],
    )


def checkerboard(cells: DataFrame, name: str, low: float, high: float) -> DataFrame:
    """``cells`` with ``name`` alternating between two values."""
    odd = F.pmod(F.floor(F.col("cx") / (2 * F.col("dcx"))) + F.floor(F.col("cy") / (2 * F.col("dcy"))), F.lit(2)) == 1
    return cells.withColumn(name, F.when(odd, F.lit(high)).otherwise(F.lit(low)))


def gradient(cells: DataFrame, name: str, vertical: bool = True) -> DataFrame:
    """``cells`` with ``name`` rising with latitude or longitude."""
    return cells.withColumn(name, F.col("cy" if vertical else "cx"))


def circle(cells: DataFrame, name: str, lon: float, lat: float, radius: float) -> DataFrame:
    """``cells`` with ``name`` 1 within a circle in degrees and 0 outside."""
    inside = F.pow(F.col("cx") - lon, 2) + F.pow(F.col("cy") - lat, 2) <= radius * radius
    return cells.withColumn(name, F.when(inside, 1.0).otherwise(0.0))

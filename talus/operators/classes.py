"""Height classes and their areas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import SQUARE_METERS_PER_ACRE, SQUARE_METERS_PER_HECTARE, VegClass


def classify(classes: tuple[VegClass, ...], height: str = "chm") -> Column:
    """The code of a height's class, whose lower bound is in it; 0 without data."""
    code = F.lit(classes[0].code)
    for c in classes[1:]:
        code = F.when(F.col(height) >= c.min_m, F.lit(c.code)).otherwise(code)
    return F.when(F.col(height).isNull(), F.lit(0)).otherwise(code).cast("smallint")


def class_table(spark: SparkSession, classes: tuple[VegClass, ...]) -> DataFrame:
    """The classes as a small table."""
    rows = [(c.code, c.name, c.min_m, None if math.isinf(c.max_m) else c.max_m, c.woody, c.treatment) for c in classes]
    return spark.createDataFrame(rows, "code smallint, name string, min_m double, max_m double, woody boolean, treatment boolean")


def class_areas(cells: DataFrame, classes: tuple[VegClass, ...], cell_area_m2: float, mask: Column | None = None) -> DataFrame:
    """A row for each class, also for those without cells: code, name, cells, area_ha, area_acres, percent.

    Cells without data count nowhere; percentages are of the counted ones, 0 if there are none.
    """
    counted = (cells.where(mask) if mask is not None else cells).where("code > 0").groupBy("code").agg(F.count("*").alias("n"))
    rows = class_table(cells.sparkSession, classes).join(counted, "code", "left").withColumn("cells", F.coalesce("n", F.lit(0)))
    total = F.sum("cells").over(Window.partitionBy())  # of a row for each class
    area = F.col("cells") * F.lit(cell_area_m2)
    percent = F.coalesce(F.try_divide(F.col("cells") * F.lit(100.0), total), F.lit(0.0))
    return rows.select("code", "name", "woody", "treatment", "cells", (area / SQUARE_METERS_PER_HECTARE).alias("area_ha"), (area / SQUARE_METERS_PER_ACRE).alias("area_acres"), percent.alias("percent"))


def role_acres(role: str) -> Column:
    """Aggregate over class areas: acres of woody or of treatment classes."""
    return F.coalesce(F.sum(F.when(F.col(role), F.col("area_acres"))), F.lit(0.0))


def woody_floor(classes: tuple[VegClass, ...]) -> float:
    """The least height of a woody class."""
    return min((c.min_m for c in classes if c.woody), default=0.0)

"""Hazard grid sink and scan.

Two layouts: one JSON object per cell with the model constants on every row
(``write_hazard``), and the viewer's single document
``{"mc": 4.5, "catalog_years": 36, "cells": [[lat, lon, a, b, n], ...]}``
(``write_hazard_document``). The viewer's grid has at most 16,200 cells of 2
degrees; the document refuses cells of any other grid, so gathering it in one
row is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HAZARD_SCHEMA = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("a", T.DoubleType()),
    T.StructField("b", T.DoubleType()),
    T.StructField("n", T.LongType()),
    T.StructField("mc", T.DoubleType()),
    T.StructField("catalog_years", T.IntegerType()),
])


def write_hazard(cells: DataFrame, path: str) -> None:
    cols = [f.name for f in HAZARD_SCHEMA.fields]
    cells.select(*cols).write.mode("overwrite").json(path)


def read_hazard(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HAZARD_SCHEMA).json(path)


def hazard_document(cells: DataFrame) -> DataFrame:
    """One row, one column ``value``: the viewer's hazard document, cells sorted by (lat, lon).

    Fails on cells that are not centred on the viewer's 2-degree grid.
    """
    centred = (F.pmod(F.col("lat") - 1.0, F.lit(2.0)) == 0) & (F.pmod(F.col("lon") - 1.0, F.lit(2.0)) == 0)
    cells = cells.where(F.coalesce(centred, F.lit(False)) | F.raise_error(F.lit("the hazard document holds 2-degree cells only")).cast("boolean"))
    as_json = F.to_json(F.array(*[F.expr(f"CAST({c} AS VARIANT)") for c in ("lat", "lon", "a", "b", "n")]))
    return cells.agg(
        F.first("mc").alias("mc"), F.first("catalog_years").alias("catalog_years"),
        F.sort_array(F.collect_list(F.struct("lat", "lon", as_json.alias("j")))).alias("cells"),
    ).select(F.concat(
        F.lit('{"mc":'), F.coalesce(F.col("mc").cast("string"), F.lit("4.5")),
        F.lit(',"catalog_years":'), F.coalesce(F.col("catalog_years").cast("string"), F.lit("0")),
        F.lit(',"cells":['), F.array_join(F.transform("cells", lambda c: c["j"]), ","), F.lit("]}"),
    ).alias("value"))


def write_hazard_document(cells: DataFrame, path: str) -> None:
    hazard_document(cells).write.mode("overwrite").text(path)


def read_hazard_document(spark: SparkSession, path: str) -> DataFrame:
    """Cell rows from viewer documents (one document per file)."""
    doc = spark.read.option("wholetext", "true").text(path)
    parsed = doc.select(F.from_json("value", "struct<mc:double,catalog_years:int,cells:array<array<double>>>").alias("d"))
    return parsed.select("d.mc", "d.catalog_years", F.explode("d.cells").alias("c")).select(
        F.element_at("c", 1).alias("lat"), F.element_at("c", 2).alias("lon"),
        F.element_at("c", 3).alias("a"), F.element_at("c", 4).alias("b"),
        F.element_at("c", 5).cast("long").alias("n"), "mc", "catalog_years",
    )

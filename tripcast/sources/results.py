"""Results artifact (S13): the evaluation as JSON lines, one record per part.

Records ``(kind, ordinal, name, index[], values[], excluded_reason)``: one of
kind ``actual``, one per model (``model``; a model without a forecast has empty
arrays and its reason) and one per name carried forward (``carry_forward``). A
record holds one model's horizon, so the artifact is written and read in
parallel however many models there are; arrays are ordered by period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("kind string, ordinal int, name string, index array<string>, values array<double>, "
          "excluded_reason string")


def _series(rows: DataFrame, by: list, value: str) -> DataFrame:
    one = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("period", F.col(value).cast("double").alias("v")))).alias("s"))
    return one.select(*by, F.transform("s", lambda r: F.date_format(r["period"], "yyyy-MM-dd")).alias("index"),
                      F.transform("s", lambda r: r["v"]).alias("values"))


def results_document(actual: DataFrame, fc_total: DataFrame, table: DataFrame,
                     carry_forward: DataFrame) -> DataFrame:
    """The artifact's records."""
    text, none = (lambda c: F.lit(c).cast("string")), F.array()
    empty = [none.cast("array<string>").alias("index"), none.cast("array<double>").alias("values"), text(None).alias("excluded_reason")]
    observed = _series(actual, [], "actual").select(
        text("actual").alias("kind"), F.lit(0).alias("ordinal"), text("actual").alias("name"), "index", "values", empty[2])
    rated = table.select("ordinal", F.col("model_name").alias("model"), "excluded_reason")
    models = _series(fc_total, ["model"], "yhat").join(rated, "model", "full").select(
        text("model").alias("kind"), "ordinal", F.col("model").alias("name"), F.coalesce("index", empty[0]).alias("index"),
        F.coalesce("values", empty[1]).alias("values"), "excluded_reason")
    carried = carry_forward.select(text("carry_forward").alias("kind"), F.col("cf_rank").cast("int").alias("ordinal"),
                                   F.col("model_name").alias("name"), *empty)
    return observed.unionByName(models).unionByName(carried)


def write_results(doc: DataFrame, path: str) -> None:
    doc.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str):
    """``(actuals, forecasts)`` long frames from a stored artifact."""
    doc = spark.read.schema(RECORD).json(path)
    long = doc.select("kind", "name", "excluded_reason", F.posexplode(F.arrays_zip("index", "values")).alias("pos", "z")).select(
        "kind", "name", "excluded_reason", "pos", F.to_timestamp("z.index").cast("timestamp_ntz").alias("period"),
        F.col("z.values").alias("value"))
    actuals = long.where("kind = 'actual'").select("pos", "period", F.col("value").alias("actual"))
    forecasts = long.where("kind = 'model'").select(F.col("name").alias("model"), "excluded_reason", "pos", "period",
                                                    F.col("value").alias("yhat"))
    return actuals, forecasts

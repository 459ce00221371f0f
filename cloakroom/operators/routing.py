"""Capability-aware model candidates for requests (offline assignment)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(requests: DataFrame, models: DataFrame) -> DataFrame:
    """(request cols..., model_id, pref): tool requests only get tool-capable models.

    ``models``: model_id, priority, tools, ins (order in the configuration); a model
    serves plain requests, and tool requests too if it can. The preference order is
    worked out once for each of the two kinds of request, and the requests join it by
    kind, so nothing is compared row by row.
    """
    served = models.select("*", F.explode(F.when(F.col("tools"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_kind"))
    ranked = served.withColumn("pref", F.row_number().over(Window.partitionBy("_kind").orderBy("priority", "ins")).cast("bigint"))
    return requests.join(ranked, requests["needs_tools"] == ranked["_kind"]).drop("_kind")

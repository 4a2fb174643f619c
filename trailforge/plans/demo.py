"""The driver's tables in the roles of the engine's own: runs are a user's events of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return e.withColumn("d", d).withColumn("traj_id", (F.col("user_id") * 100 + F.col("d")).cast("long"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(W.partitionBy("traj_id").orderBy("ts", "event_id")) - 1
    return _keyed(spark, sf_dir).select("traj_id", i.alias("i"), F.col("event_type").alias("action_type"), F.col("props").alias("command"), "value")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _keyed(spark, sf_dir).groupBy("traj_id", "user_id", "d").agg(F.sum("value").alias("total"))
    return g.select(
        "traj_id", F.col("d").cast("long").alias("instance_id"), F.concat(F.lit("r"), (F.col("d") % 3).cast("string")).alias("repo"), F.lit("agent").alias("agent"),
        (F.col("user_id") % 12).cast("long").alias("model"), F.when(F.col("total") >= 100, "pass").otherwise("fail").alias("outcome"), F.col("traj_id").alias("pos"),
    )


#: The same in SQL.
CTE = """
keyed AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, CAST(user_id * 100 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS traj_id FROM events),
ev AS (SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY ts, event_id) - 1 AS i, event_type AS action_type, props AS command, value FROM keyed),
pool AS (SELECT traj_id, CAST(d AS BIGINT) AS instance_id, 'r' || CAST(d % 3 AS VARCHAR) AS repo, CAST(user_id % 12 AS BIGINT) AS model,
                CASE WHEN sum(value) >= 100 THEN 'pass' ELSE 'fail' END AS outcome, traj_id AS pos FROM keyed GROUP BY traj_id, user_id, d)"""

PREDICATES = {
    "p_exists": "exists(purchase)",
    "p_count": "count(click) >= 3",
    "p_before": "before(view, click)",
    "p_after": "after(error, purchase)",
    "p_logic": 'not exists(error) and exists(view) or exists(any("1"))',
}
#: Their truth in SQL, over a trajectory's aggregates.
TRUTH = {
    "p_exists": "count(*) FILTER (action_type = 'purchase') > 0",
    "p_count": "count(*) FILTER (action_type = 'click') >= 3",
    "p_before": "coalesce(min(i) FILTER (action_type = 'view') < max(i) FILTER (action_type = 'click'), FALSE)",
    "p_after": "coalesce(max(i) FILTER (action_type = 'error') > min(i) FILTER (action_type = 'purchase'), FALSE)",
    "p_logic": "(count(*) FILTER (action_type = 'error') = 0 AND count(*) FILTER (action_type = 'view') > 0) OR count(*) FILTER (contains(command, '1')) > 0",
}
LABELS = "lab AS (SELECT traj_id, " + ", ".join(f"{t} AS {n}" for n, t in TRUTH.items()) + " FROM ev GROUP BY traj_id)"

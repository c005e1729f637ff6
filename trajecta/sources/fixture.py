"""Detections and ground truth derived from an event table: each user is an object on a linear
path and each event is one frame of it. Integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _events(events: DataFrame) -> DataFrame:
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select("event_id", "user_id", frame.cast("bigint").alias("frame"))


def detections(events: DataFrame) -> DataFrame:
    e = _events(events)
    det = F.row_number().over(Window.partitionBy(F.expr("user_id % 5"), "frame").orderBy("event_id"))
    return e.select(
        F.expr("CAST(user_id % 5 AS INT)").alias("seq_id"),
        F.expr("CAST(frame AS INT)").alias("frame"),
        det.alias("det_idx"),
        F.col("user_id").alias("obj_id"),
        F.expr("CAST((user_id * 193) % 1600 + ((user_id * 7) % 11 - 5) * frame + (event_id % 5 - 2) AS DOUBLE)").alias("x"),
        F.expr("CAST((user_id * 101) % 800 + ((user_id * 3) % 7 - 3) * frame + ((event_id * 3) % 5 - 2) AS DOUBLE)").alias("y"),
        F.expr("CAST(40 + (user_id * 13) % 60 + event_id % 3 AS DOUBLE)").alias("w"),
        F.expr("CAST(90 + (user_id * 29) % 110 + (event_id * 7) % 3 AS DOUBLE)").alias("h"),
        F.expr("CAST((event_id * 37) % 100 AS DOUBLE) / 100.0D").alias("score"),
        F.col("event_id"),
    )


def ground_truth(events: DataFrame) -> DataFrame:
    return _events(events).select(
        F.expr("CAST(user_id % 5 AS INT)").alias("seq_id"),
        F.expr("CAST(frame AS INT)").alias("frame"),
        F.col("user_id").alias("obj_id"),
        F.expr("CAST((user_id * 193) % 1600 + ((user_id * 7) % 11 - 5) * frame AS DOUBLE)").alias("x"),
        F.expr("CAST((user_id * 101) % 800 + ((user_id * 3) % 7 - 3) * frame AS DOUBLE)").alias("y"),
        F.expr("CAST(40 + (user_id * 13) % 60 AS DOUBLE)").alias("w"),
        F.expr("CAST(90 + (user_id * 29) % 110 AS DOUBLE)").alias("h"),
        F.expr("CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS INT)").alias("active"),
        F.expr("CAST(CASE event_id % 7 WHEN 0 THEN 7 WHEN 1 THEN -1 ELSE 1 END AS INT)").alias("class"),
        F.expr("CAST((event_id * 53) % 100 AS DOUBLE) / 100.0D").alias("visibility"),
    )


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    return detections(events), ground_truth(events)


#: The same tables for DuckDB, as the head of a WITH clause.
SQL = """e AS (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame FROM events),
det AS (SELECT CAST(user_id % 5 AS INT) AS seq_id, CAST(frame AS INT) AS frame,
  CAST(row_number() OVER (PARTITION BY user_id % 5, frame ORDER BY event_id) AS INT) AS det_idx, user_id AS obj_id,
  CAST((user_id * 193) % 1600 + ((user_id * 7) % 11 - 5) * frame + (event_id % 5 - 2) AS DOUBLE) AS x,
  CAST((user_id * 101) % 800 + ((user_id * 3) % 7 - 3) * frame + ((event_id * 3) % 5 - 2) AS DOUBLE) AS y,
  CAST(40 + (user_id * 13) % 60 + event_id % 3 AS DOUBLE) AS w, CAST(90 + (user_id * 29) % 110 + (event_id * 7) % 3 AS DOUBLE) AS h,
  CAST((event_id * 37) % 100 AS DOUBLE) / 100.0 AS score, event_id FROM e),
gt AS (SELECT CAST(user_id % 5 AS INT) AS seq_id, CAST(frame AS INT) AS frame, user_id AS obj_id,
  CAST((user_id * 193) % 1600 + ((user_id * 7) % 11 - 5) * frame AS DOUBLE) AS x, CAST((user_id * 101) % 800 + ((user_id * 3) % 7 - 3) * frame AS DOUBLE) AS y,
  CAST(40 + (user_id * 13) % 60 AS DOUBLE) AS w, CAST(90 + (user_id * 29) % 110 AS DOUBLE) AS h,
  CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS INT) AS active, CAST(CASE event_id % 7 WHEN 0 THEN 7 WHEN 1 THEN -1 ELSE 1 END AS INT) AS class,
  CAST((event_id * 53) % 100 AS DOUBLE) / 100.0 AS visibility FROM e)"""

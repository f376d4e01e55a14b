"""Logs over the shared tables, and a small one written out in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import EventLog, from_table

#: A small log of a request process, six cases in file order.
REQUESTS = {
    "3": "register request,examine casually,check ticket,decide,reinitiate request,examine thoroughly,check ticket,decide,pay compensation",
    "2": "register request,check ticket,examine casually,decide,pay compensation",
    "1": "register request,examine thoroughly,check ticket,decide,reject request",
    "6": "register request,examine casually,check ticket,decide,pay compensation",
    "5": "register request,examine casually,check ticket,decide,reinitiate request,check ticket,examine casually,decide,reinitiate request,examine casually,check ticket,decide,reject request",
    "4": "register request,check ticket,examine thoroughly,decide,reject request",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_days(spark: SparkSession, sf_dir: str) -> EventLog:
    return from_table(table(spark, sf_dir, "events"), ["user_id", F.to_date("ts")], "event_type", ["ts", "event_id"])


def users(spark: SparkSession, sf_dir: str) -> EventLog:
    return from_table(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"])


def conversations(spark: SparkSession, sf_dir: str) -> EventLog:
    return from_table(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn"])


def customers(spark: SparkSession, sf_dir: str) -> EventLog:
    return from_table(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["o_orderdate", "o_orderkey"])


def of_sequences(spark: SparkSession, sequences: dict[str, list[str]]) -> EventLog:
    """A log of given sequences, in order; empty ones are cases too."""
    cases = [(k, name) for k, name in enumerate(sequences)]
    events = [(k, i, a) for k, acts in enumerate(sequences.values()) for i, a in enumerate(acts)]
    return EventLog(spark.createDataFrame(events, "case_key long, event_order int, activity string"), spark.createDataFrame(cases, "case_key long, case_id string"))


def requests(spark: SparkSession) -> EventLog:
    return of_sequences(spark, {k: v.split(",") for k, v in REQUESTS.items()})

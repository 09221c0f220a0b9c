"""Nodes, jobs and projects: batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXPIRY_MINUTES = 2


def node_health(nodes: DataFrame, beats: DataFrame, now: Column) -> DataFrame:
    """(node_id, last_seen, minutes, alive): a node whose last beat is more than two whole minutes old has expired; one
    that never beat counts from now."""
    last = beats.groupBy("node_id").agg(F.max("ts").alias("last_seen"))
    rows = nodes.select("node_id").distinct().join(last, "node_id", "left").withColumn("last_seen", F.coalesce("last_seen", now))
    minutes = F.floor((F.unix_micros(now) - F.unix_micros("last_seen")) / 60_000_000)
    return rows.select("node_id", "last_seen", minutes.alias("minutes"), (minutes <= EXPIRY_MINUTES).alias("alive"))


def registered(events: DataFrame, overwrite: bool = True) -> DataFrame:
    """The nodes that are registered after events (ip, node_id, seq and, optionally, op: register or deregister).

    Of the registrations of an address since it was last given up, the last one holds, or without ``overwrite`` the
    first one: later ones are refused. Ties go to the smaller node."""
    op = F.coalesce(F.col("op"), F.lit("register")) if "op" in events.columns else F.lit("register")
    left = F.max(F.when(op == "deregister", F.col("seq"))).over(Window.partitionBy("ip"))
    live = events.withColumn("since", left).where((op == "register") & (F.col("since").isNull() | (F.col("seq") > F.col("since")))).drop("since")
    order = Window.partitionBy("ip").orderBy(F.desc("seq") if overwrite else F.asc("seq"), "node_id")
    return live.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def error_log(reports: DataFrame, path: str) -> None:
    """Append reports of clients (at, level, message, ...) to the table at ``path``; those without a message are dropped."""
    reports.where("trim(message) <> ''").write.mode("append").parquet(path)


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, state, percent): the last state of each job from rows (job_id, seq, state, percent); a running job
    shows at least 1 percent, a finished one 100."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("state", "percent"), "seq").alias("x"))
    within = F.least(F.lit(100), F.greatest(F.lit(0), F.col("x.percent")))
    shown = F.when(F.col("x.state") == "DONE", 100).when(F.col("x.state") == "RUNNING", F.greatest(F.lit(1), within)).otherwise(within)
    return last.select("job_id", F.col("x.state").alias("state"), shown.cast("int").alias("percent"))


def accessible(nodes: DataFrame, grants: DataFrame, user: Column) -> DataFrame:
    """Nodes that a user may see."""
    return nodes.join(grants.where(F.col("user_id") == user).select("node_id"), "node_id", "left_semi")


def platform_stats(members: DataFrame, nodes: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row: members, nodes, datasets, last_access."""
    m = members.agg(F.count("*").alias("members"), F.max("last_access").alias("last_access"))
    n = nodes.join(datasets.groupBy("node_id").agg(F.count("*").alias("n")), "node_id", "left").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("datasets"))
    return m.crossJoin(n).select("members", "nodes", "datasets", "last_access")  # one row each

"""The monitor run: readings of targets to findings, what to post of them, and the state for the next run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.scoring import confirmed_age
from vellum.functions.urls import commits_url, runs_url
from vellum.operators import freshness
from vellum.sources import tables


def readings(targets: DataFrame, runs: DataFrame, commits: DataFrame, now: Column, listed: DataFrame | None = None) -> DataFrame:
    """targets with ``cron_age`` and ``output_age`` in days, NULL if nothing is on record.

    ``listed`` are runs of the unfiltered listing: the newer of both answers counts, so a stale filtered one can't alarm by itself."""
    every = runs.unionByName(listed.select(*runs.columns)) if listed is not None else runs
    cron = freshness.newest_age(every, ["repo", "workflow"], freshness.run_start(every), freshness.scheduled_success(every), now, "cron_age")
    out = freshness.newest_age(commits, ["repo", "path"], F.col("committed_at"), F.lit(True), now, "output_age")
    return targets.join(cron, ["repo", "workflow"], "left").join(out, ["repo", "path"], "left")


def confirmed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Readings confirmed by a second one: an age beyond its limit counts only if both are."""
    s = second.select("repo", "workflow", "path", F.col("cron_age").alias("_c"), F.col("output_age").alias("_o"))
    both = first.join(s, (first["repo"] == s["repo"]) & (first["workflow"] == s["workflow"]) & first["path"].eqNullSafe(s["path"]), "left").select(first["*"], "_c", "_o")
    return both.withColumns({"cron_age": confirmed_age(F.col("cron_age"), F.col("_c"), F.col("cron_max_days")), "output_age": confirmed_age(F.col("output_age"), F.col("_o"), F.col("output_max_days"))}).drop("_c", "_o")


def findings(read: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """key, finding, text of everything wrong: schedules and outputs beyond their limits, hung and failed runs; each with the page that confirms it."""
    page, commits = runs_url(F.col("repo"), F.col("workflow")), commits_url(F.col("repo"), F.col("path"))
    label = F.concat_ws(":", "repo", "path")
    days = lambda c: F.format_string("%.1f", F.col(c))
    cron = read.withColumn("finding", freshness.stale(F.col("cron_age"), F.col("cron_max_days"), "never_ran")).where("finding IS NOT NULL").select(
        F.concat_ws("|", "repo", "workflow", F.lit("cron")).alias("key"), "finding",
        F.when(F.col("finding") == "stale", F.concat(F.lit("last scheduled success "), days("cron_age"), F.lit(" days ago: "), page)).otherwise(F.concat(F.lit("no scheduled success on record: "), page)).alias("text"))
    out = read.withColumn("finding", freshness.stale(F.col("output_age"), F.col("output_max_days"), "unreadable")).where("finding IS NOT NULL").select(
        F.concat_ws("|", label, F.when(F.col("finding") == "stale", "output").otherwise("output-error")).alias("key"), "finding",
        F.when(F.col("finding") == "stale", F.concat(F.lit("unchanged for "), days("output_age"), F.lit(" days: "), commits)).otherwise(F.concat(F.lit("no output found: "), commits)).alias("text"))
    bad = freshness.run_findings(runs, now).join(read.select("repo", "workflow").distinct(), ["repo", "workflow"], "left_semi")
    ran = bad.select(F.concat_ws("|", "repo", "workflow", "finding").alias("key"), "finding", F.concat(F.lit("newest run "), "finding", F.lit(": "), page).alias("text"))
    return cron.unionByName(out).unionByName(ran)


def run(spark: SparkSession, targets: DataFrame, probe: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], state: str, now: Column, post: Callable[[list[str]], dict | None], post_all: bool = False) -> DataFrame:
    """Findings with ``post``; those to post go to ``post`` as lines, and the keys of all are saved for the next run.

    ``probe`` reads (runs, commits, listed runs); it is called twice, and only what both readings show counts. ``post`` returns the service's answer;
    one that is not ok, and any error, is raised after the state is saved, so that a job that told nobody does not end well."""
    runs, commits, listed = probe()
    again = probe()
    read = confirmed(readings(targets, runs, commits, now, listed), readings(targets, again[0], again[1], now, again[2]))
    held = freshness.hold(findings(read, runs, now), tables.previous_keys(spark, state), post_all)
    found = spark.createDataFrame(held.collect(), held.schema)  # at most five rows a target; read before the state is replaced
    lines = [r.text for r in found.where("post").orderBy("key").collect()]
    tables.save_keys(found, state)
    if lines and (answer := post(lines)) is not None and not answer.get("ok", True):
        raise RuntimeError(f"{len(lines)} findings were not accepted: {answer.get('error')}")
    return found

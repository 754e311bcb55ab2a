"""Ages of the newest good events, and which findings to report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.scoring import age_days

PIPELINE_EVENTS = ("schedule", "repository_dispatch")
FAILURES = ("failure", "timed_out", "startup_failure")
HUNG_HOURS = 3.0


def run_start(df: DataFrame) -> Column:
    """When a run started."""
    return F.coalesce(df["run_started_at"], df["created_at"])


def newest_age(rows: DataFrame, keys: list[str], at: Column, good: Column, now: Column, name: str = "age") -> DataFrame:
    """Age in days of the newest good row of each key, NULL if there is none."""
    return rows.groupBy(*keys).agg(F.max(F.when(good, at)).alias("_t")).select(*keys, age_days(now, F.col("_t")).alias(name))


def scheduled_success(df: DataFrame) -> Column:
    """A successful run by schedule."""
    return (df["event"] == "schedule") & (df["conclusion"] == "success")


def latest(rows: DataFrame, keys: list[str], at: Column, where: Column | None = None) -> DataFrame:
    """The newest row of each key, by aggregation; ties by the row itself."""
    cols = [c for c in rows.columns if c not in keys]
    use = rows.where(where) if where is not None else rows
    return use.groupBy(*keys).agg(F.max(F.struct(at.alias("_at"), *cols)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


def run_findings(runs: DataFrame, now: Column) -> DataFrame:
    """repo, workflow, finding: hung or failed newest runs of the pipeline's own events."""
    own = runs.where(F.col("event").isin(*PIPELINE_EVENTS))
    start = F.coalesce("run_started_at", "created_at")
    newest = latest(own, ["repo", "workflow"], start)
    hung = newest.where((F.col("status") != "completed") & (F.timestamp_diff("SECOND", start, now) / 3600.0 > HUNG_HOURS)).select("repo", "workflow", F.lit("hung").alias("finding"))
    done = latest(own, ["repo", "workflow"], start, F.col("status") == "completed")
    ran = F.timestamp_diff("SECOND", start, F.col("updated_at")) / 3600.0
    failed = done.where(F.col("conclusion").isin(*FAILURES) | ((F.col("conclusion") == "cancelled") & (ran > HUNG_HOURS))).select("repo", "workflow", F.lit("failed").alias("finding"))
    return hung.unionByName(failed)


def stale(age: Column, limit: Column, missing: str) -> Column:
    """``stale`` beyond the limit, ``missing`` without an age, NULL if in order."""
    return F.when(age.isNull(), F.lit(missing)).when(age > limit, "stale")


def target_findings(targets: DataFrame, runs: DataFrame, commits: DataFrame, now: Column) -> DataFrame:
    """key, finding of each target's schedule and output."""
    cron = newest_age(runs, ["repo", "workflow"], F.coalesce("run_started_at", "created_at"), (F.col("event") == "schedule") & (F.col("conclusion") == "success"), now, "cron_age")
    out = newest_age(commits, ["repo", "path"], F.col("committed_at"), F.lit(True), now, "output_age")
    t = targets.join(cron, ["repo", "workflow"], "left").join(out, ["repo", "path"], "left")
    a = t.select(F.concat_ws("/", "repo", "workflow").alias("key"), stale(F.col("cron_age"), F.col("cron_max_days"), "never_ran").alias("finding"))
    b = t.where("path IS NOT NULL").select(F.concat_ws("/", "repo", "path").alias("key"), stale(F.col("output_age"), F.col("output_max_days"), "unreadable").alias("finding"))
    return a.unionByName(b).where("finding IS NOT NULL")


def hold(findings: DataFrame, previous: DataFrame | None, post_all: bool = False) -> DataFrame:
    """Findings with ``post``: those that the previous run had too. An unknown previous state (None) posts all, an empty one holds all."""
    if previous is None or post_all:
        return findings.withColumn("post", F.lit(True))
    seen = previous.select("key").distinct().withColumn("_seen", F.lit(True))
    return findings.join(seen, "key", "left").withColumn("post", F.coalesce("_seen", F.lit(False))).drop("_seen")


def recurring(findings: DataFrame, run: str, key: str = "key") -> DataFrame:
    """Findings with ``again``: whether the run before had the key too. Runs are numbered without gaps."""
    before = findings.select(key, (F.col(run) + 1).alias(run)).distinct().withColumn("again", F.lit(True))
    return findings.join(before, [key, run], "left").withColumn("again", F.coalesce("again", F.lit(False)))

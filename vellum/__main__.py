"""Command line: ``python -m vellum [feed|ingest|monitor] ...``.

There is no network code here: ``--transport MODULE:FUNCTION`` names what fetches a URL (status, body), ``--service MODULE:FUNCTION`` what resolves
suggestions (ingest) or reads and posts (monitor). Without a transport nothing is fetched.
"""

from __future__ import annotations

import argparse
import importlib
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum import schemas
from vellum.plans import enrich, monitor
from vellum.plans.build import build_feeds
from vellum.session import build_session
from vellum.sources.fetch import Fetcher
from vellum.sources.tables import load_settings
from vellum.streaming import ingest


def named(spec: str) -> Callable:
    """The function that MODULE:FUNCTION names."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def asker(transport: str, rate_limit: float, providers: tuple[str, ...] = enrich.ORDER) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """Asks all providers about entries, each at most once in ``rate_limit`` seconds."""
    def ask(entries: DataFrame) -> dict[str, DataFrame]:
        asked = enrich.questions(entries)
        make = lambda: Fetcher(named(transport), spacing=rate_limit)
        return {p: enrich.ask(asked, p, make) for p in providers}

    return ask


def feed_command(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="vellum", description="Feeds from bibliography files.")
    p.add_argument("files", nargs="+", help="bibliography files in order of preference, each as FILE or FILE=source")
    p.add_argument("-o", "--out", required=True)
    p.add_argument("-j", "--json", action="store_true")
    p.add_argument("-r", "--rss", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--metadata", help="Parquet table of fetched metadata")
    p.add_argument("--discovery", help="JSON table of first sightings")
    p.add_argument("--config", help="JSON or YAML settings: feeds.title, feeds.link, feeds.description")
    p.add_argument("--transport", help="MODULE:FUNCTION that fetches a URL")
    p.add_argument("--cache", help="Parquet table of cached metadata")
    p.add_argument("--no-enrich", action="store_true", help="fetch nothing")
    p.add_argument("--rate-limit", type=float, default=1.0, help="seconds between requests to a provider")
    p.add_argument("--timeout", type=float, help="seconds a request may take, handed to the transport as VELLUM_TIMEOUT")
    p.add_argument("--skip-cached-enrichment", action="store_true", help="use newly fetched metadata only")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO)
    feeds = (load_settings(a.config) if a.config else {}).get("feeds", {})
    pairs = [tuple(f.rsplit("=", 1)) if "=" in f else (f, f"source{k}") for k, f in enumerate(a.files)]
    spark = build_session(**({"spark_executorEnv_VELLUM__TIMEOUT": str(a.timeout)} if a.timeout else {}))
    ask = asker(a.transport, a.rate_limit) if a.transport and not a.no_enrich else None
    build_feeds(spark, pairs, a.out, a.metadata, a.discovery, feeds.get("title", "Bibliography"), feeds.get("link", ""), feeds.get("description", ""), a.json or not a.rss, a.rss, ask, a.cache, not a.skip_cached_enrichment)


def ingest_command(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="vellum ingest", description="Suggestions of a chat as records, ledger and replies.")
    p.add_argument("messages", help="folder of JSON messages")
    p.add_argument("-o", "--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--tag", help="hashtag of suggestions; without it every link and PDF is one")
    p.add_argument("--channel", default="")
    p.add_argument("--service", required=True, help="MODULE:FUNCTION, batch -> batch with paper (see operators.archive.resolve)")
    p.add_argument("--expire-days", type=int, default=30)
    p.add_argument("--every", help="interval of batches, such as '1 minute'; without it what is there is taken, and states don't expire")
    a = p.parse_args(argv)
    spark = build_session()
    rows = ingest.pending(ingest.threads(ingest.read_messages(spark, a.messages), a.tag), a.expire_days if a.every else 0, 90 if a.every else 0)
    ingest.ingest(rows, a.out, a.checkpoint, named(a.service), channel=a.channel, every=a.every).awaitTermination()


def monitor_command(argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="vellum monitor", description="Findings on schedules and outputs.")
    p.add_argument("targets", help="JSON table of targets")
    p.add_argument("--state", required=True, help="where the keys of this run's findings are kept for the next")
    p.add_argument("--probe", required=True, help="MODULE:FUNCTION, session -> (runs, commits, listed runs)")
    p.add_argument("--post", required=True, help="MODULE:FUNCTION, lines -> the service's answer")
    p.add_argument("--post-all", action="store_true", help="post findings at first sight")
    a = p.parse_args(argv)
    spark = build_session()
    probe = named(a.probe)
    monitor.run(spark, spark.read.schema(schemas.TARGETS).json(a.targets), lambda: probe(spark), a.state, F.current_timestamp(), named(a.post), a.post_all)


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    commands = {"feed": feed_command, "ingest": ingest_command, "monitor": monitor_command}
    command = commands.get(argv[0]) if argv else None
    command(argv[1:]) if command else feed_command(argv)


if __name__ == "__main__":
    main()

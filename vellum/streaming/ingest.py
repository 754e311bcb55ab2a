"""Suggestions as a stream: routing, pending requests as keyed state, and idempotent output."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum import schemas
from vellum.functions.files import first_pdf
from vellum.operators import archive
from vellum.operators.archive import route
from vellum.sources.tables import exists

_OUT = "ts string, outcome string, text string, reply_ts string"
_STATE = "text string, waiting boolean"


def read_messages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Messages of JSON files as they arrive; the checkpoint of the query is the cursor."""
    return spark.readStream.schema(schemas.MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def routed(messages: DataFrame, tag: str | None) -> DataFrame:
    """Suggestions of a stream, by row, without state."""
    return route(messages, tag).where("skip IS NULL")


def windowed_counts(messages: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Messages by window of their time stamp; rows later than the watermark are dropped."""
    at = messages.withColumn("at", F.col("ts").cast("double").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", width)).agg(F.count("*").alias("n"))


def threads(messages: DataFrame, tag: str | None) -> DataFrame:
    """thread, ts, text, has_pdf, asks of messages and replies, the input of ``pending``."""
    m = route(messages, tag)
    reply = F.col("thread_ts").isNotNull() & (F.col("thread_ts") != F.col("ts"))
    return m.select(F.coalesce("thread_ts", "ts").alias("thread"), "ts", "text", first_pdf(F.col("files")).isNotNull().alias("has_pdf"), (F.col("skip").isNull() & ~reply).alias("asks"), reply.alias("is_reply"))


def _step(expire_ms: int, settled_ms: int = 0) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        thread = key[0]
        if state.hasTimedOut:
            text, waiting = state.get
            if waiting and settled_ms:
                state.update((text, False))  # so that it is not taken up again
                state.setTimeoutDuration(settled_ms)
            else:
                state.remove()
            if waiting:
                yield pd.DataFrame({"ts": [thread], "outcome": ["expired"], "text": [text], "reply_ts": [None]})
            return
        rows = pd.concat(list(frames)).sort_values("ts", key=lambda ts: ts.map(Decimal), kind="stable")  # "9.5" before "10.5"
        text, waiting = state.get if state.exists else (None, False)
        out = []
        for r in rows.itertuples():
            if r.asks and not waiting and not state.exists:
                text, waiting = r.text, not r.has_pdf
                out.append((thread, "asked_for_pdf" if waiting else "added", text, None))
            elif r.is_reply and waiting and r.has_pdf:
                waiting = False
                out.append((thread, "added", text, r.ts))
        if text is not None:
            state.update((text, waiting))
            if expire_ms if waiting else settled_ms:
                state.setTimeoutDuration(expire_ms if waiting else settled_ms)
        if out:
            yield pd.DataFrame(out, columns=["ts", "outcome", "text", "reply_ts"])

    return step


def pending(thread_rows: DataFrame, expire_days: int = 30, settled_days: int = 90) -> DataFrame:
    """ts, outcome, text, reply_ts: a suggestion without a PDF waits as state of its thread; the first reply with a PDF
    completes it, and it expires by processing time. A thread that was settled is not taken up again; its state is kept for ``settled_days``
    after, for messages that are sent again, and then removed, so that the state doesn't grow with all threads ever seen. 0 keeps
    states for ever, which lets a query over what is there end."""
    timed = expire_days or settled_days
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return thread_rows.groupBy("thread").applyInPandasWithState(_step(expire_days * 86_400_000, settled_days * 86_400_000), _OUT, _STATE, "append", timeout)


def _day() -> Column:
    """The day of a message's time stamp, by which tables are partitioned."""
    return F.date_format(F.timestamp_seconds(F.col("ts").cast("decimal(20,6)")), "yyyy-MM-dd")


def append_once(batch: DataFrame, table_path: str, key: str = "ts") -> None:
    """Append the rows whose key a table doesn't have. The table is partitioned by the day of ``ts``, and only days that the batch
    touches are read, so the cost of a batch doesn't grow with the table. Repeating a batch, also after it was half written, adds what is missing."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key]).withColumn("day", _day())
    if exists(spark, table_path):
        # the days of a batch are few; the join on day lets the scan skip all other partitions
        there = spark.read.schema(f"{key} STRING, day STRING").parquet(table_path)
        fresh = fresh.join(there.join(F.broadcast(fresh.select("day").distinct()), "day", "left_semi"), [key, "day"], "left_anti")
    fresh.select(*batch.columns, "day").write.mode("append").partitionBy("day").parquet(table_path)


def write_once(rows: DataFrame, table_path: str, checkpoint: str, key: str = "ts", every: str | None = None) -> StreamingQuery:
    """Append batches to a table so that a key is there once, also after a batch is repeated.

    ``every`` runs batches at an interval; without it the query takes what is there and ends. Rows of ``pending`` need an
    interval, as states that expire by time keep such a query from ending.
    """
    return _run(rows, lambda batch, _: append_once(batch, table_path, key), checkpoint, every)


def _run(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def finalise(batch: DataFrame, out: str, resolve: Callable[[DataFrame], DataFrame], inbox: DataFrame | None = None, channel: str = "") -> None:
    """The outputs of one batch of settled suggestions (ts, text, outcome, and what ``resolve`` needs): ``inbox`` (records as
    BibTeX text by key), ``ledger`` (ts and the key it became, or ``(duplicate)``) and ``outbox`` (replies to send).

    ``resolve`` adds ``paper`` (see ``archive.resolve``) and ``pdf_source``. Each output is appended once by ts, so a batch that is repeated adds nothing,
    and one that stopped between two outputs is completed."""
    done = archive.published(resolve(batch), inbox)
    done.persist()  # one batch, used for three outputs
    try:
        fresh = done.where("NOT is_there AND outcome = 'added'")
        append_once(fresh.select("ts", "key", F.col("bib").alias("value")), f"{out}/inbox")
        append_once(done.where("outcome <> 'asked_for_pdf'").select("ts", F.when(F.col("is_there"), "(duplicate)").when(F.col("outcome") == "added", F.col("key")).otherwise(F.concat(F.lit("("), "outcome", F.lit(")"))).alias("value")), f"{out}/ledger")
        append_once(archive.outbox(done, channel, archive.reply()).withColumn("ts", F.concat("thread_ts")).select("ts", "channel_id", "thread_ts", "text"), f"{out}/outbox")
    finally:
        done.unpersist()


def ingest(rows: DataFrame, out: str, checkpoint: str, resolve: Callable[[DataFrame], DataFrame], inbox: Callable[[SparkSession], DataFrame | None] = lambda _: None, channel: str = "", every: str | None = None) -> StreamingQuery:
    """Settled suggestions of a stream (see ``pending``) to the outputs of ``finalise``; ``inbox`` reads what is there already, once a batch."""
    return _run(rows, lambda batch, _: finalise(batch, out, resolve, inbox(batch.sparkSession), channel), checkpoint, every)

"""Structured Streaming side (R1-R6): the poll loop becomes a file-source stream with a
processing-time trigger; routing runs per micro-batch; issues close by watermark.

* R1 ``stream_messages``: ``readStream`` with a declared schema.
* R2/R3/R5/R6 ``run_router``: per batch the mail in scope is routed once, config mails are
  folded, send-now requests, reposts and not-whitelisted labels recorded, and rows that cannot be
  applied (bad config text, mail for an issue already written) go to the dead letter. Once-only is
  a ledger of routed keys, not a watermark: a message that comes late, however late, is routed like any
  other, and one that comes again is not. Each output is partitioned by ``batch_id``
  and written with dynamic partition overwrite, so a replayed batch rewrites instead of duplicating.
* R4 ``run_issues``: the release of each message by the closed form (no calendar join),
  the watermark on ``release_ts`` itself, one row per (mailbox, release) in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import issues as iss
from quire.operators import mailbox as mb


def stream_messages(spark: SparkSession, path: str, schema, *, fmt: str = "parquet",
                    max_files: int | None = None) -> DataFrame:
    """A stream of exported messages."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def _trigger(w, every: str | None):
    return w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


KEY = ["mailbox_id", "message_id"]


def _first_seen(df: DataFrame, ledger: str, batch_id: int) -> DataFrame:
    """Messages of a batch that no other batch has routed, one row a key. Of the ledger only the
    batch's span of dates is read."""
    new = df.dropDuplicates(KEY)
    if not _exists(df.sparkSession, ledger):
        return new
    span = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    if span["lo"] is None:
        return new
    done = (df.sparkSession.read.parquet(ledger).where(F.col("batch_id") != batch_id)
            .where(F.col("date").between(F.lit(span["lo"]), F.lit(span["hi"]))).select(*KEY))
    return new.join(done, KEY, "left_anti")


def _of_released_issue(mail: DataFrame, issues: DataFrame, lookback_days: int) -> DataFrame:
    """Mail whose own issue is out: the next release after it, within the look-back, is written.
    Days are equi-joined, so a mail meets the releases of a few days and not of all time."""
    out = issues.select("mailbox_id", F.col("release_ts")).distinct().withColumn("_day", F.to_date("release_ts"))
    days = F.explode(F.sequence(F.to_date("date"), F.date_add(F.to_date("date"), lookback_days))).alias("_day")
    return (mail.select(*KEY, "date", days).join(out, ["mailbox_id", "_day"])
            .where(F.col("date").cast("timestamp") <= F.col("release_ts")).select(*KEY).distinct())


def run_router(stream: DataFrame, whitelist: DataFrame, out_dir: str, *, checkpoint: str, every: str | None = None,
               issues_path: str | None = None, lookback_days: int = iss.LOOKBACK_DAYS) -> StreamingQuery:
    """R2 + R3 + R5 + R6 + K5. ``every=None`` processes what is there and stops (tests).
    ``checkpoint`` is the stream's own folder on shared storage. A whitelist with a
    ``mailbox_id`` holds for its mailboxes only.

    K5: ``config_changes`` is the ledger of all applied config values (one partition per
    batch). After a batch with config mails, the setup of the mailboxes it touched is
    folded again from the whole ledger (the newest batch wins, inside a batch the oldest
    mail) and rewritten under ``out_dir/setup``, one partition per mailbox."""
    spark = stream.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        fresh = _first_seen(df.where(mb.mail_check_scope()), f"{out_dir}/routes", batch_id)
        routed = mb.route_messages(fresh, whitelist).persist()
        try:
            _write_batch(routed.select(*KEY, "date", "route"), f"{out_dir}/routes", batch_id)
            cfg = mb.config_entries(routed.where(F.col("route") == mb.ROUTE_CONFIG))
            bad = cfg.where(F.col("error").isNotNull()).select(*KEY, "error")
            good = cfg.where(F.col("_m").isNotNull())          # a bad value is left out, the others of its mail hold
            kv = good.select(*KEY, "date", F.explode("_m").alias("key", "value"))
            changes = kv.where(F.col("key").isin(*mb.CONFIG_KEYS) & ~mb.bad_value(F.col("key"), F.col("value")))
            _write_batch(changes, f"{out_dir}/config_changes", batch_id)
            touched = changes.select("mailbox_id").distinct()
            if not touched.isEmpty():
                _upsert_setup(spark, out_dir, touched)
            # A config mail with send_now closes the issue at its own time
            _write_batch(kv.where((F.col("key") == "send_now") & (F.lower("value") == "true"))
                         .select("mailbox_id", F.col("date").alias("as_of"), "message_id"),
                         f"{out_dir}/send_now", batch_id)
            _write_batch(routed.where(F.col("route") == mb.ROUTE_REPOST).select(*KEY), f"{out_dir}/reposts", batch_id)
            _write_batch(routed.where(F.col("route") == mb.ROUTE_OTHER)
                         .select(*KEY, F.array(F.lit("NOT_WHITELISTED")).alias("add")),
                         f"{out_dir}/label_changes", batch_id)
            if issues_path is not None and _exists(spark, issues_path):
                # Mail of an issue that is already out
                late = _of_released_issue(routed, spark.read.parquet(issues_path), lookback_days)
                bad = bad.unionByName(late.withColumn("error", F.lit("issue already released")))
            _write_batch(bad, f"{out_dir}/dead_letter", batch_id)
        finally:
            routed.unpersist()

    return _trigger(stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), every).start()


def _upsert_setup(spark: SparkSession, out_dir: str, touched: DataFrame) -> None:
    """K5: refold the ledger for the touched mailboxes and rewrite their setup rows."""
    from quire.sources.sinks import write_setup
    ledger = spark.read.parquet(f"{out_dir}/config_changes").join(touched, "mailbox_id", "left_semi")
    order = F.struct(F.col("batch_id"), (-F.unix_micros(F.col("date").cast("timestamp"))).alias("_d"),
                     F.col("message_id"))
    folded = ledger.groupBy("mailbox_id", "key").agg(F.max_by("value", order).alias("value"))
    setup = iss.setup_from_configs(folded, touched)
    write_setup(setup.withColumn("days", F.to_json("days"))
                     .withColumn("whitelisted_senders", F.to_json("whitelisted_senders")), f"{out_dir}/setup")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def issue_stream(stream: DataFrame, setup: DataFrame, *, whitelist: DataFrame | None = None, delay: str = "1 second") -> DataFrame:
    """R4 as a DataFrame: ``(mailbox_id, release_ts, n_messages, first_date, last_date)``
    per issue, emitted once the watermark on ``release_ts`` passes it. With a whitelist,
    config mails and reposts are no part of an issue, as in batch."""
    s = stream.where(mb.archive_state(0) & mb.labels_none(["ANALYZED"]))
    if whitelist is not None:
        s = mb.route_messages(s, whitelist).where(~F.col("route").isin(mb.ROUTE_CONFIG, mb.ROUTE_REPOST))
    s = s.join(setup.select("mailbox_id", "active", "days", "release_time_str"), "mailbox_id")
    rel = iss.next_release(F.col("date"), F.col("days"), F.col("release_time_str"), F.col("active"))
    s = s.withColumn("release_ts", rel.cast("timestamp")).where(F.col("release_ts").isNotNull())
    s = s.withWatermark("release_ts", delay).dropDuplicatesWithinWatermark(["mailbox_id", "message_id"])
    return s.groupBy("mailbox_id", "release_ts").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def run_issues(stream: DataFrame, setup: DataFrame, out_path: str, *, checkpoint: str, whitelist: DataFrame | None = None,
               every: str | None = None, delay: str = "1 second") -> StreamingQuery:
    """Closed issues appended to ``out_path`` (parquet); ``checkpoint`` is the stream's own shared folder."""
    w = (issue_stream(stream, setup, whitelist=whitelist, delay=delay).writeStream.outputMode("append").format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint))
    return _trigger(w, every).start()

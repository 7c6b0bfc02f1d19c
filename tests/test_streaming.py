"""Batch = stream: the router and the issue stream over split files, with a replayed file."""

import glob
import os

from pyspark.sql import functions as F

from conftest import SMALL
from quire.operators import issues as iss
from quire.operators import mailbox as mb
from quire.plans.queries import setup
from quire.sources import fixtures as fx
from quire.streaming.mail import issue_stream, run_issues, run_router, stream_messages


def _split_files(spark, scratch, name):
    """One folder per day (part=N) plus a replay of the first day (part=999)."""
    m = fx.messages_v(spark, SMALL).withColumn("date", F.col("date").cast("timestamp"))
    src = os.path.join(scratch, name)
    first = m.select(F.min(F.to_date("date"))).first()[0]
    parted = m.withColumn("part", F.datediff(F.to_date("date"), F.lit(first)))
    parted.write.mode("overwrite").partitionBy("part").parquet(src)
    parted.where("part = 0").withColumn("part", F.lit(999)).write.mode("append").partitionBy("part").parquet(src)
    return m, src, parted.schema


def test_router_stream_equals_batch(spark, scratch):
    m, src, schema = _split_files(spark, scratch, "router_in")
    stream = stream_messages(spark, src, schema)
    out = os.path.join(scratch, "router_out")
    q = run_router(stream, fx.whitelist_v(spark, SMALL), out, checkpoint=os.path.join(scratch, "router_ck"))
    q.awaitTermination()
    routes = spark.read.parquet(f"{out}/routes")
    batch = mb.route_messages(fx.messages_v(spark, SMALL), fx.whitelist_v(spark, SMALL)).where(mb.mail_check_scope())
    assert routes.count() == batch.count()          # the replayed day adds nothing
    got = {(r["message_id"], r["route"]) for r in routes.collect()}
    assert got == {(r["message_id"], r["route"]) for r in batch.select("message_id", "route").collect()}
    files = glob.glob(f"{out}/dead_letter/*/*.parquet")
    n_bad = spark.read.parquet(f"{out}/dead_letter").count() if files else 0
    assert n_bad == batch.where("route = 'config'").transform(mb.config_entries).where("error IS NOT NULL").count()


def test_issue_stream_equals_batch(spark, scratch):
    m, src, schema = _split_files(spark, scratch, "issues_in")
    st = setup(spark, SMALL)
    out = os.path.join(scratch, "issues_out")
    wl = fx.whitelist_v(spark, SMALL)
    q = run_issues(stream_messages(spark, src, schema), st, out, whitelist=wl,
                   checkpoint=os.path.join(scratch, "issues_ck"))
    q.awaitTermination()
    streamed = {(r["mailbox_id"], r["release_ts"], r["n_messages"]) for r in spark.read.parquet(out).collect()}
    b = mb.route_messages(m, wl).where("route = 'not_whitelisted'").where(mb.archive_state(0) & mb.labels_none(["ANALYZED"])).join(
        st.select("mailbox_id", "active", "days", "release_time_str"), "mailbox_id")
    b = b.withColumn("release_ts", iss.next_release("date", "days", "release_time_str", "active").cast("timestamp"))
    batch = {(r["mailbox_id"], r["release_ts"], r["n"]) for r in
             b.where("release_ts IS NOT NULL").groupBy("mailbox_id", "release_ts").agg(F.count("*").alias("n")).collect()}
    assert streamed <= batch                        # every closed issue equals its batch twin
    open_per_mailbox = len({k[0] for k in batch})
    assert len(batch) - len(streamed) <= open_per_mailbox   # only the last issue of a mailbox may stay open
    assert issue_stream is not None
    assert glob.glob(out)


def test_late_mail_goes_to_dead_letter(spark, scratch):
    """Mail of an issue that is already written is dead-lettered, once, however many issues are out."""
    m, src, schema = _split_files(spark, scratch, "late_in")
    issues = os.path.join(scratch, "late_issues")
    out_at = ["2024-01-03 00:00:00", "2024-01-10 00:00:00", "2024-01-10 00:00:00"]
    spark.createDataFrame([(0, t) for t in out_at], "mailbox_id int, release_ts string") \
        .selectExpr("mailbox_id", "CAST(release_ts AS TIMESTAMP) AS release_ts").write.mode("overwrite").parquet(issues)
    out = os.path.join(scratch, "late_out")
    q = run_router(stream_messages(spark, src, schema), fx.whitelist_v(spark, SMALL), out,
                   checkpoint=os.path.join(scratch, "late_ck"), issues_path=issues)
    q.awaitTermination()
    late = spark.read.parquet(f"{out}/dead_letter").where("error = 'issue already released'")
    want = m.where(mb.mail_check_scope()).where("mailbox_id = 0 AND date <= TIMESTAMP '2024-01-10 00:00:00'").count()
    assert late.count() == late.select("message_id").distinct().count() == want > 0


def test_old_files_last_lose_nothing(spark, scratch):
    """One file a micro-batch, the newest mail first: every message in scope is routed exactly once."""
    m = fx.messages_v(spark, SMALL).withColumn("date", F.col("date").cast("timestamp"))
    src = os.path.join(scratch, "reversed_in")
    cut = m.select(F.percentile_approx("date", [0.33, 0.66])).first()[0]
    parts = [m.where(F.col("date") > cut[1]), m.where(F.col("date").between(cut[0], cut[1])), m.where(F.col("date") < cut[0])]
    for p in [*parts, parts[0]]:                       # and the first file once more
        p.coalesce(1).write.mode("append").parquet(src)
    out = os.path.join(scratch, "reversed_out")
    run_router(stream_messages(spark, src, m.schema, max_files=1), fx.whitelist_v(spark, SMALL), out,
               checkpoint=os.path.join(scratch, "reversed_ck")).awaitTermination()
    got = [r["message_id"] for r in spark.read.parquet(f"{out}/routes").collect()]
    want = [r["message_id"] for r in m.where(mb.mail_check_scope()).collect()]
    assert sorted(got) == sorted(want) and want
    assert spark.read.parquet(f"{out}/routes").select("batch_id").distinct().count() == 3


def test_whitelist_holds_per_mailbox(spark):
    m = spark.createDataFrame([(0, "a", "x@y.z"), (1, "b", "x@y.z"), (1, "c", "u@v.w")], "mailbox_id int, message_id string, sender string")
    setup = spark.createDataFrame([(0, ["x@y.z", None]), (1, ["u@v.w", "u@v.w"]), (2, None)], "mailbox_id int, whitelisted_senders array<string>")
    got = {r["message_id"]: r["is_whitelisted"] for r in mb.whitelist_split(m, mb.setup_whitelist(setup)).collect()}
    assert got == {"a": True, "b": False, "c": True}
    assert {r["message_id"] for r in mb.whitelist_semi(m, mb.setup_whitelist(setup)).collect()} == {"a", "c"}


def test_setup_upsert_in_stream(spark, scratch):
    """K5: the setup written by the router equals the batch fold of the same config mails
    (one micro-batch here, so the poll is that batch)."""
    m, src, schema = _split_files(spark, scratch, "setup_in")
    out = os.path.join(scratch, "setup_stream_out")
    q = run_router(stream_messages(spark, src, schema), fx.whitelist_v(spark, SMALL), out,
                   checkpoint=os.path.join(scratch, "setup_ck"))
    q.awaitTermination()
    got = {(r["mailbox_id"], r["limit_newest"], r["release_time_str"]) for r in spark.read.json(f"{out}/setup").collect()}
    r = mb.route_messages(fx.messages_v(spark, SMALL), fx.whitelist_v(spark, SMALL)).where(mb.mail_check_scope())
    folded = mb.config_fold(r.where(F.col("route") == mb.ROUTE_CONFIG), poll=F.lit(0))
    cfg_boxes = folded.select("mailbox_id").distinct()
    want = {(x["mailbox_id"], x["limit_newest"], x["release_time_str"])
            for x in iss.setup_from_configs(folded, cfg_boxes).collect()}
    assert got == want and got

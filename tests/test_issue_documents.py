"""Issues as documents: the stream against its batch twins, whatever the order of files, and against a plain walk."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from conftest import SMALL
from quire.operators import issues as iss
from quire.operators import mailbox as mb
from quire.plans.queries import setup
from quire.sources import fixtures as fx
from quire.streaming.issue_state import DAY, SECOND, release_after, run_issue_documents
from quire.streaming.mail import stream_messages


def _reversed_files(m, src):
    """Four files, the newest mail first, then the first once more, then a tick that moves the watermark past all issues."""
    cut = m.select(F.percentile_approx("date", [0.25, 0.5, 0.75])).first()[0]
    lo, hi = m.select(F.min("date"), F.max("date")).first()
    edges = [lo, *cut, hi + dt.timedelta(seconds=1)]
    parts = [m.where((F.col("date") >= a) & (F.col("date") < b)) for a, b in zip(edges, edges[1:])][::-1]
    for p in [*parts, parts[0]]:
        p.coalesce(1).write.mode("append").parquet(src)
    return hi


def _tick(m, src, at):
    m.limit(1).withColumn("date", F.lit(at)).withColumn("mailbox_id", F.lit(99)) \
     .withColumn("labels", F.array(F.lit("INBOX"))).withColumn("title", F.lit("tick")) \
     .coalesce(1).write.mode("append").parquet(src)


def _rows(df):
    return sorted((r["mailbox_id"], r["release_ts"], r["msg_rank"], r["message_id"]) for r in df.collect())


def _streamed(spark, src, schema, wl, scratch, name, **how):
    out = os.path.join(scratch, f"{name}_out")
    run_issue_documents(stream_messages(spark, src, schema, max_files=1), wl, out, delay="400 days",
                        checkpoint=os.path.join(scratch, f"{name}_ck"), **how).awaitTermination()
    docs = spark.read.parquet(out)
    return docs, docs.select("mailbox_id", "release_ts", F.posexplode("message_ids").alias("msg_rank", "message_id"))


def test_stream_equals_batch(spark, scratch):
    """A fixed setup, no config mail: both rules for mail over the limit, one file a micro-batch, older files last."""
    wl = fx.whitelist_v(spark, SMALL)
    m = fx.messages_v(spark, SMALL).withColumn("date", F.col("date").cast("timestamp"))
    m = mb.route_messages(m, wl).where(F.col("route") != mb.ROUTE_CONFIG).select(m.columns)
    st = setup(spark, SMALL).withColumn("limit_newest", F.lit(3)).checkpoint()
    src = os.path.join(scratch, "docs_in")
    hi = _reversed_files(m, src)
    _tick(m, src, hi + dt.timedelta(days=900))
    r = mb.route_messages(m.withColumn("date", F.col("date").cast("timestamp_ntz")), wl)
    twins = {True: iss.issue_carry_over(r, st), False: iss.issue_messages(r, st, routes=r)}
    for carry, twin in twins.items():
        _, got = _streamed(spark, src, m.schema, wl, scratch, f"docs_{carry}", setup=st, carry_over=carry)
        want = _rows(twin.withColumn("release_ts", F.col("release_ts").cast("timestamp")))
        assert _rows(got) == want and len(want) > 20


def _walk(mail, configs, now, lookback=7):
    """Minute by minute: config values act from their time, a send-now or a release takes the newest that wait."""
    def at(t):
        cur = {"active": True, "days": [], "release_time_str": "", "limit_newest": 10}
        for c in sorted(configs):
            if c[0] <= t:
                cur.update(c[2])
        return cur
    out, taken = [], set()
    lo, hi = min(t for t, _ in mail), max(t for t, _ in mail) + 10 * DAY
    for t in range(lo - lo % (60 * SECOND), hi, 60 * SECOND):
        for sent in (True, False):
            if sent and t not in now:
                continue
            if not sent:
                s = at(t - 1)
                if not s["active"] or release_after(t - 1, s["days"], s["release_time_str"]) != t:
                    continue
            own = [(a, i) for a, i in mail if i not in taken and (a <= t if sent else a < t) and a // DAY >= t // DAY - lookback]
            got = sorted(own, reverse=True)[:at(t)["limit_newest"]]
            taken |= {i for _, i in got}
            if got:
                out.append((t, sent, [i for _, i in got]))
    return out


def test_config_in_time_and_send_now(spark, scratch):
    """Setup changes and send-now inside the span, against the walk; no message is in two issues."""
    import json
    rng = random.Random(5)
    start = 19_700 * DAY
    mail = [(start + rng.randrange(20 * 1440) * 60 * SECOND + 7 * SECOND, f"m{i:03d}") for i in range(160)]
    configs = [(start - 3600 * SECOND, "c0", {"days": ["Monday", "Wednesday", "Friday"], "release_time_str": "08:00:00", "limit_newest": 9}),
               (start + 6 * DAY + 3 * SECOND, "c1", {"limit_newest": 4}),
               (start + 9 * DAY + 5 * SECOND, "c2", {"days": list(iss.WEEKDAYS), "release_time_str": "20:30:00", "limit_newest": 12})]
    now = [start + 5 * DAY + 3660 * SECOND, start + 12 * DAY + 20 * 3600 * SECOND]
    rows = [(0, a, i, "u@v.w", "hello", "text", ["INBOX"]) for a, i in mail]
    rows += [(0, a, i, "x@y.z", "Config", json.dumps(c), ["INBOX"]) for a, i, c in configs]
    rows += [(0, a, f"n{a}", "x@y.z", "Config", '{"send_now": true}', ["INBOX"]) for a in now]
    rows += [(0, start, "bad", "x@y.z", "Config", "no json", ["INBOX"])]
    rng.shuffle(rows)
    src = os.path.join(scratch, "walk_in")
    for part in (rows[:60], rows[60:120], rows[120:], rows[:30], [(9, start + 900 * DAY, "tick", "u@v.w", "t", "", ["INBOX"])]):
        df = spark.createDataFrame(part, "mailbox_id int, at long, message_id string, sender string, title string, text string, labels array<string>") \
                  .withColumn("date", F.timestamp_micros("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(src)
    wl = spark.createDataFrame([("x@y.z",)], "addr string")
    docs, members = _streamed(spark, src, df.schema, wl, scratch, "walk")
    got = [(int(r["us"]), r["send_now"], r["message_ids"]) for r in
           docs.where("mailbox_id = 0").withColumn("us", F.unix_micros("release_ts")).orderBy("us", F.desc("send_now")).collect()]
    assert got == _walk(mail, configs, now) and sum(s for _, s, _ in got) == 2
    assert members.count() == members.select("message_id").distinct().count()
    assert {r["limit_newest"] for r in docs.collect()} == {9, 4, 12}


def test_release_rule_equals_the_column(spark):
    rng = random.Random(1)
    rows = [(19_000 * DAY + rng.randrange(20 * 86_400) * SECOND, rng.sample(iss.WEEKDAYS + ("Noday",), rng.randrange(0, 4)),
             rng.choice(["08:00:00", "23:59:59", "00:00:00", "24:00:00", "8:00", ""])) for _ in range(300)]
    df = spark.createDataFrame(rows, "at long, days array<string>, time string") \
              .withColumn("t", F.timestamp_micros("at").cast("timestamp_ntz"))
    got = df.select("at", "days", "time", F.unix_micros(iss.next_release("t", "days", "time").cast("timestamp")).alias("r")).collect()
    assert all(release_after(x["at"], x["days"], x["time"]) == x["r"] for x in got)

"""Issues as documents in the stream (R4, R5, J8, T4): one keyed state a mailbox, with event-time timers.

``issue_documents`` turns a stream of mail into one row per closed issue: its members, newest first, at most the
``limit_newest`` that holds when it closes. Everything comes through the same stream: mail in scope waits in the
state, config mail changes the setup from its own time on, and a send-now config closes an issue at its time, whose
members a scheduled issue then leaves out.

The state of a mailbox holds narrow rows (time and id; never a text) of mail inside the look-back, and the config
values that can still act. A timer stands at each coming release and each send-now; it fires when the watermark on
the mail's date passes it, so the order in which files arrive within ``delay`` changes nothing. Mail behind
the watermark is dropped here; the router dead-letters it (R6).

All mail of one mailbox in one micro-batch passes one task, as Arrow batches of (time, id); ``max_files`` of
``stream_messages`` bounds a micro-batch. The calendar rule is that of ``operators.issues.next_release``.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quire.operators import issues as iss
from quire.operators import mailbox as mb

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CALENDAR_KEYS = ("active", "days", "release_time_str")
SETUP_KEYS = (*CALENDAR_KEYS, "limit_newest", "newsletter_email")
SECOND = 1_000_000
DAY = 86_400 * SECOND
ALWAYS = -(1 << 62)                       # the time of a setup that holds from the start
OUT = ("mailbox_id {key}, release_us bigint, send_now boolean, limit_newest int, newsletter_email string, "
       "n_messages int, message_ids array<string>")


def release_after(at: int, days: list[str], release_time: str) -> int | None:
    """The first release strictly after ``at`` (microseconds)."""
    parts = (release_time or "").split(":")
    if len(parts) != 3 or not all(len(p) == 2 and p.isascii() and p.isdigit() for p in parts):
        return None
    h, m, s = map(int, parts)
    listed = {iss.WEEKDAYS.index(d) for d in days if d in iss.WEEKDAYS}
    if h > 23 or m > 59 or s > 59 or not listed:
        return None
    day = at // DAY
    for d in range(day, day + 8):
        r = d * DAY + (h * 3600 + m * 60 + s) * SECOND
        if (d + 3) % 7 in listed and r > at:          # day 0 was a Thursday
            return r
    return None


class Setup:
    """The config values of a mailbox in time: a value acts from its time on, ties by message id."""

    def __init__(self, entries: list):
        self.entries = sorted({tuple(e) for e in entries})            # (at, message_id, key, value)
        self.of = {k: [e for e in self.entries if e[2] == k] for k in SETUP_KEYS}
        self.changes = sorted({e[0] for k in CALENDAR_KEYS for e in self.of[k]})
        self.found: dict = {}

    def _raw(self, key: str, at: int) -> str | None:
        """The value of a key at a time."""
        es = self.of[key]
        i = bisect.bisect_right(es, at, key=lambda e: e[0])
        return es[i - 1][3] if i else None

    def release(self, at: int) -> int | None:
        """The first release after a time. A change of the calendar before it starts the search anew from the change,
        so the setup that holds when an issue closes decides."""
        if at not in self.found:
            t, i = at, bisect.bisect_right(self.changes, at)
            while True:
                r = self._planned(t)
                if i == len(self.changes) or (r is not None and self.changes[i] >= r):
                    break
                t, i = self.changes[i], i + 1
            self.found[at] = r
        return self.found[at]

    def _planned(self, at: int) -> int | None:
        """The first release after a time by the setup of that time alone."""
        active, days, time = (self._raw(k, at) for k in CALENDAR_KEYS)
        if (active or "").strip().lower() in ("false", "f", "no", "n", "0"):
            return None
        try:
            got = json.loads(days) if days else []
        except ValueError:
            got = []
        return release_after(at, [x for x in got if isinstance(x, str)] if isinstance(got, list) else [], time)

    def limit(self, at: int, most: int) -> int:
        v = self._raw("limit_newest", at)
        try:
            n = int(v) if v is not None else None
        except ValueError:
            n = None
        default = iss.SETUP_DEFAULTS["limit_newest"]
        return min(default if n is None or n < 0 else n, most)

    def email(self, at: int) -> str:
        v = self._raw("newsletter_email", at)
        return iss.SETUP_DEFAULTS["newsletter_email"] if v is None else v

    def since(self, at: int) -> list:
        """What can still act after ``at``: later values, and the last earlier one of each key."""
        return [e for es in self.of.values() for i, e in enumerate(es) if e[0] > at or i + 1 == len(es) or es[i + 1][0] > at]


class Issues(StatefulProcessor):
    """The state of a mailbox: ``mail`` (waiting rows), ``setup`` (config values, send-now times, the last release)."""

    def __init__(self, max_results: int, lookback_days: int, carry_over: bool):
        self.most, self.lookback, self.carry_over = max_results, lookback_days, carry_over

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mail = handle.getListState("mail", "at bigint, id string")
        self.setup = handle.getValueState("setup", "json string")

    def _load(self):
        got = json.loads(self.setup.get()[0]) if self.setup.exists() else {"entries": [], "now": [], "closed": ALWAYS}
        return Setup(got["entries"]), got["now"], got["closed"]

    def _save(self, setup: Setup, now: list, closed: int, at: int) -> None:
        self.setup.update((json.dumps({"entries": setup.since(at - (self.lookback + 1) * DAY), "now": now, "closed": closed}),))

    def _gone(self, at: int) -> int:
        """From when on mail of a time is outside every look-back."""
        return (at // DAY + self.lookback + 1) * DAY

    def _due(self, setup: Setup, at: int, closed: int) -> int | None:
        r = setup.release(max(at, closed) if self.carry_over else at)
        return r if r is not None and r < self._gone(at) else None

    def _timers(self, setup: Setup, times, closed: int, now: list) -> None:
        due = {self._due(setup, at, closed) or self._gone(at) for at in times} | set(now)
        for t in {-(-t // 1000) for t in due}:
            self.handle.registerTimer(t)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        entries = [(ALWAYS, "", k, v) for k, v in zip(initialState["key"], initialState["value"]) if k in SETUP_KEYS and v is not None]
        setup, now, closed = self._load()
        self._save(Setup([*setup.entries, *entries]), now, closed, ALWAYS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        setup, now, closed = self._load()
        times, entries, asked = set(), [], set(now)
        for part in rows:
            mail = part[part["kind"] == "mail"]
            if len(mail):
                self.mail.appendList(list(zip(mail["at"].tolist(), mail["id"].tolist())))
                times.update(mail["at"].tolist())
            conf = part[part["kind"] == "config"]
            entries += zip(conf["at"].tolist(), conf["id"].tolist(), conf["key"].tolist(), conf["value"].tolist())
            asked.update(part.loc[part["kind"] == "now", "at"].tolist())
        if entries:                                   # the calendar of waiting mail may move
            setup = Setup([*setup.entries, *entries])
            times.update(at for at, _ in self.mail.get())
        self._timers(setup, times, closed, sorted(asked))
        self._save(setup, sorted(asked), closed, timerValues.getCurrentWatermarkInMs() * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed, in order of time: a timer that this sets need not wait for the next batch
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        setup, now, closed = self._load()
        waiting = {i: at for at, i in self.mail.get()}                    # a replayed message waits once
        out = []
        while True:
            due = {}
            for i, at in waiting.items():
                due.setdefault(self._due(setup, at, closed), []).append(i)
            at = min([r for r in due if r is not None] + now, default=until + 1)
            if at > until:
                break
            sent_now = at in now                      # a send-now at the time of a release comes first
            if sent_now:
                now = [t for t in now if t != at]
                own = [i for i, t in waiting.items() if t <= at < self._gone(t)]
            else:
                own = [i for i, t in waiting.items() if t < at < self._gone(t)] if self.carry_over else due[at]
                closed = at
            limit = setup.limit(at, self.most)
            members = sorted(own, key=lambda i: (waiting[i], i), reverse=True)[:limit]
            if members:
                out.append((key[0], at, sent_now, limit, setup.email(at), len(members), members))
            for i in members if sent_now or self.carry_over else own:
                del waiting[i]
        waiting = {i: t for i, t in waiting.items() if self._gone(t) > until}
        if waiting:
            self.mail.put([(t, i) for i, t in waiting.items()])
        else:
            self.mail.clear()
        self._timers(setup, set(waiting.values()), closed, now)
        self._save(setup, now, closed, until)
        if out:
            yield pd.DataFrame(out, columns=["mailbox_id", "release_us", "send_now", "limit_newest", "newsletter_email",
                                             "n_messages", "message_ids"])

    def close(self) -> None:
        pass


def issue_events(routed: DataFrame) -> DataFrame:
    """Routed mail as events ``(mailbox_id, date, at, id, kind, key, value)``: mail that an issue may hold, config
    values, and send-now requests. Other mail and bad values give none."""
    base = routed.where(F.col("date").isNotNull()).withColumn("at", F.unix_micros(F.col("date").cast("timestamp")))
    conf = mb.mail_check_scope() & (F.col("route") == mb.ROUTE_CONFIG)
    mail = mb.archive_state(0) & mb.labels_none(["ANALYZED"]) & ~F.col("route").isin(mb.ROUTE_CONFIG, mb.ROUTE_REPOST)
    one = F.array(F.struct(F.lit("mail").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    values = F.transform(F.map_entries(F.from_json("text", "map<string,string>")), lambda e: F.struct(
        F.when((e["key"] == "send_now") & (F.lower(e["value"]) == "true"), F.lit("now"))
        .when(e["key"].isin(*SETUP_KEYS) & ~mb.bad_value(e["key"], e["value"]), F.lit("config")).alias("kind"), e["key"].alias("key"), e["value"].alias("value")))
    ev = F.when(conf, F.filter(values, lambda e: e["kind"].isNotNull() & e["value"].isNotNull())).when(mail, one)
    return (base.withColumn("_e", F.explode(ev))
            .select("mailbox_id", F.col("date").cast("timestamp").alias("date"), "at", F.col("message_id").alias("id"), "_e.*"))


def setup_entries(setup: DataFrame) -> DataFrame:
    """A setup table (S3) as ``(mailbox_id, key, value)``: the state that a stream starts with."""
    text = {"active": F.col("active").cast("string"), "days": F.to_json("days"), "limit_newest": F.col("limit_newest").cast("string")}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), text.get(k, F.col(k)).alias("value")) for k in SETUP_KEYS])
    return setup.select("mailbox_id", F.explode(pairs).alias("_p")).select("mailbox_id", "_p.*")


def issue_documents(stream: DataFrame, whitelist: DataFrame, *, delay: str, setup: DataFrame | None = None, max_results: int = 100,
                    lookback_days: int = iss.LOOKBACK_DAYS, carry_over: bool = True, config_mail: bool = True) -> DataFrame:
    """R4 + R5: ``(mailbox_id, release_ts, send_now, limit_newest, newsletter_email, n_messages, message_ids)`` per issue
    that the watermark (``delay`` behind the newest date) has passed.

    ``carry_over``: mail over an issue's limit waits for later issues inside the look-back (as ``issue_carry_over``);
    without it mail belongs to its first release alone (as ``issue_messages``). ``setup`` is the setup before the
    stream's first config mail; with ``config_mail=False`` it holds throughout and no mail closes an issue early. An issue without members gives no row; equal message ids of a mailbox count once."""
    events = issue_events(mb.route_messages(stream, whitelist))
    events = (events if config_mail else events.where("kind = 'mail'")).withWatermark("date", delay)
    key = events.schema["mailbox_id"].dataType.simpleString()
    start = setup_entries(setup).groupBy("mailbox_id") if setup is not None else None
    closed = events.groupBy("mailbox_id").transformWithStateInPandas(
        Issues(max_results, lookback_days, carry_over), outputStructType=OUT.format(key=key), outputMode="append",
        timeMode="eventTime", initialState=start)
    return closed.select("mailbox_id", F.timestamp_micros("release_us").alias("release_ts"), "send_now", "limit_newest",
                         "newsletter_email", "n_messages", "message_ids")


def run_issue_documents(stream: DataFrame, whitelist: DataFrame, out_path: str, *, checkpoint: str, delay: str,
                        every: str | None = None, **how) -> StreamingQuery:
    """Closed issues under ``out_path``, one partition per micro-batch (a replayed one rewrites its own).
    Timers and list states live in RocksDB, which is set for this query alone."""
    from quire.streaming.mail import _trigger, _write_batch
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        docs = issue_documents(stream, whitelist, delay=delay, **how)
        w = (docs.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
             .foreachBatch(lambda df, batch_id: _write_batch(df, out_path, batch_id)))
        return _trigger(w, every).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)

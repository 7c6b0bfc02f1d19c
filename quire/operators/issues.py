"""Issue timing and membership: T1-T4, J8, S3 (setup with defaults).

The release calendar is a closed form per row (no join): for a time ``t`` the next
release is today at the release time when today is listed and ``t`` is strictly
before it, else the first listed weekday among the next 1..7 days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import mailbox as mb
from quire.operators.ordering import running_count
from quire.session import ensure_checkpoint_dir

# ---- fixed values ---------------------------------------------------------------------
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
SETUP_DEFAULTS = {"active": True, "days": [], "release_time_str": "", "seconds_between_checks": 10,
                  "whitelisted_senders": [], "newsletter_email": "", "limit_newest": 10}
LOOKBACK_DAYS = 7
# ---------------------------------------------------------------------------------------


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def release_seconds(release_time: str | Column) -> Column:
    """'HH:MM:SS' -> seconds of the day; NULL when not such a time."""
    r = _c(release_time)
    ok = r.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$")
    secs = (F.substring(r, 1, 2).cast("int") * 3600 + F.substring(r, 4, 2).cast("int") * 60
            + F.substring(r, 7, 2).cast("int"))
    return F.when(ok, secs)


def weekday_mask(days: str | Column) -> Column:
    """Listed weekday names as a 7-bit mask (bit 0 = Monday); unknown names are ignored."""
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    return F.aggregate(_c(days), F.lit(0), lambda acc, x: acc.bitwiseOR(F.when(
        F.array_position(names, x) > 0, F.element_at(_bits(), F.array_position(names, x).cast("int")))
        .otherwise(F.lit(0))))


def _bits() -> Column:
    return F.array(*[F.lit(1 << i) for i in range(7)])


def next_release(ts: str | Column, days: str | Column, release_time: str | Column,
                 active: str | Column | bool = True) -> Column:
    """Next release TIMESTAMP_NTZ after ``ts``; NULL when inactive, incomplete or no day listed.

    Integer form: the listed days are a bit mask; today counts when its bit is set and the
    time is strictly before the release; else the first set bit among the next 7 days
    (offset 7 is the same weekday next week)."""
    t = _c(ts).cast("timestamp_ntz")
    d = F.to_date(t)
    secs = release_seconds(release_time)
    day_micros = F.unix_micros(t.cast("timestamp")) - F.unix_micros(d.cast("timestamp"))
    before = day_micros < secs.cast("bigint") * 1_000_000
    mask = weekday_mask(days)
    wd = F.weekday(d)

    def listed(offset: int) -> Column:
        bit = F.element_at(_bits(), (F.pmod(wd + offset, F.lit(7)) + 1).cast("int"))
        return mask.bitwiseAND(bit) != 0

    off = F.when(listed(0) & before, F.lit(0))
    for o in range(1, 8):
        off = off.when(listed(o), F.lit(o))
    act = F.lit(active) if isinstance(active, bool) else F.coalesce(_c(active), F.lit(True))
    rel = F.date_add(d, off).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)
    return F.when(act & secs.isNotNull() & off.isNotNull(), rel)


def release_delay(now: str | Column, release: str | Column) -> Column:
    """Seconds from now to the release."""
    return (F.unix_micros(_c(release).cast("timestamp")) - F.unix_micros(_c(now).cast("timestamp"))) / 1e6


def issue_window(release: str | Column, lookback_days: int = LOOKBACK_DAYS) -> tuple[Column, Column]:
    """First included day and the release day (both inclusive)."""
    day = F.to_date(_c(release))
    return F.date_sub(day, lookback_days), day


def setup_from_configs(folded: DataFrame, mailboxes: DataFrame, *, by: str = "mailbox_id") -> DataFrame:
    """S3: one setup row per mailbox: folded config values over the defaults."""
    def v(k):
        return F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
    wide = folded.groupBy(by).agg(*[v(k) for k in SETUP_DEFAULTS])
    arr = "array<string>"
    d = SETUP_DEFAULTS
    out = mailboxes.select(by).distinct().join(wide, by, "left")
    return out.select(
        by,
        F.coalesce(F.col("active").try_cast("boolean"), F.lit(d["active"])).alias("active"),
        F.coalesce(F.from_json("days", arr), F.array().cast(arr)).alias("days"),
        F.coalesce(F.col("release_time_str"), F.lit(d["release_time_str"])).alias("release_time_str"),
        F.coalesce(F.col("seconds_between_checks").try_cast("int"),
                   F.lit(d["seconds_between_checks"])).alias("seconds_between_checks"),
        F.coalesce(F.from_json("whitelisted_senders", arr), F.array().cast(arr)).alias("whitelisted_senders"),
        F.coalesce(F.col("newsletter_email"), F.lit(d["newsletter_email"])).alias("newsletter_email"),
        F.coalesce(F.col("limit_newest").try_cast("int"), F.lit(d["limit_newest"])).alias("limit_newest"))


def assign_issue(messages: DataFrame, setup: DataFrame, *, by: str = "mailbox_id", date: str = "date",
                 lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Each message goes to the first release after it, inside the look-back window.

    The setup has one row per mailbox; the join is on the mailbox key only."""
    s = setup.select(by, "active", "days", "release_time_str", "limit_newest")
    out = messages.join(s, by, "left")
    rel = next_release(F.col(date), F.col("days"), F.col("release_time_str"), F.col("active"))
    out = out.withColumn("release_ts", rel)
    first_day, last_day = issue_window(F.col("release_ts"), lookback_days)
    in_window = (F.to_date(F.col(date)) >= first_day) & (F.to_date(F.col(date)) <= last_day)
    return out.where(F.col("release_ts").isNotNull() & in_window) \
              .drop("active", "days", "release_time_str")


def newest_limit(max_results: int):
    """Messages an issue keeps. A negative ``limit_newest`` is bad data of one mailbox: a config that gives one
    goes to the dead letter (``mailbox.config_entries``), and a setup row that holds one counts as the default."""
    n = F.col("limit_newest")
    return F.when(n < 0, F.lit(SETUP_DEFAULTS["limit_newest"])).when(n >= 0, F.least(n, F.lit(max_results))).otherwise(F.lit(max_results))


def in_scope(messages: DataFrame) -> DataFrame:
    """Mail an issue may hold: in the inbox, not ANALYZED, not taken as config or repost."""
    m = messages.where(mb.archive_state(0) & mb.labels_none(["ANALYZED"]))
    return m.where(~F.col("route").isin(mb.ROUTE_CONFIG, mb.ROUTE_REPOST)) if "route" in messages.columns else m


def issue_carry_over(messages: DataFrame, setup: DataFrame, *, by: str = "mailbox_id", date: str = "date", key: str = "message_id",
                     max_results: int = 100, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """J8 + T4 with carry-over: every release takes the newest ``limit_newest`` of the mail that arrived before it,
    lies inside its look-back days and was taken by no earlier release; the rest may enter a later one.

    Mail waits in a last-in, first-out line, so a release takes whole runs of it. Mail is counted per (mailbox, first
    release, day); the releases of a mailbox are its calendar up to ``lookback_days`` after its last mail. One fold per
    mailbox runs over these counts (native ``aggregate``): its state are the runs still waiting, at most two a look-back
    day. A run's taken ranks, newest first, are then joined with the ranked mail. Ranks beyond what the releases of one
    look-back can take are cut before the shuffle, so no mailbox or day is held in one task.

    Result: the message columns, ``release_ts``, ``msg_rank`` (0: the newest) and ``carried`` (taken after its first
    release). A message is in at most one issue. Mailboxes that are inactive or have no release day take none.
    """
    ensure_checkpoint_dir(messages.sparkSession)
    # the setup (one row a mailbox) and the counts are read several times: written once
    s = setup.select(by, "active", "days", "release_time_str", "limit_newest").checkpoint()
    m = in_scope(messages).join(s, by)
    m = m.withColumn("_seg", next_release(F.col(date), F.col("days"), F.col("release_time_str"), F.col("active"))) \
         .where(F.col("_seg").isNotNull()).withColumn("_day", F.to_date(F.col(date))) \
         .drop("active", "days", "release_time_str", "limit_newest")
    counts = m.groupBy(by, "_seg", "_day").agg(F.count(F.lit(1)).alias("n")).checkpoint()

    span = counts.groupBy(by).agg(F.min("_day").alias("_from"), F.date_add(F.max(F.to_date("_seg")), lookback_days).alias("_to"))
    bit = F.element_at(_bits(), (F.weekday("_d") + 1).cast("int"))
    calendar = (span.join(s, by).withColumn("_d", F.explode(F.sequence("_from", "_to")))
                .where(weekday_mask("days").bitwiseAND(bit) != 0)
                .select(by, (F.col("_d").cast("timestamp_ntz") + F.make_dt_interval(
                    F.lit(0), F.lit(0), F.lit(0), release_seconds("release_time_str"))).alias("_seg"),
                        newest_limit(max_results).cast("bigint").alias("_limit")))
    fresh = counts.groupBy(by, "_seg").agg(F.array_sort(F.collect_list(F.struct(
        F.col("_day").alias("day"), F.col("_seg").alias("seg"), "n", F.lit(0).cast("bigint").alias("gone")))).alias("runs"))
    none = F.array().cast("array<struct<day:date,seg:timestamp_ntz,n:bigint,gone:bigint>>")
    line = (calendar.join(fresh, [by, "_seg"], "left")
            .groupBy(by).agg(F.array_sort(F.collect_list(F.struct(
                F.col("_seg").alias("release"), F.col("_limit").alias("limit"), F.coalesce("runs", none).alias("runs")))).alias("_line")))

    def bound(value: Column, use) -> Column:
        """``use`` of a value that is worked out once (a lambda variable), however often it is read."""
        return F.transform(F.array(value), use)[0]

    def dealt(waiting, r):
        """Waiting runs, oldest first, each with what the release takes of it: the newest go first."""
        newer = F.transform(waiting, lambda x, i: F.aggregate(
            F.slice(waiting, i + 2, F.size(waiting)), F.lit(0).cast("bigint"), lambda n, y: n + y["n"]))
        return F.zip_with(waiting, newer, lambda x, after: F.struct(
            x["day"].alias("day"), x["seg"].alias("seg"), x["n"].alias("n"), x["gone"].alias("gone"),
            F.greatest(F.lit(0), F.least(x["n"], r["limit"] - after)).cast("bigint").alias("take")))

    def after(acc, d, r):
        left = F.transform(F.filter(d, lambda x: x["take"] < x["n"]), lambda x: F.struct(
            x["day"].alias("day"), x["seg"].alias("seg"), (x["n"] - x["take"]).alias("n"), (x["gone"] + x["take"]).alias("gone")))
        took = F.transform(F.filter(d, lambda x: x["take"] > 0), lambda x: F.struct(
            r["release"].alias("release_ts"), x["seg"].alias("seg"), x["day"].alias("day"), x["gone"].alias("a"), (x["gone"] + x["take"]).alias("z")))
        return F.struct(left.alias("waiting"), F.concat(acc["taken"], took).alias("taken"))

    def step(acc, r):
        waiting = F.concat(F.filter(acc["waiting"], lambda x: x["day"] >= F.date_sub(F.to_date(r["release"]), lookback_days)), r["runs"])
        return bound(waiting, lambda w: bound(dealt(w, r), lambda d: after(acc, d, r)))

    start = F.struct(none.alias("waiting"), F.array().cast(
        "array<struct<release_ts:timestamp_ntz,seg:timestamp_ntz,day:date,a:bigint,z:bigint>>").alias("taken"))
    takes = (line.select(by, F.explode(F.aggregate("_line", start, step, lambda acc: acc["taken"])).alias("t"))
             .select(by, F.col("t.seg").alias("_seg"), F.col("t.day").alias("_day"), F.col("t.release_ts").alias("release_ts"), "t.a", "t.z"))
    # at most one release a day can take from a run
    ranked = mb.newest_n(m, max_results * (lookback_days + 2), by=[by, "_seg", "_day"], date=date, rank="_newest")
    out = (ranked.join(takes, [by, "_seg", "_day"]).where((F.col("_newest") >= F.col("a")) & (F.col("_newest") < F.col("z")))
           .withColumn("carried", F.col("release_ts") > F.col("_seg")).drop("_seg", "_day", "_newest", "a", "z"))
    return mb.newest_n(out, max_results, by=[by, "release_ts"], date=date, rank="msg_rank")


def setup_as_of(messages: DataFrame, entries: DataFrame, *, by: str = "mailbox_id", date: str = "date", key: str = "message_id") -> DataFrame:
    """A5 + S3 in time: every message with the setup that was valid when it arrived. ``entries`` are config values
    (``by``, ``date``, ``message_id``, ``key``, ``value``); one acts from its own time on (at the same time: before the
    message), a later one of the same key replaces it (same time: the greater message_id), and before the first one the default holds.

    An as-of join in buckets: values and messages meet per (mailbox, day), each day also gets the last value of every
    key from the days before it, so a mailbox with most of the mail is split by day and no validity interval is expanded.
    """
    keys = tuple(k for k in SETUP_DEFAULTS if k != "seconds_between_checks")
    order = F.struct(F.col(date).alias("d"), F.col(key).alias("k"))
    daily = (entries.where(F.col("key").isin(*keys)).groupBy(by, F.to_date(date).alias("_day"))
             .agg(*[F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, order)).alias(k) for k in keys]))
    days = messages.select(by, F.to_date(date).alias("_day")).distinct()
    before = Window.partitionBy(by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = (days.join(daily, [by, "_day"], "full")
               .select(by, "_day", *[F.last(k, ignorenulls=True).over(before).alias(f"_{k}") for k in keys]))
    changes = (entries.where(F.col("key").isin(*keys)).groupBy(by, date, key)
               .agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
               .select(by, F.col(date).alias("_at"), F.col(key).alias("_key"), *keys, F.lit(None).cast("string").alias("_row")))
    row = F.struct(*[F.col(c) for c in messages.columns])
    mail = messages.select(by, F.col(date).alias("_at"), F.lit(None).cast("string").alias("_key"),
                           *[F.lit(None).cast("string").alias(k) for k in keys], row.alias("_row"))
    both = mail.unionByName(changes.withColumn("_row", F.lit(None).cast(mail.schema["_row"].dataType))) \
               .withColumn("_day", F.to_date("_at"))
    upto = Window.partitionBy(by, "_day").orderBy("_at", F.col("_row").isNotNull(), "_key").rowsBetween(Window.unboundedPreceding, 0)
    now = both.select(by, "_day", "_row", *[F.last(k, ignorenulls=True).over(upto).alias(k) for k in keys]).where(F.col("_row").isNotNull())
    met = now.join(carried, [by, "_day"]).select("_row.*", *[F.coalesce(k, f"_{k}").alias(f"_{k}") for k in keys])
    arr, d = "array<string>", SETUP_DEFAULTS
    value = {
        "active": F.coalesce(F.col("_active").try_cast("boolean"), F.lit(d["active"])),
        "days": F.coalesce(F.from_json("_days", arr), F.array().cast(arr)),
        "release_time_str": F.coalesce("_release_time_str", F.lit(d["release_time_str"])),
        "whitelisted_senders": F.coalesce(F.from_json("_whitelisted_senders", arr), F.array().cast(arr)),
        "newsletter_email": F.coalesce("_newsletter_email", F.lit(d["newsletter_email"])),
        "limit_newest": F.coalesce(F.col("_limit_newest").try_cast("int"), F.lit(d["limit_newest"])),
    }
    return met.select(*messages.columns, *[value[k].alias(k) for k in keys])


def assign_issue_as_of(messages: DataFrame, entries: DataFrame, *, by: str = "mailbox_id", date: str = "date", key: str = "message_id",
                       lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """J8 under the setup valid at the message's arrival: a later config moves no earlier mail."""
    m = setup_as_of(messages, entries, by=by, date=date, key=key)
    out = m.withColumn("release_ts", next_release(F.col(date), F.col("days"), F.col("release_time_str"), F.col("active")))
    first_day, last_day = issue_window(F.col("release_ts"), lookback_days)
    day = F.to_date(F.col(date))
    return out.where(F.col("release_ts").isNotNull() & (day >= first_day) & (day <= last_day))


def issue_messages(messages: DataFrame, setup: DataFrame, *, routes: DataFrame | None = None,
                   by: str = "mailbox_id", date: str = "date", max_results: int = 100,
                   lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """T4: per (mailbox, issue): in the inbox, not ANALYZED, not taken as config or repost,
    newest ``min(max_results, limit_newest)``. NOT_WHITELISTED mail is included."""
    m = messages.where(mb.archive_state(0) & mb.labels_none(["ANALYZED"]))
    if routes is not None:
        m = m.where(~F.col("route").isin(mb.ROUTE_CONFIG, mb.ROUTE_REPOST))
    a = assign_issue(m, setup, by=by, date=date, lookback_days=lookback_days)
    # the literal bound lets every map task keep at most max_results rows per issue
    ranked = mb.newest_n(a, max_results, by=[by, "release_ts"], date=date, rank="msg_rank")
    return ranked.where(F.col("msg_rank") < newest_limit(max_results)).drop("limit_newest")


def send_now_issues(messages: DataFrame, requests: DataFrame, setup: DataFrame, *, by: str = "mailbox_id", date: str = "date",
                    as_of: str = "as_of", key: str = "message_id", max_results: int = 100, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """A send-now request closes an issue at its own time: the mailbox's messages from
    ``lookback_days`` before the request day up to the request, in the inbox, not analysed,
    not taken as config or repost, newest ``limit_newest``.

    As-of positions: mail and requests stand in one line per mailbox, each mail has its number and each request the
    number of mail up to its time (``running_count``, so a hot mailbox is many chunks). A request then meets the numbers
    ``n, n-1, ...`` only, at most its limit, by an equi-join; no request meets the mail of its days.

    Result: ``by, release_ts, msg_rank, key, date``; ``key`` is unique in a mailbox. A null date is in no issue."""
    mail = in_scope(messages).where(F.col(date).isNotNull()).select(
        by, F.col(date).alias("_at"), F.lit(0).alias("_kind"), F.col(key).alias("_key"))
    asked = requests.where(F.col(as_of).isNotNull()).select(
        by, F.col(as_of).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(messages.schema[key].dataType).alias("_key")).distinct()
    line = running_count(mail.unionByName(asked), by=[by], order=["_at", "_kind", "_key"], of=F.when(F.col("_kind") == 0, 1).otherwise(0), name="_n")
    limit = F.coalesce(newest_limit(max_results), F.lit(max_results))
    wanted = (line.where(F.col("_kind") == 1).join(setup.select(by, "limit_newest"), by, "left").withColumn("_limit", limit)
              .where(F.col("_limit") > 0)
              .select(by, F.col("_at").alias("release_ts"), F.col("_n").alias("_upto"),
                      F.explode(F.sequence(F.lit(0), F.col("_limit") - 1)).alias("msg_rank"))
              .select(by, "release_ts", F.col("msg_rank").cast("bigint").alias("msg_rank"), (F.col("_upto") - F.col("msg_rank")).alias("_n"))
              .where(F.col("_n") > 0))
    met = line.where(F.col("_kind") == 0).join(wanted, [by, "_n"])
    return (met.where(F.to_date("_at") >= F.date_sub(F.to_date("release_ts"), lookback_days))
            .select(by, "release_ts", "msg_rank", F.col("_key").alias(key), F.col("_at").alias(date)))

"""Mailbox side: filters F1-F9, newest-N (O1), whitelist and routing (J1, R2), config
fold (A5), counts (A6), label changes and registry (U1-U4, J6, J7), message rank (W2).

Every predicate is a plain column expression so Catalyst pushes the date range and
the label tests into the scan; only the newest-N step and the joins shuffle.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import sender_address

# ---- fixed values ---------------------------------------------------------------------
SYSTEM_LABELS = ("INBOX", "UNREAD", "STARRED", "SENT", "IMPORTANT", "TRASH", "SPAM", "DRAFT")
CONFIG_KEYS = ("active", "days", "release_time_str", "seconds_between_checks",
               "whitelisted_senders", "newsletter_email", "limit_newest")
ROUTE_CONFIG, ROUTE_REPOST, ROUTE_OTHER = "config", "repost", "not_whitelisted"
# ---------------------------------------------------------------------------------------


def _ts_lit(df: DataFrame, col: str, day: str | dt.date) -> Column:
    """A literal of the column's own timestamp type, so the comparison is pushed down."""
    dtype = df.schema[col].dataType.simpleString()
    return F.lit(str(day)).cast("date").cast(dtype)


def date_range(df: DataFrame, start=None, end=None, *, date: str = "date") -> Column:
    """both ends inclusive days: ``date >= start`` and ``date < end + 1 day``."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(date) >= _ts_lit(df, date, start))
    if end is not None:
        nxt = dt.date.fromisoformat(str(end)) + dt.timedelta(days=1)
        cond = cond & (F.col(date) < _ts_lit(df, date, nxt))
    return cond


def read_state(read: int, *, labels: str = "labels") -> Column:
    """0 unread, 1 read, anything else no filter."""
    if read == 0:
        return F.array_contains(labels, "UNREAD")
    if read == 1:
        return ~F.array_contains(labels, "UNREAD")
    return F.lit(True)


def archive_state(archived: int, *, labels: str = "labels") -> Column:
    """0 in the inbox; 1 not in inbox, trash or spam; anything else no filter."""
    if archived == 0:
        return F.array_contains(labels, "INBOX")
    if archived == 1:
        return ~F.arrays_overlap(F.col(labels), F.array(*[F.lit(x) for x in ("INBOX", "TRASH", "SPAM")]))
    return F.lit(True)


def label_id(name: str) -> str:
    """System labels resolve to their upper-case id; other names are looked up."""
    return name.upper() if name.upper() in SYSTEM_LABELS else name


def _resolve(names: Sequence[str], registry: DataFrame | None, by: str) -> tuple[list[str], DataFrame | None]:
    """Split wanted label names into system ids and a per-mailbox table of custom ids."""
    system = [n.upper() for n in names if n.upper() in SYSTEM_LABELS]
    custom = [n.lower() for n in names if n.upper() not in SYSTEM_LABELS]
    if not custom:
        return system, None
    if registry is None:  # label names are their own ids
        return system + [n for n in names if n.upper() not in SYSTEM_LABELS], None
    hits = (registry.where(F.lower("name").isin(custom))
            .groupBy(by).agg(F.collect_set("label_id").alias("_ids"),
                             F.countDistinct(F.lower("name")).alias("_n")))
    return system, hits.withColumn("_want", F.lit(len(set(custom))))


def sender_is(sender: str, *, col: str = "sender") -> Column:
    """the sender's address equals the wanted one."""
    return sender_address(col) == F.lit(sender)


def labels_all(ids: Sequence[str], *, labels: str = "labels") -> Column:
    """F5 on resolved ids."""
    return F.size(F.array_except(F.array(*[F.lit(i) for i in ids]), F.col(labels))) == 0


def labels_none(ids: Sequence[str], *, labels: str = "labels") -> Column:
    """F6 on resolved ids."""
    if not ids:
        return F.lit(True)
    return ~F.arrays_overlap(F.col(labels), F.array(*[F.lit(i) for i in ids]))


def effective_limit(max_results: int | None = 100, newest: int | None = None) -> int | None:
    """O1: the number of newest messages kept; None keeps all (no list-size cap)."""
    if newest is None:
        return max_results
    if newest < 0:
        raise ValueError("negative newest-N is not supported")
    return newest if max_results is None else min(max_results, newest)


def newest_n(df: DataFrame, n: int, *, by: str | Sequence[str] = "mailbox_id", date: str = "date",
             key: str = "message_id", rank: str | None = None) -> DataFrame:
    """O1: newest ``n`` per group, ties broken by id. Plans a WindowGroupLimit, so every
    map task keeps at most ``n`` rows per group before the shuffle."""
    by = [by] if isinstance(by, str) else list(by)
    if n <= 0:
        return df.limit(0)
    w = Window.partitionBy(*by).orderBy(F.col(date).desc(), F.col(key).desc())
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    if rank:
        return out.withColumn(rank, (F.col("_rn") - 1).cast("bigint")).drop("_rn")
    return out.drop("_rn")


def mailbox_query(messages: DataFrame, *, start=None, end=None, archived: int = 0, read: int = 2,
                  include: Sequence[str] = (), exclude: Sequence[str] = (), sender: str | None = None,
                  max_results: int | None = 100, newest: int | None = None, by: str = "mailbox_id",
                  registry: DataFrame | None = None, date: str = "date", labels: str = "labels") -> DataFrame:
    """F1..F6 ANDed, then the newest N per mailbox (O1)."""
    cond = date_range(messages, start, end, date=date) & read_state(read, labels=labels) \
        & archive_state(archived, labels=labels)
    if sender:
        cond = cond & sender_is(sender)
    inc_sys, inc_custom = _resolve(include, registry, by)
    exc_sys, exc_custom = _resolve(exclude, registry, by)
    cond = cond & labels_all(inc_sys, labels=labels) & labels_none(exc_sys, labels=labels)
    out = messages.where(cond)
    if inc_custom is not None:  # unknown required label -> nothing for that mailbox
        ok = inc_custom.where(F.col("_n") == F.col("_want")).select(by, "_ids")
        out = out.join(ok, by, "inner").where(F.size(F.array_except("_ids", labels)) == 0).drop("_ids")
    if exc_custom is not None:  # unknown banned label -> ignored
        out = (out.join(exc_custom.select(by, "_ids"), by, "left")
                  .where(F.col("_ids").isNull() | ~F.arrays_overlap("_ids", labels)).drop("_ids"))
    n = effective_limit(max_results, newest)
    return out if n is None else newest_n(out, n, by=by, date=date)


def message_rank(df: DataFrame, *, by: str = "mailbox_id", date: str = "date", key: str = "message_id",
                 name: str = "msg_rank") -> DataFrame:
    """0-based index in newest-first order, exact and skew-safe. Ranks are computed on
    the narrow (mailbox, date, id) table and joined back on (mailbox, id)."""
    from quire.operators.ordering import positions
    narrow = positions(df.select(by, date, key), by=[by], order=[F.col(date).desc(), F.col(key).desc()], name=name)
    return df.join(narrow.drop(date), [by, key])


# ---- whitelist and routing -------------------------------------------------------------
def mail_check_scope(*, labels: str = "labels", date: str | None = None, since: Column | None = None) -> Column:
    """What a mail check looks at: mail of the inbox that is neither marked as not
    whitelisted nor analysed yet, and with ``since`` only mail from that time on."""
    cond = labels_all(["INBOX"], labels=labels) & labels_none(["NOT_WHITELISTED", "ANALYZED"], labels=labels)
    return cond if since is None else cond & (F.col(date or "date") >= since)


def setup_whitelist(setup: DataFrame, *, by: str = "mailbox_id", senders: str = "whitelisted_senders") -> DataFrame:
    """The senders each mailbox trusts, ``(by, addr)``, from its folded setup."""
    return setup.select(by, F.explode(senders).alias("addr")).where(F.col("addr").isNotNull()).distinct()


def _whitelist_flag(messages: DataFrame, whitelist: DataFrame, sender: str, addr: str, by: str = "mailbox_id") -> DataFrame:
    """A whitelist with a mailbox column holds for its mailboxes only, one without for all."""
    own = [by] if by in whitelist.columns and by in messages.columns else []
    wl = whitelist.select(*own, F.col(addr).alias("_addr")).distinct().withColumn("_wl", F.lit(True))
    m = messages.withColumn("_addr", sender_address(sender))
    return m.join(wl, [*own, "_addr"], "left").withColumn("is_whitelisted", F.coalesce("_wl", F.lit(False))) \
            .drop("_wl")


def whitelist_split(messages: DataFrame, whitelist: DataFrame, *, sender: str = "sender",
                    addr: str = "addr") -> DataFrame:
    """Adds ``address`` and ``is_whitelisted`` (exact, case-sensitive)."""
    return _whitelist_flag(messages, whitelist, sender, addr).withColumnRenamed("_addr", "address")


def whitelist_semi(messages: DataFrame, whitelist: DataFrame, *, sender: str = "sender",
                   addr: str = "addr", anti: bool = False) -> DataFrame:
    """J1 as a semi or anti join; per mailbox where the whitelist names the mailbox."""
    own = [c for c in ("mailbox_id",) if c in whitelist.columns and c in messages.columns]
    wl = whitelist.select(*own, F.col(addr).alias("_addr"))
    m = messages.withColumn("_addr", sender_address(sender))
    return m.join(wl, [*own, "_addr"], "left_anti" if anti else "left_semi").drop("_addr")


def route_messages(messages: DataFrame, whitelist: DataFrame, *, sender: str = "sender",
                   title: str = "title", addr: str = "addr") -> DataFrame:
    """R2 + F9: every message gets one route. A NULL title is not a config mail."""
    flagged = whitelist_split(messages, whitelist, sender=sender, addr=addr)
    is_config = F.coalesce(F.lower(F.col(title)) == "config", F.lit(False))
    return flagged.withColumn("route", F.when(~F.col("is_whitelisted"), F.lit(ROUTE_OTHER))
                                        .when(is_config, F.lit(ROUTE_CONFIG))
                                        .otherwise(F.lit(ROUTE_REPOST)))


def config_entries(configs: DataFrame, *, text: str = "text") -> DataFrame:
    """Config mails with their values (``_m``) and ``error``: a text that is not a JSON object, or a bad value
    (a negative ``limit_newest``). A bad value is no value; the others of its mail hold."""
    parsed = configs.withColumn("_m", F.from_json(F.col(text), "map<string,string>"))
    return parsed.withColumn("error", F.when(F.col("_m").isNull(), F.lit("config text is not a JSON object"))
                             .when(bad_value(F.lit("limit_newest"), F.try_element_at("_m", F.lit("limit_newest"))),
                                   F.lit("limit_newest is negative")))


def bad_value(key: Column, value: Column) -> Column:
    """A config value that cannot hold."""
    return (key == "limit_newest") & (F.coalesce(value.try_cast("int"), F.lit(0)) < 0)


def config_values(configs: DataFrame, *, by: str = "mailbox_id", date: str = "date", key: str = "message_id", text: str = "text") -> DataFrame:
    """``(by, date, message_id, key, value)`` of every known key of every config mail; bad values are left out."""
    return (config_entries(configs, text=text).select(by, date, key, F.explode_outer("_m").alias("key", "value"))
            .where(F.col("key").isin(*CONFIG_KEYS) & ~bad_value(F.col("key"), F.col("value"))))


def config_fold(configs: DataFrame, *, by: str = "mailbox_id", poll: str | Column = "poll",
                date: str = "date", key: str = "message_id", text: str = "text") -> DataFrame:
    """A5: per mailbox and known key, the last applied value: the newest poll, and in a
    poll the oldest message (mails are walked newest first). Unknown keys are ignored."""
    p = F.col(poll) if isinstance(poll, str) else poll
    # No separate "parsed" filter and explode_outer, not explode: either would give Catalyst
    # a predicate on from_json(text) to push below the routing join, parsing every message
    # instead of the config mails only. A text that is not a JSON object yields a NULL key,
    # which the known-key filter drops.
    kv = config_entries(configs, text=text) \
        .select(by, p.alias("_poll"), date, key, F.explode_outer("_m").alias("key", "value")) \
        .where(F.col("key").isin(*CONFIG_KEYS) & ~bad_value(F.col("key"), F.col("value")))
    order = F.struct(F.col("_poll"), (-F.unix_micros(F.col(date).cast("timestamp"))).alias("_d"), F.col(key))
    return kv.groupBy(by, "key").agg(F.max_by("value", order).alias("value"))


def mailbox_counts(messages: DataFrame, *, by: str = "mailbox_id", labels: str = "labels",
                   text: str = "text") -> DataFrame:
    """Found messages and label counts per mailbox (one partial + final aggregate)."""
    return messages.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.array_contains(labels, "UNREAD").cast("int")).cast("bigint").alias("n_unread"),
        F.sum(F.array_contains(labels, "INBOX").cast("int")).cast("bigint").alias("n_inbox"),
        F.sum(F.length(text)).cast("bigint").alias("n_chars"))


# ---- label state (U1-U4, J6, J7) -------------------------------------------------------
def update_labels(messages: DataFrame, changes: DataFrame, *, key: Sequence[str] = ("mailbox_id", "message_id"),
                  labels: str = "labels", order: str = "seq") -> DataFrame:
    """``changes(key, add, remove, read)``; the read flag removes / adds ``UNREAD``; system names upper-cased; a
    label in both lists of a change ends up present (add wins). Several changes of a message act in the order of
    ``order`` (a column of ``changes``; without it they count as one): the last mention of a label decides.

    Changes are folded per (message, label) first, so a message meets one row and stays one row."""
    def norm(c):
        return F.transform(F.coalesce(c, F.array().cast("array<string>")),
                           lambda x: F.when(F.upper(x).isin(*SYSTEM_LABELS), F.upper(x)).otherwise(x))
    unread = F.array(F.lit("UNREAD"))
    add = F.when(F.col("read") == F.lit(False), F.array_union(norm(F.col("add")), unread)).otherwise(norm(F.col("add")))
    rm = F.when(F.col("read") == F.lit(True), F.array_union(norm(F.col("remove")), unread)).otherwise(norm(F.col("remove")))
    said = F.concat(F.transform(add, lambda x: F.struct(x.alias("l"), F.lit(True).alias("present"))),
                    F.transform(rm, lambda x: F.struct(x.alias("l"), F.lit(False).alias("present"))))
    seq = F.col(order) if order in changes.columns else F.lit(0)
    last = (changes.select(*key, seq.alias("_seq"), F.explode(said).alias("_s"))
            .groupBy(*key, F.col("_s.l").alias("_l")).agg(F.max_by("_s.present", F.struct("_seq", "_s.present")).alias("_p")))
    ch = last.groupBy(*key).agg(F.collect_list(F.when(F.col("_p"), F.col("_l"))).alias("_add"),
                                F.collect_list(F.when(~F.col("_p"), F.col("_l"))).alias("_rm"))
    out = messages.join(ch, list(key), "left")
    new = F.array_union(F.array_except(F.col(labels), F.col("_rm")), F.col("_add"))
    return out.withColumn(labels, F.when(F.col("_add").isNull(), F.col(labels)).otherwise(new)) \
              .drop("_add", "_rm")


def archive(messages: DataFrame, *, labels: str = "labels") -> DataFrame:
    """Remove ``INBOX``."""
    return messages.withColumn(labels, F.array_remove(labels, "INBOX"))


def delete_messages(messages: DataFrame, ids: DataFrame, *,
                    key: Sequence[str] = ("mailbox_id", "message_id")) -> DataFrame:
    """Left anti join with the delete list."""
    return messages.join(ids.select(*key), list(key), "left_anti")


def unprocessed(messages: DataFrame, ledger: DataFrame, *,
                key: Sequence[str] = ("mailbox_id", "message_id")) -> DataFrame:
    """Messages not yet in the processed ledger."""
    return messages.join(ledger.select(*key), list(key), "left_anti")


def label_registry_id(mailbox: Column, name: Column) -> Column:
    """Id of a created custom label: a hash of (mailbox, lower(name)) [our choice]."""
    return F.concat(F.lit("Label_"), F.substring(F.sha2(F.concat_ws("|", mailbox.cast("string"),
                                                                     F.lower(name)), 256), 1, 16))


def ensure_labels(registry: DataFrame, wanted: DataFrame, *, by: str = "mailbox_id") -> DataFrame:
    """U4: create missing labels (case-insensitive); existing ones keep their id."""
    w = (wanted.select(by, "name").where(~F.upper("name").isin(*SYSTEM_LABELS))
               .withColumn("_lname", F.lower("name")))
    w = w.groupBy(by, "_lname").agg(F.min("name").alias("name"))
    existing = registry.select(by, F.lower("name").alias("_lname"))
    new = (w.join(existing, [by, "_lname"], "left_anti")
            .select(by, "name", label_registry_id(F.col(by), F.col("name")).alias("label_id")))
    return registry.select(by, "name", "label_id").unionByName(new)


def label_resolve(names: DataFrame, registry: DataFrame, *, by: str = "mailbox_id") -> DataFrame:
    """Name -> id, case-insensitive; system labels map to themselves; unknown -> NULL."""
    reg = registry.select(by, F.lower("name").alias("_lname"), "label_id")
    n = names.withColumn("_lname", F.lower("name"))
    out = n.join(reg, [by, "_lname"], "left")
    return out.withColumn("label_id", F.when(F.upper("name").isin(*SYSTEM_LABELS), F.upper("name"))
                                       .otherwise(F.col("label_id"))).drop("_lname")

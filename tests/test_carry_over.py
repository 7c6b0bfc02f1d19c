"""Carry-over between issues and setups in time, against plain walks over the mail."""

import datetime as dt
import random

from quire.operators.issues import WEEKDAYS, issue_carry_over, setup_as_of
from quire.operators.mailbox import update_labels

MAIL = "mailbox_id int, message_id string, date timestamp_ntz, labels array<string>"
SETUP = "mailbox_id int, active boolean, days array<string>, release_time_str string, limit_newest int"


def walk(mail, setup):
    """Release by release: the newest of what waits inside the look-back days."""
    out = set()
    for box, active, days, at, limit in setup:
        mine = [(d, i) for b, i, d, labels in mail if b == box and "INBOX" in labels and "ANALYZED" not in labels]
        if not active or not mine:
            continue
        h, m, s = map(int, at.split(":"))
        day, last = min(mine)[0].date(), max(mine)[0].date() + dt.timedelta(days=15)
        taken = set()
        while day <= last:
            release = dt.datetime(day.year, day.month, day.day, h, m, s)
            if WEEKDAYS[day.weekday()] in days:
                waits = sorted(((d, i) for d, i in mine if d < release and d.date() >= day - dt.timedelta(days=7) and i not in taken), reverse=True)
                for rank, (d, i) in enumerate(waits[:min(limit, 100)]):
                    taken.add(i)
                    out.add((box, release, rank, i))
            day += dt.timedelta(days=1)
    return out


def test_issues_match_a_walk_over_releases(spark):
    r = random.Random(4)
    start = dt.datetime(2024, 2, 26)
    mail = [(b, f"m{k:04d}", start + dt.timedelta(minutes=r.randrange(40 * 1440)), ["INBOX"] + (["ANALYZED"] if k % 19 == 0 else []))
            for k, b in enumerate(r.choices([1, 2, 3, 4, 5], [8, 2, 2, 1, 1], k=700))]
    mail += [(1, "exact", dt.datetime(2024, 3, 4, 8), ["INBOX"]), (1, "exact2", dt.datetime(2024, 3, 4, 8), ["INBOX"])]
    setup = [(1, True, ["Monday", "Friday"], "08:00:00", 4), (2, True, list(WEEKDAYS), "00:00:00", 1), (3, True, ["Sunday"], "23:59:59", 100),
             (4, False, ["Monday"], "08:00:00", 5), (5, True, ["Tuesday"], "12:00:00", 0)]
    got = issue_carry_over(spark.createDataFrame(mail, MAIL), spark.createDataFrame(setup, SETUP)).collect()
    assert {(x.mailbox_id, x.release_ts, x.msg_rank, x.message_id) for x in got} == walk(mail, setup)
    assert len({(x.mailbox_id, x.message_id) for x in got}) == len(got)
    assert any(x.carried for x in got) and not all(x.carried for x in got)


def test_no_mail_no_issue(spark):
    setup = spark.createDataFrame([(1, True, ["Monday"], "08:00:00", 4)], SETUP)
    assert issue_carry_over(spark.createDataFrame([], MAIL), setup).count() == 0


def test_setup_acts_from_its_arrival(spark):
    day = lambda d, h=0: dt.datetime(2024, 3, d, h)
    mail = [(1, "a", day(1)), (1, "b", day(3, 9)), (1, "c", day(3, 10)), (1, "d", day(20)), (2, "e", day(9)), (1, "f", day(3, 12))]
    entries = [(1, day(3, 10), "k1", "limit_newest", "3"), (1, day(3, 11), "k2", "limit_newest", "4"), (1, day(3, 11), "k3", "limit_newest", "5"),
               (1, day(5), "k4", "active", "false"), (3, day(1), "k5", "limit_newest", "9")]
    got = setup_as_of(spark.createDataFrame(mail, "mailbox_id int, message_id string, date timestamp_ntz"),
                      spark.createDataFrame(entries, "mailbox_id int, date timestamp_ntz, message_id string, key string, value string"))
    assert {(r.message_id, r.limit_newest, r.active) for r in got.collect()} == {
        ("a", 10, True), ("b", 10, True), ("c", 3, True), ("f", 5, True), ("d", 5, False), ("e", 10, True)}


def test_changes_of_a_message_fold_in_order(spark):
    messages = spark.createDataFrame([(1, "a", ["INBOX"]), (1, "b", ["INBOX"])], "mailbox_id int, message_id string, labels array<string>")
    changes = spark.createDataFrame([(1, "a", ["x"], ["INBOX"], None, 1), (1, "a", ["inbox"], ["x"], False, 2), (1, "a", ["y"], ["y"], None, 3)],
                                    "mailbox_id int, message_id string, add array<string>, remove array<string>, read boolean, seq int")
    got = {r.message_id: sorted(r.labels) for r in update_labels(messages, changes).collect()}
    assert got == {"a": ["INBOX", "UNREAD", "y"], "b": ["INBOX"]}
    assert update_labels(messages, changes).count() == 2

"""limit_newest of an issue: zero, null, large and negative values."""

import datetime as dt
from collections import Counter

from quire.operators.issues import issue_messages, newest_limit, send_now_issues
from quire.operators.mailbox import config_entries, config_fold


def test_values(spark):
    df = spark.createDataFrame([(0,), (3,), (500,), (None,), (-1,)], "limit_newest int")
    assert [r[0] for r in df.select(newest_limit(100)).collect()] == [0, 3, 100, 100, 10]


def test_a_negative_value_stops_no_mailbox(spark):
    """A setup row with a negative limit counts as the default; other mailboxes keep theirs."""
    at = dt.datetime(2024, 1, 1, 9)
    messages = spark.createDataFrame([(b, f"m{i}", at, ["INBOX"]) for b in (1, 2) for i in range(12)],
                                     "mailbox_id int, message_id string, date timestamp_ntz, labels array<string>")
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    setup = spark.createDataFrame([(1, True, days, "12:00:00", -2), (2, True, days, "12:00:00", 3)],
                                  "mailbox_id int, active boolean, days array<string>, release_time_str string, limit_newest int")
    requests = spark.createDataFrame([(b, at + dt.timedelta(hours=1)) for b in (1, 2)], "mailbox_id int, as_of timestamp_ntz")
    for made in (issue_messages(messages, setup), send_now_issues(messages, requests, setup)):
        assert Counter(r.mailbox_id for r in made.collect()) == {1: 10, 2: 3}


def test_a_negative_config_value_goes_to_the_dead_letter(spark):
    at = dt.datetime(2024, 1, 1, 9)
    configs = spark.createDataFrame([(1, "a", at, '{"limit_newest": 5}'), (1, "b", at + dt.timedelta(days=1), '{"limit_newest": -4, "active": "false"}'),
                                     (2, "c", at, "no json")], "mailbox_id int, message_id string, date timestamp_ntz, text string")
    assert {(r.mailbox_id, r.message_id, r.error) for r in config_entries(configs).where("error is not null").collect()} == {
        (1, "b", "limit_newest is negative"), (2, "c", "config text is not a JSON object")}
    folded = {(r.key, r.value) for r in config_fold(configs, poll="date").collect()}
    assert folded == {("limit_newest", "5"), ("active", "false")}

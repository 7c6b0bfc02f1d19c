"""DuckDB oracle SQL for the registered queries.

Each string is self-contained: the fixture views of ``quire.sources.fixtures`` are
restated as CTEs over the driver's pre-registered tables. The SQL is written from the
rules of each operator, independently of the Spark code.
"""

from __future__ import annotations

# -- helpers that build DuckDB expressions ------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    from quire.functions.text import PY_WHITESPACE
    return f"trim({x}, {q(PY_WHITESPACE)})"


def sender_address(s: str) -> str:
    inner = f"regexp_extract({s}, '<([^>]+)>', 1)"
    return (f"CASE WHEN {s} IS NULL OR {s} = '' THEN '' "
            f"WHEN regexp_matches({s}, '<[^>]+>') THEN {strip(inner)} "
            f"ELSE {strip(s)} END")


CONFIG_TEXT = """
CASE WHEN event_id % 50 = 0 THEN 'config ' || CAST(event_id AS VARCHAR)
     ELSE '{"limit_newest": ' || CAST(CASE WHEN event_id % 17 = 0 THEN -1 ELSE 5 + user_id % 40 END AS VARCHAR)
          || ', "active": ' || CASE WHEN user_id % 23 = 0 THEN 'false' ELSE 'true' END
          || ', "release_time_str": "' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':00:00"'
          || ', "days": ' || CASE user_id % 3 WHEN 0 THEN '["Monday","Friday"]'
                                           WHEN 1 THEN '["Wednesday","Saturday"]'
                                           ELSE '["Tuesday","Thursday","Sunday"]' END
          || ', "send_now": ' || CASE WHEN event_id % 10 = 0 THEN 'true' ELSE 'false' END
          || ', "newsletter_email": "' || CASE WHEN user_id % 11 = 0 THEN ''
                                              ELSE 'news' || CAST(user_id % 4 AS VARCHAR) || '@example.com' END || '"'
          || ', "k": ' || CAST(event_id % 97 AS VARCHAR) || '}' END
"""

MESSAGES_V = f"""messages_v AS (
SELECT CAST(event_id AS VARCHAR) AS message_id, CAST(event_id % 4 AS INTEGER) AS mailbox_id, ts AS date,
       CASE WHEN user_id % 5 = 0 THEN 'user' || CAST(user_id AS VARCHAR) || '@example.com'
            ELSE 'User ' || CAST(user_id AS VARCHAR) || ' <user' || CAST(user_id AS VARCHAR) || '@example.com>' END AS sender,
       CASE WHEN event_type = 'signup' THEN 'Config' ELSE event_type END AS title,
       CASE WHEN event_type = 'signup' THEN {CONFIG_TEXT} ELSE props END AS text,
       CASE event_type WHEN 'view' THEN ['INBOX', 'UNREAD'] WHEN 'click' THEN ['INBOX']
                       WHEN 'purchase' THEN ['INBOX', 'ANALYZED'] WHEN 'signup' THEN ['INBOX', 'STARRED']
                       ELSE ['SPAM'] END AS labels
FROM events)"""

WHITELIST_V = """whitelist_v AS (
SELECT 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS addr FROM customer WHERE c_mktsegment = 'BUILDING')"""

ROUTED = f"""routed AS (
SELECT m.*, a.address, a.address IN (SELECT addr FROM whitelist_v) AS is_whitelisted
FROM messages_v m, LATERAL (SELECT {sender_address('m.sender')} AS address) a),
routed2 AS (
SELECT *, CASE WHEN NOT is_whitelisted THEN 'not_whitelisted'
               WHEN coalesce(lower(title) = 'config', false) THEN 'config' ELSE 'repost' END AS route
FROM routed),
checked AS (
SELECT * FROM routed2
WHERE list_contains(labels, 'INBOX') AND len(list_intersect(labels, ['NOT_WHITELISTED', 'ANALYZED'])) = 0)"""

CONFIG_KEYS = "('active','days','release_time_str','seconds_between_checks','whitelisted_senders','newsletter_email','limit_newest')"

FOLDED = f"""cfg AS (
SELECT * FROM checked WHERE route = 'config' AND CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' ELSE false END),
kv AS (
SELECT mailbox_id, date, message_id, CAST(date AS DATE) AS poll, text, unnest(json_keys(text)) AS key FROM cfg),
kv2 AS (
SELECT mailbox_id, date, message_id, poll, key, json_extract_string(text, '$."' || key || '"') AS value
FROM kv WHERE key IN {CONFIG_KEYS} AND NOT (key = 'limit_newest' AND coalesce(TRY_CAST(json_extract_string(text, '$.limit_newest') AS INTEGER), 0) < 0)),
folded AS (
SELECT mailbox_id, key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY mailbox_id, key ORDER BY poll DESC, date ASC, message_id DESC) AS rn
  FROM kv2) WHERE rn = 1)"""

SETUP = """setup AS (
SELECT mb.mailbox_id,
       coalesce(TRY_CAST(max(CASE WHEN key = 'active' THEN value END) AS BOOLEAN), true) AS active,
       coalesce(TRY_CAST(json_transform(max(CASE WHEN key = 'days' THEN value END), '["VARCHAR"]') AS VARCHAR[]),
                CAST([] AS VARCHAR[])) AS days,
       coalesce(max(CASE WHEN key = 'release_time_str' THEN value END), '') AS release_time_str,
       coalesce(TRY_CAST(max(CASE WHEN key = 'seconds_between_checks' THEN value END) AS INTEGER), 10) AS seconds_between_checks,
       coalesce(max(CASE WHEN key = 'newsletter_email' THEN value END), '') AS newsletter_email,
       coalesce(TRY_CAST(max(CASE WHEN key = 'limit_newest' THEN value END) AS INTEGER), 10) AS limit_newest
FROM (SELECT DISTINCT mailbox_id FROM messages_v) mb LEFT JOIN folded f ON f.mailbox_id = mb.mailbox_id
GROUP BY mb.mailbox_id)"""


def next_release(ts: str, days: str, rel: str, active: str = "true") -> str:
    d = f"CAST({ts} AS DATE)"
    secs = (f"(CASE WHEN regexp_full_match({rel}, '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') THEN "
            f"CAST(substr({rel},1,2) AS INTEGER)*3600 + CAST(substr({rel},4,2) AS INTEGER)*60 "
            f"+ CAST(substr({rel},7,2) AS INTEGER) END)")
    before = f"((epoch_us({ts}) - epoch_us(CAST({d} AS TIMESTAMP))) < CAST({secs} AS BIGINT) * 1000000)"
    off = (f"list_min(list_filter(range(0, 8), lambda o: list_contains({days}, dayname({d} + CAST(o AS INTEGER))) "
           f"AND (o > 0 OR {before})))")
    rel_ts = f"CAST(strftime({d} + CAST({off} AS INTEGER), '%Y-%m-%d') || ' ' || {rel} AS TIMESTAMP)"
    return f"(CASE WHEN coalesce({active}, true) AND {secs} IS NOT NULL AND {off} IS NOT NULL THEN {rel_ts} END)"


ISSUES = f"""assigned AS (
SELECT r.*, s.limit_newest, {next_release('r.date', 's.days', 's.release_time_str', 's.active')} AS release_ts
FROM routed2 r JOIN setup s ON s.mailbox_id = r.mailbox_id
WHERE list_contains(r.labels, 'INBOX') AND NOT list_contains(r.labels, 'ANALYZED')
  AND r.route NOT IN ('config', 'repost')),
in_window AS (
SELECT * FROM assigned WHERE release_ts IS NOT NULL
  AND CAST(date AS DATE) >= CAST(release_ts AS DATE) - 7 AND CAST(date AS DATE) <= CAST(release_ts AS DATE)),
issue_messages AS (
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY mailbox_id, release_ts ORDER BY date DESC, message_id DESC) - 1 AS BIGINT) AS msg_rank
  FROM in_window)
WHERE msg_rank < least(limit_newest, 100))"""


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ISSUE_CTES = (MESSAGES_V, WHITELIST_V, ROUTED, FOLDED, SETUP, ISSUES)

SQL: dict[str, str] = {}

SQL["issue_messages"] = with_views(*ISSUE_CTES) + """
SELECT mailbox_id, release_ts, msg_rank, message_id, date, address, route FROM issue_messages"""

SYSTEM = "('INBOX','UNREAD','STARRED','SENT','IMPORTANT','TRASH','SPAM','DRAFT')"


def labels_str(x: str = "labels") -> str:
    return f"array_to_string(list_sort({x}), ',')"


SQL["scan_messages"] = with_views(MESSAGES_V) + f"""
SELECT message_id, mailbox_id, date, sender, title, text, {labels_str()} AS labels_str FROM messages_v"""

SQL["scan_setup"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED, FOLDED, SETUP) + """
SELECT mailbox_id, active, array_to_string(days, ',') AS days_str, release_time_str, seconds_between_checks,
       newsletter_email, limit_newest FROM setup"""

HEADERS_V = """headers_v AS (
SELECT CAST(event_id AS VARCHAR) AS message_id,
       list_concat([{'name': 'From', 'value': CASE WHEN user_id % 5 = 0 THEN 'user' || CAST(user_id AS VARCHAR) || '@example.com'
                         ELSE 'User ' || CAST(user_id AS VARCHAR) || ' <user' || CAST(user_id AS VARCHAR) || '@example.com>' END},
                    {'name': 'Subject', 'value': event_type},
                    {'name': 'Date', 'value': CASE WHEN event_id % 13 = 0 THEN 'someday'
                         ELSE strftime(ts, '%a, %-d %b %Y %H:%M:%S')
                              || CASE user_id % 3 WHEN 0 THEN ' +0000' WHEN 1 THEN ' +0200' ELSE ' GMT' END END}],
                   CASE WHEN event_id % 7 = 0 THEN [{'name': 'SUBJECT', 'value': 'Re: ' || event_type}]
                        ELSE [] END) AS headers
FROM events)"""


def header(name: str) -> str:
    return f"list_filter(headers, lambda h: lower(h.name) = '{name}')[-1].value"


SQL["header_map"] = with_views(HEADERS_V) + f"""
SELECT message_id, {header('from')} AS sender, {header('subject')} AS subject, {header('date')} AS date_header
FROM headers_v"""

SQL["mail_date"] = with_views(HEADERS_V) + f"""
SELECT message_id, date_header,
       coalesce(timezone('UTC', try_strptime(core, '%d %b %Y %H:%M:%S %z')),
                CAST(try_strptime(regexp_replace(core, ' (GMT|UTC|UT)$', ''), '%d %b %Y %H:%M:%S') AS TIMESTAMP)) AS mail_date
FROM (SELECT message_id, date_header,
             regexp_replace(regexp_replace({strip('date_header')}, '^[A-Za-z]{{3}},\\s*', ''),
                            '\\s*\\([^)]*\\)$', '') AS core
      FROM (SELECT message_id, {header('date')} AS date_header FROM headers_v))"""

PARTS_V = """parts_v AS (
SELECT CAST(conv_id AS VARCHAR) AS message_id, turn AS path,
       CASE role WHEN 'user' THEN 'text/plain' WHEN 'assistant' THEN 'text/html' ELSE 'application/pdf' END AS mime_type,
       text, translate(to_base64(encode(text)), '+/', '-_') AS data
FROM conversations)"""


def b64_decode(x: str) -> str:
    return f"decode(from_base64(translate({x}, '-_', '+/')))"


SQL["body_decode"] = with_views(PARTS_V) + f"""
SELECT message_id, path, mime_type, {b64_decode('data')} AS text FROM parts_v"""

SQL["body_concat"] = with_views(PARTS_V) + f"""
SELECT message_id,
       coalesce(string_agg({b64_decode('data')}, '' ORDER BY path) FILTER (WHERE mime_type = 'text/plain'), '') AS plain,
       coalesce(string_agg({b64_decode('data')}, '' ORDER BY path) FILTER (WHERE mime_type = 'text/html'), '') AS html
FROM parts_v GROUP BY message_id"""

SQL["mime_leaves"] = """
SELECT CAST(conv_id AS VARCHAR) AS message_id,
       CASE WHEN idx < 2 THEN '0.' || CAST(idx AS VARCHAR) ELSE CAST(idx - 1 AS VARCHAR) END AS path_str,
       CASE role WHEN 'user' THEN 'text/plain' WHEN 'assistant' THEN 'text/html' ELSE 'application/pdf' END AS mime_type,
       text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations)"""

SQL["sender_address"] = with_views(MESSAGES_V) + f"""
SELECT message_id, sender, {sender_address('sender')} AS address FROM messages_v"""

SQL["preview_words"] = """
SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:5], ' ') AS preview
FROM documents"""

SQL["preview_chars"] = "SELECT doc_id, substring(text, 1, 500) AS head FROM documents"

SQL["safe_name"] = f"""
SELECT page_id, substring({strip("regexp_replace(url, '[\\\\/:*?\"<>|]', '_', 'g')")}, 1, 255) AS name FROM pages"""

SQL["filter_dates"] = with_views(MESSAGES_V) + """
SELECT message_id, date FROM messages_v
WHERE date >= TIMESTAMP '2024-01-08 00:00:00' AND date < TIMESTAMP '2024-01-15 00:00:00'"""

SQL["filter_read"] = with_views(MESSAGES_V) + """
SELECT message_id, 'unread' AS state FROM messages_v WHERE list_contains(labels, 'UNREAD')
UNION ALL SELECT message_id, 'read' AS state FROM messages_v WHERE NOT list_contains(labels, 'UNREAD')"""

SQL["filter_archived"] = with_views(MESSAGES_V) + """
SELECT message_id, 'inbox' AS state FROM messages_v WHERE list_contains(labels, 'INBOX')
UNION ALL SELECT message_id, 'archived' AS state FROM messages_v
WHERE NOT list_has_any(labels, ['INBOX', 'TRASH', 'SPAM'])"""

SQL["filter_sender"] = with_views(MESSAGES_V) + f"""
SELECT message_id, sender FROM messages_v WHERE {sender_address('sender')} = 'user10@example.com'"""

SQL["filter_labels_all"] = with_views(MESSAGES_V) + """
SELECT message_id FROM messages_v WHERE list_contains(labels, 'INBOX') AND list_contains(labels, 'UNREAD')"""

SQL["filter_labels_none"] = with_views(MESSAGES_V) + """
SELECT message_id FROM messages_v WHERE NOT list_contains(labels, 'ANALYZED') AND NOT list_contains(labels, 'SPAM')"""

SQL["mailbox_query"] = with_views(MESSAGES_V) + """
SELECT mailbox_id, message_id, date FROM (
  SELECT *, row_number() OVER (PARTITION BY mailbox_id ORDER BY date DESC, message_id DESC) AS rn FROM messages_v
  WHERE date >= TIMESTAMP '2024-01-03' AND date < TIMESTAMP '2024-01-21'
    AND list_contains(labels, 'INBOX') AND NOT list_contains(labels, 'ANALYZED'))
WHERE rn <= 30"""

SQL["newest_n"] = with_views(MESSAGES_V) + """
SELECT mailbox_id, message_id FROM (
  SELECT *, row_number() OVER (PARTITION BY mailbox_id ORDER BY date DESC, message_id DESC) AS rn FROM messages_v)
WHERE rn <= 25"""

SQL["message_rank"] = with_views(MESSAGES_V) + """
SELECT mailbox_id, message_id,
       CAST(row_number() OVER (PARTITION BY mailbox_id ORDER BY date DESC, message_id DESC) - 1 AS BIGINT) AS msg_rank
FROM messages_v"""

SQL["whitelist_split"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED) + """
SELECT message_id, address, is_whitelisted FROM routed"""

SQL["whitelist_own"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED) + """
SELECT mailbox_id, message_id, address, EXISTS (
  SELECT 1 FROM customer c WHERE c.c_custkey % 3 < 2 AND c.c_custkey % 4 = r.mailbox_id
  AND 'user' || CAST(c.c_custkey AS VARCHAR) || '@example.com' = r.address) AS is_whitelisted
FROM routed r"""

SQL["whitelist_semi"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED) + """
SELECT message_id FROM routed WHERE is_whitelisted"""

SQL["whitelist_anti"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED) + """
SELECT message_id FROM routed WHERE NOT is_whitelisted"""

SQL["route_messages"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED) + "SELECT message_id, route FROM checked"

SQL["config_fold"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED, FOLDED) + "SELECT mailbox_id, key, value FROM folded"

SQL["dead_letter"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED) + """, cfg AS (
SELECT *, CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' ELSE false END AS ok FROM checked WHERE route = 'config')
SELECT mailbox_id, message_id, CASE WHEN ok THEN 'limit_newest is negative' ELSE 'config text is not a JSON object' END AS error
FROM cfg WHERE NOT ok OR CAST(json_extract_string(CASE WHEN ok THEN text END, '$.limit_newest') AS INTEGER) < 0"""

SQL["mailbox_counts"] = with_views(MESSAGES_V) + """
SELECT mailbox_id, count(*) AS n_messages,
       CAST(sum(CAST(list_contains(labels, 'UNREAD') AS INTEGER)) AS BIGINT) AS n_unread,
       CAST(sum(CAST(list_contains(labels, 'INBOX') AS INTEGER)) AS BIGINT) AS n_inbox,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM messages_v GROUP BY mailbox_id"""

CHANGES_V = """changes_v AS (
SELECT CAST(event_id % 4 AS INTEGER) AS mailbox_id, CAST(event_id AS VARCHAR) AS message_id,
       CASE WHEN user_id % 2 = 0 THEN ['ANALYZED', 'starred'] ELSE ['inbox'] END AS add,
       CASE WHEN user_id % 3 = 0 THEN ['INBOX', 'ANALYZED'] ELSE ['Spam'] END AS remove,
       CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS read
FROM events WHERE event_id % 3 = 0),
changes2_v AS (
SELECT CAST(event_id % 4 AS INTEGER) AS mailbox_id, CAST(event_id AS VARCHAR) AS message_id, ['Inbox', 'later'] AS add,
       ['STARRED', 'ANALYZED'] AS remove, user_id % 2 = 1 AS read
FROM events WHERE event_id % 6 = 0)"""


def norm_labels(x: str) -> str:
    return f"list_transform(coalesce({x}, []), lambda l: CASE WHEN upper(l) IN {SYSTEM} THEN upper(l) ELSE l END)"


def changed(labels: str, c: str) -> str:
    """Labels after one change."""
    gone = f"CASE WHEN {c}.read = true THEN list_concat({norm_labels(c + '.remove')}, ['UNREAD']) ELSE {norm_labels(c + '.remove')} END"
    new = f"CASE WHEN {c}.read = false THEN list_concat({norm_labels(c + '.add')}, ['UNREAD']) ELSE {norm_labels(c + '.add')} END"
    return (f"CASE WHEN {c}.message_id IS NULL THEN {labels} ELSE list_distinct(list_concat("
            f"list_filter({labels}, lambda l: NOT list_contains({gone}, l)), {new})) END")


SQL["label_update"] = with_views(MESSAGES_V, CHANGES_V) + f"""
SELECT message_id, {labels_str(changed('one', 'd'))} AS labels_str FROM (
  SELECT m.message_id, m.mailbox_id, {changed('m.labels', 'c')} AS one
  FROM messages_v m LEFT JOIN changes_v c ON c.mailbox_id = m.mailbox_id AND c.message_id = m.message_id) s
LEFT JOIN changes2_v d USING (mailbox_id, message_id)"""

SQL["archive"] = with_views(MESSAGES_V) + f"""
SELECT message_id, {labels_str("list_filter(labels, lambda l: l <> 'INBOX')")} AS labels_str FROM messages_v"""

SQL["delete_messages"] = with_views(MESSAGES_V) + """
SELECT mailbox_id, message_id FROM messages_v WHERE CAST(message_id AS BIGINT) % 5 <> 0"""

REGISTRY = f"""existing AS (
SELECT DISTINCT mailbox_id, l AS name, l AS label_id FROM (SELECT mailbox_id, unnest(labels) AS l FROM messages_v)
WHERE upper(l) NOT IN {SYSTEM}),
wanted AS (
SELECT mailbox_id, CASE WHEN CAST(message_id AS BIGINT) % 2 = 0 THEN upper(title) ELSE title END AS name FROM messages_v
UNION ALL SELECT mailbox_id, upper(substring(name, 1, 1)) || lower(substring(name, 2)) FROM existing),
new_labels AS (
SELECT mailbox_id, min(name) AS name FROM wanted WHERE upper(name) NOT IN {SYSTEM}
GROUP BY mailbox_id, lower(name)),
registry AS (
SELECT mailbox_id, name, label_id FROM existing
UNION ALL
SELECT n.mailbox_id, n.name, 'Label_' || substring(sha256(CAST(n.mailbox_id AS VARCHAR) || '|' || lower(n.name)), 1, 16)
FROM new_labels n WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.mailbox_id = n.mailbox_id
                                                                AND lower(e.name) = lower(n.name)))"""

SQL["label_registry"] = with_views(MESSAGES_V, REGISTRY) + "SELECT mailbox_id, name, label_id FROM registry"

SQL["filter_labels_none"] = with_views(MESSAGES_V) + """
SELECT message_id FROM messages_v WHERE NOT list_contains(labels, 'ANALYZED') AND NOT list_contains(labels, 'SPAM')"""

SQL["label_resolve"] = with_views(MESSAGES_V, REGISTRY) + f"""
, names AS (
SELECT DISTINCT mailbox_id, name FROM (
  SELECT mailbox_id, lower(unnest(labels)) AS name FROM messages_v
  UNION ALL SELECT mailbox_id, title AS name FROM messages_v))
SELECT n.mailbox_id, n.name,
       CASE WHEN upper(n.name) IN {SYSTEM} THEN upper(n.name) ELSE r.label_id END AS label_id
FROM names n LEFT JOIN registry r ON r.mailbox_id = n.mailbox_id AND lower(r.name) = lower(n.name)"""

SQL["unprocessed"] = with_views(MESSAGES_V) + """
SELECT mailbox_id, message_id FROM messages_v WHERE NOT list_contains(labels, 'ANALYZED')"""

SQL["assign_issue"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED, FOLDED, SETUP) + f"""
SELECT mailbox_id, message_id, release_ts FROM (
  SELECT r.mailbox_id, r.message_id, r.date,
         {next_release('r.date', 's.days', 's.release_time_str', 's.active')} AS release_ts
  FROM routed2 r LEFT JOIN setup s ON s.mailbox_id = r.mailbox_id)
WHERE release_ts IS NOT NULL AND CAST(date AS DATE) >= CAST(release_ts AS DATE) - 7
  AND CAST(date AS DATE) <= CAST(release_ts AS DATE)"""

SCHEDULE = """schedule AS (
SELECT message_id, date,
       list_filter(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'],
                   lambda n, i: (uid + i - 1) % 3 = 0 AND (i - 1) < uid % 8) AS days,
       lpad(CAST(uid % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(uid % 60 AS VARCHAR), 2, '0') || ':00' AS release_time_str,
       uid % 9 <> 0 AS active
FROM (SELECT *, CAST(regexp_extract(sender, 'user(\\d+)@', 1) AS INTEGER) AS uid FROM messages_v))"""

SQL["next_release"] = with_views(MESSAGES_V, SCHEDULE) + f"""
SELECT message_id, {next_release('date', 'days', 'release_time_str', 'active')} AS release_ts FROM schedule"""

SQL["release_delay"] = with_views(MESSAGES_V, SCHEDULE) + f"""
SELECT message_id, (epoch_us(release_ts) - epoch_us(date)) / 1e6 AS delay_sec FROM (
  SELECT message_id, date, {next_release('date', 'days', 'release_time_str', 'active')} AS release_ts FROM schedule)
WHERE release_ts IS NOT NULL"""

SQL["issue_window"] = with_views(*ISSUE_CTES) + """
SELECT DISTINCT mailbox_id, release_ts, CAST(release_ts AS DATE) - 7 AS first_day, CAST(release_ts AS DATE) AS last_day
FROM issue_messages"""

# ---- page side ---------------------------------------------------------------------------
from html.entities import html5  # noqa: E402  (the named character references of HTML5)
SCHEMES = "mailto|tel|sms|callto|skype|javascript"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: What may follow a tag's name; quotes count after "=" only.
IN_TAG = r"""(?:[^>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))*"""
ONE_ATTR = r"""[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?"""
REFERENCES = "MAP([" + ",".join(q(k) for k in html5) + "],[" + ",".join(q(v) for v in html5.values()) + "])"
OLD_NAMES = "|".join(sorted((k for k in html5 if k[-1] != ";"), key=len, reverse=True))
WINDOWS = "[" + ",".join(q(bytes([n]).decode("cp1252", "ignore") or chr(n)) for n in range(128, 160)) + "]"


def unescape(x: str, attribute: bool = False) -> str:
    """References as HTML5 reads them, piece by piece behind every '&'."""
    n = ("CASE WHEN p[2] IN ('x', 'X') THEN TRY_CAST('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1) AS BIGINT) "
         "ELSE TRY_CAST(regexp_extract(p, '^#([0-9]+)', 1) AS BIGINT) END")
    char = (f"list_transform([{n}], lambda n: CASE WHEN n IS NULL OR n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN '�' "
            f"WHEN n BETWEEN 128 AND 159 THEN {WINDOWS}[n - 127] "
            "WHEN n < 9 OR n IN (11, 127) OR n BETWEEN 14 AND 31 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' "
            "ELSE chr(CAST(n AS INTEGER)) END)[1]")
    named = "regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')"
    old = f"regexp_extract(p, '^({OLD_NAMES})')"
    if attribute:
        run = "regexp_extract(p, '^[A-Za-z0-9]*')"
        old = f"CASE WHEN {old} = {run} AND NOT starts_with(substr(p, len({run}) + 1), '=') THEN {run} ELSE '' END"
    return (f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p "
            f"WHEN regexp_matches(p, '^#([0-9]|[xX][0-9a-fA-F])') THEN {char} || regexp_replace(p, '^#([0-9]+|[xX][0-9a-fA-F]+);?', '') "
            f"WHEN {named} <> '' AND {REFERENCES}[{named}] IS NOT NULL THEN {REFERENCES}[{named}] || substr(p, len({named}) + 1) "
            f"WHEN {old} <> '' THEN {REFERENCES}[{old}] || substr(p, len({old}) + 1) ELSE '&' || p END), '') ELSE {x} END")


def start_tag(name: str) -> str:
    return rf"<{name}(?:[\s/]{IN_TAG})?>"


def blocks(tags) -> str:
    return "(?is)" + "|".join(rf"{start_tag(t)}.*?</{t}\s*>" for t in tags)


def text_nodes(h: str, hidden) -> str:
    no_c = f"regexp_replace(regexp_replace({h}, '(?s)<!--.*?-->', '', 'g'), '<![^>]*>|<\\?[^>]*>', '', 'g')"
    no_b = f"regexp_replace({no_c}, {q(blocks(hidden))}, '', 'g')"
    return (f"list_filter(list_transform(string_split_regex({no_b}, {q('</?[A-Za-z]' + IN_TAG + '>')}), "
            f"lambda t: {strip(unescape('t'))}), lambda t: t <> '')")


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '\\n\\s*\\n+', {q("\n\n")}, 'g')"


def anchors(h: str) -> str:
    """[tag, content and what follows] of the page cut before every closed anchor."""
    whole = "(?is)(" + start_tag("a") + r")(.*?)</a\s*>"
    marked = f"regexp_replace({clean_scripts(h)}, {q(whole)}, chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g')"
    return f"string_split({marked}, chr(1))"


def problem(p: str) -> str:
    href = attr(f"string_split({p}, chr(2))[1]", "href")
    return f"(contains({p}, chr(2)) AND coalesce(regexp_matches(lower({href}), '^({SCHEMES}):'), false))"


def neutralise(h: str) -> str:
    inner = "string_split(string_split(p, chr(2))[2], chr(3))[1]"
    span = f"'<span>' || regexp_replace({inner}, {q('</?[A-Za-z]' + IN_TAG + '>')}, '', 'g') || '</span>' || split_part(p, chr(3), 2)"
    return (f"array_to_string(list_transform({anchors(h)}, lambda p: CASE WHEN {problem('p')} THEN {span} "
            f"ELSE replace(replace(p, chr(2), ''), chr(3), '</a>') END), '')")


def page_text_lines(h: str) -> str:
    return collapse(f"array_to_string({text_nodes(neutralise(h), ('script', 'style', 'noscript', 'iframe'))}, chr(10))")


def page_text_flat(h: str) -> str:
    body = (f"regexp_replace(CASE WHEN regexp_matches({h}, {q('(?i)' + start_tag('body'))}) "
            f"THEN regexp_replace({h}, {q('(?is)^.*?' + start_tag('body'))}, '') ELSE {h} END, '(?is)</body\\s*>.*$', '')")
    return f"array_to_string({text_nodes(body, ('script', 'style'))}, ' ')"


def clean_scripts(h: str) -> str:
    return f"regexp_replace(regexp_replace({h}, '(?s)<!--.*?-->', '', 'g'), {q(blocks(('script', 'style')))}, '', 'g')"


def attr(t: str, name: str) -> str:
    """Value of an attribute in a tag, the last one if it is given twice; '' for a bare name."""
    given = f"list_filter(regexp_extract_all({t}, {q(ONE_ATTR)}), lambda a: regexp_matches(a, '(?i)^{name}\\s*(=|$)'))[-1]"
    bare = f"regexp_replace({given}, '^[^=]*=?\\s*', '')"
    value = f"CASE WHEN len({bare}) > 1 AND {bare}[1] IN (chr(34), chr(39)) AND {bare}[1] = {bare}[-1] THEN {bare}[2:-2] ELSE {bare} END"
    return f"list_transform([{value}], lambda v: {unescape('v', True)})[1]"


def tag_values(h: str, tag: str, name: str) -> str:
    tags = f"regexp_extract_all({clean_scripts(h)}, {q('(?i)' + start_tag(tag))})"
    return f"list_transform({tags}, lambda t: {attr('t', name)})"


def keep_link(x: str) -> str:
    return (f"(NOT regexp_matches(lower({x}), '^({SCHEMES}):') AND {strip(x)} <> '' AND {strip(x)} <> '#')")


def url_resolve(b: str, r: str) -> str:
    sch = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
    scheme = f"regexp_extract({b}, {q(sch)}, 1)"
    auth = f"regexp_extract({b}, {q(r'^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)')}, 1)"
    bpath = f"regexp_extract({b}, {q(r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)')}, 1)"
    bquery = f"regexp_extract({b}, {q(r'^[^?#]*(\?[^#]*)')}, 1)"
    rpath = f"regexp_extract({r}, '^([^?#]*)', 1)"
    rrest = f"regexp_extract({r}, '^[^?#]*(.*)$', 1)"
    bdir = f"regexp_replace({bpath}, '[^/]*$', '')"
    merged = f"(CASE WHEN starts_with({rpath}, '/') THEN {rpath} ELSE (CASE WHEN {bdir} = '' THEN '/' ELSE {bdir} END) || {rpath} END)"
    segs = f"string_split({merged}, '/')"
    mid = f"list_filter({segs}, lambda x, i: i = 1 OR i = len({segs}) OR x <> '' OR starts_with({rpath}, '/'))"
    red = (f"list_reduce({mid}, lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc)-1] WHEN s = '.' THEN acc "
           f"ELSE list_append(acc, s) END, []::VARCHAR[])")
    out = f"(CASE WHEN {mid}[-1] IN ('.', '..') THEN list_append({red}, '') ELSE {red} END)"
    joined = f"array_to_string({out}, '/')"
    path = f"(CASE WHEN starts_with({joined}, '/') THEN {joined} ELSE '/' || {joined} END)"
    root = f"({scheme} || '://' || {auth})"
    return (f"(CASE WHEN {r} IS NULL THEN NULL WHEN {r} = '' THEN {b} WHEN regexp_matches({r}, {q(sch)}) THEN {r} "
            f"WHEN starts_with({r}, '//') THEN {scheme} || ':' || {r} "
            f"WHEN starts_with({r}, '?') THEN {root} || {bpath} || {r} "
            f"WHEN starts_with({r}, '#') THEN {root} || {bpath} || {bquery} || {r} "
            f"ELSE {root} || {path} || {rrest} END)")


QUOTED = """<article><a title="x>y" href="/q?a=1&amp;b=2&copy=3">quoted &gt; title</a> <!-- <a href="tel:1">no</a> --> <p data-x='">'>&#8217;&eacute;&#x41;&euro;&notit; &copy2024 &#128; &#x1F600; &bogus; &#xD800;|AT&T</p> <img alt="a>b" src="/i.png"><a href='TEL:5' title='>'>call <b>us</b></a>"""

PAGES_MIXED_V = f"""pages_mixed_v AS (
SELECT page_id, url, CASE WHEN page_id % 7 = 3 THEN replace(html, '<article>', {q(QUOTED)}) ELSE html END AS html FROM (
SELECT page_id, url,
       CASE WHEN page_id % 4 = 0 THEN replace(html, '<li><a href="/', '<li><a href="tel:')
            WHEN page_id % 5 = 0 THEN replace(html, '<li><a href="/', '<li><a href="MAILTO:')
            WHEN page_id % 6 = 0 THEN replace(html, '<li><a href="/', '<li><a href="#')
            ELSE html END AS html
FROM pages))"""

PAGES_IMG_V = """pages_img_v AS (
SELECT page_id, url, replace(html, '<article>',
       '<article><img src="/img/' || CAST(page_id AS VARCHAR) || '.png"><img alt="x"><img src=""><img src="/pix"><img alt="a>b" src="/p?a=1&amp;b=2">') AS html
FROM pages)"""


def long_form(key_cols: str, lst: str, pos: str, name: str, src: str) -> str:
    return (f"SELECT {key_cols}, CAST(unnest(range(len(l))) AS BIGINT) AS {pos}, unnest(l) AS {name} "
            f"FROM (SELECT {key_cols}, {lst} AS l FROM {src})")


SQL["scan_pages"] = "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages"

SQL["extract_links"] = with_views(PAGES_MIXED_V) + long_form(
    "page_id", f"list_filter({tag_values('html', 'a', 'href')}, lambda v: v IS NOT NULL)", "link_pos", "link",
    "pages_mixed_v")

SQL["filter_links"] = with_views(PAGES_MIXED_V) + long_form(
    "page_id", f"list_filter({tag_values('html', 'a', 'href')}, lambda v: v IS NOT NULL AND {keep_link('v')})",
    "link_pos", "link", "pages_mixed_v")

SQL["extract_images"] = with_views(PAGES_IMG_V) + long_form(
    "page_id", f"list_filter({tag_values('html', 'img', 'src')}, lambda v: v IS NOT NULL)", "img_pos", "src",
    "pages_img_v")

SQL["page_text_lines"] = f"SELECT page_id, {page_text_lines('html')} AS text FROM pages"

SQL["neutralise_links"] = with_views(PAGES_MIXED_V) + f"""
SELECT page_id,
       CAST(len(list_filter({anchors('html')}, lambda p: {problem('p')})) AS BIGINT) AS n_neutralised,
       {page_text_lines('html')} AS text
FROM pages_mixed_v"""

SQL["collapse_blank_lines"] = f"SELECT doc_id, {collapse('text')} AS text FROM documents"

SQL["page_text_flat"] = f"SELECT page_id, {page_text_flat('html')} AS content FROM pages"

SQL["page_links_abs"] = with_views(PAGES_IMG_V) + f"""
SELECT page_id, link_pos, {url_resolve('url', 'ref')} AS link FROM (
  {long_form("page_id, url", f"list_filter(list_transform(regexp_extract_all({clean_scripts('html')}, {q('(?i)' + start_tag('(?:a|img)'))}), lambda t: CASE WHEN starts_with(lower(t), '<a') THEN {attr('t', 'href')} ELSE {attr('t', 'src')} END), lambda v: v IS NOT NULL)", "link_pos", "ref", "pages_img_v")})"""

SQL["url_resolve"] = f"""
WITH ls AS ({long_form("page_id, url", f"list_filter({tag_values('html', 'a', 'href')}, lambda v: v IS NOT NULL)", "link_pos", "link", "pages")}),
v AS (
SELECT page_id, link_pos, url,
       CAST(unnest(range(9)) AS BIGINT) AS variant,
       unnest([link, substring(link, 2), '../' || substring(link, 2), './' || substring(link, 2),
               '?q=' || substring(link, 2), '#' || substring(link, 2), '//cdn.example.com' || link,
               'mailto:' || substring(link, 2), '']) AS ref
FROM ls)
SELECT page_id, link_pos, variant, ref, {url_resolve('url', 'ref')} AS resolved FROM v"""


SAFE_RE = r'[\\/:*?"<>|]'


def safe_name(x: str) -> str:
    replaced = f"regexp_replace({x}, {q(SAFE_RE)}, '_', 'g')"
    return f"substring({strip(replaced)}, 1, 255)"


SQL["image_manifest"] = with_views(PAGES_IMG_V) + f"""
, imgs AS ({long_form("page_id, url", tag_values('html', 'img', 'src'), "idx", "src", "pages_img_v")}),
r AS (
SELECT page_id, url, idx, {url_resolve('url', 'src')} AS img_url FROM imgs WHERE src IS NOT NULL AND src <> ''),
r2 AS (
SELECT *, regexp_extract(regexp_extract(img_url, {q(r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)')}, 1), '([^/]*)$', 1) AS base
FROM r)
SELECT page_id, save_path, arg_max(img_url, idx) AS img_url FROM (
  SELECT page_id, idx, img_url,
         'images/newsletter/' || {safe_name('url')} || '/' ||
         CASE WHEN base = '' OR NOT contains(base, '.') THEN 'image_' || CAST(idx AS VARCHAR) || '.jpg' ELSE base END AS save_path
  FROM r2)
GROUP BY page_id, save_path"""

# ---- corpus side ------------------------------------------------------------------------------
RULE = "'" + "=" * 40 + "'"
NL = "chr(10)"

LINKS_V = """links_v AS (
SELECT source AS message_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS link_pos,
       doc_id, 'https://example.com/' || CAST(doc_id AS VARCHAR) AS link
FROM documents)"""

CORPUS_LINKS = """corpus_links AS (
SELECT 'weekly' AS issue_id, l.*, CAST(dense_rank() OVER (ORDER BY message_id) - 1 AS BIGINT) AS msg_rank FROM links_v l)"""

SCRAPED_V = """scraped_v AS (
SELECT 'https://example.com/' || CAST(doc_id AS VARCHAR) AS link, text AS scraped FROM documents WHERE doc_id % 3 <> 0)"""

NUMBERED = """numbered AS (
SELECT c.*, CAST(row_number() OVER (PARTITION BY issue_id ORDER BY msg_rank, link_pos) - 1 AS BIGINT) AS article_n,
       'ARTICLE_' || CAST(row_number() OVER (PARTITION BY issue_id ORDER BY msg_rank, link_pos) - 1 AS VARCHAR) AS article_id
FROM corpus_links c),
attached AS (
SELECT n.*, s.link IS NOT NULL AS scraped_ok, coalesce(s.scraped, '[Failed to scrape this link]') AS scraped
FROM numbered n LEFT JOIN scraped_v s ON s.link = n.link)"""

CORPUS = (LINKS_V, CORPUS_LINKS, SCRAPED_V, NUMBERED)

SQL["article_ids"] = with_views(*CORPUS) + """
SELECT issue_id, message_id, link_pos, doc_id, article_n, article_id FROM numbered"""

SQL["link_page_join"] = with_views(*CORPUS) + "SELECT article_id, link, scraped_ok, scraped FROM attached"

SQL["repost_links"] = with_views(LINKS_V, SCRAPED_V) + """
SELECT l.message_id, l.link_pos, l.link, s.scraped FROM links_v l JOIN scraped_v s ON s.link = l.link"""


def email_header(rank: str, msg_id: str, article_id: str | None = None) -> str:
    head = f"'EMAIL ' || CAST({rank} + 1 AS VARCHAR)"
    if article_id:
        head = f"{article_id} || ' - ' || {head}"
    return f"{NL} || {RULE} || {NL} || {head} || ' (ID: ' || {msg_id} || ')' || {NL} || {RULE} || {NL}"


SQL["issue_corpus"] = with_views(*CORPUS) + f"""
, pieces AS (
SELECT DISTINCT issue_id, msg_rank, CAST(-1 AS BIGINT) AS link_pos,
       {email_header('msg_rank', 'message_id')} || 'Text:' || {NL} || 'Digest of ' || message_id || {NL} AS piece
FROM corpus_links
UNION ALL
SELECT issue_id, msg_rank, link_pos,
       {NL} || '--- ' || article_id || ' - Link ' || CAST(link_pos + 1 AS VARCHAR) || ': ' || link || ' ---' || {NL}
       || scraped || {NL} AS piece
FROM attached)
SELECT issue_id, CAST(row_number() OVER (PARTITION BY issue_id ORDER BY msg_rank, link_pos) - 1 AS BIGINT) AS piece_pos,
       piece FROM pieces"""

MSG_LINKS_V = """msg_links_v AS (
SELECT CAST(e.event_id AS VARCHAR) AS message_id, CAST(e.pos AS BIGINT) AS link_pos,
       coalesce(p.url, 'https://missing.example.com/' || CAST(e.event_id AS VARCHAR)) AS link
FROM (SELECT event_id, user_id, unnest([0, 1, 2]) AS pos FROM events) e
LEFT JOIN pages p ON p.page_id = CASE WHEN e.pos < 2 THEN e.user_id + 7 * e.pos END
WHERE e.pos = 2 OR p.page_id IS NOT NULL)"""

SQL["repost_corpus"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED, MSG_LINKS_V) + f"""
, page_texts AS (SELECT url AS link, {page_text_lines('html')} AS scraped FROM pages),
firsts AS (SELECT message_id, link, min(link_pos) AS link_pos FROM msg_links_v GROUP BY message_id, link),
got AS (
SELECT f.message_id, string_agg(p.scraped, {NL} || {NL} ORDER BY f.link_pos) AS pages_text
FROM firsts f JOIN page_texts p ON p.link = f.link GROUP BY f.message_id)
SELECT r.message_id, coalesce(r.title, '') || {NL} || {NL} || coalesce(r.text, '') || {NL} || {NL}
       || coalesce(g.pages_text, '') AS corpus
FROM checked r LEFT JOIN got g ON g.message_id = r.message_id WHERE r.route = 'repost'"""

EVALUATION_V = """evaluation_v AS (
SELECT source AS message_id, doc_id, 'ARTICLE_' || CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(n_chars % 101 AS INTEGER) END AS relevancy
FROM documents)"""

SQL["parse_evaluation"] = with_views(EVALUATION_V) + """
SELECT message_id, block,
       CAST(row_number() OVER (PARTITION BY message_id, block ORDER BY doc_id) - 1 AS BIGINT) AS resp_pos,
       id AS ID, message_id AS source, 'doc ' || CAST(doc_id AS VARCHAR) AS brief_description, relevancy
FROM (SELECT *, CAST(doc_id // 16 AS BIGINT) AS block FROM evaluation_v)
WHERE block % 9 <> 0 AND block % 11 <> 0"""

TOP5 = """top5 AS (
SELECT * FROM (
  SELECT message_id, id AS ID, relevancy, doc_id,
         CAST(row_number() OVER (PARTITION BY message_id ORDER BY coalesce(relevancy, 0) DESC, doc_id ASC) - 1 AS BIGINT) AS top_rank
  FROM evaluation_v)
WHERE top_rank < 5)"""

SQL["top5"] = with_views(EVALUATION_V, TOP5) + "SELECT message_id, ID, relevancy, top_rank FROM top5"

TOP_ARTICLES = """article_data AS (
SELECT c.message_id, c.msg_rank, c.link, 'ARTICLE_' || CAST(c.doc_id AS VARCHAR) AS article_id,
       s.link IS NOT NULL AS scraped_ok, coalesce(s.scraped, '[Failed to scrape this link]') AS scraped
FROM corpus_links c LEFT JOIN scraped_v s ON s.link = c.link WHERE c.doc_id % 7 <> 0),
top_articles AS (
SELECT t.*, a.msg_rank, a.link, a.scraped_ok, a.scraped FROM top5 t
JOIN article_data a ON a.message_id = t.message_id AND a.article_id = t.ID)"""

SQL["top_articles"] = with_views(EVALUATION_V, TOP5, LINKS_V, CORPUS_LINKS, SCRAPED_V, TOP_ARTICLES) + """
SELECT message_id, top_rank, ID, relevancy, link, scraped_ok FROM top_articles"""

SQL["top_corpus"] = with_views(EVALUATION_V, TOP5, LINKS_V, CORPUS_LINKS, SCRAPED_V, TOP_ARTICLES) + f"""
SELECT message_id, string_agg(
  {email_header('msg_rank', 'message_id', 'ID')} || 'Text:' || {NL} || 'Digest of ' || message_id || {NL}
  || 'Source: ' || {NL} || 'Brief Description: ' || {NL} || 'Reasoning: ' || {NL}
  || 'Relevancy: ' || CAST(coalesce(relevancy, 0) AS VARCHAR) || {NL}
  || {NL} || '--- ' || ID || ' - Link: ' || link || ' ---' || {NL} || scraped || {NL}, '' ORDER BY top_rank) AS corpus
FROM top_articles GROUP BY message_id"""

SQL["email_header"] = with_views(MESSAGES_V) + f"""
SELECT message_id, {email_header('msg_rank', 'message_id')} AS header, 'Text:' || {NL} || text || {NL} AS content
FROM (SELECT *, row_number() OVER (PARTITION BY mailbox_id ORDER BY date DESC, message_id DESC) - 1 AS msg_rank
      FROM messages_v)"""

# ---- scoring and text ---------------------------------------------------------------------------
# The fixed rule lists, stated here again and not taken from the operators.
_THEMES = (
    ("Cyber-Physical Systems", ("cyber-physical", "cyber physical", "cyberphysical")),
    ("Digital-Physical Integration", ("digital-physical", "digital physical", "digital twin")),
    ("Robotics", ("robot",)),
    ("Human-Computer Interaction", ("human-computer", "human computer", "user interface", "interaction")),
    ("Artificial Intelligence", ("artificial intelligence", "machine learning", "neural network")),
    ("Automation", ("automat",)),
    ("Decentralized Technologies", ("decentralis", "decentraliz", "blockchain", "distributed ledger")),
    ("Ethics in Technology", ("ethic",)),
    ("Interdisciplinary Research", ("interdisciplin", "research")),
    ("Innovation and Design", ("innovat", "design")),
)
_RULES = (
    ("Talks", ("talk", "lecture", "seminar", "keynote", "panel", "speaker")),
    ("Events", ("conference", "symposium", "expo", "fair", "meetup", "summit", "congress")),
    ("Workshops", ("workshop", "bootcamp", "hands-on", "tutorial", "course")),
    ("Opportunity", ("job", "internship", "fellowship", "grant", "scholarship", "competition", "hiring",
                     "call for papers")),
    ("News", ("announce", "announced", "award", "report", "partnership", "launch", "launched", "opens", "open")),
)
TOPICS = ["robot", "Cyber-physical", "digital twin", "user interface", "machine learning", "automated", "blockchain", "ethics",
          "research", "innovation", "talks", "Seminar", "conference", "fairs", "workshop", "hands-on", "job", "grants", "announced",
          "award", "talking", "reopened", "jobless", "cybernetic", "panelled", "ethnic", "call for papers", "fairly"]


def topics(k: str) -> str:
    """The same words by id, looked up in a list (beyond its end: nothing)."""
    words = "[" + ", ".join(q(w + ". ") for w in TOPICS) + "]"
    return " || ".join(f"coalesce({words}[{n} % 41 + 1], '')" for n in (k, f"({k} // 41)", f"({k} // 3)", f"({k} // 5)", f"({k} // 7)"))


TOPICAL_V = f"topical_v AS (SELECT doc_id, {topics('doc_id')} || text AS text FROM documents)"


def _contains_any(lt: str, words) -> str:
    return "(" + " OR ".join(f"contains({lt}, {q(w)})" for w in words) + ")"


def theme_count(t: str) -> str:
    lt = f"lower({t})"
    return "(" + " + ".join(f"CAST(coalesce({_contains_any(lt, kws)}, false) AS INTEGER)" for _, kws in _THEMES) + ")"


def classify(t: str) -> str:
    lt = f"lower({t})"

    def whole_word(ws):
        return r"(?:\A|[^a-z])(?:" + "|".join(ws) + r")s?(?:[^a-z]|\z)"
    return ("CASE " + " ".join(
        f"WHEN coalesce({_contains_any(lt, ws)} AND regexp_matches({lt}, {q(whole_word(ws))}), false) THEN {q(c)}"
        for c, ws in _RULES) + " ELSE 'Other' END")


def blocks_re(n: int) -> str:
    """The block rule as RE2 text; repeats above 1000 are built from 1000-character steps."""
    k, rest = divmod(n, 1000)
    if n <= 1000:
        return rf"(?s).{{1,{n}}}\z|.{{0,{n - 1}}}\.|.{{1,{n}}}"
    assert rest == 0
    steps = f"(?:.{{1000}}){{0,{k - 1}}}"
    return rf"(?s){steps}.{{1,1000}}\z|{steps}.{{0,999}}\.|{steps}.{{1,1000}}"


def text_blocks(n: int) -> str:
    arr = f"CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, {q(blocks_re(n))}) END"
    return long_form("doc_id", arr, "block_pos", "block", "documents")


SQL["text_blocks"] = text_blocks(1000)


def text_blocks_recursive(n: int) -> str:
    """The block rule walked block by block (no repeat limit)."""
    def cut(start: str) -> str:
        start = f"({start})"
        w = f"substring(text, {start}, {n})"
        dot = f"length(regexp_extract({w}, '(?s)^(.*\\.)', 1))"
        return (f"CASE WHEN length(text) - {start} + 1 <= {n} THEN length(text) - {start} + 1 "
                f"WHEN {dot} > 0 THEN {dot} ELSE {n} END")
    return f"""
WITH RECURSIVE b(doc_id, text, block_pos, start, len) AS (
  SELECT doc_id, text, CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST({cut('1')} AS BIGINT) FROM documents
  UNION ALL
  SELECT doc_id, text, block_pos + 1, start + len, CAST({cut('start + len')} AS BIGINT) FROM b
  WHERE start + len <= length(text))
SELECT doc_id, block_pos, substring(text, start, len) AS block FROM b"""


SQL["text_blocks_udf"] = text_blocks_recursive(5000)

SQL["relevancy_score"] = with_views(TOPICAL_V) + f"SELECT doc_id, CAST(({theme_count('text')} * 100) // {len(_THEMES)} AS INTEGER) AS relevancy FROM topical_v"

SQL["theme_filter"] = with_views(TOPICAL_V) + f"SELECT doc_id FROM topical_v WHERE {theme_count('text')} > 0"

SQL["classify_category"] = with_views(TOPICAL_V) + f"SELECT doc_id, {classify('text')} AS category FROM topical_v"

SQL["future_only"] = with_views(MESSAGES_V) + """
SELECT message_id, date FROM messages_v WHERE date >= TIMESTAMP '2024-01-20 00:00:00'"""

ARTICLES_V = """articles_v AS (
SELECT doc_id AS pos, source AS issue_id, split_part(text, chr(10), 1) AS title, source, 'Online' AS location,
       CASE WHEN doc_id % 4 = 0 THEN 'c' || CAST(doc_id AS VARCHAR) || '@example.com' END AS contact,
       text AS description, 'A text of ' || CAST(n_chars AS VARCHAR) || ' characters' AS summary,
       'https://example.com/' || CAST(doc_id AS VARCHAR) AS link,
       CASE doc_id % 8 WHEN 0 THEN 'News' WHEN 1 THEN 'Talks' WHEN 2 THEN 'Events' WHEN 3 THEN 'Workshops'
                       WHEN 4 THEN 'Opportunity' WHEN 5 THEN 'Other' WHEN 6 THEN 'Podcast' END AS category
FROM documents)"""

SQL["schema_violations"] = with_views(ARTICLES_V) + """
SELECT pos, error FROM (
  SELECT pos, CASE WHEN description IS NULL THEN 'missing description' WHEN title IS NULL THEN 'missing title'
                   WHEN source IS NULL THEN 'missing source' WHEN location IS NULL THEN 'missing location'
                   WHEN summary IS NULL THEN 'missing summary' WHEN category IS NULL THEN 'missing category'
                   WHEN link IS NULL THEN 'missing link'
                   WHEN category NOT IN ('News','Talks','Events','Workshops','Opportunity','Other') THEN 'unknown category'
              END AS error
  FROM articles_v) WHERE error IS NOT NULL"""


def normalised(t: str) -> str:
    return f"lower(trim(regexp_replace({t}, '[\\s\\x{{00A0}}]+', ' ', 'g')))"


EXACT = f"""exact AS (
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({normalised('text')})) AS dup_of FROM documents)"""

SQL["dedup_exact"] = with_views(EXACT) + "SELECT doc_id, dup_of, doc_id <> dup_of AS is_copy FROM exact"

# All pairs that share a shingle, exact Jaccard, then the smallest document reachable.
SQL["dedup_near"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split(lower(regexp_replace(text, '[\s\x{00a0}]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT doc_id, min(c) AS cluster, doc_id <> min(c) AS is_copy FROM r GROUP BY doc_id"""

SQL["dedup_penalty"] = with_views(EXACT, EVALUATION_V) + """
SELECT e.doc_id, CAST(CASE WHEN e.doc_id <> e.dup_of THEN coalesce(v.relevancy, 0) // 10
                           ELSE coalesce(v.relevancy, 0) END AS INTEGER) AS score
FROM exact e JOIN evaluation_v v ON v.doc_id = e.doc_id"""

SQL["best_image"] = with_views(PAGES_IMG_V) + f"""
, imgs AS ({long_form("page_id, url", tag_values('html', 'img', 'src'), "idx", "src", "pages_img_v")}),
r AS (SELECT page_id, url, idx, {url_resolve('url', 'src')} AS img_url FROM imgs WHERE src IS NOT NULL AND src <> ''),
r2 AS (
SELECT *, regexp_extract(regexp_extract(img_url, {q(r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)')}, 1), '([^/]*)$', 1) AS base
FROM r),
m AS (
SELECT page_id, save_path, arg_max(img_url, idx) AS img_url, max(idx) AS idx FROM (
  SELECT page_id, idx, img_url,
         'images/newsletter/' || {safe_name('url')} || '/' ||
         CASE WHEN base = '' OR NOT contains(base, '.') THEN 'image_' || CAST(idx AS VARCHAR) || '.jpg' ELSE base END AS save_path
  FROM r2) GROUP BY page_id, save_path)
SELECT page_id, img_url, save_path FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN ends_with(img_url, '.png') THEN 2 ELSE 1 END DESC,
                                                         idx ASC) AS rn FROM m)
WHERE rn = 1"""

SQL["trailing_rate"] = """
SELECT event_id, user_id, n_in_window, n_in_window > 3 AS over_limit FROM (
  SELECT event_id, user_id,
         count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n_in_window
  FROM events)"""

SQL["conversation_history"] = """
SELECT conv_id, count(*) AS n_turns,
       CAST(to_json(list({'role': CASE WHEN role = 'user' THEN 'user' ELSE 'model' END, 'text': text} ORDER BY turn)) AS VARCHAR) AS history
FROM conversations GROUP BY conv_id"""

SQL["turn_context"] = """
SELECT conv_id, turn, n_prior, CASE WHEN prev_role = 'model' THEN prev_text END AS prev_reply FROM (
  SELECT conv_id, turn, role, CAST(row_number() OVER w - 1 AS BIGINT) AS n_prior,
         lag(CASE WHEN role = 'user' THEN 'user' ELSE 'model' END) OVER w AS prev_role, lag(text) OVER w AS prev_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user'"""

SQL["scored_blocks"] = f"""
SELECT doc_id, block_pos, CAST(len(regexp_extract_all(block, '\\S+')) AS BIGINT) AS n_words,
       CAST(length(block) - length(replace(block, '.', '')) AS BIGINT) AS n_stops
FROM ({text_blocks(1000)})"""

# ---- digest ----------------------------------------------------------------------------------
# Fixed values and layout of the digest, stated here again and not taken from the operators.
COLORS = {"News": "#007BFF", "Talks": "#28A745", "Events": "#DC3545", "Workshops": "#17A2B8", "Opportunity": "#FFC107",
          "Other": "#6c757d"}
DIGEST_STYLE = ("body{font:16px/1.5 Georgia,serif;max-width:44rem;margin:auto}h2{border-left:.5rem solid;padding-left:.5rem}"
                ".card{margin:1rem 0}.facts{font-size:.8rem}.facts dt{float:left;padding-right:.3rem}")
DIGEST_FOOT = "<footer>Weekly digest. Compiled without an editor.</footer>\n</body></html>"


def digest_head(title: str) -> str:
    return (f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>{DIGEST_STYLE}</style></head>'
            f"<body>\n<h1>{title}</h1>")


def color(cat: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in COLORS.items())
    return f"coalesce(CASE coalesce({cat}, 'Other') {cases} END, {q(COLORS['Other'])})"


def article_html() -> str:
    """The card as one format string; missing values print as nothing."""
    card = ('<article class="card" style="border-top:3px solid {}"><h3><a href="{}">{}</a></h3><p><strong>{}</strong></p><p>{}</p>'
            '<dl class="facts"><dt>Topic</dt><dd>{}</dd><dt>Published by</dt><dd>{}</dd><dt>Place</dt><dd>{}</dd>{}</dl></article>')
    got = [color("category")] + [f"coalesce({c}, '')" for c in ("link", "title", "summary", "description")]
    got += ["coalesce(category, 'Other')", "coalesce(source, '')", "coalesce(location, '')",
            "CASE WHEN contact IS NULL THEN '' ELSE format('<dt>Ask</dt><dd>{}</dd>', contact) END"]
    return f"format({q(card)}, {', '.join(got)})"


def sections_sql(src: str, keys: str, pos: str) -> str:
    return f"""
SELECT {keys}, cat AS category,
       format('<section><h2 style="border-color:{{}}">{{}}</h2>', {color('cat')}, cat) || {NL}
       || string_agg(art, {NL} ORDER BY {pos}) || {NL} || '</section>' AS html
FROM (SELECT *, coalesce(category, 'Other') AS cat, {article_html()} AS art FROM {src})
GROUP BY {keys}, cat"""


def document_sql(sections: str, keys: str, title: str = "Weekly News") -> str:
    return f"""
SELECT {keys}, count(*) AS n_sections,
       {q(digest_head(title))} || {NL} || string_agg(html, {NL} ORDER BY category) || {NL} || {q(DIGEST_FOOT)} AS html
FROM ({sections}) GROUP BY {keys}"""


SQL["category_color"] = with_views(ARTICLES_V) + f"SELECT pos, category, {color('category')} AS color FROM articles_v"

SQL["articles_by_category"] = with_views(ARTICLES_V) + """
SELECT issue_id, coalesce(category, 'Other') AS category, count(*) AS n_articles FROM articles_v GROUP BY 1, 2"""

SQL["article_html"] = with_views(ARTICLES_V) + f"SELECT pos, {article_html()} AS html FROM articles_v"

DIGEST_ARTICLES = """digest_articles AS (
SELECT * FROM (
  SELECT a.*, e.relevancy,
         CAST(row_number() OVER (PARTITION BY a.issue_id ORDER BY coalesce(e.relevancy, 0) DESC, a.pos ASC) - 1 AS BIGINT) AS top_rank
  FROM articles_v a JOIN evaluation_v e ON e.doc_id = a.pos)
WHERE top_rank < 5)"""

SQL["category_section"] = with_views(ARTICLES_V, EVALUATION_V, DIGEST_ARTICLES) + sections_sql(
    "digest_articles", "issue_id", "top_rank")

SQL["digest_html"] = with_views(ARTICLES_V, EVALUATION_V, DIGEST_ARTICLES) + document_sql(
    sections_sql("digest_articles", "issue_id", "top_rank"), "issue_id")

SQL["repost_html"] = with_views(ARTICLES_V, EVALUATION_V, DIGEST_ARTICLES) + f"""
SELECT issue_id,
       {q(digest_head("News Repost"))} || {NL} || format('<p class="from">From {{}}</p>', issue_id) || {NL}
       || string_agg({article_html()}, {NL} ORDER BY top_rank) || {NL} || {q(DIGEST_FOOT)} AS html
FROM digest_articles GROUP BY issue_id"""

EMAIL_RE = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"

KEPT = f"""page_texts AS (SELECT url AS link, {topics('page_id')} || {page_text_lines('html')} AS scraped FROM pages),
members AS (SELECT mailbox_id, release_ts, message_id, msg_rank FROM issue_messages),
ilinks AS (SELECT m.*, l.link_pos, l.link FROM members m JOIN msg_links_v l ON l.message_id = m.message_id),
numbered_i AS (
SELECT *, row_number() OVER (PARTITION BY mailbox_id, release_ts ORDER BY msg_rank, link_pos) - 1 AS article_n FROM ilinks),
arts AS (
SELECT n.*, p.link IS NOT NULL AS scraped_ok, coalesce(p.scraped, '[Failed to scrape this link]') AS scraped
FROM numbered_i n LEFT JOIN page_texts p ON p.link = n.link),
arts2 AS (
SELECT *, CASE WHEN scraped_ok THEN CAST(({theme_count('scraped')} * 100) // {len(_THEMES)} AS INTEGER) ELSE 0 END AS rel0,
       sha256({normalised('scraped')}) AS h FROM arts),
arts3 AS (
SELECT *, CASE WHEN article_n <> min(article_n) OVER (PARTITION BY mailbox_id, release_ts, h) THEN rel0 // 10
               ELSE rel0 END AS relevancy FROM arts2),
top_i AS (
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY mailbox_id, release_ts ORDER BY coalesce(relevancy, 0) DESC, article_n ASC) - 1 AS BIGINT) AS top_rank
  FROM arts3) WHERE top_rank < 5),
kept AS (
SELECT mailbox_id, release_ts, top_rank, link, split_part(scraped, chr(10), 1) AS title,
       regexp_extract(link, {q(r'^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)')}, 1) AS source, 'Online' AS location,
       nullif(regexp_extract(scraped, {q(EMAIL_RE)}, 1), '') AS contact, scraped AS description,
       array_to_string(list_filter(string_split_regex(scraped, '\\s+'), lambda w: w <> '')[1:12], ' ') AS summary,
       {classify('scraped')} AS category
FROM top_i),
newsletters AS ({document_sql(sections_sql('kept', 'mailbox_id, release_ts', 'top_rank'), 'mailbox_id, release_ts')})"""

SQL["newsletter_html"] = with_views(*ISSUE_CTES, MSG_LINKS_V, KEPT) + """
SELECT mailbox_id, release_ts, n_sections, html FROM newsletters"""

SQL["outbox_rows"] = with_views(*ISSUE_CTES, MSG_LINKS_V, KEPT) + """
SELECT n.mailbox_id, n.release_ts, s.newsletter_email AS "to", 'Newsletter' AS subject, 'me' AS sender, n.html
FROM newsletters n JOIN setup s ON s.mailbox_id = n.mailbox_id WHERE s.newsletter_email <> ''"""

# ---- news items --------------------------------------------------------------------------------
PAGES_NEWS_V = """pages_news_v AS (
SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN html
       WHEN 1 THEN replace(replace(html, '<article>', '<section>'), '</article>', '</section>')
       ELSE replace(replace(replace(replace(html, '<article>', '<section>'), '</article>', '</section>'),
                            '<h1>', '<div>'), '</h1>', '</div>') END AS html
FROM pages)"""

from quire.operators.news import BLOCK_TAGS as _BLOCKS  # noqa: E402  (fixed tag list)

_blk = "(" + ",".join(q(t) for t in _BLOCKS) + ")"

TOKENS = f"""raw_tokens AS (
SELECT page_id, url, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS tok FROM (
  SELECT page_id, url, regexp_extract_all(
    regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<![^>]*>|<\\?[^>]*>', '', 'g'),
                   {q(blocks(('script', 'style')))}, '', 'g'),
    {q('</?[A-Za-z]' + IN_TAG + '>|[^<]+|<')}) AS l
  FROM pages_news_v)),
tokens AS (
SELECT *, CASE WHEN starts_with(tok, '</') THEN 'close' WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'open' ELSE 'text' END AS kind,
       lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag
FROM raw_tokens),
ann AS (
SELECT *, CASE WHEN kind = 'text' THEN {strip(unescape('tok'))} END AS text,
       sum(CASE WHEN kind = 'open' AND tag = 'article' THEN 1 WHEN kind = 'close' AND tag = 'article' THEN -1 ELSE 0 END) OVER w AS in_article,
       sum(CASE WHEN kind = 'open' AND tag = 'article' THEN 1 ELSE 0 END) OVER w AS article_no,
       sum(CASE WHEN kind = 'open' AND tag = 'h2' THEN 1 WHEN kind = 'close' AND tag = 'h2' THEN -1 ELSE 0 END) OVER w AS in_title,
       sum(CASE WHEN kind = 'open' AND tag = 'a' THEN 1 WHEN kind = 'close' AND tag = 'a' THEN -1 ELSE 0 END) OVER w AS in_a,
       sum(CASE WHEN kind = 'open' AND tag = 'a' THEN 1 ELSE 0 END) OVER w AS anchor_no,
       sum(CASE WHEN kind = 'open' AND tag IN ('h1','h2','h3','h4','h5') THEN 1 ELSE 0 END) OVER w AS heading_no,
       sum(CASE WHEN kind = 'open' AND tag IN ('h1','h2','h3','h4','h5') THEN 1
                WHEN kind = 'close' AND tag IN ('h1','h2','h3','h4','h5') THEN -1 ELSE 0 END) OVER w AS in_heading,
       sum(CASE WHEN kind = 'open' AND tag IN {_blk} AND tag <> 'hr' THEN 1
                WHEN kind = 'close' AND tag IN {_blk} THEN -1 ELSE 0 END) OVER w AS depth,
       sum(CASE WHEN kind = 'open' AND tag = 'p' THEN 1 ELSE 0 END) OVER w AS p_no,
       coalesce(last_value(CASE WHEN kind = 'open' AND tag = 'p' THEN 1 WHEN kind = 'close' AND tag = 'p' THEN 0
                                WHEN kind IN ('open', 'close') AND tag IN {_blk} THEN 0 END IGNORE NULLS) OVER w, 0) = 1 AS in_desc,
       CASE WHEN kind = 'open' AND tag = 'a' THEN {attr('tok', 'href')} END AS href
FROM tokens WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

NEWS_TAIL = """'News' AS category, '' AS location, '' AS contact, '' AS requirements, '' AS imageVideosLinks"""

TIER1 = f"""t1g AS (
SELECT page_id, url, article_no AS item_no,
       coalesce(string_agg(CASE WHEN in_title > 0 AND kind = 'text' AND text <> '' THEN text END, ' ' ORDER BY pos), '') AS title,
       coalesce(string_agg(CASE WHEN in_desc AND kind = 'text' AND text <> '' THEN text END, ' ' ORDER BY pos), '') AS description,
       arg_min(href, CASE WHEN tag = 'a' AND href IS NOT NULL THEN pos END) AS h
FROM ann WHERE in_article > 0 GROUP BY page_id, url, article_no),
tier1 AS (
SELECT page_id, 1 AS tier, CAST(item_no AS BIGINT) AS item_no, title, description,
       coalesce(CASE WHEN h IS NOT NULL THEN {url_resolve('url', 'h')} END, '') AS link, url AS source, {NEWS_TAIL}
FROM t1g WHERE title <> '' OR description <> '')"""

SQL["news_tier1"] = with_views(PAGES_NEWS_V, TOKENS, TIER1) + "SELECT * FROM tier1"

# Selector chains by joins of element intervals: an element's end is the nearest end tag of its name and level.
PAGES_POSTS_V = """pages_posts_v AS (
SELECT page_id, url, CASE page_id % 3
       WHEN 2 THEN replace(replace(html, '<article>', '<div class="post"><div class="entry-content">'), '</article>', '</div></div>')
       ELSE '<div class="post hentry" id="p1"><h2 class=\'\'entry-title big\'\'><a href="/post/' || page_id || '">Post <b>' || page_id
            || '</b></a></h2><a href="/no">other</a><div class="entry-content"><p>First of ' || page_id
            || '<p class=x>Second <i>part</i><div>no paragraph</div></div>'
            || CASE WHEN page_id % 3 = 1 THEN '<div class="post"><h2 class="entry-title"><a title="x>y" href="inner">Inner</a></h2></div>' ELSE '' END
            || '<p>outside</p></div>' || html || '<p class="post">tail <a href="#z">z</a>' END AS html
FROM pages)"""


def _has(cls: str) -> str:
    return f"list_contains(string_split_regex(coalesce({attr('tok', 'class')}, ''), '[ \\t\\n\\f\\r]+'), {q(cls)})"


SELECTED = f"""lv AS (
SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY pos)
          + CASE WHEN kind = 'close' THEN 1 ELSE 0 END AS lvl FROM ann),
el AS MATERIALIZED (
SELECT o.page_id, o.url, o.pos AS s, o.tag, o.tok, coalesce(min(c.pos), 1::BIGINT << 62) AS e FROM lv o LEFT JOIN lv c
  ON c.page_id = o.page_id AND c.pos > o.pos AND CASE WHEN o.tag = 'p' THEN c.kind <> 'text' AND (c.tag = 'p' OR c.tag IN {_blk})
                                                      ELSE c.kind = 'close' AND c.tag = o.tag AND c.lvl = o.lvl END
WHERE o.kind = 'open' AND (o.tag IN ('a', 'p', 'h2') OR {_has('post').replace('tok', 'o.tok')} OR {_has('entry-content').replace('tok', 'o.tok')})
  AND o.tag NOT IN ('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr') GROUP BY 1, 2, 3, 4, 5),
art AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY s) AS no FROM el WHERE {_has('post')}),
head AS (SELECT * FROM el WHERE tag = 'h2' AND {_has('entry-title')}),
body AS (SELECT * FROM el WHERE {_has('entry-content')}),
words AS (SELECT page_id, pos, text FROM ann WHERE kind = 'text' AND text <> ''),
said AS (
SELECT DISTINCT a.page_id, a.no, 't' AS what, w.pos, w.text AS v FROM art a JOIN head h ON h.page_id = a.page_id AND h.s >= a.s AND h.s < a.e
JOIN words w ON w.page_id = a.page_id AND w.pos > h.s AND w.pos < h.e AND w.pos < a.e
UNION ALL
SELECT DISTINCT a.page_id, a.no, 'd', w.pos, w.text FROM art a JOIN body b ON b.page_id = a.page_id AND b.s >= a.s AND b.s < a.e
JOIN el p ON p.page_id = a.page_id AND p.tag = 'p' AND p.s > b.s AND p.s < b.e
JOIN words w ON w.page_id = a.page_id AND w.pos > p.s AND w.pos < p.e AND w.pos < a.e
UNION ALL
SELECT DISTINCT a.page_id, a.no, 'l', l.s, {attr('l.tok', 'href')} FROM art a JOIN head h ON h.page_id = a.page_id AND h.s >= a.s AND h.s < a.e
JOIN el l ON l.page_id = a.page_id AND l.tag = 'a' AND l.s > h.s AND l.s < h.e AND l.s < a.e WHERE {attr('l.tok', 'href')} IS NOT NULL),
put AS (
SELECT a.page_id, a.url, a.no, coalesce(string_agg(v, ' ' ORDER BY pos) FILTER (WHERE what = 't'), '') AS title,
       coalesce(string_agg(v, ' ' ORDER BY pos) FILTER (WHERE what = 'd'), '') AS description, arg_min(v, CASE WHEN what = 'l' THEN pos END) AS h
FROM art a LEFT JOIN said x ON x.page_id = a.page_id AND x.no = a.no GROUP BY 1, 2, 3)"""

SQL["news_selected"] = with_views(PAGES_POSTS_V, TOKENS.replace("pages_news_v", "pages_posts_v"), SELECTED) + f"""
SELECT page_id, 1 AS tier, CAST(no AS BIGINT) AS item_no, title, description,
       coalesce(CASE WHEN h <> '' THEN {url_resolve('url', 'h')} END, '') AS link, url AS source, {NEWS_TAIL}
FROM put WHERE title <> '' OR description <> ''"""

TIER3 = f"""t3g AS (
SELECT page_id, url, anchor_no AS item_no,
       coalesce(string_agg(CASE WHEN kind = 'text' AND text <> '' THEN text END, ' ' ORDER BY pos), '') AS title,
       first(href ORDER BY pos) FILTER (WHERE href IS NOT NULL) AS h
FROM ann WHERE in_a > 0 GROUP BY page_id, url, anchor_no),
tier3 AS (
SELECT page_id, 3 AS tier, CAST(item_no AS BIGINT) AS item_no, title, '' AS description,
       {url_resolve('url', 'h')} AS link, url AS source, {NEWS_TAIL}
FROM t3g WHERE title <> '' AND h IS NOT NULL AND length(title) > 10)"""

SQL["news_tier3"] = with_views(PAGES_NEWS_V, TOKENS, TIER3) + "SELECT * FROM tier3"

SQL["html_tokens"] = with_views(PAGES_NEWS_V, TOKENS) + "SELECT page_id, pos, kind, tag, text FROM ann"


TIER2 = f"""heads AS (
SELECT page_id, url, heading_no AS item_no,
       coalesce(string_agg(CASE WHEN kind = 'text' AND text <> '' THEN text END, ' ' ORDER BY pos), '') AS title,
       arg_min(href, CASE WHEN href IS NOT NULL THEN pos END) AS own, min(pos) AS s, max(pos) AS e
FROM ann WHERE in_heading > 0 GROUP BY page_id, url, heading_no),
h AS (
SELECT heads.*, o.d FROM heads JOIN (
  SELECT page_id, heading_no AS item_no, depth - 1 AS d FROM ann
  WHERE kind = 'open' AND tag IN ('h1','h2','h3','h4','h5')) o USING (page_id, item_no)),
blocks AS (SELECT * FROM ann WHERE tag IN {_blk} AND kind <> 'text'),
ps AS (
SELECT page_id, item_no, ps FROM (
  SELECT *, last_value(bo IGNORE NULLS) OVER (PARTITION BY page_id, k ORDER BY p
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ps
  FROM (SELECT page_id, depth AS k, pos AS p, pos AS bo, CAST(NULL AS BIGINT) AS item_no FROM blocks WHERE kind = 'open'
        UNION ALL SELECT page_id, d, s, NULL, item_no FROM h))
WHERE item_no IS NOT NULL),
pe AS (
SELECT page_id, item_no, pe FROM (
  SELECT *, first_value(bc IGNORE NULLS) OVER (PARTITION BY page_id, k ORDER BY p
                                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pe
  FROM (SELECT page_id, depth AS k, pos AS p, pos AS bc, CAST(NULL AS BIGINT) AS item_no FROM blocks WHERE kind = 'close'
        UNION ALL SELECT page_id, d - 1, e, NULL, item_no FROM h))
WHERE item_no IS NOT NULL),
spans AS (SELECT h.*, ps.ps, pe.pe FROM h LEFT JOIN ps USING (page_id, item_no) LEFT JOIN pe USING (page_id, item_no)),
pl AS (
SELECT page_id, item_no, nl FROM (
  SELECT *, first_value(CASE WHEN lp IS NOT NULL THEN {{'lp': lp, 'h': hr}} END IGNORE NULLS)
              OVER (PARTITION BY page_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nl
  FROM (SELECT page_id, CAST(pos AS DOUBLE) AS p, pos AS lp, href AS hr, CAST(NULL AS BIGINT) AS item_no
        FROM ann WHERE href IS NOT NULL
        UNION ALL SELECT page_id, coalesce(ps, -1) - 0.5, NULL, NULL, item_no FROM spans))
WHERE item_no IS NOT NULL),
np AS (
SELECT page_id, item_no, pn FROM (
  SELECT *, first_value(pn0 IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY p
                                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pn
  FROM (SELECT page_id, CAST(pos AS DOUBLE) AS p, p_no AS pn0, CAST(NULL AS BIGINT) AS item_no
        FROM ann WHERE kind = 'open' AND tag = 'p'
        UNION ALL SELECT page_id, e + 0.5, NULL, item_no FROM h))
WHERE item_no IS NOT NULL),
ptext AS (
SELECT page_id, p_no AS pn, string_agg(text, ' ' ORDER BY pos) AS description
FROM ann WHERE in_desc AND kind = 'text' AND text <> '' GROUP BY page_id, p_no),
t2 AS (
SELECT s.page_id, s.url, s.item_no, s.title, t.description,
       coalesce(s.own, CASE WHEN l.nl IS NOT NULL AND l.nl.lp < coalesce(s.pe, 4611686018427387904) THEN l.nl.h END) AS raw
FROM spans s LEFT JOIN pl l USING (page_id, item_no) LEFT JOIN np n USING (page_id, item_no)
LEFT JOIN ptext t ON t.page_id = s.page_id AND t.pn = n.pn),
tier2 AS (
SELECT page_id, 2 AS tier, CAST(item_no AS BIGINT) AS item_no, title, coalesce(description, '') AS description,
       coalesce(CASE WHEN raw IS NOT NULL THEN {url_resolve('url', 'raw')} END, '') AS link, url AS source, {NEWS_TAIL}
FROM t2 WHERE title <> '' AND (raw IS NOT NULL OR coalesce(description, '') <> ''))"""

SQL["news_tier2"] = with_views(PAGES_NEWS_V, TOKENS, TIER2) + "SELECT * FROM tier2"


SQL["news_items"] = with_views(PAGES_NEWS_V, TOKENS, TIER1, TIER2, TIER3) + """
SELECT * EXCLUDE (best) FROM (
  SELECT *, min(tier) OVER (PARTITION BY page_id) AS best FROM (
    SELECT * FROM tier1 UNION ALL SELECT * FROM tier2 UNION ALL SELECT * FROM tier3))
WHERE tier = best"""

SQL["send_now_issue"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED, FOLDED, SETUP) + """
, requests AS (
SELECT DISTINCT mailbox_id, date AS as_of FROM checked
WHERE route = 'config' AND CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' ELSE false END
  AND lower(json_extract_string(text, '$.send_now')) = 'true'),
hits AS (
SELECT r.*, q.as_of AS release_ts, s.limit_newest FROM routed2 r
JOIN requests q ON q.mailbox_id = r.mailbox_id AND r.date <= q.as_of
     AND CAST(r.date AS DATE) >= CAST(q.as_of AS DATE) - 7
LEFT JOIN setup s ON s.mailbox_id = r.mailbox_id
WHERE list_contains(r.labels, 'INBOX') AND NOT list_contains(r.labels, 'ANALYZED') AND r.route NOT IN ('config', 'repost'))
SELECT mailbox_id, release_ts, msg_rank, message_id FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY mailbox_id, release_ts ORDER BY date DESC, message_id DESC) - 1 AS BIGINT) AS msg_rank
  FROM hits)
WHERE msg_rank < least(limit_newest, 100)"""


# -- mail over the limit waits for a later issue: the pending mail of a mailbox is a list, each release takes its newest -----
SQL["issue_carry_over"] = (with_views(MESSAGES_V, WHITELIST_V, ROUTED, FOLDED, SETUP) + f""", m AS (
SELECT r.*, {next_release('r.date', 's.days', 's.release_time_str', 's.active')} AS seg FROM routed2 r JOIN setup s ON s.mailbox_id = r.mailbox_id
WHERE list_contains(r.labels, 'INBOX') AND NOT list_contains(r.labels, 'ANALYZED') AND r.route NOT IN ('config', 'repost')),
came AS MATERIALIZED (SELECT mailbox_id, seg, list({{'d': date, 'id': message_id, 'seg': seg}}) AS xs FROM m WHERE seg IS NOT NULL GROUP BY 1, 2),
span AS (SELECT mailbox_id, min(CAST(date AS DATE)) AS a, max(CAST(seg AS DATE)) + 7 AS z FROM m WHERE seg IS NOT NULL GROUP BY 1),
cal AS MATERIALIZED (
SELECT mailbox_id, r, least(limit_newest, 100) AS n, row_number() OVER (PARTITION BY mailbox_id ORDER BY r) AS k FROM (
  SELECT span.mailbox_id, limit_newest, CAST(strftime(a + CAST(o AS INTEGER), '%Y-%m-%d') || ' ' || release_time_str AS TIMESTAMP) AS r
  FROM (SELECT *, unnest(range(0, z - a + 1)) AS o FROM span) span JOIN setup USING (mailbox_id)
  WHERE list_contains(days, dayname(a + CAST(o AS INTEGER))))),
step(mailbox_id, k, taken, waiting) AS (
SELECT mailbox_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(d TIMESTAMP, id VARCHAR, seg TIMESTAMP)[]),
       CAST([] AS STRUCT(d TIMESTAMP, id VARCHAR, seg TIMESTAMP)[]) FROM span
UNION ALL
SELECT mailbox_id, k, xs[1:n], xs[n + 1:] FROM (
  SELECT c.mailbox_id, c.k, c.n, list_reverse_sort(list_concat(
         list_filter(s.waiting, lambda x: CAST(x.d AS DATE) >= CAST(c.r AS DATE) - 7), coalesce(came.xs, []))) AS xs
  FROM step s JOIN cal c ON c.mailbox_id = s.mailbox_id AND c.k = s.k + 1
  LEFT JOIN came ON came.mailbox_id = c.mailbox_id AND came.seg = c.r))
SELECT mailbox_id, r AS release_ts, CAST(i - 1 AS BIGINT) AS msg_rank, taken[i].id AS message_id, r > taken[i].seg AS carried FROM (
  SELECT s.mailbox_id, r, taken, unnest(range(1, len(taken) + 1)) AS i FROM step s JOIN cal c ON c.mailbox_id = s.mailbox_id AND c.k = s.k)"""
).replace("WITH ", "WITH RECURSIVE ", 1)

_AS_OF = ("active", "days", "release_time_str", "newsletter_email", "limit_newest")
AS_OF = "dated AS (\nSELECT mailbox_id, date, key, arg_max(value, message_id) AS value FROM kv2 GROUP BY 1, 2, 3),\n" + "valid AS (\nSELECT m.*, " + ", ".join(
    f"v_{k}.value AS v_{k}" for k in _AS_OF) + " FROM routed2 m\n" + "\n".join(
    f"ASOF LEFT JOIN (SELECT * FROM dated WHERE key = '{k}') v_{k} ON v_{k}.mailbox_id = m.mailbox_id AND m.date >= v_{k}.date" for k in _AS_OF) + """),
as_of AS (
SELECT * EXCLUDE (v_active, v_days, v_release_time_str, v_newsletter_email, v_limit_newest),
       coalesce(TRY_CAST(v_active AS BOOLEAN), true) AS active,
       coalesce(TRY_CAST(json_transform(v_days, '["VARCHAR"]') AS VARCHAR[]), CAST([] AS VARCHAR[])) AS days,
       coalesce(v_release_time_str, '') AS release_time_str, coalesce(v_newsletter_email, '') AS newsletter_email,
       coalesce(TRY_CAST(v_limit_newest AS INTEGER), 10) AS limit_newest FROM valid)"""

SQL["setup_as_of"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED, FOLDED, AS_OF) + """
SELECT mailbox_id, message_id, active, array_to_string(days, ',') AS days_str, release_time_str, newsletter_email, limit_newest FROM as_of"""

SQL["assign_issue_as_of"] = with_views(MESSAGES_V, WHITELIST_V, ROUTED, FOLDED, AS_OF) + f"""
SELECT mailbox_id, message_id, release_ts FROM (
  SELECT *, {next_release('date', 'days', 'release_time_str', 'active')} AS release_ts FROM as_of)
WHERE release_ts IS NOT NULL AND CAST(date AS DATE) >= CAST(release_ts AS DATE) - 7 AND CAST(date AS DATE) <= CAST(release_ts AS DATE)"""


# -- issues that a stream with a watermark a day behind the newest mail has closed -----------------------------------------
_CARRIED, _PICKS = SQL["issue_carry_over"].rsplit("SELECT mailbox_id, r AS release_ts", 1)
SQL["issue_documents"] = _CARRIED.rstrip() + """, picks AS (
SELECT mailbox_id, r AS release_ts""" + _PICKS + """)
SELECT p.mailbox_id, release_ts, count(*) AS n_messages, least(any_value(limit_newest), 100) AS limit_newest,
       string_agg(message_id, ',' ORDER BY msg_rank) AS message_ids
FROM picks p JOIN setup s ON s.mailbox_id = p.mailbox_id
WHERE release_ts <= (SELECT max(r.date) FROM routed2 r WHERE list_contains(r.labels, 'INBOX') AND NOT list_contains(r.labels, 'ANALYZED')
                     AND r.route NOT IN ('config', 'repost')) - INTERVAL 1 DAY
GROUP BY p.mailbox_id, release_ts"""

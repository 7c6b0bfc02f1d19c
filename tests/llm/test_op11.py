"""Mixing to target weights: against the SQL of its definition, and odd tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm.op11_source_mixing import mix, quotas
from quire.llm.oracle import OP11

ROWS = ([(i, "a", "w " * (i % 40)) for i in range(150)] + [(200 + i, "b", "one two") for i in range(9)]
        + [(300, None, "x y z " * 30), (301, None, None), (302, "B", ""), (303, "B", None), (304, "ü", "word"), (305, "ü", " "),
           (5, "a", "w " * 5), (5, "a", "w " * 5), (None, "b", "no id here")])


def sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in rows])
    return sorted(con.execute(OP11).fetchall(), key=str)


def made(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return sorted((tuple(r) for r in mix(df.withColumns({c: F.lit("x") for c in more.pop("extra", [])}), **more).collect()), key=str)


def test_matches_its_definition(spark):
    got = made(spark, ROWS, extra=["size", "h", "place", "shard", "quota", "taken", "start", "target"])
    assert got == sql(ROWS)
    assert all(t <= 2 * n for _, n, _, _, t in got)


@pytest.mark.parametrize("rows", [[], [(1, "a", None)], [(1, "a", "one"), (1, "a", "one")], [(1, None, "one two three")]])
def test_small_tables(spark, rows):
    assert made(spark, rows) == sql(rows)


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    one = sorted((tuple(r) for r in mix(df.repartition(3)).collect()), key=str)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert sorted((tuple(r) for r in mix(df.coalesce(1)).collect()), key=str) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_documents_over_many_shards_come_near_the_target(spark):
    rows = [(i, "a" if i % 3 else "b", "w " * (7 * i)) for i in range(60)]
    got = made(spark, rows, block=8, shard=4)
    source = {i: s for i, s, _ in rows}
    for s in "ab":
        mine = [r for r in got if source[r[0]] == s]
        assert abs(sum(r[4] for r in mine) - mine[0][3]) <= 24
        assert all(r[4] <= 2 * r[1] for r in mine)


def test_quotas_are_the_highest_quotients(spark):
    votes = [5.0, 3.0, 3.0, 0.0, 10.5, 1.0, 40.0]
    for seats in (0, 1, 2, 5, 17, 60):
        cells = spark.createDataFrame([(0, i, v, 40, seats, sum(votes), 6) for i, v in enumerate(votes)],
                                      "g int, i int, votes double, cap long, seats long, all_votes double, contenders long")
        got = {r.i: r.quota for r in quotas(cells, by=["g"], keys=["i"], order=["i"]).collect()}
        best = sorted((-v / (2 * k + 1), i, k) for i, v in enumerate(votes) for k in range(40) if v > 0)[:seats]
        assert got == {i: sum(1 for b in best if b[1] == i) for i in range(len(votes))}

"""Capture queries against their SQL on users beyond the 16 bits of a port and the 24 of a client address."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from netquill.plans import queries as plans

from .test_queries import plain

TYPES = ["view", "click", "signup", "purchase", "error"]


def events(r):
    rows = []
    for user in (3, 64_511, 64_512, 66_322, 70_002, 88_440, 1 << 24):
        rows += [(len(rows) + i, user, r.choice(TYPES), r.uniform(0, 400)) for i in range(12)]
    return rows


def against_sql(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    df = df.withColumn("ts", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("event_id") * 61_000_001)).withColumn("props", F.lit('{"k": 1}'))
    df.write.parquet(f"{folder}/events.parquet")
    got = plans.QUERIES[name](spark, str(folder))
    duck = duckdb.connect()
    duck.execute("SET timezone = 'UTC'")
    duck.execute(f"CREATE VIEW events AS SELECT event_id, user_id, event_type, value, ts::TIMESTAMP AS ts, props FROM '{folder}/events.parquet/*.parquet'")
    want = duck.execute(plans.ORACLE_SQL[name])
    cols = sorted(got.columns)
    at = [d[0] for d in want.description]
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["packet_decode", "packet_tls", "packet_tls_ipv6", "captures_by_label", "capture_ranges_read", "temporal_flows"])
def test_users_beyond_a_port(spark, tmp_path, name):
    against_sql(spark, tmp_path, name, events(random.Random(7)))


def test_deviation_is_that_of_the_lengths(spark, tmp_path):
    """The root of a variance of four digits rounds to another third digit here."""
    r = random.Random(10_707)
    against_sql(spark, tmp_path, "temporal_flows", [(i, 4, "click", r.randrange(54, 500) - 54 + 0.5) for i in range(30)])


@pytest.mark.parametrize("name", ["temporal_flows", "feature_flows", "flow_rows"])
def test_users_of_one_tuple_are_one_flow(spark, tmp_path, name):
    """Users that differ by 63 * 2**24 have the same address, port and server; 2 and the one five such steps on also name certificates."""
    step, r = 63 << 24, random.Random(11)
    users = [4, 4 + step, 2, 2 + 5 * step]
    against_sql(spark, tmp_path, name, [(i, users[i % 4], r.choice(TYPES), r.uniform(0, 400)) for i in range(80)])

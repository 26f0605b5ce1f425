"""Every query with an SQL equivalent, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from waymill.plans import oracles, queries  # noqa: F401
from waymill.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(rows):
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = got.select(*(f"`{n}`" for n in names)).collect()
    assert plain(rows) == plain(want.project(", ".join(f'"{n}"' for n in names)).fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["hmm_matched", "hmm_viterbi", "hmm_sd_matched"])
def test_ways_of_one_length(spark, name, tmp_path):
    """Points on the roads' vertices and crossings lie on several segments at once, so ways of one length differ by the last bit alone."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i event_id, (i * 48271 % 12 * 50)::DOUBLE AS value FROM range(3000) a(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    names = sorted(got.columns)
    rows = got.select(*(f"`{n}`" for n in names)).collect()
    assert plain(rows) == plain(want.project(", ".join(f'"{n}"' for n in names)).fetchall())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no larger tables here")
def test_best_path_where_six_copies_of_the_events_differed(spark, tmp_path):
    """The two trajectories of events 6 times sf0.1 in which paths of one cost were told apart unlike in SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT event_id + copy * 100000 AS event_id, value FROM '/root/testdata/sf0.1/events.parquet', range(6) c(copy) WHERE (event_id + copy * 100000) // 500 IN (695, 1120)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    got, want = QUERIES["hmm_viterbi"](spark, str(tmp_path)), con.sql(ORACLES["hmm_viterbi"])
    names = sorted(got.columns)
    rows = got.select(*(f"`{n}`" for n in names)).collect()
    assert len(rows) == 966
    assert plain(rows) == plain(want.project(", ".join(f'"{n}"' for n in names)).fetchall())

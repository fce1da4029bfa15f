"""Flow means of exactly a threshold fall where the SQL has them, since both add them up in the order of the events."""

import duckdb

from hazeline.plans import catalog


def test_ids_against_time(spark, tmp_path):
    """A frame's two detections are added by time, and their ids descend. Both means are 0.55, and in order of ids each verdict is the other."""
    ks = [[17, 83, 5, 66, 74, 85], [83, 23, 99, 94, 18, 13]]
    rows = [(100 - 10 * u - i, i, u, k, 90 - 10 * i) for u, seq in enumerate(ks) for i, k in enumerate(seq)]
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE r (event_id BIGINT, nth INT, user_id BIGINT, k INT, value DOUBLE)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?, ?)", rows)
    con.execute("CREATE TABLE events AS SELECT event_id, TIMESTAMP '2024-01-01' + to_minutes(nth) AS ts, user_id, 'error' AS event_type, value, '{\"k\": ' || k || '}' AS props FROM r")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(f"SELECT seq_id, flow_upward_ratio, tier FROM ({catalog.oracle_sql()['dense_tracks']}) ORDER BY seq_id").fetchall()
    got = catalog.queries()["dense_tracks"](spark, str(tmp_path)).orderBy("seq_id").select("seq_id", "flow_upward_ratio", "tier").collect()
    assert [tuple(r) for r in got] == want == [(0, 0.55, "GLOW"), (1, 0.55, "SPARK")]

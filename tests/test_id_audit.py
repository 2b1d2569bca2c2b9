"""The audit of ids made of times without zone."""

import duckdb

from weftline.plans import queries


def test_ids_do_not_follow_the_zone_of_the_session(spark, tmp_path):
    """Before, a session in London had other minutes for events of the summer, and one id for an hour's events that its clock skips."""
    spark.sql("select id as event_id, cast(timestamp_ntz'2024-03-31 00:30:00' + make_interval(0, 0, 0, 0, 0, id) as timestamp_ntz) as ts, id % 3 as user_id from range(200)").write.parquet(f"{tmp_path}/events.parquet")
    found = {}
    for zone in ("UTC", "Europe/London"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found[zone] = sorted(tuple(r) for r in queries.QUERIES["sca3_id_audit"](spark, str(tmp_path)).collect())
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(found["UTC"]) == 200 and found["UTC"] == found["Europe/London"]


def test_times_round_to_the_nearest_millisecond(spark, tmp_path):
    """Before, part of a millisecond was cut off, and an event of a minute's last half millisecond had another minute than in SQL."""
    times = ("2024-01-05 00:00:59.9996", "2024-01-05 00:00:59.9995", "2024-01-05 00:00:59.999499", "2024-02-29 23:59:59.9999", "2024-02-29 12:00:00.0005", "1969-12-31 23:59:59.9995", "1969-12-31 23:59:59.9996")
    for kind in ("timestamp_ntz", "timestamp"):
        rows = " union all ".join(f"select {i}L as event_id, cast('{t}' as {kind}) as ts, {i % 3}L as user_id" for i, t in enumerate(times))
        spark.sql(rows).write.option("compression", "zstd").parquet(f"{tmp_path}/{kind}/events.parquet")
        found = queries.QUERIES["sca3_id_audit"](spark, f"{tmp_path}/{kind}")
        connection = duckdb.connect()
        connection.sql(f"create view events as select * from '{tmp_path}/{kind}/events.parquet/*.parquet'")
        want = connection.sql(queries.ORACLE["sca3_id_audit"])
        assert found.columns == want.columns
        assert sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())

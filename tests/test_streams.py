"""Tests of the change-log source and of candidates that wait for decisions."""

import json

import pytest

from weftline.sources import change_log, tables
from weftline.streaming import decisions, jobs


@pytest.fixture
def few_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def entry(event, table="outbox", op="INSERT", rows=1, **more):
    names = ["Event_Id", "payload", "status", "retry_count", "event_type"]
    held = [{"names": names, "values": [str(event + k), "p ü", 0, "0", None if event % 7 == 0 else "Order"]} for k in range(rows)]
    return json.dumps({"type": "ROWDATA", "table": table, "op": op, "ts": 1700000000000 + event, "rows": held} | more, ensure_ascii=False) + "\n"


MARKS = '{"type": "TRANSACTIONBEGIN"}\n', '{"type": "TRANSACTIONEND"}\n'


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_change_log_goes_on_where_it_stopped(spark, tmp_path, piece):
    """Lines cut by pieces, a line written in two parts, a new segment, entries of other kinds, and lines that are none."""
    log = tmp_path / "log"
    log.mkdir()
    (log / "_notes").write_text("not a segment\n")

    def run():
        out = jobs.run_to_files(change_log.change_log(spark, str(log), piece), f"{tmp_path}/out", f"{tmp_path}/check")
        return out

    assert run().count() == 0
    torn = entry(5)
    (log / "000").write_text(MARKS[0] + entry(1, rows=2) + entry(3, op="UPDATE") + MARKS[1] + "\n" + "no entry\n" + '["list"]\n' + torn[:20])
    first = run()
    assert sorted(r["values"][0] for r in first.where("corrupt is null").collect()) == ["1", "2", "3"]
    assert sorted(r["corrupt"] for r in first.where("corrupt is not null").collect()) == ['["list"]', "no entry"]
    assert run().count() == 5
    with (log / "000").open("a") as file:
        file.write(torn[20:] + entry(6, table="Outbox", is_ddl=True))
    (log / "001").write_text(MARKS[0] + entry(7) + entry(8, table="posts") + MARKS[1] + '{"type": "ROWDATA", "table": "outbox", "op": "INSERT"}\n')
    second = run()
    assert sorted(r["values"][0] for r in second.where("corrupt is null").collect()) == ["1", "2", "3", "5", "6", "7", "8"]
    assert run().count() == 9
    typed = {r["event_id"]: (r["payload"], r["status"], r["err"]) for r in tables.to_outbox(tables.outbox_inserts(second)).collect()}
    assert typed == {1: ("p ü", 0, None), 2: ("p ü", 0, None), 5: ("p ü", 0, None), 7: ("p ü", 0, "MISSING_EVENT_TYPE")}
    stamps = second.where("corrupt is null").selectExpr("unix_millis(ts) - 1700000000000 as at").distinct().collect()
    assert sorted(r["at"] for r in stamps) == [1, 3, 5, 6, 7, 8]


def test_change_log_of_a_lost_segment_is_an_error(tmp_path):
    reader = change_log.ChangeLogReader(str(tmp_path), 100)
    (tmp_path / "b").write_text(entry(1))
    assert reader.latestOffset() == {"segment": "b", "at": len(entry(1).encode())}
    with pytest.raises(ValueError, match="gone"):
        reader.partitions({"segment": "a", "at": 3}, reader.latestOffset())


def test_change_log_has_few_pieces_however_long(tmp_path, monkeypatch):
    """Small pieces grow with the log; each line is read by one of them, and little beyond a piece's end is."""
    for k in range(3):
        (tmp_path / f"{k}").write_text("".join(MARKS[0] + entry(100 * k + n) + MARKS[1] for n in range(100)))
    reader = change_log.ChangeLogReader(str(tmp_path), 7)
    monkeypatch.setattr(change_log, "PIECES", 8)
    monkeypatch.setattr(change_log, "REST", 16)
    pieces = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert 8 <= len(pieces) <= 8 + 3
    rows = [r for p in pieces for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted(int(r["values"][0]) for r in rows) == list(range(300))
    monkeypatch.setattr(change_log, "PIECE", 64)
    assert max(p.end - p.start for p in reader.partitions(reader.initialOffset(), reader.latestOffset())) == 64


def test_candidates_meet_decisions_or_time_out(spark, tmp_path, few_parts):
    """Decided, undecided, decided too late or before, by no known action, without a target, twice, and for another user."""
    at = lambda day, minute: f"2024-01-0{day} 00:{minute:02}:00"
    cands = "ts timestamp, user_id long, seq long, memory_key string, content string, target_id long"
    said = "said_at timestamp, user_id long, seq long, action string, merged string"
    batches = [
        ([(at(1, 5), 1, n, "topics", f"c{n}", None if n == 4 else 100 + n) for n in range(1, 10)],
         [(at(1, 6), 1, 1, "UPDATE", "m1"), (at(1, 6), 1, 2, "INSERT", None), (at(1, 7), 1, 4, "UPDATE", "m4"), (at(1, 6), 1, 5, "MERGE", "m5"), (at(1, 4), 1, 6, "UPDATE", "m6"),
          (at(1, 6), 1, 7, "UPDATE", None), (at(1, 6), 1, 7, "UPDATE", None), (at(1, 6), 2, 8, "UPDATE", "m8"), (at(1, 40), 1, 9, "UPDATE", "m9")]),
        ([(at(2, 0), 3, 1, "topics", "d1", 7)], [(at(2, 1), 3, 1, "UPDATE", "n1")]),
    ]
    for mine, theirs in batches:
        spark.createDataFrame([(a, *r) for a, *r in mine], cands.replace("timestamp", "string")).selectExpr("cast(ts as timestamp) as ts", "* except (ts)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/c")
        spark.createDataFrame(theirs, said.replace("timestamp", "string")).selectExpr("cast(said_at as timestamp) as said_at", "* except (said_at)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
        streams = [spark.readStream.schema(s).parquet(f"{tmp_path}/{name}") for s, name in ((cands, "c"), (said, "d"))]
        out = jobs.run_to_files(decisions.decided_candidates(*streams, wait="10 minutes"), f"{tmp_path}/out", f"{tmp_path}/check")
    found = sorted((r["user_id"], r["seq"], r["action"], r["target_id"], r["content"]) for r in out.collect())
    assert found == [
        (1, 1, "UPDATE", 101, "m1"), (1, 2, "INSERT", None, "c2"), (1, 3, "INSERT", None, "c3"), (1, 4, "INSERT", None, "m4"), (1, 5, "INSERT", None, "c5"),
        (1, 6, "INSERT", None, "c6"), (1, 7, "UPDATE", 107, "c7"), (1, 8, "INSERT", None, "c8"), (1, 9, "INSERT", None, "c9"), (3, 1, "UPDATE", 7, "n1"),
    ]

"""Waiting for jobs that try messages again, and slots of very many messages."""

import pandas as pd
import pytest
from test_state import Handle

from weftline.streaming import retries


class Job:
    """Stands for a job whose batches end at the times given, with the rows that they took and the messages settled by then."""

    def __init__(self, monkeypatch, batches):
        self.now, self.batches, self.stopped = 0.0, batches, False
        monkeypatch.setattr(retries.time, "monotonic", lambda: self.now)
        monkeypatch.setattr(retries.time, "sleep", self.sleep)
        monkeypatch.setattr(retries, "settled", lambda spark, path, name: self)
        self.status = {"isTriggerActive": True}

    def sleep(self, _):
        self.now += 5

    @property
    def ended(self):
        return [b for b in self.batches if b[0] <= self.now]

    @property
    def lastProgress(self):
        return {"batchId": len(self.ended) - 1, "numInputRows": self.ended[-1][1]} if self.ended else None

    def count(self):
        return self.ended[-1][2] / 2  # as many are good as are dead

    def exception(self):
        return None

    def stop(self):
        self.stopped = True


def test_a_long_job_is_not_an_error(monkeypatch):
    """Before, a job that took more than ten minutes in all was an error, though each of its batches settled messages."""
    job = Job(monkeypatch, [(400, 50, 10), (1300, 50, 20), (1310, 0, 20), (1700, 30, 60), (2500, 0, 100)])
    retries.wait_until_settled(None, job, "", 100)
    assert job.stopped and job.now >= 2500


def test_a_job_that_settles_nothing_is_an_error(monkeypatch):
    job = Job(monkeypatch, [(100, 50, 10), *((200 + 10 * i, 0, 10) for i in range(500))])
    with pytest.raises(TimeoutError):
        retries.wait_until_settled(None, job, "", 100)
    assert job.stopped and 700 < job.now < 800


def test_a_slot_of_many_messages_is_taken_in_parts(monkeypatch):
    """Before, a task held all the ids and all the waiting messages of its slot's batch."""

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 5000

        def getExpiryTimeInMs(self):
            return 7000

    monkeypatch.setattr(retries, "MOST", 10)
    handle, due, most = Handle(), retries.DueRows(10**6), 0
    handle.registerTimer = lambda at: None
    due.init(handle)
    parts = [pd.DataFrame({"id": range(k, k + 1000), "attempt": 1, "due": 6500, "payload": "{}"}) for k in range(0, 20_000, 1000)]
    for out in due.handleInputRows((0,), iter(parts), Clock()):
        most = max(most, len(due.taken.read))
        assert not len(out)
    assert most <= 10
    assert not sum(map(len, due.handleInputRows((0,), iter(parts), Clock()))) and due.taken.entries == 20_000
    assert sorted(i for out in due.handleExpiredTimer((0,), None, Clock()) for i in out["id"]) == list(range(20_000))

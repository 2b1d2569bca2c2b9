"""State in buckets, against a dictionary, with the calls that it costs."""

import random

import pytest

from weftline.streaming import jobs, state


class Handle:
    """Stands for a key's state store, and counts what is asked of it."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    def _variable(self, name):
        handle, kept = self, self.kept.setdefault(name, {})

        class Variable:
            def __getattr__(self, call):
                def run(*args):
                    handle.calls += 1
                    key = args[0] if args and call != "update" else ()
                    if call in ("update", "updateValue"):
                        kept[key] = args[-1]
                    elif call == "removeKey":
                        del kept[key]
                    else:
                        return key in kept if call == "exists" else kept.get(key)

                return run

        return Variable()

    def getValueState(self, name, schema):
        return self._variable(name)

    def getMapState(self, name, key, value, ttlDurationMs=None):
        return self._variable(name)


@pytest.mark.parametrize("size", [1, 40, 3000])
def test_buckets_equal_a_dictionary(size):
    rng, handle, want = random.Random(size), Handle(), {}
    buckets = state.Buckets(handle, "b", "x long, y long", "v long, s string")
    for batch in range(12):
        buckets.open()
        for _ in range(size):
            key = (rng.randrange(4 * size), rng.randrange(-2, 3))
            assert buckets.get(*key) == want.get(key)
            if rng.random() < 0.7:
                want[key] = (batch, f"s{rng.randrange(9)}")
                buckets.put(key, want[key])
        buckets.close()
    buckets.open()
    assert all(buckets.get(*k) == v for k, v in want.items())
    assert buckets.entries == len(want)
    rows = [len(v[0]) for v in handle.kept["b"].values()]
    assert sum(rows) == len(want) and max(rows) < 8 * state.FULL


def test_old_entries_of_buckets_are_gone():
    buckets = state.Buckets(Handle(), "b", "x long", "at long", ttl=10)
    buckets.open(0)
    buckets.put((1,), (0,))
    buckets.close()
    buckets.open(9)
    assert buckets.get(1) == (0,)
    buckets.open(10)
    assert buckets.get(1) is None
    buckets.put((2,), (10,))
    buckets.close()
    assert buckets.entries == 1


def test_a_batch_of_orders_needs_few_calls():
    """Each order id had a call or two of its own before."""
    import pandas as pd

    handle, registry, n = Handle(), jobs.OrderRegistry(), 20_000
    registry.init(handle)
    for batch in range(3):
        ids = range(batch, 3 * n, 3)
        pdf = pd.DataFrame({"slot": 0, "arrival": ids, "kind": "REQUEST", "order_id": ids, "sku_id": 1, "user_id": 2, "held_sku": -1, "held_user": -1})
        (out,) = registry.handleInputRows((0,), iter([pdf]), None)
        assert out["owner"].all()
    assert handle.calls < 3 * n / 10


def test_a_queue_gives_the_rows_of_a_time_once():
    handle = Handle()
    queue = state.Queue(handle, "q", "id long, due long")
    queue.put(1000, [(i, 900) for i in range(2500)])
    queue.put(2000, [(1, 1500)])
    queue.put(1000, [(9999, 950)])
    assert [r for part in queue.take(1000) for r in part] == [*((i, 900) for i in range(2500)), (9999, 950)]
    assert not list(queue.take(1000))
    assert [r for part in queue.take(2000) for r in part] == [(1, 1500)] and not any(handle.kept[k] for k in ("q", "q_parts"))


def test_a_batch_of_messages_to_retry_needs_few_calls():
    """Each message had calls of its own before, and a timer read all that waited in its slot."""
    import pandas as pd

    from weftline.streaming import retries

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 5000

        def getExpiryTimeInMs(self):
            return 7000

    handle, due, n, timers = Handle(), retries.DueRows(10**6), 20_000, set()
    handle.registerTimer = timers.add
    due.init(handle)
    pdf = pd.DataFrame({"id": range(n), "attempt": 1, "due": [6500 if i % 2 else 8500 for i in range(n)], "payload": "{}"})
    assert sum(map(len, due.handleInputRows((0,), iter([pdf]), Clock()))) == 0 and timers == {7000, 9000}
    assert sum(map(len, due.handleInputRows((0,), iter([pdf]), Clock()))) == 0  # said again
    found = [i for out in due.handleExpiredTimer((0,), None, Clock()) for i in out["id"]]
    assert sorted(found) == list(range(1, n, 2)) and handle.calls < n / 10


def test_a_batch_of_counter_events_needs_few_calls():
    """Each event had two calls of its own before."""
    import pandas as pd

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 5000

    handle, seen, n = Handle(), jobs.SeenEvents(10**6), 20_000
    seen.init(handle)
    pdf = pd.DataFrame({"slot": 0, "sid": 1, "event_id": range(n), "idx": 2, "delta": 1})
    assert [sum(map(len, seen.handleInputRows((0,), iter([pdf]), Clock()))) for _ in range(2)] == [n, 0]
    assert handle.calls < n / 10


def test_a_bucket_is_small():
    """Before, an entry was a struct of its own, of which a store wrote about 19 bytes each time."""
    handle = Handle()
    buckets = state.Buckets(handle, "b", "order_id long", "status string, keep boolean, result string")
    buckets.open()
    for i in range(3000):
        buckets.put((i * 7_000_003,), ("CANCELLED", i % 3 > 0, "APPLIED" if i % 2 else "BUYER_ORDER_LOST"))
    buckets.close()
    assert sum(len(rest) for _, rest in handle.kept["b"].values()) < 3 * 3000

"""Streams over tables as they come: one file, or a folder of part files."""

from scholarch.plans import QUERIES


def test_progress_of_a_table_in_part_files(spark, tmp_path):
    talk = spark.range(0, 200).selectExpr("id AS conv_id", "CAST(0 AS INT) AS turn", "IF(id % 3 = 0, 'system', 'user') AS role", "'x' AS text")
    talk.repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = QUERIES["stream_progress"](spark, str(tmp_path)).collect()
    assert len(rows) == 20
    assert sum(r.total_pages for r in rows) == 200 and sum(r.failed_pages for r in rows) == 67


class _Store:
    """A store of one operation that counts its messages."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):
        return self

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "update":
                self.value = args[0]
            elif name == "clear":
                self.value = None
            elif name == "exists":
                return self.value is not None
            elif name == "get":
                return self.value
            elif name == "registerTimer":
                self.timers.add(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])
            elif name == "listTimers":
                return list(self.timers)

        return call


def test_tracker_sends_no_needless_messages():
    import pandas as pd

    from scholarch.streaming import jobs as J

    def event(n, status, day):
        return [7, n, status, "extracting", 3, n, 0, pd.Timestamp(2024, 1, day)]

    store, tracker = _Store(), J.OperationTracker()
    tracker.init(store)

    def feed(*events):
        store.calls.clear()
        return [r for d in tracker.handleInputRows((7,), iter([pd.DataFrame([e], columns=J.OPERATION.names) for e in events]), None) for r in d.values.tolist()]

    assert [r[1] for r in feed(event(2, "processing", 2), event(1, "processing", 1))] == [1, 2]  # the first ran out before the second came
    assert store.calls == ["get", "update", "registerTimer"] and len(store.timers) == 1
    assert [r[2:4] for r in feed(event(3, "cancelled", 2))] == [["cancelled", "extracting"]]
    assert store.calls == ["get", "deleteTimer", "update", "registerTimer"] and len(store.timers) == 1
    assert feed(event(4, "processing", 3)) == [] and store.calls == ["get"]
    assert [r[1] for r in feed(event(5, "completed", 20))] == [5]
    assert store.calls == ["get", "deleteTimer", "clear"] and store.timers == set() and store.value is None
    assert [r[1] for r in feed(event(6, "failed", 21))] == [6] and store.calls == ["get"]

"""The queue's steps against a plain queue in memory; restarts; what a step reads."""

import random
from datetime import datetime, timedelta

from bidloom.sources.committed import CommittedTable
from bidloom.streaming import queue as q

NOW = datetime(2026, 8, 5, 9, 0)


class Plain:
    """Priorities and leases by name; the greatest (priority, name) goes first."""

    def __init__(self, ttl, default):
        self.jobs, self.leases, self.ttl, self.default = {}, {}, ttl, default

    def step(self, events, n, now):
        finished = {e[1] for e in events if e[0] == "finish"}
        for key in finished:
            self.leases.pop(key, None)
        new = {}
        for _, key, priority, _, _ in sorted((e for e in events if e[0] == "enqueue"), key=lambda e: e[3:]):
            new[key] = self.default if priority is None else priority
        for key, (at, priority) in list(self.leases.items()):
            if at <= now - timedelta(seconds=self.ttl):
                self.jobs[key] = priority
                del self.leases[key]
        self.jobs |= new
        out = sorted(self.jobs, key=lambda k: (self.jobs[k], f"proc:{k}"), reverse=True)[:n]
        for key in out:
            self.leases[key] = now, self.jobs[key]
        return [(key, self.jobs.pop(key)) for key in out]


def test_steps_equal_a_plain_queue(spark, tmp_path):
    queue, plain, rng = q.open_queue(spark, f"file://{tmp_path}/q", 8), Plain(60, 7.0), random.Random(5)
    claimed, now = [], NOW
    for batch in range(6):
        now += timedelta(seconds=rng.choice([20, 70]))
        events = [("enqueue", rng.randint(1, 30), rng.choice([None, 1.0, 2.0, 2.0, 5.5]), now - timedelta(seconds=rng.randint(1, 9)), s) for s in range(rng.randint(0, 12))]
        events += [("finish", rng.choice(claimed), None, now, 99) for _ in range(2) if claimed] + [("finish", 999, None, now, 100), ("other", 1, None, now, 101)]
        want = plain.step(events, 4, now)
        out = q.step(queue, spark.createDataFrame(events, q.EVENTS), batch, 4, 60, 7.0, now)
        assert [tuple(r) for r in out.collect()] == want
        state = {r["procurement_id"]: r for r in queue.read().collect()}
        assert {k: r["priority"] for k, r in state.items() if r["priority"] is not None} == plain.jobs
        assert {k: (r["claimed_at"], r["claimed_priority"]) for k, r in state.items() if r["claimed_at"]} == plain.leases
        version = queue.commit().version
        again = q.step(queue, spark.createDataFrame(events, q.EVENTS), batch, 4, 60, 7.0, now)
        assert [tuple(r) for r in again.collect()] == want and queue.commit().version == version
        queue.compact(1)
        assert [tuple(r) for r in q.claim(queue, 4, now, batch).collect()] == want
        claimed += [k for k, _ in want]


def test_heads_are_few(spark, tmp_path):
    queue = q.open_queue(spark, f"file://{tmp_path}/q", 32)
    events = [("enqueue", k, float(k % 97), NOW, k) for k in range(500)]
    out = q.step(queue, spark.createDataFrame(events, q.EVENTS), 0, 3, 60, 0.0, NOW)
    assert [tuple(r) for r in out.collect()] == [(96, 96.0), (484, 96.0), (387, 96.0)]
    assert len(queue.commit().touched) <= 3 and len(q.heads(queue, 2)) < 32
    later = q.step(queue, spark.createDataFrame([], q.EVENTS), 1, 0, 60, 0.0, NOW + timedelta(seconds=61))
    assert later.count() == 0 and queue.read().where("claimed_at is not null").count() == 0 and queue.read().where("priority is not null").count() == 500


def test_restart_repeats_nothing(spark, tmp_path):
    base = f"file://{tmp_path}"
    queue, handed = q.open_queue(spark, f"{base}/q", 4), []

    def fail(claims, batch):
        handed.append((batch, [tuple(r) for r in claims.collect()]))
        if batch == 1 and len(handed) == 2:
            raise RuntimeError("lost")

    for k in range(3):
        spark.createDataFrame([("enqueue", 10 * k + j, float(j), NOW + timedelta(seconds=k), j) for j in range(4)], q.EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/in")
    read = lambda: spark.readStream.schema(q.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    try:
        q.run_queue(read(), queue, f"{base}/cp", fail, n=2).awaitTermination()
        raise AssertionError("must fail")
    except Exception as e:
        assert "lost" in str(e)
    q.run_queue(read(), CommittedTable(spark, f"{base}/q"), f"{base}/cp", fail, n=2, compact_files=1).awaitTermination()
    assert [b for b, _ in handed] == [0, 1, 1, 2] and handed[1] == handed[2]
    assert handed[0][1] == [(3, 3.0), (2, 2.0)] and handed[2][1] == [(13, 3.0), (12, 2.0)] and handed[3][1] == [(23, 3.0), (22, 2.0)]
    assert queue.read().where("priority is not null").count() == 6

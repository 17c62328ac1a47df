"""The review state machine over late, repeated and illegal events."""

import datetime
import random

from pyspark.sql import Row

from terraspan.streaming import reviews

SCHEMA = "candidate_id long, event_id string, ts timestamp, seq long, action string"
START = datetime.datetime(2024, 5, 1)


def plain(events):
    out, state, seen = [], {}, set()
    for c, e, ts, seq, action in sorted((x for x in events if None not in x[:3]), key=lambda x: (x[2], x[3], x[1])):
        if (c, e, ts) in seen:
            continue
        seen.add((c, e, ts))
        status, step = state.get(c, (None, 0))
        if action not in ("ENQUEUED", "ARCHIVED", "CONFIRMED", "REJECTED", "UNCERTAIN"):
            reason = "UNKNOWN_ACTION"
        elif action == "ENQUEUED":
            reason = "ALREADY_QUEUED" if status else None
        else:
            reason = "NOT_FOUND" if status is None else "ARCHIVED" if status == "ARCHIVED" else None
        to = status if reason else action
        state[c] = to, step + (reason is None)
        out.append((c, e, ts, seq, action, status, to, reason is None, reason, step + (reason is None)))
    return sorted(out, key=repr)


def events(seed):
    rng = random.Random(seed)
    for k in range(240):
        action = rng.choice(["ENQUEUED", "CONFIRMED", "REJECTED", "UNCERTAIN", "UNCERTAIN", "NOTE", None, *["ARCHIVED"] * (k % 3 == 0)])
        yield rng.randrange(9), f"e{k}", START + datetime.timedelta(minutes=k // 2), k, action


def test_log(spark):
    rows = list(events(1)) * 2 + [(None, "x", START, 0, "ENQUEUED"), (1, None, START, 0, "ENQUEUED"), (1, "x", None, 0, "ENQUEUED")]
    got = reviews.steps_of_log(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_stream(spark, tmp_path):
    """Four runs: events come shuffled within half an hour, repeated in the
    same and in later runs, and one far too late."""
    rng = random.Random(2)
    rows = list(events(2))
    shuffled = sorted(rows, key=lambda r: r[2] + datetime.timedelta(minutes=rng.randrange(30)))
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    runs = [shuffled[k : k + 60] for k in range(0, 240, 60)]
    runs[1] = runs[1] + runs[1][:20] + runs[0]  # replays
    runs[3] = runs[3] + runs[2] + [(3, "late", START, 0, "ARCHIVED"), (100, "tick", START + datetime.timedelta(days=2), 0, "ENQUEUED")]
    told = []
    for run in runs:
        spark.createDataFrame(run, SCHEMA).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(SCHEMA).parquet(log)
        reviews.keep_steps(stream, out, check).awaitTermination()
        told.append(spark.read.parquet(out).count())
    got = spark.read.schema(f"candidate_id long, {reviews.STEP}").parquet(out).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    assert told == sorted(told) and told[0] < 60  # what is above the watermark waits


def test_one_timer_waits(spark):
    """However many events wait, a candidate has one timer, its state is read
    once when that fires, and all that is due takes effect at once."""
    calls = []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Waiting:
        held = []

        def get(self):
            calls.append("read")
            return iter(self.held)

        def appendValue(self, value):
            self.held = [*self.held, value]

        def appendList(self, values):
            self.held = [*self.held, *values]

        def put(self, values):
            self.held = list(values)

        def clear(self):
            self.held = []

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getListState(self, *_):
            return Waiting()

        def registerTimer(self, ms):
            calls.append(ms)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    events = [Row(event_id=f"e{k}", ts=START + datetime.timedelta(seconds=k), seq=k, action="ENQUEUED" if k == 0 else "CONFIRMED", ms=1000 * k) for k in range(200)]
    review = reviews.Review()
    review.init(Handle())
    assert not list(review.handleInputRows((1,), iter(events[::-1]), At(0)))
    assert calls == ["read", 0]
    done = list(review.handleExpiredTimer((1,), At(150_000), At(0)))
    assert [r.event_id for r in done] == [f"e{k}" for k in range(151)] and done[-1].step == 151
    assert calls == ["read", 0, "read", 151_000]
    assert len(list(review.handleExpiredTimer((1,), At(500_000), At(151_000)))) == 49 and calls[-1] == "read"

"""Streaming flows against their batch forms, over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from assetloom.operators import decisions
from assetloom.streaming import flows


def _batches(spark, tmp_path, rows, schema, parts):
    """A stream that reads `rows` as `parts` files, one a micro-batch."""
    src = f"file://{tmp_path}/in"
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def _run(stream, mode, name, tmp_path):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()


def test_decision_stream_ends_at_the_batch_fold(spark, tmp_path):
    rng = random.Random(5)
    value = {"star": lambda: str(rng.randrange(6)), "label": lambda: rng.choice("PX"), "pick": lambda: rng.choice("PX"), "scene": lambda: rng.choice(["food", "city"])}
    rows = []
    for seq in range(90):
        kind = rng.choice(sorted(value))
        rows.append((seq, f"p{rng.randrange(7)}", kind, value[kind]()))
    rng.shuffle(rows)  # later files hold lower seqs too
    schema = "seq long, path string, kind string, value string"
    want = {r["path"]: (r["star"], r["label"], r["scene_manual"]) for r in decisions.fold(spark.createDataFrame(rows, schema)).collect()}
    # in update mode each micro-batch sends a path's state again; a path's states only ever gain fields or later values
    seen = []
    stream = flows.decision_stream(_batches(spark, tmp_path, rows, schema, 3))
    stream.writeStream.foreachBatch(lambda b, i: seen.extend((i, tuple(r)) for r in b.collect())).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert len({i for i, _ in seen}) >= 3
    got = {r[0]: r[1:] for _, r in sorted(seen, key=lambda x: x[0])}
    assert got == want


def test_undo_in_the_stream_ends_at_the_batch_fold(spark, tmp_path, rocksdb):
    """Undos before and after their decisions, of other paths, of unknown and repeated numbers, over several batches."""
    rng = random.Random(15)
    value = {"star": lambda: rng.choice(["0", "3", "5", "x", None]), "label": lambda: rng.choice(["P", "X", "", None]), "pick": lambda: rng.choice("PX"), "scene": lambda: rng.choice(["food", "city"])}
    rows = []
    for seq in range(70):
        kind = rng.choice(sorted(value))
        rows.append((seq, f"p{rng.randrange(9)}", kind, value[kind]()))
    rows += [(100 + i, rng.choice(["p1", "elsewhere", None]), "undo", str(rng.randrange(80))) for i in range(25)] + [(200, "p1", "undo", "no number"), (201, "p1", "undo", None), (202, "p2", "other", "x")]
    rows += [(300, "gone", "star", "4"), (301, "gone", "undo", "300")]
    rng.shuffle(rows)
    schema = "seq long, path string, kind string, value string"
    want = {r["path"]: (r["star"], r["label"], r["scene_manual"]) for r in decisions.fold(decisions.without_undone(spark.createDataFrame(rows, schema))).collect()}
    seen = []
    stream = flows.settled_decisions(_batches(spark, tmp_path, rows, schema, 4))
    stream.writeStream.foreachBatch(lambda b, i: seen.extend((i, tuple(r)) for r in b.collect())).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert len({i for i, _ in seen}) >= 3
    got = {r[0]: r[1:] for _, r in sorted(seen, key=lambda x: x[0])}
    assert {p: v for p, v in got.items() if p in want} == want
    assert {v for p, v in got.items() if p not in want} <= {(None, None, None)} and "gone" not in want


def test_online_bursts_equal_batch_sessions(spark, tmp_path):
    rng = random.Random(6)
    gap, at, rows = 1_500_000, 1_700_000_000_000_000, []
    for _ in range(120):
        at += rng.choice([200_000, 900_000, gap - 1, gap, gap + 1, 40_000_000])
        rows.append((at, rng.choice("ab")))
    end = (at + 3_600_000_000, "end")  # moves the watermark past all bursts
    schema = "us long, who string"
    events = _batches(spark, tmp_path, [*rows, *[end] * 2], schema, 4).select(F.timestamp_micros("us").alias("ts"), "who")
    _run(flows.online_bursts(events, gap, "1 minute", ["who"]), "append", "bursts", tmp_path)
    want = set()
    for who in "ab":
        times = sorted(t for t, w in rows if w == who)
        first = last = times[0]
        n = 1
        for t in [*times[1:], None]:
            if t is None or t - last >= gap:
                want.add((who, n, first, last))
                first, n = t, 0
            n, last = n + 1, t
    got = spark.table("bursts").select("who", "n", F.unix_micros("first"), F.unix_micros("last")).collect()
    assert {tuple(r) for r in got if r["who"] != "end"} == want and len(got) == len(set(map(tuple, got)))


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    flows.rocksdb_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_items_get_their_sessions_and_corrections(spark, tmp_path, rocksdb):
    """Late items, in any order within the delay, join bursts that were told apart; each item's last row is the batch's answer."""
    rng = random.Random(16)
    gap, rows, at = 1_500_000, [], 1_700_000_000_000_000
    for i in range(150):
        at += rng.choice([200_000, 900_000, gap - 1, gap, gap + 1, 4_000_000])
        rows.append((at, rng.choice("ab"), i))
    rows.sort(key=lambda r: r[0] + rng.randrange(20_000_000))  # out of order by up to 20 s
    schema = "us long, who string, id long"
    events = _batches(spark, tmp_path, rows, schema, 6).select(F.timestamp_micros("us").alias("ts"), "who", "id")
    seen = []
    stream = flows.item_sessions(events, gap, "40 seconds", "who", "id")
    stream.writeStream.foreachBatch(lambda b, n: seen.extend((n, r) for r in b.collect())).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = {}
    for who in "ab":
        first = last = None
        for t, _, i in sorted((r for r in rows if r[1] == who), key=lambda r: (r[0], r[2])):
            first = t if last is None or t - last >= gap else first
            last, want[i] = t, first
    assert {r["id"]: r["session_start"] for _, r in sorted(seen, key=lambda x: x[0])} == want
    assert sum(not r["correction"] for _, r in seen) == 150 and any(r["correction"] for _, r in seen)


def test_near_stored_equals_brute_force(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(40)]
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(63), n))
    stored = [(f"s{i:02}", fp) for i, fp in enumerate(base)] + [("s99", base[0]), ("null", None)]
    new = [(f"n{i:02}", flip(rng.choice(base), rng.randrange(15))) for i in range(60)] + [("nx", base[0]), ("nn", None)]
    schema = "path string, fp long"
    index = flows.band_index(spark.createDataFrame(stored, schema))
    assert index.count() == 4 * 40  # stored fingerprints are not widened
    got = flows.near_stored(spark.createDataFrame(new, schema), index, 12).collect()
    least = {}
    for p, fp in stored:
        if fp is not None:
            least[fp] = min(p, least.get(fp, p))
    want = {(n, p, (x ^ y).bit_count()) for n, x in new if x is not None for y, p in least.items() if (x ^ y).bit_count() < 12}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_kept_band_index_is_not_moved(spark, tmp_path):
    rng = random.Random(18)
    base = [rng.getrandbits(63) for _ in range(60)]
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(63), n))
    schema = "path string, fp long"
    stored = [(f"s{i:02}", fp) for i, fp in enumerate(base)] + [("a0", base[0]), ("null", None)]
    new = spark.createDataFrame([(f"n{i:02}", flip(rng.choice(base), rng.randrange(14))) for i in range(50)] + [("nn", None)], schema)
    index = flows.BandIndex(spark, f"file://{tmp_path}/bands", 4)
    index.add(spark.createDataFrame(stored[:30], schema), 1)
    index.add(spark.createDataFrame(stored[30:], schema), 2)
    index.add(spark.createDataFrame(stored[30:], schema), 2)  # a run that came again
    again = flows.BandIndex(spark, f"file://{tmp_path}/bands", 4)
    found = flows.near_stored(new, again.read(), most=0)
    want = flows.near_stored(new, flows.band_index(spark.createDataFrame(stored, schema)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(at#" in line]
    assert len(dealt) == 1 and "Bucketed: true" in plan, plan  # the batch's side alone
    assert again.read(1).select("stored").distinct().count() == 30


def test_decisions_share_state_by_ranges(spark, tmp_path, rocksdb):
    """Two thousand numbers, below zero and very large ones too, are a few states; undone across files and of other paths."""
    rng = random.Random(44)
    rows = [(seq, f"p{seq % 3}", rng.choice(["star", "pick"]), rng.choice("PX5")) for seq in [*range(-1000, 1000), 1 << 40, -(1 << 62)]]
    rows += [(5000 + i, "p0", "undo", str(rng.randrange(-1000, 1000))) for i in range(900)] + [(9000, None, "undo", str(1 << 40))]
    rng.shuffle(rows)
    schema = "seq long, path string, kind string, value string"
    log = spark.createDataFrame(rows, schema)
    want = {r["path"]: (r["star"], r["label"], r["scene_manual"]) for r in decisions.fold(decisions.without_undone(log)).collect()}
    seen = []
    query = flows.settled_decisions(_batches(spark, tmp_path, rows, schema, 3)).writeStream.foreachBatch(lambda b, i: seen.extend((i, tuple(r)) for r in b.collect())).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r[0]: r[1:] for _, r in sorted(seen, key=lambda x: x[0])} == want
    states = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
    assert sum(o["numRowsTotal"] for o in states[-1]) < 30


class _State:
    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return self.x

    def update(self, x):
        self.x = x

    def clear(self):
        self.x = None


def test_item_sessions_set_a_timer_only_when_it_changes():
    import pandas as pd

    calls = []

    class Handle:
        def getValueState(self, name, schema):
            return _State()

        def __getattr__(self, name):
            return lambda *a: calls.append((name, *a)) or []

    class Now:
        def getCurrentWatermarkInMs(self):
            return 0

    sessions = flows.ItemSessions(1_000_000, "id", "us")
    sessions.init(Handle())
    send = lambda us: pd.concat(list(sessions.handleInputRows(("k",), iter([pd.DataFrame({"id": range(len(us)), "us": us})]), Now())))
    assert send([5_000_000, 90_000_000])["session_start"].tolist() == [5_000_000, 90_000_000]
    assert calls == [("registerTimer", 6000)]
    send([90_500_000])
    assert calls == [("registerTimer", 6000)]  # the first that closes is the same
    out = send([5_900_000, 4_500_000])
    assert out["session_start"].tolist() == [4_500_000] * 3 and out["correction"].tolist() == [False, True, False]
    assert calls[1:] == [("deleteTimer", 6000), ("registerTimer", 6900)]


def test_keys_share_states_of_sessions(spark, tmp_path, rocksdb):
    """Three thousand keys, one of them null and one named None, have their own sessions in at most 1024 states."""
    rng = random.Random(45)
    gap, keys = 1_000_000, [None, "None", "", *map(str, range(3000))]
    rows = [(rng.randrange(4_000_000), k, 0) for k in keys for _ in range(2)] + [(rng.randrange(4_000_000), rng.choice(keys[:5]), 0) for _ in range(60)]
    rng.shuffle(rows)
    rows = [(us, k, i) for i, (us, k, _) in enumerate(rows)]
    events = _batches(spark, tmp_path, rows, "us long, who string, id long", 2).select(F.timestamp_micros("us").alias("ts"), "who", "id")
    seen = []
    query = flows.item_sessions(events, gap, "1 hour", "who", "id").writeStream.foreachBatch(lambda b, n: seen.extend((n, r) for r in b.collect())).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    want, first, last = {}, {}, {}
    for us, k, i in sorted(rows, key=lambda r: (r[0], r[2])):
        if k not in last or us - last[k] >= gap:
            first[k] = us
        last[k], want[i] = us, (k, first[k])
    assert {r["id"]: (r["key"], r["session_start"]) for _, r in sorted(seen, key=lambda x: x[0])} == want
    states = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
    assert sum(o["numRowsTotal"] for o in states[-1]) <= 1024


def test_a_shared_state_forgets_closed_sessions_of_each_key():
    import pandas as pd

    state, timers = _State(), []

    class Handle:
        def getValueState(self, name, schema):
            return state

        def registerTimer(self, ms):
            timers.append(ms)

        def deleteTimer(self, ms):
            timers.remove(ms)

    class Now:
        ms = 0

        def getCurrentWatermarkInMs(self):
            return self.ms

    now, sessions = Now(), flows.ItemSessions(1_000_000, "id", "us", "key")
    sessions.init(Handle())
    send = lambda rows: pd.concat(list(sessions.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["key", "us", "id"])]), now))).values.tolist()
    assert [r[0] for r in send([("a", 5_000_000, 1), (None, 5_000_000, 2), ("b", 9_000_000, 3), ("a", 9_500_000, 4)])] == ["a", "a", None, "b"]
    assert timers == [6000]
    now.ms = timers.pop()
    list(sessions.handleExpiredTimer((7,), now, None))
    keys, of, at, ids, first = sessions._kept()
    assert (keys, of.tolist(), at.tolist(), ids.tolist()) == (["a", "b"], [0, 1], [9_500_000, 9_000_000], [4, 3]) and timers == [10_000]
    assert send([("b", 8_900_000, 5), ("c", 9_000_000, 6)]) == [["b", 5, 8_900_000, 8_900_000, False], ["b", 3, 9_000_000, 8_900_000, True], ["c", 6, 9_000_000, 9_000_000, False]]
    assert timers == [10_000]

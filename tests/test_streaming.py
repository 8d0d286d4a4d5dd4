"""The lockout stream gives what its batch twin gives; incremental scoring scores once."""

import random
import tempfile
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import similarity
from tessera.streaming import jobs, lockout


def plain(events, attempts=5, minutes=15):
    """(attempts, locked) of a key's (time, success) in order, one after another."""
    n, ends, out = 0, None, []
    for ts, ok in events:
        if ends is not None and ts >= ends:
            n, ends = 0, None
        if n >= attempts:
            out.append((n, True))
            continue
        n = 0 if ok else n + 1
        ends = None if ok else ts + pd.Timedelta(minutes=minutes) if n == 1 else ends
        out.append((n, False))
    return out


def test_lockout_rules():
    t = [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m) for m in (0, 1, 2, 3, 4, 6, 15, 16)]
    ok = [False] * 5 + [True, False, True]
    us = np.array([x.value // 1000 for x in t])
    n, locked, state = lockout.Events(us, np.array(ok)).outcomes(lockout.State())
    assert list(zip(n.tolist(), locked.tolist())) == plain(list(zip(t, ok))) == [(1, False), (2, False), (3, False), (4, False), (5, False), (5, True), (1, False), (0, False)]
    assert state == lockout.State()


def test_a_key_in_chunks():
    """However a key's events are cut, the chunks' tables lead to the same states, and events to the same counts."""
    rng = random.Random(12)
    for case in range(300):
        step = rng.choice([10, 60, 200, 400, 900])
        us = np.cumsum([rng.choice([0, 1, 1, 2]) * rng.randrange(2 * step) * 1_000_000 for _ in range(rng.randrange(1, 60))])
        ok = np.array([rng.random() < rng.choice([0.05, 0.3]) for _ in us])
        want = plain([(pd.Timestamp(int(u), unit="us"), x) for u, x in zip(us, ok)])
        cuts = sorted({0, len(us), *(rng.randrange(len(us)) for _ in range(rng.randrange(6)))})
        state, got = lockout.State(), []
        for lo, hi in zip(cuts, cuts[1:]):
            part = lockout.Events(us[lo:hi], ok[lo:hi])
            n, locked, after = part.outcomes(state)
            got += zip(n.tolist(), locked.tolist())
            assert part.table().leave(state) == after, (case, lo, hi, state)
            state = after
        assert got == want


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_lockouts_of_a_table(spark, kind):
    """A key with most of the events, cut into many chunks over all partitions; small keys; nulls; repeated rows; both kinds of time."""
    rng = random.Random(4)
    start = pd.Timestamp("2024-03-30 22:00")  # a change of summer time follows
    rows = [("hot", "1", (start + pd.Timedelta(seconds=13 * i + rng.randrange(40))).to_pydatetime(), rng.random() < 0.04) for i in range(6000)]
    rows += [(f"u{rng.randrange(300)}", None if rng.random() < 0.1 else "2", (start + pd.Timedelta(seconds=rng.randrange(40_000))).to_pydatetime(), rng.random() < 0.2) for _ in range(2000)]
    rows += [(None, None, start.to_pydatetime(), None)] * 7 + [("hot", "1", None, False)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, f"email string, ip string, ts {kind}, success boolean").selectExpr("*", "1 as us", "2 as ok", "3 as seq")
    want = Counter()
    keys = {(e, i) for e, i, _, _ in rows}
    for key in keys:
        own = sorted((pd.Timestamp(t), bool(ok)) for e, i, t, ok in rows if (e, i) == key and t is not None)
        want.update((*key, t.to_pydatetime(), ok, n, shut) for (t, ok), (n, shut) in zip(own, plain(own)))
    want[("hot", "1", None, False, None, None)] += 1
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        if kind == "timestamp_ntz":
            spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        found = lockout.lockout_batch(events, chunk=500)
        assert dict(found.dtypes)["ts"] == kind and Counter(map(tuple, found.collect())) == want
        assert lockout.lockout_batch(events.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sum(n for r, n in want.items() if r[5]) > 500


def test_score_new(spark):
    src, out, ck = (tempfile.mkdtemp(prefix="tessera-") for _ in range(3))
    rows = spark.range(6).select(F.lit("b").alias("batch"), F.col("id").alias("doc"), F.concat(F.lit("text "), (F.col("id") % 4).cast("string")).alias("text"), F.current_timestamp().alias("ts"))
    rows.write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    for _ in range(2):
        q = jobs.score_new(stream, lambda r: r.select("doc", F.length("text").alias("n")), f"{out}/r", ck).trigger(availableNow=True).start()
        q.awaitTermination(90)
        time.sleep(0.1)
    assert spark.read.parquet(f"{out}/r").count() == 4


def run(rows, folder):
    """Runs a stream of rows to its end; what it wrote."""
    q = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_lockout_stream_gives_what_its_batch_twin_gives(spark, tmp_path):
    rng = random.Random(3)
    start = pd.Timestamp("2024-01-01")
    rows = []
    for minute in range(240):
        rows += [(f"u{rng.randrange(3)}", "10.0.0.1", (start + pd.Timedelta(seconds=60 * minute + s)).to_pydatetime(), rng.random() < 0.15) for s in (1, 20, 40)]
    schema = "email string, ip string, ts timestamp, success boolean"
    for i in range(0, len(rows), 180):  # four batches; windows and locks reach across them
        spark.createDataFrame(rows[i : i + 180], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken by time of change
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(lockout.lockout_stream(stream), str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/out")
    want = lockout.lockout_batch(spark.read.parquet(f"{tmp_path}/in"))
    assert want.where("locked").count() > 10 and want.where("attempts = 5").count() > 5
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_audit_stream_and_counts(spark, tmp_path):
    times = [pd.Timestamp("2024-01-01 10:00") + pd.Timedelta(minutes=7 * i) for i in range(40)]
    rows = [("u1", "GET" if i % 4 == 0 else "POST", "/api/batches", None, "10.0.0.9", t.to_pydatetime()) for i, t in enumerate(times)]
    schema = "user_id string, method string, path string, x_forwarded_for string, client_host string, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = jobs.audit_stream(stream, ["10.0.0.1"], f"{tmp_path}/audit", f"{tmp_path}/ck0").trigger(availableNow=True).start()
    q.awaitTermination(120)
    audit = spark.read.parquet(f"{tmp_path}/audit")
    assert audit.count() == 30 and {r["action"] for r in audit.collect()} == {"batch.create"}
    want = {(r["window_start"], r["n"]) for r in jobs.action_counts(audit).collect()}
    run(jobs.action_counts(spark.readStream.schema(audit.schema).parquet(f"{tmp_path}/audit")), str(tmp_path))
    got = {(r["window_start"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    last = max(times) - pd.Timedelta(minutes=10)
    assert got == {(w, n) for w, n in want if w + pd.Timedelta(hours=1) <= last}  # windows that the watermark has passed
    assert sum(n for _, n in want) == 30 and len(got) >= 3


def test_new_submissions_meet_all_before(spark, tmp_path):
    """The stream's pairs, micro-batch by micro-batch, are those of the whole table; one that runs again changes nothing."""
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    texts = [[word() for _ in range(60)] for _ in range(12)]
    rows = [("b" + str(i % 2), i, " ".join(w if rng.random() < 0.95 else word() for w in texts[i % 6])) for i in range(36)]
    rows += [("b0", 36, rows[0][2]), ("b0", 37, rows[2][2]), ("b0", 38, rows[0][2]), ("b1", 39, None), ("b1", 40, "")]
    schema = "batch string, doc long, text string"
    for i, (lo, hi) in enumerate([(0, 10), (10, 37), (37, 41)]):
        spark.createDataFrame(rows[lo:hi] + rows[lo : lo + 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    index = jobs.BandIndex(spark, f"{tmp_path}/index")
    q = jobs.compare_new(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), index, f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    docs = spark.createDataFrame([r for r in rows if r[2] is not None], schema)
    want = sorted(map(tuple, similarity.lsh_candidates(similarity.minhash_signatures(docs)).collect()))
    assert sorted(map(tuple, index.pairs().collect())) == want and len(want) > 40
    index.add(docs.where("doc >= 37"), 2)
    assert sorted(map(tuple, index.pairs().collect())) == want

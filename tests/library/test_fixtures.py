"""Cases with known answers, and brute-force versions of what SQL can't say."""

import random
import struct
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fanweave.functions import frames
from fanweave.functions.binary import crc32c_bytes, le_hex, le_value
from fanweave.functions.selection import canonical_key, parse_selection, selected_count, selected_partitions, selection
from fanweave.functions.text import id_code
from fanweave.operators import ledger, lifecycle, manifests, pressure, scheduler, topology
from fanweave.operators.ranking import ranked, running_max, running_sum
from fanweave.policy import Limits, Policy, policy_problem, policy_text
from fanweave.schemas import ERROR_CODES, MESSAGE_TYPES, retry_class
from fanweave.sources import journal
from fanweave.streaming.fold import fold_batches

CONSUMER = "consumer_id long, kind string, b long, e long, l array<long>, state string, shuffle_id long"


def consumers(spark, rows):
    df = spark.createDataFrame([(i, k, b, e, l, s, 1) for i, k, b, e, l, s in rows], CONSUMER)
    return df.select(
        "consumer_id", F.lit(1).cast("long").alias("incarnation"), "state", F.lit("x").alias("endpoint"),
        selection(F.col("kind"), F.col("b"), F.col("e"), F.col("l")).alias("selection"), "shuffle_id"
    )


def all_of(i, state="Active"):
    return (i, "All", 0, 0, [], state)


def ranged(i, b, e, state="Active"):
    return (i, "Range", b, e, [], state)


def listed(i, *members, state="Active"):
    return (i, "List", 0, 0, list(members), state)


def producers(spark, *ids, state="Active"):
    return spark.createDataFrame(
        [(i, 1, state, f"e{i}") for i in ids], "producer_id long, incarnation long, state string, endpoint string"
    )


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_edge_counts_close(spark):
    df = consumers(spark, [all_of(1), ranged(2, 0, 5), listed(3, 3, 7, 11)])
    assert topology.planned_edges(df, 12).first()["planned_edges"] == topology.edges(df, 12).count() == 20
    gone = consumers(spark, [all_of(1, "Withdrawn"), ranged(2, 0, 5), listed(3, 3, 7, 11)])
    assert topology.planned_edges(gone, 12).first()["planned_edges"] == 8
    assert topology.planned_edges(consumers(spark, []), 12).first()["planned_edges"] == 0


def test_large_requirement_needs_no_edges(spark):
    df = spark.range(256).select(
        (F.col("id") + 1).alias("consumer_id"), F.lit("Active").alias("state"),
        selection(F.lit("All"), F.lit(0), F.lit(0), F.expr("cast(array() as array<bigint>)")).alias("selection")
    )
    row = topology.planned_edges(df, 65_536).first()
    assert (row["planned_edges"], row["pattern_count"]) == (16_777_216, 1)


def test_ownership_follows_active_rank(spark):
    assert values(
        topology.owners(producers(spark, 2, 1, 3), 12), "partition", "producer_id"
    ) == [(p, 1 + p % 3) for p in range(12)]
    assert (3, 4) in values(topology.owners(producers(spark, 2, 1, 3, 4), 12), "partition", "producer_id")
    assert topology.owners(producers(spark, 1, state="Failed"), 4).count() == 0


def test_fan_bounds(spark):
    df = consumers(spark, [all_of(1), ranged(2, 0, 3), listed(3, 0, 2, 4)])
    out = dict(values(topology.fan_out(df, 16), "partition", "fan_out"))
    assert (out[2], out[3], len(out)) == (3, 1, 16)
    assert values(topology.fan_in(df, producers(spark, 1, 2), 16), "consumer_id", "fan_in") == [(1, 2), (2, 2), (3, 1)]


def test_violations(spark):
    df = consumers(spark, [ranged(i, 0, 4) for i in range(1, 7)])
    got = topology.policy_violations(df, producers(spark, 1), 16, Policy(max_fan_out=2)).collect()
    assert {r["code"] for r in got} == {"FanOutCeilingExceeded"} and len(got) == 4


def test_clamping_and_text(spark):
    df = consumers(spark, [ranged(1, 4, 1000), ranged(2, 100, 200), listed(3, 1, 99), all_of(4)])
    s = F.col("selection")
    assert values(
        df.select("consumer_id", selected_count(s, 16).alias("n"), F.size(selected_partitions(s, 16)).alias("m")),
        "consumer_id", "n", "m"
    ) == [(1, 12, 12), (2, 0, 0), (3, 1, 1), (4, 16, 16)]
    assert values(df.select(canonical_key(s).alias("k")), "k") == [
        ("all",), ("list:1,99",), ("range:100:200",), ("range:4:1000",)
    ]
    texts = spark.createDataFrame(
        [(t,) for t in ("all", "range:1:5", "range:5:1", "list:3,1", "list:1,1", "list:", "some", "range:a:b", None)],
        "t string"
    ).select("t", parse_selection(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] and (r["s"]["kind"], r["s"]["list"]) for r in texts.collect()} == {
        "all": ("All", []), "range:1:5": ("Range", []), "range:5:1": None, "list:3,1": ("List", [1, 3]),
        "list:1,1": None, "list:": None, "some": None, "range:a:b": None, None: None
    }


def test_two_level_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(-5, 9)) for i in rng.sample(range(40_000), 300)]
    df = spark.createDataFrame(rows, "i long, v long")
    ordered = sorted(rows)
    assert values(running_sum(df, "i", F.col("v"), "s", 64), "i", "s") == [
        (i, sum(v for _, v in ordered[:k + 1])) for k, (i, _) in enumerate(ordered)
    ]
    assert values(running_max(df, "i", F.col("v"), "m", 64), "i", "m") == [
        (i, max(v for _, v in ordered[:k + 1])) for k, (i, _) in enumerate(ordered)
    ]
    assert [r for _, r in values(ranked(df, "i", "r", 64), "i", "r")] == list(range(1, 301))


LOG = "seq long, partition long, partition_gen long, consumer_id long, producer_id long, producer_incarnation long, shuffle_gen long, digest string, bytes long, integrity boolean"


def commit(seq, p=0, g=1, c=1, digest="d", size=512, inc=1, integrity=True, sg=1):
    return (seq, p, g, c, 1, inc, sg, digest, size, integrity)


def folded(spark, rows, n=8):
    return {
        r["seq"]: (r["error_code"], r["outcome"]) for r in ledger.fold_commits(
            spark.createDataFrame(rows, LOG), n
        ).collect()
    }


def test_exactly_once(spark):
    got = folded(spark, [commit(i) for i in range(6)])
    assert Counter(o for _, o in got.values()) == {"new": 1, "duplicate": 5}
    assert folded(spark, [commit(1, c=5), commit(2, c=2)]) == {1: ("Ok", "new"), 2: ("Ok", "edge")}
    got = folded(
        spark,
        [commit(1), commit(2, digest="x"), commit(3, inc=2), commit(4, size=1), commit(5, g=2), commit(6, g=1, c=9)]
    )
    assert [got[i][0] for i in range(1, 7)] == [
        "Ok", "DivergentCommit", "DivergentCommit", "AccountingMismatch", "Ok", "StaleGeneration"
    ]
    got = folded(
        spark,
        [
            commit(1, p=9), commit(2, g=0, integrity=False), commit(3, integrity=False, digest=""),
            commit(4, digest="", size=0), commit(5, size=0, sg=2), commit(6, sg=2)
        ]
    )
    assert [got[i][0] for i in range(1, 7)] == [
        "UnknownPartition", "InvalidArgument", "IntegrityFailure", "ManifestInconsistent", "InvalidArgument",
        "StaleGeneration"
    ]


def random_log(seed, n=120):
    rng = random.Random(seed)
    return [
        commit(
            i, rng.randrange(5), rng.randrange(0, 4), rng.randrange(4), rng.choice("ddde"), rng.choice([5, 5, 5, 6, 0]),
            rng.choice([1, 1, 1, 2]), rng.random() > 0.1, rng.choice([1, 1, 1, 1, 2])
        ) for i in range(n)
    ]


def loop(rows, n=4):
    latest, anchors, done, out = {}, {}, set(), {}
    for seq, p, g, c, pid, inc, sg, digest, size, ok in rows:
        code = "UnknownPartition" if p >= n else "InvalidArgument" if g == 0 else "IntegrityFailure" if not ok else "ManifestInconsistent" if not digest else "InvalidArgument" if size == 0 else "StaleGeneration" if sg != 1 or g < latest.get(p, 0) else "Ok"
        outcome = "refused"
        if code == "Ok":
            anchor = anchors.setdefault((p, g), (digest, pid, inc, size))
            if anchor[:3] != (digest, pid, inc):
                code = "DivergentCommit"
            elif anchor[3] != size:
                code = "AccountingMismatch"
            else:
                outcome = "duplicate" if (p, g, c) in done else "edge" if any(d[:2] == (p, g) for d in done) else "new"
                done.add((p, g, c))
                latest[p] = g
        out[seq] = (code, outcome)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_fold_like_a_loop(spark, seed):
    rows = random_log(seed)
    assert folded(spark, rows, 4) == loop(rows)


def test_stream_folds_like_the_batch(spark, tmp_path):
    rows = random_log(77, 200)
    for k in range(4):
        spark.createDataFrame(
            rows[50 * k:50 * k + 50], LOG
        ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/b={k}")
    stream = spark.readStream.schema(LOG + ", b int").option(
        "maxFilesPerTrigger", 1
    ).option("latestFirst", False).parquet(f"{tmp_path}/log").drop("b")
    assert {r["seq"]: (r["error_code"], r["outcome"]) for r in fold_batches(stream, 4).collect()} == loop(rows)


def test_only_the_first_cancellation_with_a_reason_counts(spark):
    opened = spark.createDataFrame([(1, 10), (2, 10)], "shuffle_id long, opened_at long")
    cancels = spark.createDataFrame(
        [
            (5, 1, "PolicyDenied"), (20, 1, "Ok"), (30, 1, "ShuttingDown"), (40, 1, "PolicyDenied"), (50, 1, "Ok"),
            (60, 3, "PolicyDenied")
        ],
        "seq long, shuffle_id long, reason string"
    )
    spans = lifecycle.state_spans(opened, cancels)
    assert sorted(map(tuple, spans.collect())) == [(1, 10, 30, "ShuttingDown"), (2, 10, None, None)]
    assert values(lifecycle.judge_cancellations(cancels, spans), "seq", "error_code", "applied") == [
        (5, "InvalidState", False), (20, "InvalidArgument", False), (30, "Ok", True), (40, "Ok", False),
        (50, "Ok", False), (60, "InvalidState", False)
    ]
    asked = spark.createDataFrame([(s, i) for i in (1, 2, 3) for s in (9, 29, 31)], "seq long, shuffle_id long")
    got = {(r["shuffle_id"], r["seq"]): r["error_code"] for r in lifecycle.lifecycle_gate(asked, spans).collect()}
    assert got == {
        (1, 9): "InvalidState", (1, 29): "Ok", (1, 31): "Cancelled", (2, 9): "InvalidState", (2, 29): "Ok",
        (2, 31): "Ok", **{(3, s): "InvalidState" for s in (9, 29, 31)}
    }


def test_a_store_recovers_whole_or_not_at_all(spark):
    schema = "store long, origin string, version long, seq long, kind string, id long, state string, epoch long, readable boolean, torn boolean"
    base = [
        ("snapshot", 1, 1, "Producer", 1, "Active", 3, True, False),
        ("journal", 1, 2, "Producer", 1, "Suspect", 3, True, False),
        ("journal", 1, 3, "Consumer", 1, "Active", 4, True, False)
    ]
    stores = {
        1: base, 2: base + [("journal", 1, 4, "Producer", 1, "Active", 9, False, True)],
        3: base + [("journal", 1, 4, "Commit", 1, "", 5, False, False)], 4: [("snapshot", 2, *base[0][2:]), *base[1:]]
    }
    rows = spark.createDataFrame([(s, *r) for s, rs in stores.items() for r in rs], schema)
    assert sorted(map(tuple, journal.recover(rows).collect())) == [
        (1, "Ok", 3, 5, 1, False), (2, "Ok", 3, 5, 1, True), (3, "StateCorrupt", 0, 5, 0, False),
        (4, "UnsupportedVersion", 0, 4, 0, False)
    ]


def test_progress_closes(spark):
    log = [commit(1, 0, c=1), commit(2, 0, c=2), commit(3, 1, c=1)]
    fold = ledger.fold_commits(spark.createDataFrame(log, LOG), 6)
    reports = spark.createDataFrame(
        [
            (4, 2, 1, 1, "AuthorityDenied", 1, 9), (5, 3, 1, 1, "ConnectionFailure", 1, 9),
            (6, 3, 1, 2, "BackpressureActive", 1, 9)
        ],
        "seq long, partition long, partition_gen long, consumer_id long, code string, attempts long, tick long"
    )
    judged = ledger.judge_failures(reports, 6, min_ticks=7)
    assert {r["seq"]: (r["error_code"], r["outcome"], r["ready_at"]) for r in judged.collect()} == {
        4: ("Ok", "AuthorityRefused", 9), 5: ("Ok", "RetriableFailure", 16), 6: ("InvalidArgument", "refused", 16)
    }
    required = topology.planned_edges(consumers(spark, [all_of(1), all_of(2)]), 6)
    failures = ledger.last_failures(judged.filter("error_code = 'Ok'"))
    latest = ledger.latest_generations(fold.filter("outcome = 'new'"), reports)
    row = ledger.progress(required, fold, failures, judged, latest, 6).first()
    assert (
        row["edges_required"], row["edges_completed"], row["edges_failed"], row["edges_incomplete"]
    ) == (12, 3, 1, 8)
    assert (
        row["partitions_committed"], row["partitions_failed"], row["authority_refusals"], row["bytes_committed"],
        row["closes"]
    ) == (2, 1, 1, 1024, True)
    text = ledger.render(
        ledger.explain(
            failures, fold, spark.range(0).withColumnRenamed("id", "partition"), producers(spark, 1),
            consumers(spark, [all_of(1)])
        )
    ).orderBy("position").collect()
    assert [r["line"] for r in text] == [
        "1x AuthorityDenied [p2/g1/c1] permanent=yes attempts=1 ready_at=9",
        "1x ConnectionFailure [p3/g1/c1] permanent=no attempts=1 ready_at=16"
    ]


def test_retention(spark):
    fold = ledger.fold_commits(spark.createDataFrame([commit(g, g=g) for g in range(1, 5)], LOG), 4)
    kept = ledger.retained_generations(fold)
    assert values(kept.filter("retained"), "partition_gen") == [(3,), (4,)]
    wanted = spark.createDataFrame(
        [(0, g, 1) for g in range(1, 5)], "partition long, partition_gen long, consumer_id long"
    )
    none = spark.createDataFrame(
        [],
        "partition long, partition_gen long, consumer_id long, code string, permanent boolean, attempts long, ready_at long"
    )
    phases = ledger.edge_status(wanted, ledger.committed_edges(fold), none, ledger.latest_generations(fold), kept, 4)
    assert values(phases, "partition_gen", "phase") == [
        (1, "Purged"), (2, "Purged"), (3, "Completed"), (4, "Completed")
    ]


def test_hysteresis(spark):
    rows = spark.createDataFrame(
        [(1, t, v) for t, v in enumerate([50, 90, 60, 10, 60])], "target long, tick long, level long"
    )
    assert [p for _, p in values(pressure.hysteresis(rows), "tick", "paused")] == [False, True, True, False, False]


def wave_of(spark, n, ps, cs, policy, cursor=0, done=(), load=None):
    """A wave from ``cursor``; edges of ``done`` are completed."""
    people = consumers(spark, cs)
    cursors = scheduler.cursor_steps(people, n).select(
        "shuffle_id", F.lit(cursor).cast("long").alias("cursor"), "full_pass"
    )
    edges = scheduler.wave_edges(people, n, cursors, policy.max_examined)
    own = topology.owners(producers(spark, *ps), n).select("partition", "producer_id")
    finished = spark.createDataFrame([(*e, True) for e in done], "partition long, consumer_id long, _done boolean")
    decided = edges.join(own, "partition").join(finished, ["partition", "consumer_id"], "left").withColumn(
        "disposition", F.when(F.col("_done"), "completed").otherwise("candidate")
    )
    return scheduler.next_wave(decided, cursors, policy, load)


def test_limits_bound_a_wave(spark):
    wave = wave_of(spark, 64, (1, 2), [all_of(1), all_of(2)], Policy(per_source=2, per_destination=1))
    assert values(wave.filter("outcome = 'granted'"), "partition", "consumer_id") == [(0, 1), (0, 2)]
    wave = wave_of(spark, 32, (1, 2), [all_of(1), all_of(2)], Policy(global_limit=3, per_source=3, per_destination=3))
    counts = scheduler.wave_counters(wave).first()
    assert counts["granted"] == 3 and counts["limits"] > 0 and not counts["all_resolved"]
    load = spark.createDataFrame(
        [(1, "source", 1, 2), (1, "destination", 1, 2)], "shuffle_id long, side string, id long, in_flight long"
    )
    wave = wave_of(
        spark, 32, (1, 2), [all_of(1), all_of(2)], Policy(global_limit=3, per_source=3, per_destination=3), load=load
    )
    assert scheduler.wave_counters(wave).first()["granted"] == 1


def covered(selection, p):
    _, kind, begin, end, members, _ = selection
    return kind == "All" or (begin <= p < end if kind == "Range" else p in members)


def whole_pass(n, cs):
    """The steps of one pass: an edge (partition, consumer), or None for leaving a pattern or a partition."""
    key = lambda i, k, b, e, l, s: "all" if k == "All" else f"range:{b}:{e}" if k == "Range" else "list:" + ",".join(map(str, l))
    steps = []
    for p in range(n):
        for pattern in sorted({key(*c) for c in cs}):
            steps += [(p, c[0]) for c in sorted(cs) if key(*c) == pattern and covered(c, p)] + [None]
        steps.append(None)
    return steps


def plain_wave(steps, owner, policy, cursor, done):
    """A wave step by step: its outcomes, the steps taken, the new cursor, and whether it came by the end of a pass."""
    source, destination, own, out = Counter(), Counter(), set(), []
    taken, at_end, wrapped, full = 0, 0, False, False
    while taken < policy.max_examined and len(own) < policy.max_grants and not full:
        step = steps[cursor]
        taken, cursor = taken + 1, cursor + 1
        if cursor == len(steps):
            cursor, wrapped, full, at_end = 0, True, len(own) == at_end, len(own)
        if step is None:
            continue
        p, c = step
        if step in done:
            outcome = "completed"
        elif step in own:
            outcome = "in_flight"
        elif len(own) >= policy.global_limit:
            outcome, full = "limits", True
        elif source[owner(p)] >= policy.per_source or destination[c] >= policy.per_destination:
            outcome = "limits"
        else:
            outcome = "granted"
            own.add(step)
            source[owner(p)] += 1
            destination[c] += 1
        out.append((taken, p, c, outcome))
    return out, taken, cursor, wrapped


@pytest.mark.parametrize("seed", range(6))
def test_waves_match_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    n = rng.randrange(4, 20)
    cs = [
        rng.choice(
            [
                all_of(i), ranged(i, (b := rng.randrange(n)), rng.randrange(b, n) + 1),
                listed(i, *sorted(rng.sample(range(n), 2)))
            ]
        ) for i in range(1, rng.randrange(3, 12))
    ]
    steps = whole_pass(n, cs)
    policy = Policy(
        global_limit=rng.randrange(4, 12), per_source=rng.randrange(1, 4), per_destination=rng.randrange(1, 4),
        max_grants=rng.randrange(2, 12), max_examined=rng.randrange(20, 3 * len(steps))
    )
    edges = [e for e in steps if e]
    done = set(rng.sample(edges, len(edges) * rng.choice([0, 3, 9, 10]) // 10))
    cursor = rng.randrange(len(steps))
    people = consumers(spark, cs)
    assert values(
        scheduler.cursor_edges(people, n), "step", "partition", "consumer_id"
    ) == [(k, *e) for k, e in enumerate(steps, 1) if e]
    assert scheduler.cursor_steps(people, n).first()["full_pass"] == len(steps)
    out, taken, after, wrapped = plain_wave(steps, lambda p: 1 + p % 3, policy, cursor, done)
    rows = wave_of(spark, n, (1, 2, 3), cs, policy, cursor, done)
    assert values(rows.filter("outcome <> 'end'"), "position", "partition", "consumer_id", "outcome") == out
    counts = scheduler.wave_counters(rows).first()
    assert (counts["examined"], counts["cursor"], counts["cursor_wrapped"]) == (taken, after, wrapped)
    kinds = Counter(o for *_, o in out)
    assert counts["all_resolved"] == (wrapped and set(kinds) <= {"completed"})


def test_every_required_edge_is_granted_once_until_resolved(spark):
    """Twelve partitions, 21 edges, four grants and 64 steps a wave, each grant completed before the next wave."""
    cs, policy = [all_of(1), ranged(2, 1, 7), listed(3, 0, 4, 11)], Policy(max_grants=4, max_examined=64)
    granted, cursor, resolved = [], 0, False
    for _ in range(12):
        wave = wave_of(spark, 12, (1, 2, 3), cs, policy, cursor, granted).cache()
        counts = scheduler.wave_counters(wave).first()
        if resolved := counts["all_resolved"]:
            break
        new = values(wave.filter("outcome = 'granted'"), "partition", "consumer_id")
        assert new and not set(new) & set(granted)
        granted, cursor = granted + new, counts["cursor"]
    assert resolved and len(granted) == 21


def test_a_wave_makes_no_more_edges_than_its_budget_reaches(spark):
    """Work doesn't grow with the partitions: only those within the budget are made."""
    policy = Policy(max_examined=100, max_grants=8)
    many = spark.range(64).select(
        (F.col("id") + 1).alias("consumer_id"), F.lit("Active").alias("state"),
        F.lit(1).cast("long").alias("shuffle_id"),
        selection(F.lit("All"), F.lit(0), F.lit(0), F.expr("cast(array() as array<bigint>)")).alias("selection")
    )
    made = []
    for n in (1024, 4096, 1 << 22):
        cursors = scheduler.cursor_steps(many, n).select(
            "shuffle_id", F.lit(n * 33).cast("long").alias("cursor"), "full_pass"
        )
        segments = scheduler.pass_segments(many, n)
        assert segments.count() == 1 and cursors.first()["full_pass"] == n * 66
        made.append(
            (
                scheduler.visited_partitions(segments, cursors, policy.max_examined).count(),
                scheduler.wave_edges(many, n, cursors, policy.max_examined).count()
            )
        )
    assert len(set(made)) == 1 and made[0][0] <= 3 and made[0][1] <= 100


def test_cursors_restart_when_generations_move(spark):
    people = consumers(spark, [all_of(1)])
    bind = lambda old: scheduler.bind_cursors(
        spark.createDataFrame(old, "shuffle_id long, topology_gen long, policy_gen long, cursor long"),
        spark.createDataFrame([(1, 2, 3)], "shuffle_id long, topology_gen long, policy_gen long"), people, 8
    ).first()
    assert [bind(x)["cursor"] for x in ([(1, 2, 3, 7)], [(1, 1, 3, 7)], [(1, 2, 2, 7)], [])] == [7, 0, 0, 0]
    nobody = scheduler.wave_counters(
        scheduler.next_wave(
            spark.createDataFrame(
                [], "shuffle_id long, step long, partition long, consumer_id long, producer_id long, disposition string"
            ),
            spark.createDataFrame([(1, 0, None)], "shuffle_id long, cursor long, full_pass long"), Policy()
        )
    ).first()
    assert nobody["all_resolved"] and nobody["examined"] == 0


def test_manifest_cases(spark):
    content = spark.createDataFrame([(1, bytes(1000)), (2, b"")], "partition long, payload binary")
    chunks = manifests.chunk_rows(content, 256)
    assert values(chunks, "chunk_id", "length") == [(0, 256), (1, 256), (2, 256), (3, 232)]
    bad = chunks.withColumn("digest", F.when(F.col("chunk_id") == 2, "0").otherwise(F.col("digest")))
    assert manifests.verify_chunks(chunks, bad).first()["error_code"] == "DigestMismatch"
    short = bad.withColumn("length", F.when(F.col("chunk_id") == 2, 1).otherwise(F.col("length")))
    assert manifests.verify_chunks(chunks, short).first()["error_code"] == "IntegrityFailure"


def test_checksums_and_bytes(spark):
    assert crc32c_bytes(b"123456789") == 0xE3069283 and crc32c_bytes(b"") == 0
    row = spark.sql("SELECT 258L AS v").select(
        le_hex(F.col("v"), 4).alias("h"), le_value(le_hex(F.col("v"), 4), 4).alias("back")
    ).first()
    assert (row["h"], row["back"]) == (struct.pack("<I", 258).hex(), 258)


def test_id_text(spark):
    texts = ["", "007", "+7", " 7", "7 ", "0x7", "18446744073709551616", "18446744073709551615", "0", "7", None]
    got = {
        r["t"]: r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
            "t", id_code(F.col("t")).alias("c")
        ).collect()
    }
    assert [got[t] for t in texts] == [
        "EmptyValue", *["InvalidArgument"] * 5, "IntegerOverflow", "Ok", "Ok", "Ok", "EmptyValue"
    ]


def test_replay_windows():
    def run(size, *sequences):
        window = frames.Window(size)
        return [window.answer(s) for s in sequences]

    assert run(4, 1, 3, 5, 2, 4, 2, 4) == ["accepted"] * 5 + ["duplicate"] * 2
    assert run(4, *range(1, 17), 16, 13, 12) == ["accepted"] * 16 + ["duplicate", "duplicate", "SequenceViolation"]
    assert run(4, 0, 1, 2 + (1 << 40)) == ["SequenceViolation", "accepted", "MalformedInput"]


def test_dimensions():
    assert len(ERROR_CODES) == 90 and len(MESSAGE_TYPES) == 32
    assert [
        retry_class(c) for c in ("Ok", "IntegrityFailure", "QueueFull", "Cancelled", "DigestMismatch")
    ] == ["NotApplicable", "Retriable", "Deferred", "Authority", "Permanent"]


def test_policies():
    assert Policy().problem() is None
    assert [
        p.problem() for p in (
            Policy(shuffle=0), Policy(per_source=99), Policy(max_grants=9, max_examined=8), Policy(max_attempts=65),
            Policy(pause=101), Policy(resume=90), Policy(require_fresh=True, validity=0)
        )
    ] == ["shuffle", "concurrency above global", "max_examined", "max_attempts", "pause", "resume", "validity"]
    assert Policy(limits=Limits(max_tracked_partitions=1 << 23)).problem() == "max_tracked_partitions"
    assert "fan_out<=64" in Policy().describe()


def test_policies_as_rows_are_judged_like_values(spark):
    rng = random.Random(3)
    some = [
        Policy(
            shuffle=rng.randrange(2), per_source=rng.randrange(3), global_limit=rng.randrange(1, 3),
            max_grants=rng.randrange(3), pause=rng.choice([39, 60, 101]), require_fresh=bool(rng.randrange(2)),
            validity=rng.randrange(2), limits=Limits(max_wave_grants=rng.randrange(4))
        ) for _ in range(300)
    ]
    schema = "n long, shuffle long, per_source long, global_limit long, max_grants long, pause long, require_fresh boolean, validity long, per_destination long, max_wave_grants long"
    some = [replace(p, per_destination=1) for p in some]
    rows = spark.createDataFrame(
        [
            (
                k, p.shuffle, p.per_source, p.global_limit, p.max_grants, p.pause, p.require_fresh, p.validity, 1,
                p.limits.max_wave_grants
            ) for k,
            p in enumerate(some)
        ],
        schema
    )
    got = rows.select("n", policy_problem(rows).alias("problem"), policy_text(rows).alias("text")).collect()
    assert {r["n"]: (r["problem"], r["text"]) for r in got} == {
        k: (p.problem(), p.describe()) for k, p in enumerate(some)
    }
    assert len({p.problem() for p in some}) > 6


def test_commit_refusals_in_order(spark):
    from fanweave.operators.commits import admit_commits

    base = dict(
        attempt=1, partition=0, partition_gen=1, consumer_id=1, consumer_incarnation=1, producer_id=1,
        producer_incarnation=1, shuffle_gen=1, digest="m", content_digest="c", bytes=9, integrity=True,
        chunk_digests=["a", "b"]
    )
    changes = [
        dict(), dict(attempt=9), dict(shuffle_gen=2, consumer_id=2), dict(consumer_id=2),
        dict(producer_incarnation=3, digest="x"), dict(digest="x"), dict(integrity=False, bytes=8),
        dict(content_digest="m"), dict(content_digest="z", bytes=8), dict(bytes=8), dict(chunk_digests=["a"]),
        dict(chunk_digests=["a", "x"])
    ]
    schema = "attempt long, partition long, partition_gen long, consumer_id long, consumer_incarnation long, producer_id long, producer_incarnation long, shuffle_gen long, digest string, content_digest string, bytes long, integrity boolean, chunk_digests array<string>, seq long"
    requests = spark.createDataFrame([tuple((base | c).values()) + (i,) for i, c in enumerate(changes)], schema)
    grants = spark.createDataFrame(
        [(1, 0, 1, 1, 1, 1, 1, "m")],
        "attempt long, partition long, partition_gen long, consumer_id long, consumer_incarnation long, producer_id long, producer_incarnation long, digest string"
    )
    accepted = spark.createDataFrame(
        [(0, 1, "m", "c", 9, ["a", "b"])],
        "partition long, partition_gen long, digest string, content_digest string, bytes long, chunk_digests array<string>"
    )
    people, makers = consumers(spark, [all_of(1), all_of(2)]), producers(spark, 1)
    judge = lambda **more: [
        c for _,
        c in values(
            admit_commits(requests, grants, people, makers, topology.owners(makers, 4), accepted, **more), "seq",
            "error_code"
        )
    ]
    assert judge() == [
        "Ok", "StaleAttempt", "StaleGeneration", "AttemptSuperseded", "StaleIncarnation", "ManifestInconsistent",
        "IntegrityFailure", "Ok", "DigestMismatch", "AccountingMismatch", "IntegrityFailure", "DigestMismatch"
    ]
    assert set(judge(shuffle_state="Cancelled")) == {"Cancelled"}
    assert [*dict.fromkeys(judge(shuffle_state="Completed"))] == ["InvalidState", "StaleAttempt"]

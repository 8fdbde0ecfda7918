"""Waves: what each required edge waits for, and the bounded, ordered selection of those that may move now.

A pass examines partitions in order, within a partition its patterns by key as text, within a pattern its
consumers by id, with one step to leave each pattern and each partition. The steps of a pass follow in closed
form from the points where fan-out changes, so a wave makes only the edges that its cursor and its budget reach.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.selection import canonical_key, covers, selected_count
from ..policy import Policy
from ..schemas import first_refusal
from .ranking import running_sums

#: The answers that come before any limit, in order of precedence.
EARLY = ("unproduced", "completed", "failed", "in_flight", "retry_wait")
#: What a wave counts besides its grants; all but the first two keep a shuffle unresolved.
COUNTED = (
    "completed", "failed", "in_flight", "unproduced", "limits", "source_pressure", "destination_pressure",
    "unknown_pressure", "retry_wait"
)


def _required(consumers: DataFrame) -> DataFrame:
    return consumers.filter("state <> 'Withdrawn'").select(
        "shuffle_id", "consumer_id", "selection", canonical_key(F.col("selection")).alias("canonical_key")
    )


def cursor_steps(consumers: DataFrame, n: int) -> DataFrame:
    """(shuffle_id, patterns, planned_edges, full_pass): how many steps one full pass takes, in closed form."""
    keyed = _required(consumers).withColumn("_n", selected_count(F.col("selection"), n))
    by = keyed.groupBy("shuffle_id").agg(
        F.countDistinct("canonical_key").alias("patterns"), F.sum("_n").alias("planned_edges")
    )
    return by.withColumn("full_pass", n * (1 + F.col("patterns")) + F.col("planned_edges"))


def pass_segments(consumers: DataFrame, n: int) -> DataFrame:
    """Runs of partitions of equal fan-out: shuffle_id, first, stop, each (steps of one partition), start (steps before ``first``).

    Fan-out changes where a range begins or ends and around the members of a list, so the segments grow with
    the selections, not with the partitions.
    """
    keyed = _required(consumers)
    bound = lambda c: F.least(F.col(f"selection.{c}"), F.lit(n).cast("long"))
    one = lambda at, by: F.struct(at.cast("long").alias("first"), F.lit(by).alias("by"))
    members = F.filter("selection.list", lambda m: m < n)
    changes = (
        F.when(F.col("selection.kind") == "All", F.array(one(F.lit(0), 1), one(F.lit(n), -1)))
        .when(
            F.col("selection.kind") == "Range",
            F.when(bound("begin") < bound("end"), F.array(one(bound("begin"), 1), one(bound("end"), -1)))
        )
        .otherwise(F.concat(F.transform(members, lambda m: one(m, 1)), F.transform(members, lambda m: one(m + 1, -1))))
    )
    edges = F.array(one(F.lit(0), 0), one(F.lit(n), 0))
    steps = keyed.select(
        "shuffle_id", F.explode(F.concat(F.coalesce(changes, edges), edges)).alias("c")
    ).groupBy("shuffle_id", F.col("c.first").alias("first")).agg(F.sum("c.by").alias("by"))
    patterns = keyed.groupBy("shuffle_id").agg(F.countDistinct("canonical_key").alias("patterns"))
    order = Window.partitionBy("shuffle_id").orderBy("first")
    upto, before = order.rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    ), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = steps.join(patterns, "shuffle_id").withColumns(
        {"stop": F.lead("first").over(order), "each": F.col("patterns") + 1 + F.sum("by").over(upto)}
    ).filter("stop IS NOT NULL")
    return rows.select(
        "shuffle_id", "first", "stop", "each",
        F.coalesce(F.sum(F.expr("(stop - first) * each")).over(before), F.lit(0)).alias("start")
    )


def visited_partitions(segments: DataFrame, cursors: DataFrame | None = None, budget: int = 0) -> DataFrame:
    """(shuffle_id, partition, start): the partitions that a wave's steps touch, and the steps that come before each.

    ``cursors``: shuffle_id, cursor, full_pass. Steps run from the cursor on and wrap once; without cursors
    every partition counts. No more than ``budget`` partitions of a shuffle are made, however many it has.
    """
    if cursors is None:
        spans = segments.withColumns({"low": F.col("first"), "high": F.col("stop") - 1})
    else:
        over = F.greatest(F.col("cursor") + budget - F.col("full_pass"), F.lit(0))
        ranges = F.array(
            F.struct(F.col("cursor").alias("a"), F.least(F.col("cursor") + budget, F.col("full_pass")).alias("b")),
            F.struct(F.lit(0).cast("long").alias("a"), F.least(over, F.col("cursor")).alias("b"))
        )
        asked = segments.join(cursors, "shuffle_id").withColumn("r", F.explode(ranges)).withColumn(
            "end", F.expr("start + (stop - first) * each")
        )
        asked = asked.filter("r.a < end AND r.b > start AND r.a < r.b")
        spans = asked.withColumns(
            {
                "low": F.expr("first + (greatest(r.a, start) - start) div each"),
                "high": F.expr("first + (least(r.b, end) - 1 - start) div each")
            }
        )
    rows = spans.select("shuffle_id", F.explode(F.sequence("low", "high")).alias("partition"), "first", "each", "start")
    return rows.select(
        "shuffle_id", "partition", F.expr("start + (partition - first) * each").alias("start")
    ).distinct()


def _numbered(consumers: DataFrame, visited: DataFrame) -> DataFrame:
    """The edges of the visited partitions with their steps. Each partition is numbered by itself."""
    keyed = _required(consumers)
    order = Window.partitionBy("shuffle_id").orderBy("canonical_key")
    kinds = keyed.groupBy("shuffle_id", "canonical_key").agg(
        F.first("selection").alias("selection")
    ).withColumn("_pattern", F.row_number().over(order))
    rows = visited.join(kinds, "shuffle_id").filter(covers(F.col("selection"), F.col("partition"))).drop("selection")
    rows = rows.join(keyed.select("shuffle_id", "canonical_key", "consumer_id"), ["shuffle_id", "canonical_key"])
    place = F.row_number().over(Window.partitionBy("shuffle_id", "partition").orderBy("canonical_key", "consumer_id"))
    return rows.select(
        "shuffle_id", "partition", "canonical_key", "consumer_id",
        (F.col("start") + F.col("_pattern") - 1 + place).alias("step")
    )


def cursor_edges(consumers: DataFrame, n: int) -> DataFrame:
    """(shuffle_id, partition, canonical_key, consumer_id, step) of every required edge, for many shuffles at once."""
    return _numbered(consumers, visited_partitions(pass_segments(consumers, n)))


def wave_edges(consumers: DataFrame, n: int, cursors: DataFrame, budget: int) -> DataFrame:
    """Those of ``cursor_edges`` that a wave from ``cursors`` (shuffle_id, cursor, full_pass) may examine within ``budget`` steps."""
    edges = _numbered(
        consumers, visited_partitions(pass_segments(consumers, n), cursors, budget)
    ).join(cursors, "shuffle_id")
    ahead = (F.col("step") - F.col("cursor") - 1 + F.col("full_pass")) % F.col("full_pass") + 1
    return edges.filter(ahead <= budget).drop("cursor", "full_pass")


def bind_cursors(cursors: DataFrame, bound: DataFrame, consumers: DataFrame, n: int) -> DataFrame:
    """(shuffle_id, topology_gen, policy_gen, cursor, full_pass) for the generations that shuffles are bound to now.

    ``cursors`` and ``bound`` have shuffle_id, topology_gen and policy_gen, the former also cursor. A cursor
    of other generations restarts at 0, so that every edge is examined anew; what is in flight stays so.
    """
    old = cursors.select("shuffle_id", F.struct("topology_gen", "policy_gen", "cursor").alias("_old"))
    rows = bound.select("shuffle_id", "topology_gen", "policy_gen").join(old, "shuffle_id", "left").join(
        cursor_steps(consumers, n).select("shuffle_id", "full_pass"), "shuffle_id", "left"
    )
    same = (F.col("_old.topology_gen") == F.col("topology_gen")) & (F.col("_old.policy_gen") == F.col("policy_gen"))
    return rows.select(
        "shuffle_id", "topology_gen", "policy_gen",
        F.coalesce(F.when(same, F.col("_old.cursor")), F.lit(0)).cast("long").alias("cursor"), "full_pass"
    )


def wave_admission(bound: DataFrame, offered: DataFrame) -> DataFrame:
    """(shuffle_id, error_code): whether a shuffle may plan under what is offered.

    Both have shuffle_id, shuffle_gen and topology_gen: what the shuffle was bound to, and what it is asked to plan with.
    """
    own = bound.select("shuffle_id", F.struct("shuffle_gen", "topology_gen").alias("own"))
    rows = offered.join(own, "shuffle_id", "left")
    return rows.select(
        "shuffle_id",
        first_refusal(
            ("own IS NULL", "InvalidState"), ("own.shuffle_gen <> shuffle_gen", "PolicyMismatch"),
            ("own.topology_gen <> topology_gen", "StaleTopology")
        ).alias("error_code")
    )


def dispositions(
    edges: DataFrame, facts: DataFrame, owners: DataFrame, producers: DataFrame, consumers: DataFrame,
    status: DataFrame, in_flight: DataFrame, now: int, policy: Policy, pressure: DataFrame | None = None
) -> DataFrame:
    """Edges with ``disposition``: one of EARLY, else a pressure answer, ``inactive`` or ``candidate``.

    facts: partition, partition_gen, producer_id, producer_incarnation, manifest_digest, total_bytes;
    status: partition, consumer_id, phase, attempts, ready_at; in_flight: partition, consumer_id;
    pressure: side, id, decision (missing means Allow). Limits are left to the wave.
    """
    own = owners.select("partition", F.col("producer_id").alias("_owner"), F.col("incarnation").alias("_incarnation"))
    who = producers.select(F.col("producer_id").alias("_owner"), F.col("state").alias("_producer_state"))
    dest = consumers.select(
        "consumer_id", F.col("state").alias("_consumer_state"), F.col("incarnation").alias("consumer_incarnation")
    )
    rows = edges.join(facts, "partition", "left").join(own, "partition", "left").join(who, "_owner", "left").join(
        dest, "consumer_id", "left"
    )
    rows = rows.join(status, ["partition", "consumer_id"], "left").join(
        in_flight.select("partition", "consumer_id", F.lit(True).alias("_flying")), ["partition", "consumer_id"], "left"
    )
    if pressure is None:
        rows = rows.withColumns({"_source": F.lit("Allow"), "_destination": F.lit("Allow")})
    else:
        for side, key, name in (("source", "producer_id", "_source"), ("destination", "consumer_id", "_destination")):
            part = pressure.filter(F.col("side") == side).select(F.col("id").alias(key), F.col("decision").alias(name))
            rows = rows.join(part, key, "left")
        rows = rows.fillna("Allow", ["_source", "_destination"])
    attempts = F.coalesce("attempts", F.lit(0))
    case = (
        F.when(
            F.expr(
                "producer_id IS NULL OR _owner IS NULL OR _owner <> producer_id OR _producer_state <> 'Active' OR _incarnation <> producer_incarnation"
            ),
            "unproduced"
        )
        .when(F.expr("phase = 'Completed'"), "completed").when(
            F.expr("phase IN ('Failed', 'Purged')") | (attempts >= policy.max_attempts), "failed"
        )
        .when(F.col("_flying"), "in_flight").when(F.coalesce("ready_at", F.lit(0)) > now, "retry_wait")
        .when(F.expr("_source = 'Paused'"), "source_pressure").when(F.expr("_source = 'Unknown'"), "unknown_pressure")
        .when(
            F.expr("_destination = 'Paused'"), "destination_pressure"
        ).when(F.expr("_destination = 'Unknown'"), "unknown_pressure")
        .when(F.expr("_consumer_state <> 'Active'"), "inactive").otherwise("candidate")
    )
    return rows.select(
        *edges.columns, "partition_gen", "producer_id", "producer_incarnation", "consumer_incarnation",
        "manifest_digest", "total_bytes", (attempts + 1).alias("attempt_ordinal"), case.alias("disposition")
    )


def grants_one_sided(candidates: DataFrame, side: str, limit: int, total: int) -> DataFrame:
    """Candidates (shuffle_id, step, ...) granted under a limit per ``side`` and one per shuffle: two row numbers, exact."""
    by_side = Window.partitionBy("shuffle_id", side).orderBy("step")
    within = candidates.withColumn("_n", F.row_number().over(by_side)).filter(F.col("_n") <= limit)
    return within.withColumn(
        "_n", F.row_number().over(Window.partitionBy("shuffle_id").orderBy("step"))
    ).filter(F.col("_n") <= total).drop("_n")


_WAVE = "shuffle_id long, position long, attempt long, step long, partition long, consumer_id long, producer_id long, outcome string, cursor long, cursor_wrapped boolean"


def next_wave(decided: DataFrame, cursors: DataFrame, policy: Policy, load: DataFrame | None = None) -> DataFrame:
    """One wave of every shuffle of ``cursors`` (shuffle_id, cursor, full_pass): a row per examined edge, and one that ends the wave.

    ``decided``: shuffle_id, step, partition, consumer_id, producer_id, disposition, those within the budget
    at least. ``position`` counts steps from the cursor. ``outcome`` is granted, limits or the disposition;
    the last row's is ``end``, with the steps taken as ``position``, the new ``cursor`` and whether the
    wave came by the end of a pass. A wave ends with its budget, its grants, a full global limit, or a pass
    since which nothing was granted. Each grant changes what later edges may do, so a shuffle is decided in
    order, by one task that reads at most the budget. ``load`` (shuffle_id, side, id, in_flight) was in flight before.
    """
    names = ["shuffle_id", "step", "partition", "consumer_id", "producer_id", "disposition"]
    starts = cursors.select("shuffle_id", "cursor", "full_pass")
    if load is None:
        starts = starts.withColumn("load", F.lit(None).cast("array<struct<side:string,id:bigint,in_flight:bigint>>"))
    else:
        starts = starts.join(
            load.groupBy("shuffle_id").agg(F.collect_list(F.struct("side", "id", "in_flight")).alias("load")),
            "shuffle_id", "left"
        )

    def examine(edges: pd.DataFrame, cursor: int, full: int) -> Iterator[tuple[int, object]]:
        """(position, edge) in order, pass after pass; the end of a pass has no edge."""
        base, edges = -cursor, edges.sort_values("step")
        first = edges[edges.step > cursor]
        while True:
            for row in first.itertuples(index=False):
                yield base + row.step, row
            base, first = base + full, edges
            yield base, None

    def decide(start: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        head, out = start.iloc[0], []
        source, destination, total = Counter(), Counter(), 0
        for item in head["load"] if head["load"] is not None else ():
            (source if item["side"] == "source" else destination)[item["id"]] += item["in_flight"]
            total += item["in_flight"] if item["side"] == "source" else 0
        granted, at_last_end, wrapped, taken, own = 0, 0, False, 0, set()
        for position, row in examine(
            edges, int(head["cursor"]), int(head["full_pass"])
        ) if head["full_pass"] > 0 else ():
            taken = min(position, policy.max_examined)
            if position > policy.max_examined:
                break
            if row is None:
                wrapped, still, at_last_end = True, granted == at_last_end, granted
                if still:
                    break
                continue
            outcome = "in_flight" if row.disposition not in EARLY and (
                row.partition, row.consumer_id
            ) in own else row.disposition
            if outcome not in EARLY:
                full = total >= policy.global_limit
                if full or source[row.producer_id] >= policy.per_source or destination[row.consumer_id] >= policy.per_destination:
                    outcome = "limits"
                elif outcome == "inactive":
                    outcome = "unproduced"
                elif outcome == "candidate":
                    outcome, granted, total = "granted", granted + 1, total + 1
                    source[row.producer_id] += 1
                    destination[row.consumer_id] += 1
                    own.add((row.partition, row.consumer_id))
            out.append(
                (
                    position, granted if outcome == "granted" else None, row.step, row.partition, row.consumer_id,
                    row.producer_id, outcome, None, None
                )
            )
            if outcome == "limits" and full or granted >= policy.max_grants:
                break
        after = (int(head["cursor"]) + taken) % int(head["full_pass"]) if head["full_pass"] > 0 else 0
        out.append((taken, None, None, None, None, None, "end", after, wrapped))
        frame = pd.DataFrame(
            out,
            columns=[
                "position", "attempt", "step", "partition", "consumer_id", "producer_id", "outcome", "cursor",
                "cursor_wrapped"
            ]
        )
        frame.insert(0, "shuffle_id", head["_of"])
        return frame.astype(
            {
                c: "Int64" for c in ("attempt", "step", "partition", "consumer_id", "producer_id", "cursor")
            } | {"cursor_wrapped": "boolean"}
        )

    def wave(start: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        return decide(start, edges) if len(start) else pd.DataFrame(
            columns=[part.split()[0] for part in _WAVE.split(", ")]
        )

    own = starts.select(
        F.col("shuffle_id").alias("_of"), "cursor", F.coalesce("full_pass", F.lit(0)).alias("full_pass"), "load"
    )
    edges = decided.select(F.col("shuffle_id").alias("_with"), *names[1:])
    return own.groupBy("_of").cogroup(edges.groupBy("_with")).applyInPandas(wave, _WAVE)


def wave_counters(wave: DataFrame) -> DataFrame:
    """Per shuffle how many edges had each outcome, the steps taken, the cursor after them, and whether nothing is left to wait for.

    That takes a wave that grants nothing, meets nothing that waits and has come by the end of a pass. A
    shuffle without required edges has no steps and is resolved.
    """
    end = F.col("outcome") == "end"
    counted = wave.groupBy("shuffle_id").agg(
        *[
            F.count_if(F.col("outcome") == name).alias(name) for name in ("granted", *COUNTED)
        ], F.max(F.when(end, F.col("position"))).alias("examined"),
        F.max("cursor").alias("cursor"), F.bool_or(F.col("cursor_wrapped")).alias("cursor_wrapped"))
    waiting = sum((F.col(c) for c in COUNTED if c not in ("completed", "failed")), F.col("granted"))
    return counted.withColumn("all_resolved", (waiting == 0) & (F.col("cursor_wrapped") | (F.col("examined") == 0)))


def scheduler_totals(counters: DataFrame, order: str) -> DataFrame:
    """Wave counters with running totals in ascending ``order`` (unique integers): waves planned, grants issued, edges examined, edges skipped as resolved."""
    resolved = F.col("completed") + F.col("failed")
    rows = running_sums(
        counters, order,
        {
            "waves_planned": F.lit(1), "grants_issued": F.col("granted"), "edges_examined": F.col("examined"),
            "edges_skipped_resolved": resolved
        }
    )
    return rows.select(order, "waves_planned", "grants_issued", "edges_examined", "edges_skipped_resolved")


def in_flight(grants: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(shuffle_id, side, id, in_flight) of grants without an outcome; ``outcomes`` has shuffle_id and attempt."""
    open_ = grants.join(outcomes.select("shuffle_id", "attempt"), ["shuffle_id", "attempt"], "left_anti")
    side = lambda name, key: open_.groupBy("shuffle_id", F.col(key).alias("id")).agg(F.count("*").alias("in_flight")).select(
        "shuffle_id", F.lit(name).alias("side"), "id", "in_flight"
    )
    return side("source", "producer_id").unionByName(side("destination", "consumer_id"))

"""The library's queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames
from ..functions.binary import crc32c, digest_hex, is_digest, le_hex
from ..functions.selection import canonical_key, covers, parse_selection, selected_count
from ..functions.text import edge_text, id_code, id_value
from ..operators import commits, ledger, lifecycle, manifests, pressure, scheduler, topology
from ..operators.ranking import running_max
from ..policy import Limits, Policy, policy_problem, policy_text
from ..schemas import AUTHORITY, DEFERRED, ERROR_CODES, EXPLAINED, RECORD_KINDS, RETRIABLE, STATES, error_codes, error_text, retry_class
from ..sources import journal
from ..sources.shared import written
from ..streaming.fold import fold_batches
from . import domain as D

N, SMALL, LOGGED = D.SPACE, D.SMALL, D.LOGGED
POLICY = Policy(max_fan_out=100, max_fan_in=6)
WAVE = Policy(global_limit=12, per_source=3, per_destination=2, max_grants=10, max_examined=400)
_FOUND: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""
    def put(f):
        _FOUND[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f
    return put


def queries() -> dict:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# the same views in SQL
P = """p AS (SELECT s_suppkey + 1 AS producer_id, 1 + CAST(s_suppkey % 3 = 0 AS BIGINT) AS incarnation,
  'loop:' || s_name AS endpoint,
  CASE s_suppkey % 10 WHEN 7 THEN 'Suspect' WHEN 8 THEN 'Failed' WHEN 9 THEN 'Withdrawn' ELSE 'Active' END AS state
    FROM supplier)"""


def C(n: int) -> str:
    return f"""c0 AS (SELECT *, c_custkey % {n} AS k, CASE WHEN c_custkey % 16 = 0 THEN 'All'
      WHEN c_custkey % 2 = 0 THEN 'Range' ELSE 'List' END AS kind FROM customer),
c AS (SELECT c_custkey + 1 AS consumer_id, CAST(1 AS BIGINT) AS incarnation, CASE c_custkey % 11 WHEN 9 THEN 'Suspect'
  WHEN 10 THEN 'Withdrawn' ELSE 'Active' END AS state, 'loop:' || c_name AS endpoint, c_custkey // 64 AS shuffle_id,
  kind,
  CASE WHEN kind = 'Range' THEN k ELSE 0 END AS b, CASE WHEN kind = 'Range' THEN least(k + 8, {n}) ELSE 0 END AS e, CASE
    WHEN kind = 'List' THEN list_sort(list_distinct([k, (k + 5) % {n}])) ELSE [] END AS l FROM c0),
k AS (SELECT *, CASE kind WHEN 'All' THEN 'all' WHEN 'Range' THEN 'range:' || b || ':' || e
  ELSE 'list:' || array_to_string(l, ',') END AS canonical_key,
  CAST(CASE kind WHEN 'All' THEN {n} WHEN 'Range' THEN e - b ELSE len(l) END AS BIGINT) AS selected FROM c)"""


def E_(n: int) -> str:
    return f"""e AS (SELECT shuffle_id, consumer_id, canonical_key, x AS partition FROM (SELECT *, unnest(CASE kind WHEN 'All' THEN range({n}) WHEN 'Range' THEN range(b, e) ELSE l END) AS x FROM k WHERE state <> 'Withdrawn'))"""


def O_(n: int) -> str:
    return f"""a AS (SELECT *, row_number() OVER (ORDER BY producer_id) - 1 AS slot, count(*) OVER () AS active FROM p WHERE state = 'Active'), o AS (SELECT CAST(x.range AS BIGINT) AS partition, producer_id, incarnation, endpoint FROM range({n}) x JOIN a ON x.range % active = slot)"""


_GEN = "1 + (day(ts) - 1) // 10 - CAST(event_id % 40 = 0 AS BIGINT)"
L = f"""lg AS (SELECT event_id AS seq, event_type AS kind, user_id % {LOGGED} AS partition, user_id, {_GEN}
  AS partition_gen, event_id % 25 + 1 AS consumer_id, user_id % {LOGGED} % 7 + 1 AS producer_id,
  1 + CAST(event_id % 70 = 5 AS BIGINT) AS producer_incarnation, 1 + CAST(event_id % 90 = 7 AS BIGINT) AS shuffle_gen,
  sha256(concat(user_id % {LOGGED}, ':', {_GEN}, CASE WHEN event_id % 50 = 1 THEN ':x'
    ELSE '' END)) AS digest, 1000 + user_id % {LOGGED} + CAST(event_id % 60 = 2 AS BIGINT) AS bytes, event_id % 20 <> 3
    AS integrity,
  least(100, CAST(floor(value) AS BIGINT)) AS level FROM events)"""
FOLD = L + """,
f0 AS (SELECT *, kind <> 'view' AS is_commit, CASE WHEN kind = 'view' THEN 'Ok'
  WHEN partition_gen = 0 THEN 'InvalidArgument' WHEN NOT integrity THEN 'IntegrityFailure'
  WHEN shuffle_gen <> 1 THEN 'StaleGeneration' ELSE 'Ok' END AS loc FROM lg
  WHERE kind IN ('click', 'purchase', 'view')),
f1 AS (SELECT *, coalesce(max(CASE WHEN loc = 'Ok' THEN partition_gen END) OVER (PARTITION BY partition
  ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > partition_gen AS stale FROM f0),
f2 AS (SELECT *, loc = 'Ok' AND NOT stale AS open FROM f1 WHERE is_commit),
f3 AS (SELECT *, first_value(digest) OVER w AS ad, first_value(producer_incarnation) OVER w AS ai, first_value(bytes)
  OVER w AS ab FROM f2 WINDOW w AS (PARTITION BY partition, partition_gen, open ORDER BY seq)),
f4 AS (SELECT *, CASE WHEN loc <> 'Ok' THEN loc WHEN stale THEN 'StaleGeneration'
  WHEN digest <> ad OR producer_incarnation <> ai THEN 'DivergentCommit' WHEN bytes <> ab THEN 'AccountingMismatch'
  ELSE 'Ok' END AS error_code FROM f3),
fold AS (SELECT *, CASE WHEN error_code <> 'Ok' THEN 'refused'
  WHEN row_number() OVER (PARTITION BY partition, partition_gen, error_code = 'Ok' ORDER BY seq) = 1 THEN 'new'
  WHEN row_number() OVER (PARTITION BY partition, partition_gen, consumer_id, error_code = 'Ok'
    ORDER BY seq) = 1 THEN 'edge' ELSE 'duplicate' END AS outcome FROM f4)"""


def _class_sql(code: str) -> str:
    return f"""CASE WHEN {code} = 'Ok' THEN 'NotApplicable' WHEN {code} IN {RETRIABLE} THEN 'Retriable' WHEN {code} IN {DEFERRED} THEN 'Deferred' WHEN {code} IN {AUTHORITY} THEN 'Authority' ELSE 'Permanent' END"""


FAIL = f"""fl0 AS (SELECT seq, partition, partition_gen, consumer_id,
  {list(D.FAILURE_CODES)}[seq % {len(D.FAILURE_CODES)} + 1] AS code, seq % 4 + 1 AS attempts, seq AS tick FROM lg
  WHERE kind = 'error'),
fl1 AS (SELECT *, {_class_sql('code')} AS retry_class FROM fl0),
judged AS (SELECT *, retry_class IN ('Authority', 'Permanent') OR attempts >= 3 AS permanent, CASE
  WHEN retry_class = 'Deferred' THEN 'InvalidArgument' ELSE 'Ok' END AS error_code FROM fl1),
fails AS (SELECT partition, partition_gen, consumer_id, max_by(code, seq) AS code, max_by(permanent, seq) AS permanent,
  max_by(attempts, seq) AS attempts, max_by(tick, seq) AS ready_at FROM judged WHERE error_code = 'Ok' GROUP BY ALL)"""
LATEST = """latest AS (SELECT partition, max(partition_gen) AS latest FROM (SELECT partition, partition_gen FROM fold WHERE outcome = 'new' UNION ALL SELECT partition, partition_gen FROM lg WHERE kind = 'view') GROUP BY partition)"""
RETAIN = """retain AS (SELECT partition, partition_gen, dense_rank() OVER (PARTITION BY partition ORDER BY partition_gen DESC) <= 2 AS retained FROM fold WHERE outcome = 'new')"""
NOW = """cur AS (SELECT partition, latest AS partition_gen FROM latest),
done AS (SELECT f.* FROM fold f JOIN cur USING (partition, partition_gen) WHERE outcome IN ('new', 'edge')),
lost AS (SELECT x.* FROM fails x JOIN cur USING (partition, partition_gen) WHERE permanent AND NOT EXISTS (SELECT 1
  FROM done d WHERE d.partition = x.partition AND d.partition_gen = x.partition_gen
  AND d.consumer_id = x.consumer_id))"""


def _state(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The folded event log. The fold is written once, for most of what asks for it reads it several times."""
    log = D.event_log(spark, d)
    folded = written(ledger.fold_commits(D.commit_log(log), LOGGED, manifests=D.manifest_log(log)), "commit-fold")
    judged = ledger.judge_failures(D.failure_log(log), LOGGED)
    latest = ledger.latest_generations(folded.filter("outcome = 'new'"), D.manifest_log(log))
    return {
        "log": log, "folded": folded, "judged": judged,
        "failures": ledger.last_failures(judged.filter("error_code = 'Ok'")), "latest": latest,
        "retained": ledger.retained_generations(folded)
    }


# -- topology ------------------------------------------------------------------------------------


@query(
    f"""WITH {C(N)}, g AS (SELECT canonical_key, count(*) AS n, min(selected) AS s FROM k WHERE state <> 'Withdrawn' GROUP BY 1) SELECT CAST(sum(n * s) AS BIGINT) AS planned_edges, count(*) AS pattern_count, 'Ok' AS error_code FROM g"""
)
def planned_edges(spark: SparkSession, d: str) -> DataFrame:
    return topology.planned_edges(D.consumers(spark, d), N)


@query(f"WITH {C(N)}, {E_(N)} SELECT CAST(partition AS BIGINT) AS partition, consumer_id FROM e")
def edge_expansion(spark: SparkSession, d: str) -> DataFrame:
    return topology.edges(D.consumers(spark, d), N)


@query(
    f"""WITH {C(N)} SELECT consumer_id, consumer_id * 7 % {N} AS partition, CASE kind WHEN 'All' THEN true WHEN 'Range' THEN consumer_id * 7 % {N} >= b AND consumer_id * 7 % {N} < e ELSE list_contains(l, consumer_id * 7 % {N}) END AS covered FROM k"""
)
def selection_covers(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("consumer_id") * 7 % N
    return D.consumers(spark, d).select(
        "consumer_id", p.alias("partition"), covers(F.col("selection"), p).alias("covered")
    )


@query(f"WITH {C(N)} SELECT consumer_id, selected FROM k")
def selected_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.consumers(spark, d).select("consumer_id", selected_count(F.col("selection"), N).alias("selected"))


@query(f"WITH {C(N)} SELECT consumer_id, canonical_key FROM k")
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    return D.consumers(spark, d).select("consumer_id", canonical_key(F.col("selection")).alias("canonical_key"))


@query(
    f"""WITH {C(N)} SELECT consumer_id, canonical_key, kind, CAST(b AS BIGINT) AS range_begin, CAST(e AS BIGINT) AS range_end, len(l) AS listed FROM k"""
)
def selection_parse(spark: SparkSession, d: str) -> DataFrame:
    """Selections read back from their text."""
    rows = D.consumers(spark, d).select("consumer_id", canonical_key(F.col("selection")).alias("canonical_key"))
    s = F.col("s")
    return rows.withColumn("s", parse_selection(F.col("canonical_key"))).select(
        "consumer_id", "canonical_key", s["kind"].alias("kind"), s["begin"].alias("range_begin"),
        s["end"].alias("range_end"), F.size(s["list"]).cast("long").alias("listed")
    )


@query(
    f"""WITH {C(N)} SELECT canonical_key, count(*) AS consumers, min(consumer_id) AS first_consumer, min(selected) AS selected FROM k WHERE state <> 'Withdrawn' GROUP BY 1"""
)
def pattern_intern(spark: SparkSession, d: str) -> DataFrame:
    return topology.patterns(D.consumers(spark, d), N).select(
        "canonical_key", "consumers", "first_consumer", "selected"
    )


@query(f"WITH {P}, {O_(N)} SELECT partition, producer_id, incarnation, endpoint FROM o")
def ownership(spark: SparkSession, d: str) -> DataFrame:
    return topology.owners(D.producers(spark, d), N)


@query(
    f"""WITH {C(N)}, {E_(N)} SELECT CAST(r.range AS BIGINT) AS partition, count(consumer_id) AS fan_out FROM range({N}) r LEFT JOIN e ON e.partition = r.range GROUP BY 1"""
)
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    return topology.fan_out(D.consumers(spark, d), N)


_FAN_IN = f"""fi AS (SELECT k.consumer_id, count(DISTINCT x % act) AS fan_in FROM (SELECT *, unnest(CASE kind WHEN 'All' THEN range({N}) WHEN 'Range' THEN range(b, e) ELSE l END) AS x FROM k) k, (SELECT count(*) AS act FROM p WHERE state = 'Active') GROUP BY 1)"""


@query(f"WITH {P}, {C(N)}, {_FAN_IN} SELECT consumer_id, fan_in FROM fi")
def fan_in(spark: SparkSession, d: str) -> DataFrame:
    return topology.fan_in(D.consumers(spark, d), D.producers(spark, d), N)


@query(f"""WITH {P}, {C(N)}, {E_(N)}, {_FAN_IN}, fo AS (SELECT partition, count(*) AS n FROM e
  GROUP BY 1 HAVING count(*) > {POLICY.max_fan_out} ORDER BY 1 LIMIT 8), fx AS (SELECT * FROM fi
  WHERE fan_in > {POLICY.max_fan_in} ORDER BY 1 LIMIT 8)
SELECT 'FanOutCeilingExceeded' AS code, 'partition ' || partition AS subject,
  'fan-out ' || n || ' exceeds max_fan_out {POLICY.max_fan_out}' AS detail FROM fo
UNION ALL SELECT 'FanInCeilingExceeded', 'consumer ' || consumer_id,
  'fan-in ' || fan_in || ' exceeds max_fan_in {POLICY.max_fan_in}' FROM fx""")
def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    return topology.policy_violations(D.consumers(spark, d), D.producers(spark, d), N, POLICY)


@query(
    f"""WITH {P}, {C(N)} SELECT 'Producer' AS kind, count(*) AS registered, count(*) FILTER (state = 'Active') AS active FROM p UNION ALL SELECT 'Consumer', count(*), count(*) FILTER (state = 'Active') FROM c"""
)
def active_counts(spark: SparkSession, d: str) -> DataFrame:
    return topology.active_counts(D.producers(spark, d), D.consumers(spark, d))


@query(f"""WITH {P}, r AS (SELECT CASE WHEN s_suppkey % 23 = 5 THEN 0 ELSE s_suppkey + 1 END AS producer_id, CASE
  WHEN s_suppkey % 19 = 4 THEN 0 ELSE 1 + CAST(s_suppkey % 3 = 0 AS BIGINT) END AS incarnation,
  CASE WHEN s_suppkey % 17 = 3 THEN repeat('x', 300) WHEN s_suppkey % 13 = 2 THEN 'moved'
    ELSE 'loop:' || s_name END AS endpoint FROM supplier)
SELECT r.producer_id, r.incarnation, r.endpoint, CASE WHEN r.producer_id = 0 OR r.incarnation = 0 THEN 'InvalidArgument'
  WHEN strlen(r.endpoint) > 256 THEN 'OversizedInput'
  WHEN p.incarnation = r.incarnation AND p.endpoint <> r.endpoint THEN 'IdentityMismatch' ELSE 'Ok' END AS error_code
FROM r LEFT JOIN p USING (producer_id)""")
def producer_registration_checks(spark: SparkSession, d: str) -> DataFrame:
    s = D.table(spark, d, "supplier")
    requests = s.select(
        F.expr("CASE WHEN s_suppkey % 23 = 5 THEN 0 ELSE s_suppkey + 1 END").alias("producer_id"),
        F.expr(
            "CASE WHEN s_suppkey % 19 = 4 THEN 0 ELSE 1 + CAST(s_suppkey % 3 = 0 AS BIGINT) END"
        ).alias("incarnation"),
        F.expr(
            """CASE WHEN s_suppkey % 17 = 3 THEN repeat('x', 300) WHEN s_suppkey % 13 = 2 THEN 'moved' ELSE concat('loop:', s_name) END"""
        ).alias("endpoint")
    )
    return topology.check_producers(requests, D.producers(spark, d), POLICY)


@query(f"""WITH r AS (SELECT c_custkey + 1 AS consumer_id, CASE WHEN c_custkey % 17 = 0 THEN 0
  ELSE 1 END AS incarnation, c_custkey % 262 AS b, c_custkey % 262 + (c_custkey % 31 <> 1)::INT * 8 AS e, c_custkey % 3
  AS t FROM customer),
q AS (SELECT *, CASE WHEN t = 0 THEN 'all' WHEN t = 1 THEN 'range:' || b || ':' || e
  ELSE 'list:' || b || ',' || (b + 1) END AS canonical_key FROM r),
o AS (SELECT *, CASE WHEN incarnation = 0 THEN 'InvalidArgument' WHEN t = 1 AND b >= e THEN 'InvalidArgument'
  WHEN t = 1 AND e > {N} THEN 'UnknownPartition' WHEN t = 2 AND b + 1 >= {N} THEN 'UnknownPartition'
  ELSE 'Ok' END AS code FROM q),
m AS (SELECT canonical_key, row_number() OVER (ORDER BY min(consumer_id)) AS n FROM o WHERE code = 'Ok' GROUP BY 1)
SELECT consumer_id, canonical_key, CASE WHEN code = 'Ok' AND n > 40 THEN 'TooManyPatterns' ELSE code END AS error_code
  FROM o LEFT JOIN m USING (canonical_key)""")
def consumer_registration_checks(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.selection import selection
    t = D.table(spark, d, "customer").select(
        "c_custkey", F.expr("c_custkey % 262").alias("b"),
        F.expr("c_custkey % 262 + CAST(c_custkey % 31 <> 1 AS INT) * 8").alias("e"), F.expr("c_custkey % 3").alias("t")
    )
    kind = F.when(F.col("t") == 0, "All").when(F.col("t") == 1, "Range").otherwise("List")
    members = F.when(F.col("t") == 2, F.array("b", F.col("b") + 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    requests = t.select(
        (F.col("c_custkey") + 1).alias("consumer_id"),
        F.expr("CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 1 END").alias("incarnation"), F.lit("loop").alias("endpoint"),
        selection(kind, F.col("b"), F.col("e"), members).alias("selection")
    )
    return topology.check_consumers(requests, N, Policy(limits=Limits(max_selection_patterns=40)))


@query(f"""WITH {P}, {C(N)}, {L}, who AS (SELECT 'Producer' AS kind, producer_id AS id, incarnation FROM p UNION ALL
  SELECT 'Consumer', consumer_id, incarnation FROM c),
r AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN 'Producer'
  ELSE 'Consumer' END AS kind, user_id % 300 AS id, 1 + CAST(seq % 7 = 0 AS BIGINT) AS inc, ['Active', 'Suspect',
  'Gone', 'Withdrawn', 'Failed'][seq % 5 + 1] AS state FROM lg)
SELECT seq, r.kind, r.id, r.state, CASE WHEN state NOT IN {STATES} THEN 'InvalidArgument'
  WHEN r.id = 0 THEN 'InvalidArgument' WHEN who.incarnation IS NULL THEN 'UnknownParticipant'
  WHEN who.incarnation <> inc THEN 'StaleIncarnation' ELSE 'Ok' END AS error_code FROM r LEFT
  JOIN who USING (kind, id)""")
def state_change_checks(spark: SparkSession, d: str) -> DataFrame:
    states = F.array(*map(F.lit, ("Active", "Suspect", "Gone", "Withdrawn", "Failed")))
    log = D.event_log(spark, d).select(
        "seq", F.expr("CASE WHEN seq % 2 = 0 THEN 'Producer' ELSE 'Consumer' END").alias("kind"),
        F.expr("user_id % 300").alias("id"), F.expr("1 + CAST(seq % 7 = 0 AS BIGINT)").alias("incarnation"),
        F.get(states, F.expr("CAST(seq % 5 AS INT)")).alias("state")
    )
    return topology.check_state_changes(log, D.participants(D.producers(spark, d), D.consumers(spark, d)))


@query(f"""WITH {L}, r AS (SELECT seq, user_id AS id, 1 + seq // 3000 AS incarnation FROM lg
  WHERE kind = 'signup'), m AS (SELECT *, coalesce(incarnation <> lag(incarnation) OVER (PARTITION BY id
  ORDER BY seq), false) AS ch FROM r)
SELECT id, max_by(incarnation, seq) AS incarnation, count(*) AS registrations, count(*) FILTER (ch) AS superseded FROM m
  GROUP BY id""")
def registration_fold(spark: SparkSession, d: str) -> DataFrame:
    return topology.registration_fold(
        D.event_log(spark, d).filter("kind = 'signup'").select(
            "seq", F.col("user_id").alias("id"), F.expr("1 + seq div 3000").alias("incarnation")
        )
    )


@query(f"""WITH {L}, r AS (SELECT seq, user_id AS id, kind AS state FROM lg), m AS (SELECT *, CASE
  WHEN lag(state) OVER (PARTITION BY id ORDER BY seq) IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS ch FROM r)
SELECT seq, CAST(sum(ch) OVER (ORDER BY seq) AS BIGINT) AS generation FROM m""")
def topology_generation(spark: SparkSession, d: str) -> DataFrame:
    return topology.topology_generation(
        D.event_log(spark, d).select("seq", F.col("user_id").alias("id"), F.col("kind").alias("state"))
    )


@query(
    """SELECT event_id AS seq, max(CASE WHEN event_id % 9 = 4 THEN event_id - 20 ELSE event_id END) OVER (ORDER BY event_id) AS clock FROM events"""
)
def logical_clock(spark: SparkSession, d: str) -> DataFrame:
    log = D.event_log(spark, d).select("seq")
    return running_max(
        log, "seq", F.expr("CASE WHEN seq % 9 = 4 THEN seq - 20 ELSE seq END"), "clock"
    ).select("seq", "clock")


# -- manifests -----------------------------------------------------------------------------------

CHUNK = 256
_CH = f"""d AS (SELECT doc_id AS partition, encode(coalesce(text, '')) AS payload FROM documents),
ch AS (SELECT partition, k AS chunk_id, k * {CHUNK} AS "offset",
  CAST(octet_length(payload[k * {CHUNK} + 1:(k + 1) * {CHUNK}]) AS BIGINT) AS length,
  sha256(payload[k * {CHUNK} + 1:(k + 1) * {CHUNK}]) AS digest
  FROM (SELECT *, unnest(range((octet_length(payload) + {CHUNK - 1}) // {CHUNK})) AS k FROM d))"""


@query(f"WITH {_CH} SELECT partition, chunk_id, \"offset\", length, digest FROM ch")
def chunk_manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifests.chunk_rows(D.contents(spark, d), CHUNK)


@query(f"""WITH {_CH}, s AS (SELECT partition, chunk_id, CASE WHEN partition % 7 = 3 AND chunk_id = 1 THEN length - 1
  ELSE length END AS len2, CASE WHEN partition % 5 = 2 AND chunk_id >= 1 THEN sha256('x')
  ELSE digest END AS dig2, length, digest FROM ch WHERE NOT (partition % 11 = 6 AND chunk_id = 2)),
j AS (SELECT ch.partition, ch.chunk_id, CASE WHEN len2 IS NULL OR len2 <> ch.length THEN 'IntegrityFailure'
  WHEN dig2 <> ch.digest THEN 'DigestMismatch' ELSE 'Ok' END AS code FROM ch LEFT JOIN s USING (partition, chunk_id))
SELECT partition, coalesce(min(chunk_id) FILTER (code <> 'Ok'), -1) AS failing_chunk, coalesce(min_by(code,
  chunk_id) FILTER (code <> 'Ok'), 'Ok') AS error_code FROM j GROUP BY 1""")
def chunk_verify(spark: SparkSession, d: str) -> DataFrame:
    declared = manifests.chunk_rows(D.contents(spark, d), CHUNK)
    observed = declared.filter("NOT (partition % 11 = 6 AND chunk_id = 2)").withColumns(
        {
            "length": F.expr("CASE WHEN partition % 7 = 3 AND chunk_id = 1 THEN length - 1 ELSE length END"),
            "digest": F.expr("CASE WHEN partition % 5 = 2 AND chunk_id >= 1 THEN sha2('x', 256) ELSE digest END")
        }
    )
    return manifests.verify_chunks(declared, observed).fillna(-1, ["failing_chunk"])


@query(f"""WITH {_CH}, h AS (SELECT partition, CAST(partition % 29 <> 4 AS BIGINT) AS shuffle, CASE
  WHEN partition % 31 = 5 THEN 0 ELSE 1 END AS producer_id, octet_length(payload) + CAST(partition % 13 = 8 AS BIGINT)
  AS total_bytes FROM d),
b AS (SELECT partition, chunk_id AS position, CASE WHEN partition % 17 = 9 AND chunk_id = 1 THEN 5
  ELSE chunk_id END AS chunk_id, "offset" + CAST(partition % 19 = 7 AND chunk_id = 2 AS BIGINT) AS "offset", CASE
  WHEN partition % 23 = 1 AND chunk_id = 0 THEN 20000000 ELSE length END AS length, digest FROM ch),
w AS (SELECT *, coalesce(lag("offset" + length) OVER (PARTITION BY partition ORDER BY position), 0) AS expected FROM b),
r AS (SELECT *, CASE WHEN chunk_id <> position THEN 'ManifestInconsistent' WHEN length = 0 THEN 'ManifestInconsistent'
  WHEN length > 16777216 THEN 'OversizedInput' WHEN "offset" <> expected THEN 'ManifestInconsistent'
  ELSE 'Ok' END AS rule FROM w),
g AS (SELECT partition, count(*) AS n, min_by(rule, position) FILTER (rule <> 'Ok') AS first, max_by("offset" + length,
  position) AS stop FROM r GROUP BY 1)
SELECT h.partition, CASE WHEN n IS NULL OR total_bytes = 0 OR shuffle = 0 OR producer_id = 0 THEN 'ManifestInconsistent'
  WHEN first = 'OversizedInput' THEN 'OversizedInput'
  WHEN first IS NOT NULL OR stop <> total_bytes THEN 'ManifestInconsistent' ELSE 'Ok' END AS error_code FROM h LEFT
  JOIN g USING (partition)""")
def manifest_validate(spark: SparkSession, d: str) -> DataFrame:
    content = D.contents(spark, d)
    headers = content.select(
        "partition", F.expr("CAST(partition % 29 <> 4 AS BIGINT)").alias("shuffle"),
        F.expr("CASE WHEN partition % 31 = 5 THEN 0 ELSE 1 END").alias("producer_id"),
        F.expr("octet_length(payload) + CAST(partition % 13 = 8 AS BIGINT)").alias("total_bytes")
    )
    chunks = manifests.chunk_rows(content, CHUNK).withColumn("position", F.col("chunk_id")).withColumns(
        {
            "chunk_id": F.expr("CASE WHEN partition % 17 = 9 AND position = 1 THEN 5 ELSE position END"),
            "offset": F.expr("offset + CAST(partition % 19 = 7 AND position = 2 AS BIGINT)"),
            "length": F.expr("CASE WHEN partition % 23 = 1 AND position = 0 THEN 20000000 ELSE length END")
        }
    )
    return manifests.validate_manifests(headers, chunks)


def _le(value: str, size: int) -> str:
    return "(" + " || ".join(
        f"substr(lpad(printf('%x', CAST({value} AS BIGINT)), {2 * size}, '0'), {2 * (size - i) - 1}, 2)" for i in range(size)
    ) + ")"


_BODY = f"""bd AS (SELECT partition, count(*) AS n, CAST(sum(length) AS BIGINT) AS total, string_agg({_le('chunk_id', 8)} || {_le('"offset"', 8)} || {_le('length', 4)} || digest, '' ORDER BY chunk_id) AS body FROM ch GROUP BY 1)"""


@query(
    f"""WITH {_CH}, {_BODY} SELECT partition, total AS total_bytes, n AS chunks, sha256(unhex({_le('total', 8)} || {_le('n', 4)} || body)) AS partition_digest FROM bd"""
)
def partition_digest(spark: SparkSession, d: str) -> DataFrame:
    return manifests.partition_digests(manifests.chunk_rows(D.contents(spark, d), CHUNK))


@query(
    f"""WITH {_CH}, {_BODY} SELECT partition, sha256(unhex({_le('1', 8)} || {_le('1', 8)} || {_le('partition', 8)} || {_le('1', 8)} || {_le('partition % 7 + 1', 8)} || {_le('1', 8)} || {_le('3', 8)} || {_le('total', 8)} || {_le('n', 4)} || body)) AS manifest_digest FROM bd"""
)
def manifest_digest(spark: SparkSession, d: str) -> DataFrame:
    content = D.contents(spark, d)
    one = F.lit(1).cast("long")
    headers = content.select(
        one.alias("shuffle"), one.alias("shuffle_gen"), "partition", one.alias("partition_gen"),
        (F.col("partition") % 7 + 1).alias("producer_id"), one.alias("producer_incarnation"),
        F.lit(3).alias("topology_gen"), F.octet_length("payload").alias("total_bytes")
    )
    return manifests.manifest_digests(headers, manifests.chunk_rows(content, CHUNK))


_ADMIT = f"""ad0 AS (SELECT m.*, o.producer_id AS owner, p.incarnation AS pinc, p.state AS pstate
  FROM (SELECT seq, partition, partition_gen, CASE WHEN seq % 8 = 0 THEN seq % 9 + 1
  ELSE own.producer_id END AS producer_id, own.incarnation + CAST(seq % 21 = 5 AS BIGINT) AS producer_incarnation,
  shuffle_gen, digest FROM lg LEFT JOIN (SELECT * FROM o) own USING (partition) WHERE kind = 'view') m LEFT
  JOIN o USING (partition) LEFT JOIN p ON p.producer_id = m.producer_id),
ad1 AS (SELECT *, CASE WHEN shuffle_gen <> 1 THEN 'StaleGeneration'
  WHEN owner IS NULL OR owner <> producer_id THEN 'PartitionNotOwned' WHEN pinc IS NULL THEN 'UnknownParticipant'
  WHEN pinc <> producer_incarnation THEN 'StaleIncarnation' WHEN pstate <> 'Active' THEN 'ParticipantNotActive'
  ELSE 'Ok' END AS loc FROM ad0),
ad2 AS (SELECT *, max(CASE WHEN loc = 'Ok' THEN partition_gen END) OVER (PARTITION BY partition
  ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, first_value(digest)
  OVER (PARTITION BY partition, partition_gen, loc = 'Ok' ORDER BY seq) AS fd FROM ad1),
adm AS (SELECT seq, partition, partition_gen, CASE WHEN loc <> 'Ok' THEN loc
  WHEN top > partition_gen THEN 'StaleGeneration' WHEN fd <> digest THEN 'DivergentCommit' ELSE 'Ok' END AS error_code
  FROM ad2)"""


def _admitted(spark: SparkSession, d: str) -> DataFrame:
    producers = D.producers(spark, d)
    owners = topology.owners(producers, LOGGED)
    own = owners.select("partition", F.col("producer_id").alias("_p"), F.col("incarnation").alias("_i"))
    log = D.manifest_log(D.event_log(spark, d)).join(own, "partition", "left").withColumns(
        {
            "producer_id": F.expr("CASE WHEN seq % 8 = 0 THEN seq % 9 + 1 ELSE _p END"),
            "producer_incarnation": F.expr("_i + CAST(seq % 21 = 5 AS BIGINT)")
        }
    ).drop("_p", "_i")
    return manifests.admit_manifests(log, owners, producers, LOGGED)


@query(f"WITH {P}, {O_(LOGGED)}, {L}, {_ADMIT} SELECT seq, partition, partition_gen, error_code FROM adm")
def manifest_admission(spark: SparkSession, d: str) -> DataFrame:
    return _admitted(spark, d)


@query(
    f"""WITH {P}, {O_(LOGGED)}, {L}, {_ADMIT}, s AS (SELECT *, max(partition_gen) OVER (PARTITION BY partition ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM adm WHERE error_code = 'Ok') SELECT seq, partition, partition_gen, CASE WHEN last < partition_gen THEN last ELSE -1 END AS supersedes FROM s"""
)
def manifest_supersession(spark: SparkSession, d: str) -> DataFrame:
    return manifests.supersession(_admitted(spark, d).filter("error_code = 'Ok'")).fillna(-1, ["supersedes"])


@query(
    f"""WITH {L} SELECT CAST(r.range AS BIGINT) AS partition FROM range({LOGGED}) r WHERE r.range NOT IN (SELECT partition FROM lg WHERE kind = 'view' AND user_id % 3 = 0)"""
)
def missing_partitions(spark: SparkSession, d: str) -> DataFrame:
    return manifests.missing_partitions(D.event_log(spark, d).filter("kind = 'view' AND user_id % 3 = 0"), LOGGED)


@query(f"""WITH r AS (SELECT o_orderkey AS partition, 40 + o_orderkey % 60 AS size
  FROM orders), b AS (SELECT partition, size, unnest(range((size + 31) // 32)) AS k FROM r),
h AS (SELECT partition, size, string_agg(sha256(unhex({_le('1', 8)} || {_le('1', 8)} || {_le('partition', 8)} ||
  {_le('1', 8)} || {_le('k', 8)})), '' ORDER BY k) AS body FROM b GROUP BY 1, 2)
SELECT partition, size, substr(body, 1, size * 2) AS payload_hex FROM h""")
def synthetic_payload(spark: SparkSession, d: str) -> DataFrame:
    one = F.lit(1).cast("long")
    rows = D.table(spark, d, "orders").select(
        one.alias("shuffle"), one.alias("shuffle_gen"), F.col("o_orderkey").alias("partition"),
        one.alias("partition_gen"), (40 + F.col("o_orderkey") % 60).alias("size")
    )
    return manifests.synthetic_payload(rows)


# -- the ledger ----------------------------------------------------------------------------------


@query(f"WITH {FOLD}, {LATEST} SELECT partition, latest FROM latest")
def latest_generation(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)["latest"]


@query(f"WITH {FOLD} SELECT seq, partition, partition_gen, consumer_id, error_code, outcome FROM fold")
def commit_fold(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)["folded"].select(
        "seq", "partition", "partition_gen", "consumer_id", "error_code", "outcome"
    )


@query(
    f"""WITH {FOLD}, n AS (SELECT partition, partition_gen, row_number() OVER (ORDER BY seq) AS commit_sequence FROM fold WHERE outcome = 'new') SELECT seq, commit_sequence, outcome = 'duplicate' AS duplicate, CASE WHEN outcome = 'new' THEN bytes ELSE 0 END AS bytes_counted FROM fold JOIN n USING (partition, partition_gen) WHERE outcome <> 'refused'"""
)
def commit_receipts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.commit_receipts(_state(spark, d)["folded"])


@query(f"WITH {FOLD}, {RETAIN} SELECT partition, partition_gen, retained FROM retain")
def retained_generations(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)["retained"]


@query(
    f"""WITH {FOLD} SELECT partition, partition_gen, count(*) FILTER (outcome IN ('new', 'edge')) AS consumers, string_agg(CAST(consumer_id AS VARCHAR), ',' ORDER BY consumer_id) FILTER (outcome IN ('new', 'edge')) AS consumer_list, min(bytes) FILTER (outcome = 'new') AS bytes FROM fold WHERE outcome <> 'refused' GROUP BY 1, 2"""
)
def commit_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per committed generation with its ascending consumers (at most one of each)."""
    done = F.col("outcome").isin("new", "edge")
    listed = F.array_join(F.array_sort(F.collect_set(F.when(done, F.col("consumer_id")))).cast("array<string>"), ",")
    return _state(spark, d)["folded"].filter("outcome <> 'refused'").groupBy("partition", "partition_gen").agg(
        F.count_if(done).alias("consumers"), listed.alias("consumer_list"),
        F.min(F.when(F.col("outcome") == "new", F.col("bytes"))).alias("bytes")
    )


@query(f"WITH {L}, {FAIL} SELECT partition, partition_gen, consumer_id, code, permanent, attempts, ready_at FROM fails")
def failures_last(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)["failures"]


@query(f"WITH {L}, {FAIL} SELECT seq, code, retry_class FROM fl1")
def retry_classification(spark: SparkSession, d: str) -> DataFrame:
    log = D.failure_log(D.event_log(spark, d))
    return log.join(
        F.broadcast(error_codes(spark).select(F.col("name").alias("code"), "retry_class")), "code"
    ).select("seq", "code", "retry_class")


@query(
    f"""WITH {L}, {FAIL} SELECT seq, error_code, permanent, tick AS ready_at, CASE WHEN error_code <> 'Ok' THEN 'refused' WHEN retry_class = 'Authority' THEN 'AuthorityRefused' WHEN permanent THEN 'PermanentFailure' ELSE 'RetriableFailure' END AS outcome FROM judged"""
)
def failure_permanence(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)["judged"].select("seq", "error_code", "permanent", "ready_at", "outcome")


_STATUS = """st AS (SELECT w.partition, w.partition_gen, w.consumer_id, CASE
  WHEN dn.partition IS NOT NULL THEN 'Completed' WHEN permanent THEN 'Failed'
  WHEN w.partition_gen < latest THEN 'Purged' ELSE 'Pending' END AS phase,
  CASE WHEN dn.partition IS NOT NULL THEN 'Ok' WHEN permanent THEN code
    WHEN w.partition_gen < latest THEN 'PurgedHistory'
    ELSE coalesce(code, 'NotCommitted') END AS reason, coalesce(attempts, 0) AS attempts, coalesce(ready_at, 0)
    AS ready_at
  FROM (SELECT DISTINCT partition, partition_gen, consumer_id FROM lg) w LEFT
    JOIN (SELECT f.partition, f.partition_gen, f.consumer_id FROM fold f
    JOIN retain r ON r.partition = f.partition AND r.partition_gen = f.partition_gen AND retained
    WHERE outcome IN ('new', 'edge')) dn USING (partition, partition_gen, consumer_id)
  LEFT JOIN fails USING (partition, partition_gen, consumer_id) LEFT JOIN latest USING (partition))"""


@query(f"WITH {FOLD}, {FAIL}, {LATEST}, {RETAIN}, {_STATUS} SELECT * FROM st")
def edge_status(spark: SparkSession, d: str) -> DataFrame:
    s = _state(spark, d)
    wanted = s["log"].select("partition", "partition_gen", "consumer_id").distinct()
    return ledger.edge_status(
        wanted, ledger.committed_edges(s["folded"]), s["failures"], s["latest"], s["retained"], LOGGED
    )


_MEASURES = f"""pr AS (SELECT (SELECT CAST(sum(selected) AS BIGINT) FROM k
  WHERE state <> 'Withdrawn') AS edges_required, (SELECT count(*)
  FROM done) AS edges_completed, (SELECT count(DISTINCT partition) FROM done) AS partitions_committed,
  (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM fold JOIN cur USING (partition, partition_gen)
    WHERE outcome = 'new') AS bytes_committed, (SELECT count(*) FROM lost) AS edges_failed,
  (SELECT count(DISTINCT partition) FROM lost WHERE partition NOT IN (SELECT partition
    FROM done)) AS partitions_failed, (SELECT count(*) FROM fold
    WHERE outcome = 'duplicate') AS duplicate_commits_suppressed, (SELECT CAST(sum(bytes) AS BIGINT)
    FROM fold) AS bytes_attempted,
  (SELECT count(*) FROM fails WHERE permanent) AS permanent_failures, (SELECT count(*) FROM fails
    WHERE NOT permanent) AS retriable_failures, (SELECT count(*) FROM judged
    WHERE error_code = 'Ok' AND retry_class = 'Authority') AS authority_refusals),
pr2 AS (SELECT *, CAST({LOGGED} AS BIGINT) AS partitions_total,
  greatest({LOGGED} - partitions_committed - partitions_failed, 0) AS partitions_incomplete,
  greatest(edges_required - edges_completed - edges_failed, 0) AS edges_incomplete,
  greatest(edges_completed + edges_failed - edges_required, 0) AS edges_over_counted FROM pr)"""


def _progress(spark: SparkSession, d: str) -> DataFrame:
    s = _state(spark, d)
    return ledger.progress(
        topology.planned_edges(D.consumers(spark, d, LOGGED), LOGGED), s["folded"], s["failures"], s["judged"],
        s["latest"], LOGGED
    )


@query(
    f"""WITH {C(LOGGED)}, {FOLD}, {FAIL}, {LATEST}, {NOW}, {_MEASURES} SELECT *, edges_over_counted = 0 AND edges_completed + edges_failed + edges_incomplete = edges_required AS closes FROM pr2"""
)
def progress(spark: SparkSession, d: str) -> DataFrame:
    return _progress(spark, d)


@query(f"""WITH {FOLD}, {FAIL}, {LATEST}, {NOW}, q AS (SELECT partition, consumer_id
  FROM range({LOGGED}) r(partition), (SELECT DISTINCT consumer_id FROM lg))
SELECT q.partition, count(*) AS required, count(d.seq) AS completed, count(x.code) AS failed,
  count(*) - count(d.seq) - count(x.code) AS incomplete, true AS closes FROM q LEFT
  JOIN done d ON d.partition = q.partition AND d.consumer_id = q.consumer_id LEFT
  JOIN lost x ON x.partition = q.partition AND x.consumer_id = q.consumer_id GROUP BY 1""")
def closure(spark: SparkSession, d: str) -> DataFrame:
    """Per partition, where every consumer of the log requires every partition: completed, failed and incomplete add up."""
    s = _state(spark, d)
    now = s["latest"].withColumnRenamed("latest", "partition_gen")
    done = ledger.committed_edges(s["folded"]).join(now, ["partition", "partition_gen"], "left_semi")
    lost = s["failures"].filter("permanent").join(now, ["partition", "partition_gen"], "left_semi").join(
        done.select(*ledger.COMMIT), [*ledger.COMMIT], "left_anti"
    )
    required = s["log"].agg(F.countDistinct("consumer_id").alias("required"))
    count = lambda df, name: df.groupBy("partition").agg(F.count("*").alias(name))
    rows = spark.range(LOGGED).withColumnRenamed("id", "partition").join(
        count(done, "completed"), "partition", "left"
    ).join(count(lost, "failed"), "partition", "left").fillna(0, ["completed", "failed"]).crossJoin(F.broadcast(required))
    rows = rows.withColumn("incomplete", F.greatest(F.col("required") - F.col("completed") - F.col("failed"), F.lit(0)))
    return rows.withColumn(
        "closes", F.col("completed") + F.col("failed") + F.col("incomplete") == F.col("required")
    ).select("partition", "required", "completed", "failed", "incomplete", "closes")


# the shuffles of the log, in groups of partitions: when each opened, and who asked to cancel it
_LIFE = f"""{L}, op AS (SELECT partition % 8 AS shuffle_id, min(seq) AS opened_at FROM lg WHERE kind = 'signup'
  GROUP BY 1),
cn AS (SELECT seq, partition % 8 AS shuffle_id, CASE WHEN seq % 3 = 0 THEN 'Ok' WHEN seq % 2 = 0 THEN 'ShuttingDown'
  ELSE 'PolicyDenied' END AS reason FROM lg WHERE kind = 'error' AND seq % 5 = 1 AND partition % 8 <> 6),
sp AS (SELECT shuffle_id, opened_at, cancelled_at, reason FROM op LEFT
  JOIN (SELECT shuffle_id, min(seq) AS cancelled_at, min_by(reason, seq) AS reason FROM cn JOIN op USING (shuffle_id)
  WHERE seq > opened_at AND reason <> 'Ok' GROUP BY 1) USING (shuffle_id))"""


def _spans(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state spans, cancellations) of the log's shuffles."""
    opened = log.filter("kind = 'signup'").groupBy(
        F.expr("partition % 8").alias("shuffle_id")
    ).agg(F.min("seq").alias("opened_at"))
    cancels = log.filter("kind = 'error' AND seq % 5 = 1 AND partition % 8 <> 6").select(
        "seq", F.expr("partition % 8").alias("shuffle_id"),
        F.expr(
            """CASE WHEN seq % 3 = 0 THEN 'Ok' WHEN seq % 2 = 0 THEN 'ShuttingDown' ELSE 'PolicyDenied' END"""
        ).alias("reason")
    )
    return lifecycle.state_spans(opened, cancels), cancels


_EXPLAIN = f"""st AS (SELECT (SELECT 1 + max(partition_gen) FROM lg) AS epoch, (SELECT count(*) FROM (SELECT state
  FROM p UNION ALL SELECT state FROM c) WHERE state = 'Active') AS pending, (SELECT count(*) > 0 FROM lg
  WHERE seq % 151 = 7) AS torn,
  (SELECT cancelled_at IS NOT NULL FROM sp WHERE shuffle_id = 0) AS cancelled, (SELECT reason FROM sp
    WHERE shuffle_id = 0) AS reason, (SELECT edges_over_counted FROM pr2) AS over),
ex AS (SELECT code, min('p' || partition || '/g' || partition_gen || '/c' || consumer_id) AS subject,
  min_by('permanent=' || CASE WHEN permanent THEN 'yes'
  ELSE 'no' END || ' attempts=' || attempts || ' ready_at=' || ready_at,
  'p' || partition || '/g' || partition_gen || '/c' || consumer_id) AS detail, count(*) AS "count" FROM fails GROUP BY 1
UNION ALL SELECT 'DuplicateCompletion', 'ledger', '{EXPLAINED["duplicates"]}', count(*) FROM fold
  WHERE outcome = 'duplicate' HAVING count(*) > 0
UNION ALL SELECT 'PartitionNotProduced', 'partition ' || min(range), '{EXPLAINED["missing"]}', count(*)
  FROM range({LOGGED}) WHERE range NOT IN (SELECT partition FROM lg
  WHERE kind = 'view' AND user_id % 3 = 0) HAVING count(*) > 0
UNION ALL SELECT 'ParticipantNotActive', 'topology', '{EXPLAINED["inactive"]}', count(*) FROM (SELECT state FROM p
  UNION ALL SELECT state FROM c) WHERE state <> 'Active' HAVING count(*) > 0
UNION ALL SELECT 'RevalidationRequired', 'epoch ' || epoch, '{EXPLAINED["pending"]}', pending FROM st WHERE pending > 0
UNION ALL SELECT 'RevalidationRequired', 'journal', '{EXPLAINED["torn"]}', 1 FROM st WHERE torn
UNION ALL SELECT reason, 'shuffle', '{EXPLAINED["state"]}Cancelled', 1 FROM st WHERE cancelled
UNION ALL SELECT 'CapabilityUnsupported', 'durability', '{EXPLAINED["volatile"]}', 1
UNION ALL SELECT 'AccountingMismatch', 'progress', '{EXPLAINED["over"]}', over FROM st WHERE over > 0)"""
_EXPLAIN_WITH = f"WITH {P}, {C(LOGGED)}, {FOLD}, {_LIFE[len(L) + 2:]}, {FAIL}, {LATEST}, {NOW}, {_MEASURES}, {_EXPLAIN}"


def _explained(spark: SparkSession, d: str) -> DataFrame:
    s = _state(spark, d)
    log, producers, consumers = s["log"], D.producers(spark, d), D.consumers(spark, d, LOGGED)
    missing = manifests.missing_partitions(log.filter("kind = 'view' AND user_id % 3 = 0"), LOGGED)
    progress_ = ledger.progress(
        topology.planned_edges(consumers, LOGGED), s["folded"], s["failures"], s["judged"], s["latest"], LOGGED
    )
    status = log.agg((F.max("partition_gen") + 1).alias("epoch"), F.bool_or(F.col("seq") % 151 == 7).alias("torn"))
    pending = journal.demote(D.participants(producers, consumers)).agg(F.count_if("pending").alias("pending"))
    state = _spans(log)[0].filter("shuffle_id = 0").select(
        F.when(F.col("cancelled_at").isNotNull(), "Cancelled").otherwise("Open").alias("state"), "reason",
        F.lit(False).alias("durable")
    )
    status = status.crossJoin(pending).crossJoin(state).crossJoin(  # one row each
        progress_.select("edges_over_counted", "closes")
    )
    return ledger.explain(s["failures"], s["folded"], missing, producers, consumers, status)


@query(f"{_EXPLAIN_WITH} SELECT * FROM ex")
def explain(spark: SparkSession, d: str) -> DataFrame:
    return _explained(spark, d)


@query(f"""{_EXPLAIN_WITH}, dim(code, number)
  AS (VALUES {", ".join(f"('{name}', {n})" for name, n in ERROR_CODES.items())})
SELECT CAST(row_number() OVER (ORDER BY number, subject) AS INTEGER) AS position,
  "count" || 'x ' || code || ' [' || subject || '] ' || detail AS line FROM ex JOIN dim USING (code)""")
def explain_text(spark: SparkSession, d: str) -> DataFrame:
    """The explanation as lines, in order of code and subject."""
    return ledger.render(_explained(spark, d))


@query(
    f"""WITH {_LIFE} SELECT seq, cn.shuffle_id, CASE WHEN opened_at IS NULL OR seq <= opened_at THEN 'InvalidState' WHEN seq > cancelled_at THEN 'Ok' WHEN cn.reason = 'Ok' THEN 'InvalidArgument' ELSE 'Ok' END AS error_code, coalesce(seq = cancelled_at, false) AS applied FROM cn LEFT JOIN sp USING (shuffle_id)"""
)
def cancellations(spark: SparkSession, d: str) -> DataFrame:
    spans, cancels = _spans(D.event_log(spark, d))
    return lifecycle.judge_cancellations(cancels, spans)


@query(
    f"""WITH {_LIFE}, g AS (SELECT seq, partition % 8 AS shuffle_id FROM lg WHERE kind IN ('click', 'purchase')), s AS (SELECT seq, shuffle_id, CASE WHEN opened_at IS NULL OR seq <= opened_at THEN 'Closed' WHEN seq > cancelled_at THEN 'Cancelled' ELSE 'Open' END AS shuffle_state FROM g LEFT JOIN sp USING (shuffle_id)) SELECT *, CASE shuffle_state WHEN 'Cancelled' THEN 'Cancelled' WHEN 'Open' THEN 'Ok' ELSE 'InvalidState' END AS error_code FROM s"""
)
def lifecycle_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether each commit of the log finds its shuffle open."""
    log = D.event_log(spark, d)
    return lifecycle.lifecycle_gate(
        log.filter("kind IN ('click', 'purchase')").select("seq", F.expr("partition % 8").alias("shuffle_id")),
        _spans(log)[0]
    )


@query(
    f"""WITH {_LIFE}, g AS (SELECT partition % 8 AS shuffle_id, seq FROM lg WHERE kind = 'click' AND seq % 3 <> 0) SELECT shuffle_id, count(*) FILTER (NOT coalesce(seq < cancelled_at, false)) AS in_flight, count(*) FILTER (seq < cancelled_at) AS dropped FROM g LEFT JOIN sp USING (shuffle_id) GROUP BY 1"""
)
def dropped_grants(spark: SparkSession, d: str) -> DataFrame:
    """Grants in flight per shuffle, and those that its cancellation dropped."""
    log = D.event_log(spark, d)
    grants = log.filter("kind = 'click'").select(
        F.expr("partition % 8").alias("shuffle_id"), F.col("seq").alias("attempt"), "seq"
    )
    return lifecycle.dropped_grants(grants, grants.filter("seq % 3 = 0"), _spans(log)[0])


@query(f"""WITH {FOLD}, {FAIL}, ad AS (SELECT seq, outcome FROM fold WHERE outcome IN ('new', 'edge') UNION ALL
  SELECT min(seq), 'failure' FROM judged GROUP BY partition, partition_gen, consumer_id),
rs AS (SELECT *, CAST(count(*) FILTER (outcome = 'new') OVER (ORDER BY seq) AS BIGINT) AS tracked_partitions, count(*)
  OVER (ORDER BY seq) AS tracked_edges FROM ad) SELECT seq, CASE
  WHEN tracked_partitions > 150 OR tracked_edges > 600 THEN 'TooManyTrackedEdges'
  ELSE 'Ok' END AS error_code, tracked_partitions, tracked_edges FROM rs WHERE outcome <> 'failure'""")
def tracked_bounds(spark: SparkSession, d: str) -> DataFrame:
    s = _state(spark, d)
    return ledger.bound_tracked(s["folded"], s["judged"], 150, 600)


@query(
    FOLD.join(
        ("WITH ", " SELECT seq, partition, partition_gen, consumer_id, error_code, outcome FROM fold")
    ).replace("'purchase', 'view')", "'purchase')")
)
def streamed_fold(spark: SparkSession, d: str) -> DataFrame:
    """The commits of the log folded as a stream: every batch is written by its number, so one that is retried counts once."""
    events = spark.readStream.schema(
        D.table(spark, d, "events").schema
    ).option("pathGlobFilter", "events.parquet").parquet(d)
    return fold_batches(D.commit_log(D.as_log(events)), LOGGED)


# -- envelopes and texts -------------------------------------------------------------------------

_ENVELOPES = {
    "shuffle": "p_partkey % 23", "max_fan_out": "p_partkey % 19", "max_fan_in": "p_partkey % 17", "global_limit": "p_partkey % 37", "per_source": "p_partkey % 13 % 9", "per_destination": "p_size % 11", "max_grants": "p_partkey % 29 * 8", "max_examined": "p_partkey % 31 * 64",
    "max_attempts": "p_size * 2", "pause": "p_partkey % 110", "resume": "p_size + 10", "require_fresh": "p_partkey % 2 = 0", "validity": "p_size % 3", "max_string_bytes": "p_partkey % 41 * 256", "max_endpoint_bytes": "p_partkey % 43 * 32", "max_tracked_partitions": "p_partkey % 47 * 131072",
    "max_retained_generations": "p_partkey % 53", "max_wave_grants": "p_partkey % 59 * 16", "max_tracked_edges": "p_partkey % 61 * 64"}
_ENV = f"env AS (SELECT p_partkey, {', '.join(f'{sql} AS {name}' for name, sql in _ENVELOPES.items())} FROM part)"


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "part").select("p_partkey", *[F.expr(sql).alias(name) for name, sql in _ENVELOPES.items()])


@query(f"""WITH {_ENV} SELECT p_partkey, CASE WHEN shuffle = 0 THEN 'shuffle'
  WHEN max_fan_out = 0 OR max_fan_in = 0 THEN 'fan'
  WHEN global_limit = 0 OR per_source = 0 OR per_destination = 0 THEN 'concurrency'
  WHEN per_source > global_limit OR per_destination > global_limit THEN 'concurrency above global'
 WHEN max_grants = 0 OR max_grants > max_wave_grants THEN 'max_grants'
   WHEN max_examined < max_grants THEN 'max_examined' WHEN max_attempts = 0 OR max_attempts > 64 THEN 'max_attempts'
   WHEN pause > 100 THEN 'pause' WHEN resume > pause THEN 'resume' WHEN require_fresh AND validity = 0 THEN 'validity'
 WHEN max_string_bytes = 0 THEN 'max_string_bytes'
   WHEN max_endpoint_bytes = 0 OR max_endpoint_bytes > max_string_bytes THEN 'max_endpoint_bytes'
   WHEN max_tracked_edges = 0 OR max_tracked_partitions = 0 THEN 'max_planned_edges'
   WHEN max_tracked_partitions > 4194304 THEN 'max_tracked_partitions'
 WHEN max_retained_generations = 0 THEN 'max_retained_generations'
   WHEN max_wave_grants = 0 OR max_wave_grants > max_tracked_edges THEN 'max_wave_grants' ELSE 'none' END AS problem
   FROM env""")
def policy_problems(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes and bounds of the parts table, each with the first rule that it breaks."""
    rows = _envelopes(spark, d)
    return rows.select("p_partkey", F.coalesce(policy_problem(rows), F.lit("none")).alias("problem"))


@query(f"""WITH {_ENV} SELECT p_partkey, 'shuffle=' || shuffle || ' generation=1 policy_generation=1' || chr(10) ||
  '  fan_out<=' || max_fan_out || ' fan_in<=' || max_fan_in || chr(10) || '  concurrency global=' || global_limit ||
  ' per_source=' || per_source || ' per_destination=' || per_destination || chr(10)
 || '  waves grants<=' || max_grants || ' examined<=' || max_examined || chr(10) || '  retry attempts<=' || max_attempts
   || ' min_ticks=0' || chr(10) || '  congestion pause>=' || pause || ' resume<=' || resume || ' fresh_required=' ||
   CASE WHEN require_fresh THEN 'yes' ELSE 'no' END || ' validity_ticks=' || validity || chr(10) AS text FROM env""")
def policy_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = _envelopes(spark, d)
    return rows.select("p_partkey", policy_text(rows).alias("text"))


_DIGESTS = """CASE event_id % 6 WHEN 0 THEN sha256(props) WHEN 1 THEN upper(sha256(props)) WHEN 2 THEN substr(sha256(props), 1, 63) WHEN 3 THEN sha256(props) || '0' WHEN 4 THEN 'x' || substr(sha256(props), 2) ELSE '' END"""


@query(
    f"""SELECT event_id, regexp_full_match({_DIGESTS}, '[0-9a-f]{{64}}') AS canonical, CASE WHEN regexp_full_match({_DIGESTS}, '[0-9a-f]{{64}}') THEN sha256(unhex({_DIGESTS})) END AS digest_of_bytes FROM events"""
)
def digest_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that may be digests: whether each is one in canonical form, and its bytes hashed again."""
    full = F.sha2(F.col("props"), 256)
    kinds = [
        full, F.upper(full), F.substring(full, 1, 63), F.concat(full, F.lit("0")),
        F.concat(F.lit("x"), F.substring(full, 2, 63))
    ]
    text = F.lit("")
    for k, kind in enumerate(kinds):
        text = F.when(F.col("event_id") % 6 == k, kind).otherwise(text)
    rows = D.table(spark, d, "events").select("event_id", text.alias("text")).withColumn(
        "canonical", is_digest(F.col("text"))
    )
    return rows.select(
        "event_id", "canonical", F.when(F.col("canonical"), digest_hex(F.col("text"))).alias("digest_of_bytes")
    )


@query(
    f"""WITH {FOLD} SELECT seq, CASE WHEN seq % 4 = 0 THEN error_code ELSE error_code || ': p' || partition || '/g' || partition_gen || '/c' || consumer_id END AS text FROM fold WHERE outcome = 'refused'"""
)
def error_texts(spark: SparkSession, d: str) -> DataFrame:
    """Refused commits as texts: the code, and the edge as detail where one is given."""
    edge = edge_text(F.col("partition"), F.col("partition_gen"), F.col("consumer_id"))
    return _state(spark, d)["folded"].filter("outcome = 'refused'").select(
        "seq", error_text(F.col("error_code"), F.when(F.col("seq") % 4 != 0, edge).otherwise("")).alias("text")
    )


_RECORDS = """rc AS (SELECT user_id % 60 AS store, CASE WHEN event_id % 4 = 0 THEN 'snapshot'
  ELSE 'journal' END AS origin, CASE WHEN user_id % 60 % 13 = 5 THEN 2
  ELSE 1 END AS version, event_id AS seq, CASE event_type WHEN 'signup' THEN 'Producer' WHEN 'click' THEN 'Consumer'
  ELSE 'Commit' END AS kind, user_id AS id,
  CASE WHEN event_id % 5 = 1 THEN 'Failed'
    ELSE 'Active' END AS state, CAST(day(ts) AS BIGINT) AS epoch, user_id % 60 % 11 <> 3 OR event_id % 2 = 0
    AS readable, user_id % 60 % 7 = 2 AND event_id % 151 = 7 AS torn FROM events)"""


@query(f"""WITH {_RECORDS}, pt AS (SELECT store, kind, id, max_by(state, seq) AS state FROM rc
  WHERE NOT torn AND kind IN ('Producer', 'Consumer')
  GROUP BY ALL), pn AS (SELECT store, count(*) FILTER (state = 'Active') AS pn FROM pt GROUP BY 1),
t AS (SELECT store, CASE WHEN bool_or(origin = 'snapshot' AND version <> 1) THEN 'UnsupportedVersion'
  WHEN bool_or(NOT readable AND NOT torn) THEN 'StateCorrupt'
  ELSE 'Ok' END AS error_code, count(*) FILTER (NOT torn) AS n, max(epoch) FILTER (NOT torn) AS e, bool_or(torn) AS torn
  FROM rc GROUP BY 1)
SELECT store, error_code, CASE WHEN error_code = 'Ok' THEN n
  ELSE 0 END AS adopted, e + CAST(error_code = 'Ok' AS BIGINT) AS epoch, CASE
  WHEN error_code = 'Ok' THEN coalesce(pn, 0) ELSE 0 END AS pending, error_code = 'Ok' AND torn AS history_incomplete
  FROM t LEFT JOIN pn USING (store)""")
def recovery(spark: SparkSession, d: str) -> DataFrame:
    """What every store of the log adopts after a restart: all of it under a new epoch, or nothing."""
    records = D.table(spark, d, "events").select(
        F.expr("user_id % 60").alias("store"), F.expr(
            "CASE WHEN event_id % 4 = 0 THEN 'snapshot' ELSE 'journal' END"
        ).alias("origin"), F.expr("CASE WHEN user_id % 60 % 13 = 5 THEN 2 ELSE 1 END").alias("version"), F.col("event_id").alias("seq"),
        F.expr(
            """CASE event_type WHEN 'signup' THEN 'Producer' WHEN 'click' THEN 'Consumer' ELSE 'Commit' END"""
        ).alias("kind"), F.col("user_id").alias("id"), F.expr("CASE WHEN event_id % 5 = 1 THEN 'Failed' ELSE 'Active' END").alias("state"), F.expr("CAST(day(ts) AS BIGINT)").alias("epoch"),
        F.expr("user_id % 60 % 11 <> 3 OR event_id % 2 = 0").alias("readable"), F.expr("user_id % 60 % 7 = 2 AND event_id % 151 = 7").alias("torn"))
    return journal.recover(records)


# -- pressure ------------------------------------------------------------------------------------


@query(f"""WITH {P}, {C(N)}, {L}, who AS (SELECT 'Producer' AS reporter_kind, producer_id AS reporter_id, incarnation,
  state FROM p UNION ALL SELECT 'Consumer', consumer_id, incarnation, state FROM c),
r AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN 'Producer'
  ELSE 'Consumer' END AS reporter_kind, user_id % 400 + 1 AS reporter_id, 1 + CAST(seq % 6 = 1 AS BIGINT) AS inc,
  level + CAST(seq % 25 = 0 AS BIGINT) * 100 AS level, 1 + CAST(seq % 35 = 2 AS BIGINT) AS pg, seq AS tick,
  seq + 5 - CAST(seq % 45 = 3 AS BIGINT) * 9 AS now FROM lg)
SELECT seq, CASE WHEN level > 100 THEN 'InvalidArgument' WHEN pg <> 1 THEN 'StalePolicy'
  WHEN tick > now THEN 'InvalidArgument' WHEN incarnation IS NULL THEN 'UnknownParticipant'
  WHEN incarnation <> inc THEN 'StaleIncarnation' WHEN state <> 'Active' THEN 'ParticipantNotActive'
  ELSE 'Ok' END AS error_code FROM r LEFT JOIN who USING (reporter_kind, reporter_id)""")
def pressure_admission(spark: SparkSession, d: str) -> DataFrame:
    log = D.event_log(spark, d).select(
        "seq", F.expr("CASE WHEN seq % 2 = 0 THEN 'Producer' ELSE 'Consumer' END").alias("reporter_kind"),
        F.expr("user_id % 400 + 1").alias("reporter_id"),
        F.expr("1 + CAST(seq % 6 = 1 AS BIGINT)").alias("reporter_incarnation"),
        F.expr("level + CAST(seq % 25 = 0 AS BIGINT) * 100").alias("level"),
        F.expr("1 + CAST(seq % 35 = 2 AS BIGINT)").alias("policy_gen"), F.col("seq").alias("tick"),
        F.expr("seq + 5 - CAST(seq % 45 = 3 AS BIGINT) * 9").alias("now")
    )
    return pressure.admit_readings(
        log, D.participants(D.producers(spark, d), D.consumers(spark, d))
    ).select("seq", "error_code")


_ASOF = f"""{L}, q AS (SELECT user_id AS target, seq AS tick FROM lg WHERE kind IN ('click', 'purchase')), rd AS (SELECT user_id AS target, seq AS tick, level FROM lg WHERE kind IN ('view', 'error')), af AS (SELECT q.target, q.tick, rd.level, rd.tick AS observed_at FROM q ASOF LEFT JOIN rd ON q.target = rd.target AND q.tick >= rd.tick)"""


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    log = D.event_log(spark, d).withColumns({"target": F.col("user_id"), "tick": F.col("seq")})
    return pressure.as_of(log.filter("kind IN ('click', 'purchase')"), log.filter("kind IN ('view', 'error')"))


@query(
    f"""WITH {_ASOF} SELECT target, tick, coalesce(level, -1) AS level, coalesce(observed_at, -1) AS observed_at FROM af"""
)
def pressure_asof(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d).fillna(-1, ["level", "observed_at"])


@query(
    f"""WITH {_ASOF} SELECT target, tick, coalesce(observed_at <= tick AND tick - observed_at <= 2000, false) AS fresh FROM af"""
)
def pressure_fresh(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d).select(
        "target", "tick", pressure.is_fresh(F.col("observed_at"), F.col("tick"), 2000).alias("fresh")
    )


_HYST = """hy AS (SELECT user_id AS target, seq AS tick, level, coalesce(last_value(CASE WHEN level >= 80 THEN true WHEN level <= 40 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS paused FROM lg)"""


@query(f"WITH {L}, {_HYST} SELECT * FROM hy")
def hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return pressure.hysteresis(
        D.event_log(spark, d).select(F.col("user_id").alias("target"), F.col("seq").alias("tick"), "level")
    )


@query(f"""WITH {L}, {_HYST}, b AS (SELECT *, lag(paused, 1, false) OVER (PARTITION BY target ORDER BY tick) AS was
  FROM hy)
SELECT target, tick, CASE WHEN tick % 5 = 0 THEN 'Unknown' WHEN level >= 80 THEN 'Paused' WHEN level <= 40 THEN 'Allow'
  WHEN was THEN 'Paused' ELSE 'Allow' END AS decision FROM b""")
def pressure_decision(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = pressure.hysteresis(
        D.event_log(spark, d).select(F.col("user_id").alias("target"), F.col("seq").alias("tick"), "level")
    )
    was = F.lag("paused", 1, False).over(Window.partitionBy("target").orderBy("tick"))
    return rows.withColumn("was", was).select(
        "target", "tick",
        pressure.decision(F.col("level"), F.col("tick") % 5 != 0, F.col("was"), 80, 40, True).alias("decision")
    )


# -- waves ---------------------------------------------------------------------------------------

_PLACES = f"""kp AS (SELECT shuffle_id, canonical_key, row_number() OVER (PARTITION BY shuffle_id
  ORDER BY canonical_key) AS pat, count(*) OVER (PARTITION BY shuffle_id) AS pats
  FROM (SELECT DISTINCT shuffle_id, canonical_key FROM e)),
pl AS (SELECT shuffle_id, CAST(partition AS BIGINT) AS partition, canonical_key, consumer_id,
  partition * (pats + 1) + pat - 1 + row_number() OVER (PARTITION BY shuffle_id
  ORDER BY partition, canonical_key, consumer_id) AS step FROM e JOIN kp USING (shuffle_id, canonical_key))"""
_DECIDED = f"""fc AS (SELECT partition, CAST(1 AS BIGINT) AS partition_gen, CASE
  WHEN partition % 13 = 4 THEN producer_id + 1
  ELSE producer_id END AS producer_id, incarnation + CAST(partition % 17 = 6 AS BIGINT) AS pinc FROM o
  WHERE partition % 11 <> 3),
de AS (SELECT pl.*, fc.producer_id, CASE WHEN fc.producer_id IS NULL OR o.producer_id IS NULL
  OR o.producer_id <> fc.producer_id OR o.incarnation <> pinc THEN 'unproduced'
  WHEN (pl.partition + pl.consumer_id) % 9 = 1 THEN 'completed'
  WHEN (pl.partition + pl.consumer_id) % 9 = 2 THEN 'failed'
  WHEN (pl.partition + pl.consumer_id) % 9 = 3 THEN 'in_flight'
    WHEN (pl.partition + pl.consumer_id) % 9 = 4 THEN 'retry_wait' WHEN fc.producer_id % 5 = 0 THEN 'source_pressure'
    WHEN pl.consumer_id % 7 = 0 THEN 'destination_pressure' WHEN c.state <> 'Active' THEN 'inactive'
    ELSE 'candidate' END AS disposition
  FROM pl LEFT JOIN fc USING (partition) LEFT JOIN o USING (partition) LEFT JOIN c USING (consumer_id))"""
_WAVES = f"{P}, {C(SMALL)}, {E_(SMALL)}, {O_(SMALL)}, {_PLACES}, {_DECIDED}"


def _decided(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    """What each edge waits for; of every edge, if none are given."""
    consumers, producers = D.consumers(spark, d, SMALL), D.producers(spark, d)
    owners = topology.owners(producers, SMALL)
    edges = scheduler.cursor_edges(consumers, SMALL) if edges is None else edges
    facts = owners.filter("partition % 11 <> 3").select(
        "partition", F.lit(1).cast("long").alias("partition_gen"),
        F.expr("CASE WHEN partition % 13 = 4 THEN producer_id + 1 ELSE producer_id END").alias("producer_id"),
        F.expr("incarnation + CAST(partition % 17 = 6 AS BIGINT)").alias("producer_incarnation"),
        F.sha2(F.col("partition").cast("string"), 256).alias("manifest_digest"),
        (F.col("partition") + 100).alias("total_bytes")
    )
    m = F.expr("(partition + consumer_id) % 9")
    status = edges.select(
        "partition", "consumer_id",
        F.when(m == 1, "Completed").when(m == 2, "Failed").otherwise("Pending").alias("phase"),
        F.lit(0).alias("attempts"), F.when(m == 4, 9).otherwise(0).alias("ready_at")
    )
    flying = edges.filter(m == 3).select("partition", "consumer_id")
    paused = producers.filter("producer_id % 5 = 0").select(F.lit("source").alias("side"), F.col("producer_id").alias("id"), F.lit("Paused").alias("decision")).unionByName(
        consumers.filter("consumer_id % 7 = 0").select(
            F.lit("destination").alias("side"), F.col("consumer_id").alias("id"), F.lit("Paused").alias("decision")
        )
    )
    return scheduler.dispositions(edges, facts, owners, producers, consumers, status, flying, 5, WAVE, paused)


@query(f"WITH {_WAVES} SELECT shuffle_id, partition, consumer_id, step, disposition FROM de")
def edge_disposition(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("shuffle_id", "partition", "consumer_id", "step", "disposition")


@query(
    f"""WITH {C(SMALL)} SELECT shuffle_id, count(DISTINCT canonical_key) AS patterns, CAST(sum(selected) AS BIGINT) AS planned_edges, CAST({SMALL} * (1 + count(DISTINCT canonical_key)) + sum(selected) AS BIGINT) AS full_pass FROM k WHERE state <> 'Withdrawn' GROUP BY 1"""
)
def cursor_steps(spark: SparkSession, d: str) -> DataFrame:
    return scheduler.cursor_steps(D.consumers(spark, d, SMALL), SMALL)


@query(
    f"""WITH {_WAVES}, a1 AS (SELECT *, row_number() OVER (PARTITION BY shuffle_id, producer_id ORDER BY step) AS n FROM de WHERE disposition = 'candidate'), a2 AS (SELECT *, row_number() OVER (PARTITION BY shuffle_id ORDER BY step) AS m FROM a1 WHERE n <= 3) SELECT shuffle_id, step, partition, consumer_id, producer_id FROM a2 WHERE m <= 12"""
)
def grants_one_sided(spark: SparkSession, d: str) -> DataFrame:
    return scheduler.grants_one_sided(
        _decided(spark, d).filter("disposition = 'candidate'"), "producer_id", 3, 12
    ).select("shuffle_id", "step", "partition", "consumer_id", "producer_id")


# each shuffle's wave begins where an earlier one may have left its cursor
_CURSORS = f"""cu AS (SELECT shuffle_id, full_pass, shuffle_id * 997 % full_pass AS cursor FROM (SELECT shuffle_id, CAST({SMALL} * (1 + count(DISTINCT canonical_key)) + sum(selected) AS BIGINT) AS full_pass FROM k WHERE state <> 'Withdrawn' GROUP BY 1))"""
# the wave as a recursion over its examined edges and ends of passes, with all grants so far in lists
_WAVE_SQL = f"""{_WAVES}, {_CURSORS},
ev0 AS (SELECT shuffle_id, (step - cursor - 1 + full_pass) % full_pass + 1 + lap * full_pass AS position, step,
  partition, consumer_id, producer_id, disposition FROM de JOIN cu USING (shuffle_id), range(8) l(lap)
  UNION ALL SELECT shuffle_id, full_pass - cursor + lap * full_pass, NULL, NULL, NULL, NULL, 'lap'
    FROM cu, range(8) l(lap)),
ev AS (SELECT *, row_number() OVER (PARTITION BY shuffle_id ORDER BY position) AS k FROM ev0
  WHERE position <= {WAVE.max_examined}),
wv AS (SELECT shuffle_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS g, CAST(0
  AS BIGINT) AS at_lap, false AS done, CAST([] AS BIGINT[]) AS src, CAST([] AS BIGINT[]) AS dst, CAST([] AS BIGINT[])
  AS own, 'start' AS outcome,
    CAST(NULL AS BIGINT) AS step, CAST(NULL AS BIGINT) AS partition, CAST(NULL AS BIGINT) AS consumer_id, CAST(NULL
      AS BIGINT) AS producer_id FROM cu
  UNION ALL SELECT shuffle_id, k, position, g + CAST(o = 'granted' AS BIGINT), CASE WHEN o = 'lap' THEN g
    ELSE at_lap END,
    o = 'lap' AND g = at_lap OR o = 'limits' AND g >= {WAVE.global_limit} OR o = 'granted'
      AND g + 1 >= {WAVE.max_grants},
    CASE WHEN o = 'granted' THEN list_append(src, producer_id) ELSE src END, CASE
      WHEN o = 'granted' THEN list_append(dst, consumer_id) ELSE dst END, CASE
      WHEN o = 'granted' THEN list_append(own, partition * 1000000 + consumer_id) ELSE own END,
    o, step, partition, consumer_id, producer_id
  FROM (SELECT ev.*, wv.g, wv.at_lap, wv.src, wv.dst, wv.own, CASE
    WHEN disposition IN ('lap', {", ".join(repr(x) for x in scheduler.EARLY)}) THEN disposition
    WHEN list_contains(wv.own, ev.partition * 1000000 + ev.consumer_id) THEN 'in_flight'
      WHEN wv.g >= {WAVE.global_limit} OR len(list_filter(wv.src, lambda x: x = ev.producer_id)) >= {WAVE.per_source}
        OR len(list_filter(wv.dst, lambda x: x = ev.consumer_id)) >= {WAVE.per_destination} THEN 'limits'
      WHEN disposition = 'inactive' THEN 'unproduced' WHEN disposition = 'candidate' THEN 'granted'
        ELSE disposition END AS o
    FROM wv JOIN ev ON ev.shuffle_id = wv.shuffle_id AND ev.k = wv.k + 1 WHERE NOT wv.done))"""
_COUNTERS_SQL = f"""wc AS (SELECT shuffle_id, {", ".join(f"count(*) FILTER (outcome = '{name}') AS {name}" for name in ("granted", *scheduler.COUNTED))}, CASE WHEN bool_or(done) THEN max(position) ELSE {WAVE.max_examined} END AS examined, bool_or(outcome = 'lap') AS cursor_wrapped FROM wv GROUP BY 1)"""


def _cursors(spark: SparkSession, d: str) -> DataFrame:
    return scheduler.cursor_steps(D.consumers(spark, d, SMALL), SMALL).select(
        "shuffle_id", F.expr("shuffle_id * 997 % full_pass").alias("cursor"), "full_pass"
    )


def _wave(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The edges that a wave of every small shuffle may examine, and the wave. Both are read from written tables."""
    cursors = written(_cursors(spark, d), "wave-cursors")
    edges = written(scheduler.wave_edges(D.consumers(spark, d, SMALL), SMALL, cursors, WAVE.max_examined), "wave-edges")
    decided = written(_decided(spark, d, edges), "wave-dispositions")
    return decided, scheduler.next_wave(decided, cursors, WAVE)


@query(f"""WITH RECURSIVE {_WAVE_SQL} SELECT wv.shuffle_id, wv.partition, wv.consumer_id, wv.position, wv.g AS attempt,
  wv.step, CAST(1 AS BIGINT) AS partition_gen, wv.producer_id, pinc AS producer_incarnation, c.incarnation
  AS consumer_incarnation,
  sha256(CAST(wv.partition AS VARCHAR)) AS manifest_digest, wv.partition + 100 AS total_bytes, CAST(1 AS INTEGER)
    AS attempt_ordinal FROM wv JOIN fc USING (partition) JOIN c USING (consumer_id) WHERE outcome = 'granted'""")
def next_wave(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: one wave of every small shuffle from its cursor on, with the identity of every grant."""
    decided, wave = _wave(spark, d)
    granted = wave.filter("outcome = 'granted'").select(
        "shuffle_id", "partition", "consumer_id", "position", "attempt", "step"
    )
    return granted.join(
        decided.drop("disposition", "step", "canonical_key"), ["shuffle_id", "partition", "consumer_id"]
    )


@query(
    f"""WITH RECURSIVE {_WAVE_SQL}, {_COUNTERS_SQL} SELECT wc.*, (cursor + examined) % full_pass AS cursor, cursor_wrapped AND {" + ".join(x for x in ("granted", *scheduler.COUNTED) if x not in ("completed", "failed"))} = 0 AS all_resolved FROM wc JOIN cu USING (shuffle_id)"""
)
def wave_counters(spark: SparkSession, d: str) -> DataFrame:
    return scheduler.wave_counters(_wave(spark, d)[1])


@query(
    f"""WITH RECURSIVE {_WAVE_SQL}, {_COUNTERS_SQL} SELECT shuffle_id, count(*) OVER w AS waves_planned, CAST(sum(granted) OVER w AS BIGINT) AS grants_issued, CAST(sum(examined) OVER w AS BIGINT) AS edges_examined, CAST(sum(completed + failed) OVER w AS BIGINT) AS edges_skipped_resolved FROM wc WINDOW w AS (ORDER BY shuffle_id)"""
)
def scheduler_totals(spark: SparkSession, d: str) -> DataFrame:
    return scheduler.scheduler_totals(scheduler.wave_counters(_wave(spark, d)[1]), "shuffle_id")


@query(
    f"""WITH {C(SMALL)}, {_CURSORS} SELECT shuffle_id, 1 + shuffle_id % 3 AS topology_gen, CAST(1 AS BIGINT) AS policy_gen, CASE WHEN shuffle_id % 4 = 1 OR 1 + shuffle_id % 3 <> 1 + shuffle_id % 2 THEN 0 ELSE cursor END AS cursor, full_pass FROM cu"""
)
def cursor_binding(spark: SparkSession, d: str) -> DataFrame:
    """Cursors of one topology bound to the next: where the generation moved, or none was kept, a pass begins anew."""
    kept = _cursors(spark, d).filter("shuffle_id % 4 <> 1").select(
        "shuffle_id", F.expr("1 + shuffle_id % 2").alias("topology_gen"), F.lit(1).cast("long").alias("policy_gen"),
        "cursor"
    )
    bound = _cursors(spark, d).select(
        "shuffle_id", F.expr("1 + shuffle_id % 3").alias("topology_gen"), F.lit(1).cast("long").alias("policy_gen")
    )
    return scheduler.bind_cursors(kept, bound, D.consumers(spark, d, SMALL), SMALL)


@query(
    f"""WITH {C(SMALL)} SELECT DISTINCT shuffle_id, CASE WHEN shuffle_id % 5 = 4 THEN 'InvalidState' WHEN shuffle_id % 7 = 3 THEN 'PolicyMismatch' WHEN shuffle_id % 3 = 2 THEN 'StaleTopology' ELSE 'Ok' END AS error_code FROM c"""
)
def wave_admission(spark: SparkSession, d: str) -> DataFrame:
    """Whether each shuffle may plan with the topology that is offered to it."""
    shuffles = D.consumers(spark, d, SMALL).select("shuffle_id").distinct()
    bound = shuffles.filter("shuffle_id % 5 <> 4").select(
        "shuffle_id", F.lit(1).alias("shuffle_gen"), F.lit(1).alias("topology_gen")
    )
    return scheduler.wave_admission(
        bound,
        shuffles.select(
            "shuffle_id", F.expr("1 + CAST(shuffle_id % 7 = 3 AS INT)").alias("shuffle_gen"),
            F.expr("1 + CAST(shuffle_id % 3 = 2 AS INT)").alias("topology_gen")
        )
    )


@query("""WITH g AS (SELECT l_suppkey AS producer_id, l_orderkey % 25 AS consumer_id, l_orderkey % 64 AS shuffle_id,
  l_orderkey * 10 + l_linenumber AS attempt FROM lineitem
  WHERE l_returnflag = 'N'), o AS (SELECT DISTINCT shuffle_id, attempt FROM g WHERE attempt % 3 = 0), x AS (SELECT *
  FROM g ANTI JOIN o USING (shuffle_id, attempt))
SELECT shuffle_id, 'source' AS side, producer_id AS id, count(*) AS in_flight FROM x GROUP BY 1, 3 UNION ALL
  SELECT shuffle_id, 'destination', consumer_id, count(*) FROM x GROUP BY 1, 3""")
def in_flight(spark: SparkSession, d: str) -> DataFrame:
    grants = D.table(spark, d, "lineitem").filter("l_returnflag = 'N'").select(
        F.col("l_suppkey").alias("producer_id"), F.expr("l_orderkey % 25").alias("consumer_id"),
        F.expr("l_orderkey % 64").alias("shuffle_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("attempt")
    )
    return scheduler.in_flight(grants, grants.filter("attempt % 3 = 0"))


_COMMIT_SQL = f"""{P}, {C(N)}, {O_(LOGGED)}, {L},
rq AS (SELECT lg.seq, lg.partition, lg.partition_gen, lg.consumer_id, lg.shuffle_gen, lg.digest, lg.bytes, lg.integrity,
  o.producer_id, o.incarnation AS pinc, CAST(1 AS BIGINT) AS cinc FROM lg JOIN o USING (partition)
  WHERE kind IN ('click', 'purchase')),
gr AS (SELECT seq, partition, partition_gen, CASE WHEN seq % 33 = 4 THEN consumer_id + 1
  ELSE consumer_id END AS gc, pinc + CAST(seq % 37 = 6 AS BIGINT) AS gi, CASE WHEN seq % 41 = 8 THEN 'other'
  ELSE digest END AS gd FROM rq WHERE seq % 10 <> 7),
mf AS (SELECT CAST(range AS BIGINT) AS partition, 2 AS pg, sha256(concat(range, ':', 2)) AS md, 1000 + range AS mb
  FROM range({LOGGED})),
cm AS (SELECT rq.seq, CASE WHEN gr.seq IS NULL THEN 'StaleAttempt' WHEN shuffle_gen <> 1 THEN 'StaleGeneration'
  WHEN gc <> rq.consumer_id THEN 'AttemptSuperseded' WHEN gi <> pinc THEN 'StaleIncarnation'
  WHEN gd <> rq.digest THEN 'ManifestInconsistent' WHEN c.state IS NULL THEN 'UnknownParticipant'
  WHEN c.state <> 'Active' THEN 'ParticipantNotActive'
  WHEN pg <> rq.partition_gen THEN 'StaleGeneration' WHEN md <> rq.digest THEN 'DigestMismatch'
    WHEN NOT integrity THEN 'IntegrityFailure' WHEN rq.seq % 43 = 9 THEN 'DigestMismatch'
    WHEN mb <> rq.bytes THEN 'AccountingMismatch' WHEN rq.seq % 47 = 10 THEN 'IntegrityFailure'
    WHEN rq.seq % 53 = 11 THEN 'DigestMismatch' ELSE 'Ok' END AS error_code
  FROM rq LEFT JOIN gr USING (seq) LEFT JOIN c ON c.consumer_id = rq.consumer_id LEFT
    JOIN mf ON mf.partition = rq.partition)"""


@query(f"WITH {_COMMIT_SQL} SELECT seq, error_code FROM cm")
def commit_admission(spark: SparkSession, d: str) -> DataFrame:
    producers, consumers = D.producers(spark, d), D.consumers(spark, d)
    owners = topology.owners(producers, LOGGED)
    requests = D.commit_log(D.event_log(spark, d)).drop("producer_id", "producer_incarnation").join(
        owners.select("partition", "producer_id", F.col("incarnation").alias("producer_incarnation")), "partition"
    )
    requests = requests.withColumns(
        {
            "attempt": F.col("seq"), "consumer_incarnation": F.lit(1).cast("long"),
            "content_digest": F.expr("CASE WHEN seq % 43 = 9 THEN 'other' ELSE digest END"),
            "chunk_digests": F.expr(
                """CASE WHEN seq % 47 = 10 THEN array('a') WHEN seq % 53 = 11 THEN array('a', 'x') ELSE array('a', 'b') END"""
            )
        }
    )
    grants = requests.filter("seq % 10 <> 7").select(
        "attempt", "partition", "partition_gen",
        F.expr("CASE WHEN seq % 33 = 4 THEN consumer_id + 1 ELSE consumer_id END").alias("consumer_id"),
        "consumer_incarnation", "producer_id",
        F.expr("producer_incarnation + CAST(seq % 37 = 6 AS BIGINT)").alias("producer_incarnation"),
        F.expr("CASE WHEN seq % 41 = 8 THEN 'other' ELSE digest END").alias("digest")
    )
    accepted = spark.range(LOGGED).select(
        F.col("id").alias("partition"), F.lit(2).cast("long").alias("partition_gen"),
        F.expr("sha2(concat(id, ':', 2), 256)").alias("digest"), F.lit("content").alias("content_digest"),
        (F.col("id") + 1000).alias("bytes"), F.array(F.lit("a"), F.lit("b")).alias("chunk_digests")
    )
    return commits.admit_commits(requests, grants, consumers, producers, owners, accepted)


# -- journal, identity and wire ------------------------------------------------------------------

_KINDS = list(RECORD_KINDS)


@query(
    f"""WITH {L} SELECT u.kind, count(lg.seq) AS records FROM (SELECT unnest({_KINDS}) AS kind) u LEFT JOIN lg ON u.kind = {_KINDS[:5]}[lg.seq % 5 + 1] GROUP BY 1"""
)
def journal_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, RECORD_KINDS[:5]))
    return journal.records_by_kind(
        D.event_log(spark, d).select(F.get(kinds, F.expr("CAST(seq % 5 AS INT)")).alias("kind"))
    )


_AUDIT = """j AS (SELECT user_id AS journal, event_id AS position, CASE WHEN event_id % 29 = 5 THEN event_id - 4000 ELSE event_id - event_id % 2 END AS seq, event_id % 151 <> 7 AS ok FROM events)"""


@query(f"""WITH {_AUDIT}, b AS (SELECT *, NOT ok OR seq < coalesce(lag(seq) OVER w, 0) AS bad, seq = lag(seq) OVER w
  OR seq <= 100 AS rep FROM j WINDOW w AS (PARTITION BY journal ORDER BY position)),
s AS (SELECT *, coalesce(bool_or(bad) OVER (PARTITION BY journal
  ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM b)
SELECT journal, position, seq, CASE WHEN stopped THEN 'discarded' WHEN bad THEN 'corrupt' WHEN rep THEN 'skipped'
  ELSE 'replayed' END AS status FROM s""")
def journal_audit(spark: SparkSession, d: str) -> DataFrame:
    log = D.table(spark, d, "events").select(
        F.col("user_id").alias("journal"), F.col("event_id").alias("position"),
        F.expr("CASE WHEN event_id % 29 = 5 THEN event_id - 4000 ELSE event_id - event_id % 2 END").alias("seq"),
        F.expr("event_id % 151 <> 7").alias("header_ok"), F.lit(True).alias("payload_ok")
    )
    return journal.audit(log, 100)


@query(
    f"""WITH {P}, {C(N)}, x AS (SELECT 'Producer' AS kind, producer_id AS id, incarnation, state FROM p UNION ALL SELECT 'Consumer', consumer_id, incarnation, state FROM c) SELECT kind, id, incarnation, CASE WHEN state = 'Active' THEN 'Suspect' ELSE state END AS state, state = 'Active' AS pending FROM x"""
)
def recovery_demote(spark: SparkSession, d: str) -> DataFrame:
    return journal.demote(D.participants(D.producers(spark, d), D.consumers(spark, d)))


@query(
    f"""WITH {L} SELECT seq, kind, CASE WHEN seq <= 500 THEN 'snapshot' ELSE 'journal' END AS origin FROM lg WHERE seq <= 500 OR seq > 500"""
)
def snapshot_union(spark: SparkSession, d: str) -> DataFrame:
    log = D.event_log(spark, d).select("seq", "kind")
    return journal.snapshot_union(log.filter("seq <= 500"), log.filter("seq > 450"), 500)


_IDS = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN '0' || user_id WHEN 2 THEN '+' || user_id WHEN 3 THEN ' ' || user_id WHEN 4 THEN user_id || ' ' WHEN 5 THEN '0x' || user_id WHEN 6 THEN '184467440737095516' || (10 + event_id % 11) ELSE CAST(event_id AS VARCHAR) END AS text FROM events"""


@query(f"""WITH i AS ({_IDS}), j AS (SELECT *, CASE WHEN text = '' THEN 'EmptyValue'
  WHEN length(text) > 1 AND text LIKE '0%' THEN 'InvalidArgument'
  WHEN NOT regexp_full_match(text, '[0-9]+') THEN 'InvalidArgument'
  WHEN length(text) > 20 OR TRY_CAST(text AS DECIMAL(38,0)) > 18446744073709551615 THEN 'IntegerOverflow'
  ELSE 'Ok' END AS error_code FROM i)
SELECT event_id, error_code, CASE WHEN error_code = 'Ok' THEN text END AS id FROM j""")
def id_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr(
        """CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN concat('0', user_id) WHEN 2 THEN concat('+', user_id) WHEN 3 THEN concat(' ', user_id) WHEN 4 THEN concat(user_id, ' ') WHEN 5 THEN concat('0x', user_id) WHEN 6 THEN concat('184467440737095516', 10 + event_id % 11) ELSE CAST(event_id AS STRING) END"""
    )
    return D.table(spark, d, "events").select("event_id", text.alias("text")).select(
        "event_id", id_code(F.col("text")).alias("error_code"), id_value(F.col("text")).cast("string").alias("id")
    )


@query("SELECT doc_id, true AS whole, doc_id % 3 <> 0 AS cut FROM documents")
def utf8_valid(spark: SparkSession, d: str) -> DataFrame:
    """Texts are valid UTF-8; with a stray continuation byte behind they aren't."""
    whole = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    bad = F.when(F.col("doc_id") % 3 == 0, F.concat(whole, F.unhex(F.lit("80")))).otherwise(whole)
    return D.table(spark, d, "documents").select(
        "doc_id", F.is_valid_utf8(whole.cast("string")).alias("whole"), F.is_valid_utf8(bad.cast("string")).alias("cut")
    )


@query(
    f"""SELECT event_id, {_le('event_id', 8)} AS u64, {_le('user_id % 60000', 2)} AS u16, sha256(unhex({_le('event_id', 8)})) AS digest FROM events"""
)
def le_encode(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "events").select(
        "event_id", le_hex(F.col("event_id"), 8).alias("u64"), le_hex(F.col("user_id") % 60000, 2).alias("u16"),
        F.sha2(F.unhex(le_hex(F.col("event_id"), 8)), 256).alias("digest")
    )


@query(f"WITH {L} SELECT seq, 'p' || partition || '/g' || partition_gen || '/c' || consumer_id AS edge FROM lg")
def edge_names(spark: SparkSession, d: str) -> DataFrame:
    return D.event_log(spark, d).select(
        "seq", edge_text(F.col("partition"), F.col("partition_gen"), F.col("consumer_id")).alias("edge")
    )


@query()
def replay_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = D.table(spark, d, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("arrival"),
        F.expr(
            """CASE WHEN event_id % 7 = 3 THEN event_id - 200 WHEN event_id % 501 = 9 THEN event_id + 2199023255552 ELSE event_id END"""
        ).alias("sequence")
    )
    return frames.replay_guard(rows, 8)


@query()
def crc32c_checksums(spark: SparkSession, d: str) -> DataFrame:
    return D.contents(spark, d).select(F.col("partition").alias("doc_id"), crc32c(F.col("payload")).alias("crc32c"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 19 = 2 THEN 99 ELSE 10 + event_id % 26 END").alias("type"),
        F.expr("CASE WHEN event_id % 23 = 1 THEN 2 ELSE event_id % 2 END").alias("flags"),
        F.col("user_id").alias("session"),
        F.expr("CASE WHEN event_id % 29 = 3 THEN 0 ELSE event_id + 1 END").alias("sequence"),
        F.encode("props", "UTF-8").alias("payload")
    )


@query("""SELECT event_id, CASE WHEN event_id % 31 = 4 THEN 'TruncatedInput'
  WHEN event_id % 37 = 5 THEN 'ProtocolViolation' WHEN event_id % 41 = 6 THEN 'ChecksumMismatch'
  WHEN event_id % 23 = 1 THEN 'MalformedInput' WHEN event_id % 19 = 2 THEN 'FrameTypeUnsupported'
  WHEN event_id % 29 = 3 THEN 'SequenceViolation' WHEN event_id % 43 = 7 THEN 'TrailingGarbage'
  ELSE 'Ok' END AS error_code,
 CASE WHEN event_id % 19 = 2 THEN 'Unknown' WHEN event_id % 2 = 0 THEN 'Request' ELSE 'Response' END AS message_class
   FROM events""")
def frame_decode(spark: SparkSession, d: str) -> DataFrame:
    """Frames of the events, some damaged, decoded again."""
    sent = frames.encode_frames(_frames(spark, d))
    damaged = F.expr(
        """CASE WHEN event_id % 31 = 4 THEN substring(frame, 1, 20) WHEN event_id % 37 = 5 THEN concat(unhex('00'), substring(frame, 2, 100000)) WHEN event_id % 41 = 6 THEN concat(substring(frame, 1, 12), unhex('ffffff'), substring(frame, 16, 100000)) WHEN event_id % 43 = 7 THEN concat(frame, unhex('00')) ELSE frame END"""
    )
    back = frames.decode_frames(sent.select("event_id", F.col("type").alias("_sent"), damaged.alias("frame")))
    return back.select("event_id", "error_code", frames.message_class(F.col("_sent")).alias("message_class"))


_DIMENSION = ", ".join(f"({n}, '{name}', '{retry_class(name)}')" for name, n in ERROR_CODES.items())


@query(
    f"""WITH {FOLD}, dim(code, name, retry_class) AS (VALUES {_DIMENSION}) SELECT code, name, retry_class, count(seq) AS n FROM dim LEFT JOIN fold ON name = error_code GROUP BY 1, 2, 3"""
)
def refusal_dimension(spark: SparkSession, d: str) -> DataFrame:
    """How often each refusal code occurs in the commit fold, with its number and class; zeros too."""
    counted = _state(spark, d)["folded"].groupBy("error_code").agg(F.count("*").alias("n"))
    return error_codes(spark).join(counted, F.col("name") == F.col("error_code"), "left").select(
        "code", "name", "retry_class", F.coalesce("n", F.lit(0)).alias("n")
    )


@query(f"""WITH {P}, {C(N)}, {L} SELECT (SELECT count(*) FROM p) AS producers, (SELECT count(*) FROM p
  WHERE state = 'Active') AS active_producers, (SELECT count(*) FROM c) AS consumers, (SELECT count(*) FROM c
  WHERE state = 'Active') AS active_consumers,
(SELECT count(DISTINCT canonical_key) FROM k
  WHERE state <> 'Withdrawn') AS patterns, (SELECT CAST(sum(selected) AS BIGINT) FROM k
  WHERE state <> 'Withdrawn') AS planned_edges, (SELECT max(seq) FROM lg) AS last_sequence, (SELECT count(*)
  FROM lg) AS records""")
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row: the topology and the log at a glance."""
    counts = topology.active_counts(D.producers(spark, d), D.consumers(spark, d))
    pick = lambda kind, column, name: F.max(F.when(F.col("kind") == kind, F.col(column))).alias(name)
    sides = counts.agg(
        pick("Producer", "registered", "producers"), pick("Producer", "active", "active_producers"),
        pick("Consumer", "registered", "consumers"), pick("Consumer", "active", "active_consumers")
    )
    planned = topology.planned_edges(D.consumers(spark, d), N).select(
        F.col("pattern_count").alias("patterns"), "planned_edges"
    )
    log = D.event_log(spark, d).agg(F.max("seq").alias("last_sequence"), F.count("*").alias("records"))
    return sides.crossJoin(planned).crossJoin(log)  # one row each


@query(
    f"""WITH {P}, {C(N)} SELECT kind, count(*) FILTER (state = 'Active') AS pending FROM (SELECT 'Producer' AS kind, state FROM p UNION ALL SELECT 'Consumer', state FROM c) GROUP BY 1"""
)
def pending_revalidation(spark: SparkSession, d: str) -> DataFrame:
    return journal.demote(
        D.participants(D.producers(spark, d), D.consumers(spark, d))
    ).groupBy("kind").agg(F.count_if("pending").alias("pending"))


@query(
    f"""WITH {FOLD}, {FAIL}, {LATEST}, {NOW}, q AS (SELECT CAST(r.range AS BIGINT) AS partition, consumer_id FROM range({LOGGED}) r, (SELECT DISTINCT consumer_id FROM lg)) SELECT partition, consumer_id FROM q ANTI JOIN done USING (partition, consumer_id) ANTI JOIN lost USING (partition, consumer_id)"""
)
def incomplete_edges(spark: SparkSession, d: str) -> DataFrame:
    """Required edges that are neither completed nor failed, where each consumer of the log requires every partition."""
    s = _state(spark, d)
    now = s["latest"].withColumnRenamed("latest", "partition_gen")
    done = ledger.committed_edges(s["folded"]).join(now, ["partition", "partition_gen"], "left_semi")
    lost = s["failures"].filter("permanent").join(now, ["partition", "partition_gen"], "left_semi")
    required = s["log"].select("consumer_id").distinct().select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOGGED - 1).cast("long"))).alias("partition"), "consumer_id"
    )
    return required.join(
        done, ["partition", "consumer_id"], "left_anti"
    ).join(lost, ["partition", "consumer_id"], "left_anti")


@query(
    f"""WITH {P}, {O_(LOGGED)}, {L}, {_ADMIT}, acc AS (SELECT partition, max(partition_gen) AS partition_gen FROM adm WHERE error_code = 'Ok' GROUP BY 1) SELECT DISTINCT lg.partition, coalesce(acc.partition_gen, -1) AS partition_gen, CASE WHEN acc.partition IS NULL THEN 'PartitionNotProduced' ELSE 'Ok' END AS error_code FROM lg LEFT JOIN acc USING (partition)"""
)
def accepted_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The accepted generation of every partition of the log; absence is a row with its code."""
    accepted = _admitted(spark, d).filter("error_code = 'Ok'").groupBy("partition").agg(
        F.max("partition_gen").alias("partition_gen")
    )
    asked = D.event_log(spark, d).select("partition").distinct()
    return asked.join(accepted, "partition", "left").select(
        "partition", F.coalesce("partition_gen", F.lit(-1)).alias("partition_gen"),
        F.when(F.col("partition_gen").isNull(), "PartitionNotProduced").otherwise("Ok").alias("error_code")
    )


@query(f"""WITH {L}, s AS (SELECT user_id, consumer_id AS bound FROM lg
  WHERE kind = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1)
SELECT seq, CASE WHEN bound IS NULL THEN 'HandshakeRequired' WHEN bound <> consumer_id THEN 'IdentityMismatch'
  ELSE 'Ok' END AS error_code FROM lg LEFT JOIN s USING (user_id) WHERE kind IN ('click', 'purchase')""")
def session_identity(spark: SparkSession, d: str) -> DataFrame:
    """Whether each commit comes from the consumer that its session was last bound to."""
    log = D.event_log(spark, d)
    bound = log.filter("kind = 'signup'").groupBy("user_id").agg(F.max_by("consumer_id", "seq").alias("bound"))
    code = F.when(F.col("bound").isNull(), "HandshakeRequired").when(
        F.col("bound") != F.col("consumer_id"), "IdentityMismatch"
    ).otherwise("Ok")
    return log.filter(
        "kind IN ('click', 'purchase')"
    ).join(bound, "user_id", "left").select("seq", code.alias("error_code"))


@query(f"""WITH {C(N)}, m AS (SELECT partition AS p, count(*) AS n FROM (SELECT unnest(CASE kind
  WHEN 'All' THEN range({N}) WHEN 'Range' THEN range(b, e) ELSE l END) AS partition FROM k WHERE state <> 'Withdrawn')
  GROUP BY 1)
SELECT CAST(p AS BIGINT) AS partition, n AS by_join, n AS by_pattern FROM m""")
def edge_count_audit(spark: SparkSession, d: str) -> DataFrame:
    """Edges per partition counted one by one and by pattern: the two must agree."""
    consumers = D.consumers(spark, d)
    counted = topology.edges(consumers, N).groupBy("partition").agg(F.count("*").alias("by_join"))
    return counted.join(
        topology.fan_out(consumers, N).select("partition", F.col("fan_out").alias("by_pattern")), "partition"
    )

"""Policy envelopes and bounds: checked in a fixed order, one as a value or a table of them as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Bounds of one engine."""

    # The defaults of the format.
    max_frame_payload_bytes: int = 1 << 20
    max_message_payload_bytes: int = 1 << 24
    max_allocation_bytes: int = 1 << 24
    max_string_bytes: int = 4096
    max_endpoint_bytes: int = 256
    max_collection_items: int = 1 << 20
    max_chunks_per_partition: int = 1 << 16
    max_partitions: int = 1 << 22
    max_participants: int = 1 << 16
    max_selection_patterns: int = 4096
    max_selection_items: int = 1 << 20
    max_planned_edges: int = 1 << 32
    max_tracked_edges: int = 1 << 26
    max_tracked_partitions: int = 1 << 22
    max_state_bytes: int = 1 << 30
    max_journal_record_bytes: int = 1 << 24
    max_retained_generations: int = 2
    max_wave_grants: int = 1 << 14

    def problem(self) -> str | None:
        """What is wrong with the bounds, by the first rule broken."""
        return next((name for name, holds in LIMIT_RULES if not holds(self)), None)


@dataclass(frozen=True)
class Policy:
    """One envelope: fan bounds, concurrency, wave budget, retries and congestion thresholds."""

    # The defaults of the format.
    shuffle: int = 1
    shuffle_generation: int = 1
    generation: int = 1
    max_fan_out: int = 64
    max_fan_in: int = 64
    global_limit: int = 64
    per_source: int = 8
    per_destination: int = 8
    max_grants: int = 256
    max_examined: int = 8192
    max_attempts: int = 3
    min_ticks: int = 0
    pause: int = 80
    resume: int = 40
    require_fresh: bool = False
    validity: int = 20
    limits: Limits = field(default_factory=Limits)

    def problem(self) -> str | None:
        """What is wrong with the envelope itself, by the first rule broken."""
        return next((name for name, holds in POLICY_RULES if not holds(self)), None) or self.limits.problem()

    def describe(self) -> str:
        """The envelope as text, one group a line."""
        return POLICY_TEXT.format(**vars(self) | {"require_fresh": "yes" if self.require_fresh else "no"})


# The rules in the order in which the first one broken is named; each holds for values and for columns alike.
POLICY_RULES = (
    ("shuffle", lambda v: v.shuffle != 0),
    ("fan", lambda v: (v.max_fan_out > 0) & (v.max_fan_in > 0)),
    ("concurrency", lambda v: (v.global_limit > 0) & (v.per_source > 0) & (v.per_destination > 0)),
    ("concurrency above global", lambda v: (v.per_source <= v.global_limit) & (v.per_destination <= v.global_limit)),
    ("max_grants", lambda v: (v.max_grants > 0) & (v.max_grants <= v.limits.max_wave_grants)),
    ("max_examined", lambda v: v.max_examined >= v.max_grants),
    ("max_attempts", lambda v: (v.max_attempts > 0) & (v.max_attempts <= 64)),
    ("pause", lambda v: v.pause <= 100),
    ("resume", lambda v: v.resume <= v.pause),
    ("validity", lambda v: (v.require_fresh == False) | (v.validity > 0)),  # noqa: E712
)
LIMIT_RULES = (
    (
        "max_frame_payload_bytes",
        lambda v: (v.max_frame_payload_bytes > 0) & (v.max_frame_payload_bytes <= v.max_message_payload_bytes)
    ),
    (
        "max_allocation_bytes",
        lambda v: (v.max_allocation_bytes > 0) & (v.max_allocation_bytes <= v.max_message_payload_bytes)
    ),
    ("max_string_bytes", lambda v: (v.max_string_bytes > 0) & (v.max_string_bytes <= v.max_allocation_bytes)),
    ("max_endpoint_bytes", lambda v: (v.max_endpoint_bytes > 0) & (v.max_endpoint_bytes <= v.max_string_bytes)),
    ("max_collection_items", lambda v: v.max_collection_items > 0),
    ("max_chunks_per_partition", lambda v: v.max_chunks_per_partition > 0),
    ("max_partitions", lambda v: (v.max_partitions > 0) & (v.max_participants > 0)),
    ("max_selection_patterns", lambda v: (v.max_selection_patterns > 0) & (v.max_selection_items > 0)),
    (
        "max_planned_edges",
        lambda v: (v.max_planned_edges > 0) & (v.max_tracked_edges > 0) & (v.max_tracked_partitions > 0)
    ),
    ("max_tracked_partitions", lambda v: v.max_tracked_partitions <= v.max_partitions),
    (
        "max_state_bytes",
        lambda v: (v.max_state_bytes > 0) & (v.max_journal_record_bytes > 0) & (
            v.max_journal_record_bytes <= v.max_state_bytes
        )
    ),
    ("max_retained_generations", lambda v: v.max_retained_generations > 0),
    ("max_wave_grants", lambda v: (v.max_wave_grants > 0) & (v.max_wave_grants <= v.max_tracked_edges)),
)

# Fixed value: an envelope as text.
POLICY_TEXT = """shuffle={shuffle} generation={shuffle_generation} policy_generation={generation}
  fan_out<={max_fan_out} fan_in<={max_fan_in}
  concurrency global={global_limit} per_source={per_source} per_destination={per_destination}
  waves grants<={max_grants} examined<={max_examined}
  retry attempts<={max_attempts} min_ticks={min_ticks}
  congestion pause>={pause} resume<={resume} fresh_required={require_fresh} validity_ticks={validity}
"""


class _Columns:
    """Columns by attribute, ``limits`` being the same row; what a row doesn't have is the default's value."""

    def __init__(self, names: list[str]):
        self._names = set(names)

    def __getattr__(self, name: str) -> object:
        if name == "limits":
            return self
        if name in self._names:
            return F.col(name)
        return F.lit(getattr(Policy(), name) if name in Policy.__dataclass_fields__ else getattr(Limits(), name))


def policy_problem(rows: DataFrame) -> Column:
    """What is wrong with each envelope of ``rows``, by the first rule broken; null if nothing is.

    Columns are named as the fields of ``Policy`` and ``Limits``; fields without a column have their defaults.
    """
    values = _Columns(rows.columns)
    return F.coalesce(*[F.when(~holds(values), name) for name, holds in (*POLICY_RULES, *LIMIT_RULES)])


def policy_text(rows: DataFrame) -> Column:
    """Each envelope of ``rows`` as text, one group a line."""
    values = _Columns(rows.columns)
    parts = re.split(r"\{(\w+)\}", POLICY_TEXT)
    text = lambda name: F.when(
        values.require_fresh, "yes"
    ).otherwise("no") if name == "require_fresh" else getattr(values, name).cast("string")
    return F.concat(*[text(part) if k % 2 else F.lit(part) for k, part in enumerate(parts)])

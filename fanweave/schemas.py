"""Names, codes and dimensions that rows of every operator use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Refusal codes with their numbers.
ERROR_CODES = {
    "Ok": 0,
    "InvalidArgument": 100, "MalformedInput": 101, "TruncatedInput": 102, "OversizedInput": 103, "TrailingGarbage": 104, "UnsupportedVersion": 105, "ChecksumMismatch": 106, "IntegerOverflow": 107, "InvalidUnicode": 108, "EmptyValue": 109, "LimitExceeded": 110, "InvalidState": 111, "UnsupportedOperation": 112, "CapabilityUnsupported": 113, "InternalError": 114,
    "UnknownShuffle": 200, "UnknownPartition": 201, "UnknownChunk": 202, "UnknownParticipant": 203, "StaleGeneration": 204, "StaleIncarnation": 205, "StaleTopology": 206, "StalePolicy": 207, "StaleAttempt": 208, "IncarnationMismatch": 209, "GenerationMismatch": 210, "DigestMismatch": 211, "AuthorityDenied": 212, "EligibilityDenied": 213, "DivergentCommit": 214, "LateAuthority": 215, "TopologyMismatch": 216, "PolicyMismatch": 217, "ManifestInconsistent": 218, "ParticipantNotActive": 219, "DuplicateRegistration": 220, "PartitionNotOwned": 221, "InterestNotFound": 222, "PartitionNotProduced": 223,
    "FanOutCeilingExceeded": 300, "FanInCeilingExceeded": 301, "ConcurrencyLimitExceeded": 302, "PolicyDenied": 303, "BackpressureActive": 304, "BackpressureUnknown": 305, "NoWorkAvailable": 306, "WaveLimitReached": 307, "Cancelled": 308, "ShuttingDown": 309, "AttemptSuperseded": 310, "EdgeAlreadyDispatched": 311, "RetryDeferred": 312,
    "DuplicateCompletion": 400, "AlreadyCompleted": 401, "PartitionIncomplete": 402, "IntegrityFailure": 403, "PayloadRejected": 404, "AccountingMismatch": 405, "PurgedHistory": 406, "RevalidationRequired": 407, "NotCommitted": 408,
    "RetryExhausted": 500, "RetryNotAllowed": 501, "AmbiguousOutcome": 502,
    "PersistenceFailure": 600, "StateCorrupt": 601, "StateIncompatible": 602, "StateImpossible": 603, "AtomicReplaceFailed": 604, "StateTooLarge": 605, "JournalSequenceViolation": 606,
    "SessionNotFound": 700, "SessionClosed": 701, "ProtocolViolation": 702, "DuplicateFrame": 703, "SequenceViolation": 704, "FrameTypeUnsupported": 705, "HandshakeRequired": 706, "IdentityMismatch": 707, "ConnectionFailure": 708, "PeerUnavailable": 709, "ConnectionClosed": 710,
    "ResourceExhausted": 800, "QueueFull": 801, "TooManyParticipants": 802, "TooManyPartitions": 803, "TooManyChunks": 804, "TooManyPatterns": 805, "TooManyTrackedEdges": 806,
}
# How a refusal may be retried; every other code but Ok is Permanent.
RETRIABLE = (
    "ConnectionFailure", "PeerUnavailable", "ConnectionClosed", "SessionClosed", "IntegrityFailure", "PayloadRejected",
    "ChecksumMismatch", "AmbiguousOutcome"
)
DEFERRED = (
    "BackpressureActive", "BackpressureUnknown", "RetryDeferred", "NoWorkAvailable", "WaveLimitReached",
    "ConcurrencyLimitExceeded", "QueueFull", "DuplicateFrame"
)
AUTHORITY = (
    "AuthorityDenied", "EligibilityDenied", "StaleGeneration", "StaleIncarnation", "StaleTopology", "StalePolicy",
    "StaleAttempt", "IncarnationMismatch", "GenerationMismatch", "LateAuthority", "AttemptSuperseded",
    "TopologyMismatch", "PolicyMismatch", "ParticipantNotActive", "PartitionNotOwned", "PolicyDenied",
    "FanOutCeilingExceeded", "FanInCeilingExceeded", "Cancelled", "ShuttingDown", "DivergentCommit"
)
# Participant states and the kinds of journal records.
STATES = ("Joining", "Active", "Suspect", "Failed", "Withdrawn")
RECORD_KINDS = ("ShuffleState", "Producer", "Consumer", "Manifest", "Commit", "Failure")
# Numbers of the message types.
MESSAGE_TYPES = (*range(1, 4), *range(10, 36), *range(40, 43))

# What explanations say.
EXPLAINED = {
    "duplicates": "duplicate completions suppressed without double accounting",
    "missing": "partitions without an accepted manifest are explicitly incomplete",
    "inactive": "registered participants that currently hold no authority",
    "pending": "participants must re-register with a fresh incarnation after the restart",
    "torn": "recovery discarded a torn journal tail; the discarded record was never acknowledged",
    "state": "shuffle state is ",
    "volatile": "this coordinator runs without a durable sink; commits are not durable",
    "over": "more edges are resolved than the current requirement implies",
    "open": "required edge accounting does not close against completed and failed edges",
}


def retry_class(code: str) -> str:
    """The retry class of a refusal code."""
    if code == "Ok":
        return "NotApplicable"
    return "Retriable" if code in RETRIABLE else "Deferred" if code in DEFERRED else "Authority" if code in AUTHORITY else "Permanent"


def retry_class_of(code: Column) -> Column:
    """The retry class of a column of code names."""
    return F.when(code == "Ok", "NotApplicable").when(
        code.isin(*RETRIABLE), "Retriable"
    ).when(code.isin(*DEFERRED), "Deferred").when(code.isin(*AUTHORITY), "Authority").otherwise("Permanent")


def error_codes(spark: SparkSession) -> DataFrame:
    """(code, name, retry_class): the dimension of refusal codes."""
    return spark.createDataFrame(
        [(n, name, retry_class(name)) for name, n in ERROR_CODES.items()], "code int, name string, retry_class string"
    )


def first_refusal(*rules: tuple[Column | str, str]) -> Column:
    """The code of the first rule that applies, ``Ok`` if none does. The order of rules is part of the semantics."""
    out = None
    for condition, code in rules:
        condition = F.expr(condition) if isinstance(condition, str) else condition
        out = F.when(condition, code) if out is None else out.when(condition, code)
    return out.otherwise("Ok")


def error_text(code: Column, detail: Column) -> Column:
    """A refusal as text: its code, and its detail if it has one."""
    return F.concat_ws(": ", code, F.nullif(detail, F.lit("")))

"""Wire frames as binary rows: encoding, decoding with a fixed order of refusals, replay protection."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MESSAGE_TYPES, first_refusal
from .binary import crc32c, le_hex, le_value

# Magic, version and sizes of the frame header.
MAGIC, VERSION, HEADER_BYTES, CRC_AT, MOST_PAYLOAD = 0x31424653, 1, 40, 36, 1 << 20
#: Furthest that a sequence may jump past the highest accepted one.
MOST_JUMP = 1 << 40


def encode_frames(rows: DataFrame) -> DataFrame:
    """``rows`` (type, flags, session, sequence, payload) with ``frame``, the header and payload as bytes."""
    head = F.concat(
        le_hex(F.lit(MAGIC), 4), le_hex(F.lit(VERSION), 2), le_hex(F.col("type"), 2), le_hex(F.col("flags"), 4),
        le_hex(F.col("session"), 8), le_hex(F.col("sequence"), 8), le_hex(F.octet_length("payload"), 4),
        le_hex(crc32c(F.col("payload")), 4)
    )
    headed = rows.withColumn("_head", head)
    return headed.withColumn(
        "frame", F.concat(F.unhex("_head"), F.unhex(le_hex(crc32c(F.unhex("_head")), 4)), F.col("payload"))
    ).drop("_head")


def decode_frames(rows: DataFrame, most_payload: int = MOST_PAYLOAD) -> DataFrame:
    """``rows`` (frame) with type, flags, session, sequence, payload_bytes and ``error_code``.

    The first failing check names the code: size, magic, version, header checksum, flags, type, payload
    bound, sequence, then the payload's length and checksum.
    """
    text = F.lower(F.hex("frame"))
    field = lambda at, size: le_value(F.substring("_hex", 2 * at + 1, 2 * size), size)
    size = F.octet_length("frame")
    split = rows.withColumns(
        {
            "_hex": text, "_head_crc": crc32c(F.substring("frame", 1, CRC_AT)),
            "_body_crc": crc32c(F.substring("frame", HEADER_BYTES + 1, 1 << 30))
        }
    )
    parts = split.withColumns(
        {
            "_magic": field(0, 4), "_version": field(4, 2), "type": field(6, 2), "flags": field(8, 4),
            "session": field(12, 8), "sequence": field(20, 8), "payload_bytes": field(28, 4), "_crc": field(32, 4),
            "_own_crc": field(CRC_AT, 4)
        }
    )
    code = first_refusal(
        (size < HEADER_BYTES, "TruncatedInput"), (F.col("_magic") != MAGIC, "ProtocolViolation"), (F.col("_version") != VERSION, "UnsupportedVersion"), (
            F.col("_own_crc") != F.col("_head_crc"), "ChecksumMismatch"
        ),
        (F.col("flags") > 1, "MalformedInput"), (
            ~F.col("type").isin(*MESSAGE_TYPES), "FrameTypeUnsupported"
        ), (F.col("payload_bytes") > most_payload, "OversizedInput"), (F.col("sequence") == 0, "SequenceViolation"),
        (size < HEADER_BYTES + F.col("payload_bytes"), "TruncatedInput"), (
            size > HEADER_BYTES + F.col("payload_bytes"), "TrailingGarbage"
        ), (F.col("_crc") != F.col("_body_crc"), "ChecksumMismatch"),
    )
    return parts.withColumn("error_code", code).drop(
        "_hex", "_head_crc", "_body_crc", "_magic", "_version", "_crc", "_own_crc"
    )


def message_class(number: Column) -> Column:
    """Request, Response or Unknown for a message type: requests are even from 10 on and 1, 40 besides."""
    known = number.isin(*MESSAGE_TYPES)
    request = number.isin(1, 40) | (number.between(10, 35) & (number % 2 == 0))
    return F.when(~known, "Unknown").when(request, "Request").otherwise("Response")


class Window:
    """The sequences that one direction of a session has accepted, of which the last ``size`` are told apart."""

    def __init__(self, size: int = 1024):
        self.size, self.recent, self.held, self.highest = min(size, 1 << 16), deque(), set(), 0

    def answer(self, sequence: int) -> str:
        """accepted, duplicate, or the code that refuses the sequence."""
        if sequence <= 0:
            return "SequenceViolation"
        if sequence > self.highest:
            if sequence - self.highest > MOST_JUMP:
                return "MalformedInput"
            self.highest = sequence
        elif sequence == self.highest or sequence in self.held:
            return "duplicate"
        elif not self.recent or sequence < self.recent[0]:
            return "SequenceViolation"
        self.recent.append(sequence)
        self.held.add(sequence)
        while len(self.recent) > self.size:
            self.held.discard(self.recent.popleft())
        return "accepted"


def replay_guard(rows: DataFrame, size: int = 1024) -> DataFrame:
    """``rows`` (session, arrival, sequence) with ``answer``. Sessions are read in order of arrival; a task holds one window."""

    def guard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window = None, Window(size)
        for frame in frames:
            answers = []
            for session, sequence in zip(frame["session"], frame["sequence"]):
                if session != now:
                    now, window = session, Window(size)
                answers.append(window.answer(int(sequence)))
            yield frame.assign(answer=answers)

    dealt = rows.select(
        "session", "arrival", "sequence"
    ).repartition("session").sortWithinPartitions("session", "arrival")
    return dealt.mapInPandas(guard, "session long, arrival long, sequence long, answer string")

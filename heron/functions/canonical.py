"""Canonical JSON, keyed digests and decibels as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of HMAC (RFC 2104): the block of SHA-256 and the bytes of the two pads.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C
#: Level of silence.
SILENCE_DB = -200.0


def canonical_json(text: Column) -> Column:
    """JSON without white space and with the keys of every object sorted; null where the text is not JSON."""
    return F.to_json(F.try_parse_json(text))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of a string or binary column as binary, by the built-in digest; null stays null."""
    block = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(INNER), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(pad(OUTER), inner), 256))


def decibels(rms: Column) -> Column:
    """20 * log10(rms), and silence at the least."""
    return F.when(rms > 0, F.greatest(20 * F.log10(rms), F.lit(SILENCE_DB))).otherwise(F.lit(SILENCE_DB))

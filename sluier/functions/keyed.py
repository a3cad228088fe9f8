"""Keys of sessions, HMAC-SHA256 from built-in functions, and the pseudonyms made with them.

What is written into a plan can be read in explain(), the web UI and event logs. The global key therefore stays in
the closure of one small Arrow function, which gives each row the padded key of its session; all values of the row
are then digested by built-in functions, from columns.
"""

from __future__ import annotations

import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 6


def pad_key(key: bytes, pad: int) -> str:
    """A key as hex, filled to 64 bytes and XORed with a pad byte."""
    return bytes(b ^ pad for b in key.ljust(64, b"\0")).hex()


def session_key(session_id: Column, key: bytes) -> Column:
    """HMAC of the session id under the global key, hex; null for a null session."""

    @F.arrow_udf("string")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if s is None else hmac.digest(key, s.encode(), "sha256").hex() for s in batch.to_pylist()], pa.string())

    return keys(session_id)


def session_pads(session_id: Column, key: bytes) -> Column:
    """(inner, outer): the padded forms of a session's key, hex, to be made once for all values of a row; nulls for a null session."""

    @F.arrow_udf("struct<inner:string,outer:string>")
    def pads(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sessions = batch.to_pylist()
            keys = {s: hmac.digest(key, s.encode(), "sha256") for s in set(sessions) if s is not None}
            told = [[None if s is None else pad_key(keys[s], pad) for s in sessions] for pad in (0x36, 0x5C)]
            yield pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in told], ["inner", "outer"])

    return pads(session_id)


def hmac_sha256(inner: Column, outer: Column, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string; inner and outer: the padded key as hex."""
    first = F.sha2(F.unhex(F.concat(inner, F.hex(message.cast("binary")))), 256)
    return F.sha2(F.unhex(F.concat(outer, first)), 256)


#: White space of any kind.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(value: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(value, F.lit(BLANKS))


def pseudonym(pads: Column, entity_type: Column, original: Column, code: Column, width: int = WIDTH) -> Column:
    """[CODE-xxxxxx] of a value in its session."""
    digest = hmac_sha256(pads["inner"], pads["outer"], F.concat(entity_type, F.lit(":"), strip(original)))
    return F.concat(F.lit("["), code, F.lit("-"), F.substring(digest, 1, width), F.lit("]"))

"""The write-ahead log beside a database: its committed pages laid over the file, by the published file format."""

from __future__ import annotations

import struct
import sys
from array import array

HEAD, FRAME = 32, 24
# The first word of a log, for checksums of little- and big-endian words.
MAGIC = {0x377F0682: "little", 0x377F0683: "big"}


def checksum(data: bytes, order: str, start: tuple[int, int] = (0, 0)) -> tuple[int, int]:
    """The log's running checksum of whole pairs of 32-bit words."""
    words = array("I", data)
    if sys.byteorder != order:
        words.byteswap()
    a, b = start
    for i in range(0, len(words), 2):
        a = (a + words[i] + b) & 0xFFFFFFFF
        b = (b + words[i + 1] + a) & 0xFFFFFFFF
    return a, b


def overlaid(data: bytes, log: bytes | None) -> bytes:
    """The database with all pages of the log's last commit and before.

    Frames count as long as their salts are the header's and the running checksum holds, up to the last one that commits; so
    a torn frame, an open transaction and what is left of an older log are not seen.  A log that is empty, or whose header is
    broken, changes nothing."""
    if not log or len(log) < HEAD:
        return data
    magic, version, size = struct.unpack_from(">III", log)
    order = MAGIC.get(magic)
    if order is None or version != 3007000 or size < 512 or size & (size - 1):
        return data
    salts, state = log[16:24], checksum(log[:24], order)
    if state != struct.unpack_from(">II", log, 24):
        return data
    open_: dict[int, int] = {}
    pages: dict[int, int] = {}
    count = None
    for at in range(HEAD, len(log) - FRAME - size + 1, FRAME + size):
        page, commit = struct.unpack_from(">II", log, at)
        state = checksum(log[at + FRAME : at + FRAME + size], order, checksum(log[at : at + 8], order, state))
        if log[at + 8 : at + 16] != salts or state != struct.unpack_from(">II", log, at + 16) or not page:
            break
        open_[page] = at + FRAME
        if commit:
            pages |= open_
            open_, count = {}, commit
    if count is None:
        return data
    out = bytearray(data[: count * size].ljust(count * size, b"\0"))
    for page, at in pages.items():
        if page <= count:
            out[(page - 1) * size : page * size] = log[at : at + size]
    return bytes(out)

"""Frames on a socket: the payload's length in bytes, a line feed, the payload, a line feed."""

from __future__ import annotations

from typing import BinaryIO


def send(out: BinaryIO, text: str) -> None:
    raw = text.encode()
    out.write(b"%d\n%s\n" % (len(raw), raw))
    out.flush()


def receive(source: BinaryIO, most: int = 1 << 28) -> str | None:
    """None at the end of the stream or after a broken frame."""
    head = source.readline(32).strip()
    if not head.isdigit() or int(head) > most:
        return None
    raw = source.read(int(head))
    if len(raw) < int(head):
        return None
    source.read(1)
    return raw.decode(errors="replace")

"""Revision ids: parsing, and the deterministic hash of an edit.

The hash is the MD5 of an Erlang external term (version 131, minor version 1): the list of the deleted flag, the
parent's generation, the parent's hash as bytes, the body and the attachments. Objects are one-tuples of a list of
name and value pairs in document order, strings are binaries, and a list of bytes only has the short string form.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterable
from typing import Any

from quillgrid.errors import QueryError

_REV = re.compile(r"([1-9][0-9]*)-([0-9A-Za-z]+)\Z")


def parse_rev(text: str) -> tuple[int, str]:
    m = _REV.match(text)
    if not m:
        raise QueryError("bad_request", f"Invalid rev format: {text}")
    return int(m[1]), m[2]


def format_rev(num: int, digest: str) -> str:
    return f"{num}-{digest}"


class _Raw(float):
    """A number whose literal had a fraction or an exponent."""


def _loads(text: str) -> Any:
    return json.loads(text, parse_float=_Raw, object_pairs_hook=lambda pairs: {"__pairs": pairs})


def _atom(name: str) -> bytes:
    return b"d" + struct.pack(">H", len(name)) + name.encode()


def _binary(data: bytes) -> bytes:
    return b"m" + struct.pack(">I", len(data)) + data


def _integer(n: int) -> bytes:
    if 0 <= n <= 255:
        return b"a" + bytes([n])
    if -(1 << 31) <= n < 1 << 31:
        return b"b" + struct.pack(">i", n)
    size = (abs(n).bit_length() + 7) // 8
    head = b"n" + bytes([size]) if size < 256 else b"o" + struct.pack(">I", size)
    return head + bytes([n < 0]) + abs(n).to_bytes(size, "little")


def _list(items: list[bytes]) -> bytes:
    return b"l" + struct.pack(">I", len(items)) + b"".join(items) + b"j" if items else b"j"


def _tuple(*items: bytes) -> bytes:
    return b"h" + bytes([len(items)]) + b"".join(items)


def term(value: Any) -> bytes:
    """A decoded JSON value as an external term, without the version byte."""
    if value is None or isinstance(value, bool):
        return _atom({None: "null", True: "true", False: "false"}[value])
    if isinstance(value, str):
        return _binary(value.encode())
    if isinstance(value, float):
        return b"F" + struct.pack(">d", value)
    if isinstance(value, int):
        return _integer(value)
    if isinstance(value, dict):
        return _tuple(_list([_tuple(_binary(k.encode()), term(v)) for k, v in value.get("__pairs", value.items())]))
    small = value and all(isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= 255 for x in value)
    if small and len(value) < 65536:
        return b"k" + struct.pack(">H", len(value)) + bytes(value)
    return _list([term(x) for x in value])


def rev_hash(deleted: bool, parent: tuple[int, str] | None, raw: str, attachments: Iterable[tuple[str, str, str]] = ()) -> str:
    """The hash of an edit; ``raw`` is the document's JSON text, attachments are (name, content type, digest)."""
    body = _loads(raw)
    pairs = [(k, v) for k, v in body["__pairs"] if not k.startswith("_")]
    start, old = parent or (0, "")
    if parent is None:
        before = _integer(0)
    else:
        before = _binary(bytes.fromhex(old) if re.fullmatch("[0-9a-fA-F]{32}", old) else old.encode())
    files = [_tuple(_binary(n.encode()), _binary(t.encode()), _binary(base64.b64decode(d.removeprefix("md5-")))) for n, t, d in attachments]
    whole = _list([_atom("true" if deleted else "false"), _integer(start), before, term({"__pairs": pairs}), _list(files[::-1])])
    return hashlib.md5(b"\x83" + whole).hexdigest()


def next_rev(deleted: bool, parent: tuple[int, str] | None, raw: str, attachments: Iterable[tuple[str, str, str]] = ()) -> tuple[int, str]:
    return (parent[0] if parent else 0) + 1, rev_hash(deleted, parent, raw, attachments)

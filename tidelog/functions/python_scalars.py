"""Functions that Spark has no expression for, as Arrow-batched UDFs, and the plain Python they are made of."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ip_bucket(ip: str | None) -> str | None:
    """IPv4 as it is (also when mapped into IPv6), IPv6 by its /64."""
    if ip is None:
        return None
    try:
        a = ipaddress.ip_address(ip)
    except ValueError:
        return None
    if a.version == 4:
        return str(a)
    if a.ipv4_mapped:
        return str(a.ipv4_mapped)
    return str(ipaddress.ip_network((a, 64), strict=False).network_address)


def leb128(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def read_leb128(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, place after it); at most ten bytes."""
    value = 0
    for k in range(10):
        if at >= len(data):
            raise ValueError("truncated number")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << (7 * k)
        if b < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
    raise ValueError("number too long")


def cbor(data: bytes, at: int = 0) -> tuple[object, int]:
    """(value, place after it) of the DAG-CBOR item at a place: integers, bytes, text, lists, maps, links (tag
    42), booleans, null and 64-bit floats."""
    import struct

    head = data[at]
    kind, low, at = head >> 5, head & 31, at + 1
    if kind == 7:
        if low in (20, 21, 22):
            return {20: False, 21: True, 22: None}[low], at
        if low == 27:
            return struct.unpack(">d", data[at : at + 8])[0], at + 8
        raise ValueError("unknown simple value")
    if low < 24:
        n = low
    elif low <= 27:
        width = 1 << (low - 24)
        if at + width > len(data):
            raise ValueError("truncated item")
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
    else:
        raise ValueError("indefinite length")
    if kind in (0, 1):
        return (n if kind == 0 else -1 - n), at
    if kind in (2, 3):
        if at + n > len(data):
            raise ValueError("truncated string")
        raw = bytes(data[at : at + n])
        return (raw if kind == 2 else raw.decode()), at + n
    if kind == 4:
        items = []
        for _ in range(n):
            x, at = cbor(data, at)
            items.append(x)
        return items, at
    if kind == 5:
        found = {}
        for _ in range(n):
            k, at = cbor(data, at)
            found[k], at = cbor(data, at)
        return found, at
    x, at = cbor(data, at)
    return x, at


def frame_meta(frame: bytes | None) -> tuple[str | None, str | None]:
    """(kind, did) of an event-stream frame: a header map {op, t}, then the body, whose repo or did names it."""
    try:
        header, at = cbor(frame)
        body, _ = cbor(frame, at)
        return header.get("t"), body.get("repo") or body.get("did")
    except (ValueError, IndexError, AttributeError, TypeError, UnicodeDecodeError):
        return None, None


@F.pandas_udf(T.StringType())
def ip_key(ip: pd.Series) -> pd.Series:
    return ip.map(ip_bucket, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("did", T.StringType())]))
def frame_meta_udf(frame: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([frame_meta(bytes(f) if f is not None else None) for f in frame], columns=["kind", "did"])

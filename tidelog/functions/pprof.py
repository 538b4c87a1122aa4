"""Heap profiles in the pprof format: gzip of one protobuf message. A Writer takes locations and samples as they come
and holds what is compressed so far, the names of functions and 8 bytes a location; samples_of() reads likewise.

Numbers of fields are those of the public profile.proto (fixed values)."""

from __future__ import annotations

import gzip
import zlib
from array import array
from collections.abc import Iterator

import numpy as np

from .python_scalars import leb128, read_leb128

PROFILE = {"sample_type": 1, "sample": 2, "mapping": 3, "location": 4, "function": 5, "string_table": 6, "period_type": 11, "period": 12}
VALUE_TYPE = {"type": 1, "unit": 2}
SAMPLE = {"location_id": 1, "value": 2}
MAPPING = {"id": 1, "memory_start": 2, "memory_limit": 3, "file_offset": 4, "filename": 5}
LOCATION = {"id": 1, "mapping_id": 2, "address": 3, "line": 4}
LINE = {"function_id": 1}
FUNCTION = {"id": 1, "name": 2, "system_name": 3}
SAMPLE_TYPES = (("inuse_objects", "count"), ("inuse_space", "bytes"))


def message(fields: dict[str, int], **values: int | bytes | list) -> bytes:
    """A protobuf message: integers as varints, bytes as they are, lists of integers packed, lists of bytes repeated."""
    out = b""
    for name, value in values.items():
        number = fields[name]
        if isinstance(value, int):
            out += leb128(number << 3) + leb128(value & (1 << 64) - 1) if value else b""
            continue
        if isinstance(value, list) and (not value or isinstance(value[0], int)):
            value = b"".join(leb128(v & (1 << 64) - 1) for v in value)
        for part in value if isinstance(value, list) else [value]:
            out += leb128(number << 3 | 2) + leb128(len(part)) + part
    return out


def fields_of(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields of varints and bytes."""
    at, end = 0, len(data)
    while at < end:
        head, at = (data[at], at + 1) if data[at] < 128 else read_leb128(data, at)
        value, at = (data[at], at + 1) if data[at] < 128 else read_leb128(data, at)
        if head & 7 == 2:
            value, at = data[at : at + value], at + value
        yield head >> 3, value


def packed(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for x in data:
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            out.append(value - (1 << 64) if value >> 63 else value)
            value = shift = 0
    return out


def encode(stacks: list[tuple[list[int], int, int]], names: dict[int, str], maps: list[tuple[int, int, int, str]], rate: int) -> bytes:
    """stacks: (addresses, leaf first; objects, bytes); names: function of an address; maps: (start, end, offset, path)."""
    strings = {"": 0}
    text = lambda s: strings.setdefault(s, len(strings))
    functions: dict[str, int] = {}
    locations: dict[int, int] = {}
    for addresses, *_ in stacks:
        for a in addresses:
            locations.setdefault(a, len(locations) + 1)
    types = [message(VALUE_TYPE, type=text(t), unit=text(u)) for t, u in SAMPLE_TYPES]
    maps = sorted(maps)
    where = [message(MAPPING, id=k, memory_start=a, memory_limit=z, file_offset=o, filename=text(p)) for k, (a, z, o, p) in enumerate(maps, 1)]
    places = []
    for a, number in locations.items():
        own = next((k for k, (lo, hi, *_) in enumerate(maps, 1) if lo <= a < hi), 0)
        line = [message(LINE, function_id=functions.setdefault(names[a], len(functions) + 1))] if a in names else []
        places.append(message(LOCATION, id=number, mapping_id=own, address=a, **({"line": line} if line else {})))
    samples = [message(SAMPLE, location_id=[locations[a] for a in addresses], value=[objs, size]) for addresses, objs, size in stacks]
    named = [message(FUNCTION, id=k, name=text(f), system_name=text(f)) for f, k in functions.items()]
    body = message(PROFILE, sample_type=types) if types else b""
    for kind, parts in (("sample", samples), ("mapping", where), ("location", places), ("function", named)):
        body += message(PROFILE, **{kind: parts}) if parts else b""
    period = message(VALUE_TYPE, type=text("space"), unit=text("bytes"))
    body += message(PROFILE, string_table=[s.encode() for s in strings], period_type=period, period=rate)
    return gzip.compress(body, mtime=0)


def varints(x: np.ndarray) -> tuple[bytes, np.ndarray]:
    """64-bit integers as varints, one after the other, and where each begins (and the last one ends)."""
    x = x.astype(np.int64).view(np.uint64)
    n = 1 + sum(((x >> np.uint64(7 * k)) > 0).astype(np.int64) for k in range(1, 10))
    at = np.append(0, np.cumsum(n))
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(n.max(initial=0))):
        on = n > k
        out[at[:-1][on] + k] = ((x[on] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(n[on] > k + 1, 128, 0).astype(np.uint64)
    return out.tobytes(), at


class Writer:
    """A profile, written as it comes: first the locations, by address, then the samples."""

    def __init__(self, rate: int):
        self.rate, self.strings, self.functions, self.addresses = rate, {"": 0}, {}, array("q")
        self.known, self.lines, self.parts, self.packer = np.zeros(0, np.int64), {}, [], zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(message(PROFILE, sample_type=[message(VALUE_TYPE, type=self._text(t), unit=self._text(u)) for t, u in SAMPLE_TYPES]))

    def _text(self, s: str) -> int:
        return self.strings.setdefault(s, len(self.strings))

    def _put(self, data: bytes) -> None:
        if data := self.packer.compress(data):
            self.parts.append(data)

    def location(self, address: int, names: list[str]) -> None:
        """Addresses rise."""
        self.addresses.append(address)
        if (line := self.lines.get(key := tuple(names))) is None:
            line = [message(LINE, function_id=self.functions.setdefault(f, len(self.functions) + 1)) for f in names]
            line = self.lines[key] = message(LOCATION, line=line) if line else b""
        own = b"\x08" + leb128(len(self.addresses)) + b"\x18" + leb128(address & (1 << 64) - 1) + line
        self._put(b'"' + leb128(len(own)) + own)

    def samples(self, sizes: np.ndarray, addresses: np.ndarray, objs: np.ndarray, size: np.ndarray) -> None:
        """sizes: how many of the addresses each sample has."""
        if len(self.known) != len(self.addresses):
            self.known = np.array(self.addresses, np.int64)
        ids, at = varints(np.searchsorted(self.known, addresses) + 1)
        values, place = varints(np.stack([objs, size], 1).ravel())
        ends = np.append(0, np.cumsum(sizes))
        out = []
        for k in range(len(sizes)):
            a, z = ids[at[ends[k]] : at[ends[k + 1]]], values[place[2 * k] : place[2 * k + 2]]
            own = b"\n" + leb128(len(a)) + a + b"\x12" + leb128(len(z)) + z
            out.append(b"\x12" + leb128(len(own)) + own)
        self._put(b"".join(out))

    def finish(self) -> bytes:
        for f, k in self.functions.items():
            self._put(message(PROFILE, function=[message(FUNCTION, id=k, name=self._text(f), system_name=self._text(f))]))
        period = message(VALUE_TYPE, type=self._text("space"), unit=self._text("bytes"))
        self._put(message(PROFILE, string_table=[s.encode() for s in self.strings], period_type=period, period=self.rate))
        return b"".join([*self.parts, self.packer.flush()])


def samples_of(data: bytes) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """The samples of a profile: addresses, functions of those that have one, values. Of the locations 16 bytes each
    are held, of the samples one."""
    raw = gzip.decompress(data)
    texts, functions, kinds = [], {}, {}
    ids, addresses, lines = array("Q"), array("q"), array("i")
    for number, value in fields_of(raw):
        if number == PROFILE["string_table"]:
            texts.append(value.decode())
        elif number == PROFILE["function"]:
            own = dict(fields_of(value))
            functions[own[FUNCTION["id"]]] = own.get(FUNCTION["name"], 0)
        elif number == PROFILE["location"]:
            address, own = 0, ()
            for n, v in fields_of(value):
                if n == LOCATION["id"]:
                    ids.append(v)
                elif n == LOCATION["address"]:
                    address = v
                elif n == LOCATION["line"]:
                    own += (v,)
            addresses.append(address - (1 << 64) if address >> 63 else address)
            lines.append(kinds.setdefault(own, len(kinds)))
    named = [[texts[functions[dict(fields_of(v))[LINE["function_id"]]]] for v in own] for own in kinds]
    dense = not len(ids) or bool((np.frombuffer(ids, np.uint64) == np.arange(1, len(ids) + 1, dtype=np.uint64)).all())
    where = None if dense else {x: k for k, x in enumerate(ids)}
    for number, value in fields_of(raw):
        if number == PROFILE["sample"]:
            own = dict(fields_of(value))
            at = [x - 1 if dense else where[x] for x in packed(own[SAMPLE["location_id"]])]
            yield [addresses[k] for k in at], [f for k in at for f in named[lines[k]]], packed(own[SAMPLE["value"]])


def decode(data: bytes) -> list[tuple[list[int], list[str], list[int]]]:
    return list(samples_of(data))

"""The binary segment format: building, sealing, compressing and parsing one log object.

Numbers are big-endian. A header is never compressed; the body is plain or one zstd frame. A fence is the
magic and the name of who closed the log."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..functions.python_scalars import leb128, read_leb128

#: Fixed values of the format: magics by feature level, the fence's, codecs, the mark of a delete and of derived mutations.
MAGICS = {b"VLSEG06\n": 1}
FENCE = b"VLFENCE\n"
CODEC_NONE, CODEC_ZSTD = 0, 1
DELETED, DERIVED = 0xFFFFFFFF, 1 << 31
#: A body whose frame doesn't state its size may have so many bytes.
MAX_BODY = 1 << 30

Mutation = tuple[bytes, bytes | None]
#: Layouts of the fixed parts: of a header after the log's name, and of an entry before its frame.
HEAD, ENTRY = ">QQqqIBI", ">qIQI"
HEAD_SIZE, ENTRY_SIZE = struct.calcsize(HEAD), struct.calcsize(ENTRY)


class FormatError(ValueError):
    """A log object that isn't one, or is cut short."""


@dataclass
class Header:
    log_id: str
    ordinal: int
    prefix_end: int
    first_seq: int
    last_seq: int
    count: int
    codec: int
    body_len: int
    level: int = 1
    size: int = 0


@dataclass
class Entry:
    seq: int
    shard: int
    epoch: int
    frame: bytes
    muts: list[Mutation] = field(default_factory=list)
    derived: int = 0
    gen: int = 0


def fence(by: str) -> bytes:
    return FENCE + by.encode()


def build(log_id: str, ordinal: int, prefix_end: int, entries: list[Entry]) -> bytes:
    """A sealed, uncompressed segment. An entry's first `derived` mutations aren't stored: a reader rebuilds them."""
    body = bytearray()
    for e in entries:
        body += struct.pack(ENTRY, e.seq, e.shard, e.epoch, len(e.frame)) + e.frame
        stored = e.muts[e.derived :]
        body += struct.pack(">I", DERIVED | e.derived << 16 | len(stored)) + leb128(e.gen) if e.derived else struct.pack(">I", len(stored))
        for key, value in stored:
            body += struct.pack(">H", len(key)) + key + struct.pack(">I", DELETED if value is None else len(value)) + (value or b"")
    return seal_body(log_id, ordinal, prefix_end, [e.seq for e in entries], bytes(body))


def build_events(log_id: str, ordinal: int, prefix_end: int, seqs: list, shards: list, epochs: list, frames: list) -> bytes:
    """build() of entries without mutations, given by columns."""
    pack = struct.Struct(ENTRY).pack
    body = b"".join([pack(seq, shard, epoch, len(frame)) + frame + b"\0\0\0\0" for seq, shard, epoch, frame in zip(seqs, shards, epochs, frames, strict=True)])
    return seal_body(log_id, ordinal, prefix_end, seqs, body)


def seal_body(log_id: str, ordinal: int, prefix_end: int, seqs: list[int], body: bytes) -> bytes:
    if prefix_end > ordinal:
        raise FormatError(f"prefix end {prefix_end} past ordinal {ordinal}")
    name = log_id.encode()
    head = struct.pack(HEAD, ordinal, prefix_end, min(seqs, default=0), max(seqs, default=0), len(seqs), CODEC_NONE, len(body))
    magic = next(m for m, level in MAGICS.items() if level == 1)
    return magic + struct.pack(">H", len(name)) + name + head + body


def parse_header(data: bytes) -> Header | None:
    """From an object or its beginning. None for a fence."""
    if data[:8] == FENCE:
        return None
    level = MAGICS.get(bytes(data[:8]))
    if level is None:
        raise FormatError("unknown magic")
    if len(data) < 10:
        raise FormatError("truncated header")
    at = 10 + struct.unpack(">H", data[8:10])[0]
    if len(data) < at + HEAD_SIZE:
        raise FormatError("truncated header")
    h = Header(data[10:at].decode(), *struct.unpack(HEAD, data[at : at + HEAD_SIZE]), level=level, size=at + HEAD_SIZE)
    if h.prefix_end > h.ordinal:
        raise FormatError(f"prefix end {h.prefix_end} past ordinal {h.ordinal}")
    return h


def compress(data: bytes, level: int = 1) -> bytes:
    """The object with its body as a zstd frame if that is smaller; level 0 leaves it alone, as do fences."""
    import zstandard

    h = parse_header(data)
    if h is None or level == 0:
        return data
    if h.codec != CODEC_NONE or len(data) != h.size + h.body_len:
        raise FormatError("not a sealed, uncompressed segment")
    body = zstandard.ZstdCompressor(level=level).compress(data[h.size :])
    if len(body) >= h.body_len:
        return data
    return data[: h.size - 5] + bytes([CODEC_ZSTD]) + data[h.size - 4 : h.size] + body


def body_of(data: bytes, h: Header) -> bytes:
    import zstandard

    body = data[h.size :]
    if h.codec == CODEC_ZSTD:
        try:
            stated = zstandard.frame_content_size(body)
            if stated >= 0 and stated != h.body_len:
                raise FormatError("the frame states another size than the header")
            if stated < 0 and h.body_len > MAX_BODY:
                raise FormatError("the body is too large")
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=h.body_len)
        except zstandard.ZstdError as e:
            raise FormatError(str(e)) from e
    elif h.codec != CODEC_NONE:
        raise FormatError(f"unknown codec {h.codec}")
    if len(body) != h.body_len:
        raise FormatError("truncated body")
    return body


def parse_entries(data: bytes, shard: int | None = None, with_muts: bool = True, derive: Callable[[bytes, int, int], list[Mutation]] | None = None) -> Iterator[Entry]:
    """An object's entries, of one shard if asked. Derived mutations come first; without `derive` asking for
    them is an error."""
    return (e for _, e in indexed_entries(data, shard, with_muts, derive))


def indexed_entries(data: bytes, shard: int | None = None, with_muts: bool = True, derive: Callable[[bytes, int, int], list[Mutation]] | None = None) -> Iterator[tuple[int, Entry]]:
    """parse_entries() with each entry's number in the object."""
    h = parse_header(data)
    if h is None:
        return
    body, at = body_of(data, h), 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(body):
            raise FormatError("truncated segment")
        at += n
        return body[at - n : at]

    for i in range(h.count):
        seq, own, epoch, size = struct.unpack(ENTRY, take(ENTRY_SIZE))
        frame = take(size)
        (stored,) = struct.unpack(">I", take(4))
        derived = gen = 0
        if stored & DERIVED:
            derived, stored = (stored & ~DERIVED) >> 16, stored & 0xFFFF
            if derived:
                gen, at = read_leb128(body, at)
        wanted = shard is None or shard == own
        e = Entry(seq, own, epoch, frame, gen=gen)
        if derived and with_muts and wanted:
            if derive is None:
                raise FormatError(f"entry {seq} has derived mutations and there is nothing to derive them")
            e.muts, e.derived = list(derive(frame, derived, gen)), derived
        for _ in range(stored):
            key = take(struct.unpack(">H", take(2))[0])
            (size,) = struct.unpack(">I", take(4))
            value = None if size == DELETED else take(size)
            if with_muts and wanted:
                e.muts.append((key, value))
        if wanted:
            yield i, e


def parse_columns(data: bytes, shard: int | None = None) -> tuple[list, list, list, list, list] | None:
    """(idx, seq, shard, epoch, frame) of an object's entries, by columns and without their mutations. None for a fence."""
    h = parse_header(data)
    if h is None:
        return None
    body, at = body_of(data, h), 0
    entry, word, key_size = struct.Struct(ENTRY).unpack_from, struct.Struct(">I").unpack_from, struct.Struct(">H").unpack_from
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    try:
        for i in range(h.count):
            seq, own, epoch, size = entry(body, at)
            start = at + ENTRY_SIZE
            at = end = start + size
            (stored,) = word(body, at)
            at += 4
            if stored:
                if stored & DERIVED:
                    derived, stored = (stored & ~DERIVED) >> 16, stored & 0xFFFF
                    if derived:
                        at = read_leb128(body, at)[1]
                for _ in range(stored):
                    at += 2 + key_size(body, at)[0]
                    (size,) = word(body, at)
                    at += 4 + (0 if size == DELETED else size)
            if shard is None or shard == own:
                for column, value in zip(out, (i, seq, own, epoch, body[start:end]), strict=True):
                    column.append(value)
    except (struct.error, ValueError) as e:
        raise FormatError("truncated segment") from e
    if at > len(body):
        raise FormatError("truncated segment")
    return out


def checksum(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()[:8]

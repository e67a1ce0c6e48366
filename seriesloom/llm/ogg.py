"""Ogg media columns: pages with checksums, packets from lacing values, logical streams, timestamps from granules."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import extended, raw

#: Samples (bytes) a second of the 8-bit streams written here, bytes of a packet, and packets of a page at most.
RATE, PACKET, PAGE_PACKETS = 8000, 4000, 15
MAGIC = b"u8pcm\x00\x01\x00"
_HEAD = "<4sBBqIIIB"
_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 04C11DB7, most significant bit first, start 0): zlib's of the bit-reversed bytes."""
    return int(f"{zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def write_page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    page = struct.pack(_HEAD, b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", page_crc(page)) + page[26:]


def _pages(serial: int, packets: list[tuple[bytes, int]], last: bool) -> Iterator[tuple[int, bytes]]:
    """(granule, page) for the packets (data, granule at its end) of a stream, headers first."""
    lacing, body, flags, seq, granule, begun = bytearray(), [], 2, 0, -1, 0
    for k, (data, end) in enumerate(packets):
        marks, at = b"\xff" * (len(data) // 255) + bytes([len(data) % 255]), 0
        while marks:
            room = 255 - len(lacing)
            now, marks = marks[:room], marks[room:]
            n = sum(now)
            lacing += now
            body.append(data[at : at + n])
            at += n
            if not marks:
                granule, begun = end, begun + 1
            full = len(lacing) == 255
            if full or (not marks and (k == 0 or begun == PAGE_PACKETS or k == len(packets) - 1)):
                end_flag = 4 if last and not marks and k == len(packets) - 1 else 0
                yield granule, write_page(serial, seq, granule, flags | end_flag, bytes(lacing), b"".join(body))
                lacing, body, flags, seq, granule, begun = bytearray(), [], 1 if marks else 0, seq + 1, -1, 0


def mux(payload: bytes) -> bytes:
    """The payload as 8-bit samples in two interleaved logical streams that hold its packets in turn.

    Each stream begins with a header packet (magic, rate, stream number, number of
    streams, samples of a packet); a data
    packet's granule is the number of samples of the whole payload up to its end.
    Serial numbers come from the payload, so equal payloads give equal files.
    """
    base = zlib.crc32(payload)
    streams = []
    for s in (0, 1):
        data = [(payload[a : a + PACKET], min(a + PACKET, len(payload))) for a in range(s * PACKET, len(payload), 2 * PACKET)]
        streams.append(list(_pages((base + s) & 0xFFFFFFFF, [(MAGIC + struct.pack("<IIII", RATE, s, 2, PACKET), 0), *data], True)))
    out = [p[0][1] for p in streams]  # all streams' first pages come before any other page
    rest = sorted(((g, s, k, page) for s, pages in enumerate(streams) for k, (g, page) in enumerate(pages[1:])), key=lambda x: (x[1], x[2]))
    reach = {0: 0, 1: 0}
    ordered = []
    for g, s, k, page in rest:  # a page that ends no packet belongs where its stream has come to
        reach[s] = max(reach[s], g)
        ordered.append((reach[s], s, k, page))
    return b"".join(out + [x[3] for x in sorted(ordered, key=lambda x: x[:3])])


@dataclass
class Logical:
    """What was read of one logical stream. packets: (granule at the end, or None inside a page; data)."""

    serial: int
    packets: list[tuple[int | None, bytes]] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    granule: int = 0
    _part: list[bytes] | None = None
    _next: int = 0


@dataclass
class Container:
    streams: dict[int, Logical]
    pages: int = 0
    bad_pages: int = 0
    skipped_bytes: int = 0


def demux(media: bytes | None) -> Container:
    """Read an Ogg file: every page's checksum is verified, packets are put together over pages, streams are kept apart.

    A page with a wrong checksum or cut short is counted and skipped, and reading
    goes on at the next capture pattern; a packet that lacks a page (sequence
    gap, missing start or end) is counted as lost, never returned in part.  Null
    and empty media give no streams.
    """
    out, at, media = Container({}), 0, media or b""
    while at < len(media):
        if media[at : at + 4] != b"OggS":
            to = media.find(b"OggS", at + 1)
            to = len(media) if to < 0 else to
            out.skipped_bytes += to - at
            at = to
            continue
        head = media[at : at + 27]
        count = head[26] if len(head) == 27 else 0
        lacing = media[at + 27 : at + 27 + count]
        size = 27 + count + sum(lacing)
        page = media[at : at + size]
        if len(head) < 27 or len(lacing) < count or len(page) < size or head[4] or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != struct.unpack_from("<I", head, 22)[0]:
            out.bad_pages += 1
            at += 4
            out.skipped_bytes += min(4, len(media) - at + 4)
            continue
        _, _, flags, granule, serial, sequence, _, _ = struct.unpack(_HEAD, head)
        s = out.streams.setdefault(serial, Logical(serial))
        out.pages += 1
        if s.pages and sequence != s._next or not s.pages and sequence and flags & 1:
            if s._part is not None:
                s.lost, s._part = s.lost + 1, None
        s.pages, s._next, s.ended = s.pages + 1, sequence + 1, s.ended or bool(flags & 4)
        if granule >= 0:
            s.granule = max(s.granule, granule)
        pos, ended = at + 27 + count, []
        part = s._part if flags & 1 else []
        if not flags & 1 and s._part is not None:
            s.lost += 1
        orphan = flags & 1 and part is None  # the rest of a packet whose start is missing
        part = [] if part is None else part
        for k, n in enumerate(lacing):
            part.append(media[pos : pos + n])
            pos += n
            if n < 255:
                if orphan:
                    s.lost, orphan = s.lost + 1, False
                else:
                    ended.append(b"".join(part))
                part = []
        s._part = part if lacing and lacing[-1] == 255 and not orphan else None
        s.packets += [(None, p) for p in ended[:-1]] + [(granule if granule >= 0 else None, p) for p in ended[-1:]]
        at += size
    for s in out.streams.values():
        if s._part is not None:
            s.lost += 1
    return out


def interleaved(header: bytes) -> int:
    """Samples of the other streams between two packets of a stream, as its header packet says; 0 for other headers."""
    if not header.startswith(MAGIC) or len(header) < len(MAGIC) + 16:
        return 0
    _, _, streams, packet = struct.unpack_from("<IIII", header, len(MAGIC))
    return (streams - 1) * packet


def timed(stream: Logical) -> list[tuple[int, bytes]]:
    """(granule at the end, data) of the data packets: a page gives its last packet's, the others count back from it.

    A packet of 8-bit samples lasts as long as its bytes; between two of them lies
    what the stream's header says that other streams send.  A stream without such
    a header has all samples itself.
    """
    out: list[tuple[int, bytes]] = []
    pending: list[bytes] = []
    gap = interleaved(stream.packets[0][1]) if stream.packets else 0
    for granule, data in stream.packets[1:]:
        pending.append(data)
        if granule is not None:
            end = granule
            back = []
            for p in reversed(pending):
                back.append((end, p))
                end -= len(p) + gap
            out += back[::-1]
            pending = []
    return out


def payload_of(found: Container) -> bytes:
    """The samples of all streams put together in the order of their timestamps."""
    parts = [x for s in found.streams.values() for x in timed(s)]
    return b"".join(data for _, data in sorted(parts, key=lambda x: x[0]))


def padded(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def store_media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Replace the text by ``out``, an Ogg file with the whole text (null: empty); other columns pass through.

    Repeated rows give equal files; an empty table stays empty.
    """

    def task() -> Callable[[pa.Array], list[pa.Array]]:
        return lambda texts: [pa.array((mux(padded(raw(x))) for x in texts), pa.binary())]

    return extended(docs, text, [T.StructField(out, T.BinaryType())], task, (text,))


FEATURES = "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, pages long, bad_pages long, streams long, packets long, lost_packets long, duration_ms long, feature string"


def read_media(stored: DataFrame, media: str = "media") -> DataFrame:
    """Replace the ``media`` column by what its bytes hold: payload digests, pages, packets, streams, duration.

    Damaged files give what is whole in them: bad pages and lost packets are
    counted.  Null media read as empty: no pages, payload of 0 bytes.  Repeated
    rows are read alike; an empty table stays empty.
    """

    def features(x: pa.Scalar) -> tuple:
        data = raw(x)
        found = demux(data)
        payload = payload_of(found)
        streams = sorted(found.streams.values(), key=lambda s: s.packets[0][1] if s.packets else b"")
        ms = max((s.granule for s in streams), default=0) * 1000 // RATE
        per = ";".join(f"{s.pages}p{len(s.packets)}k@{s.granule}{'e' if s.ended else ''}" for s in streams)
        packets, lost = sum(len(s.packets) for s in streams), sum(s.lost for s in streams)
        level = sum(payload) // max(len(payload), 1)
        text = f"ogg pages={found.pages} bad={found.bad_pages} streams={len(streams)} packets={packets} lost={lost} ms={ms} mean={level} [{per}]"
        return (len(data), hashlib.sha256(data).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), found.pages, found.bad_pages, len(streams), packets, lost, ms, text)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 7, pa.string()]

    def task() -> Callable[[pa.Array], list[pa.Array]]:
        def make(files: pa.Array) -> list[pa.Array]:
            rows = [features(x) for x in files]
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

        return make

    return extended(stored, media, T._parse_datatype_string(FEATURES).fields, task, (media,))

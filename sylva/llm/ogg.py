"""Ogg as a media column: pages with checksums, lacing, logical streams and granule positions (RFC 3533)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_of, small_batches

HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
FRAME = 576
RATE = 8000
SAMPLES, NOTES = 1, 2  # serial numbers of the two logical streams of a stored payload
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes are not a sound Ogg file."""


def checksum(data: bytes) -> int:
    """Ogg's CRC: polynomial 0x04c11db7, most significant bit first, from 0. zlib's runs least significant bit first, so bits are mirrored going in and out."""
    low = zlib.crc32(data.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(MIRROR), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    whole = head + lacing + body
    return whole[:22] + checksum(whole).to_bytes(4, "little") + whole[26:]


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """One logical stream. The first packet has a page of its own; a packet may run on over pages. packets: bytes, granule position at its end."""
    number = 0
    for part in (packets[:1], packets[1:]):
        lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p, _ in part)
        body = b"".join(p for p, _ in part)
        ends = np.cumsum([len(p) // 255 + 1 for p, _ in part])  # lacing values up to the end of each packet
        at = byte = 0
        while at < len(lacing):
            values = lacing[at : at + 255]
            size = sum(values)
            done = int(np.searchsorted(ends, at + len(values), "right"))  # packets that end in or before this page
            before = int(np.searchsorted(ends, at, "right"))
            flags = (CONTINUED if at and lacing[at - 1] == 255 else 0) | (FIRST if number == 0 else 0)
            if at + len(values) == len(lacing) and (part is not packets and (number or len(packets) == 1)):
                flags |= LAST
            yield page(flags, part[done - 1][1] if done > before else -1, serial, number, values, body[byte : byte + size])
            at, byte, number = at + len(values), byte + size, number + 1


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """Logical streams in one file: all first pages, then the others by turns."""
    queues = [list(pages_of(serial, packets)) for serial, packets in streams.items()]
    out = [q[0] for q in queues]
    rest = [q[1:] for q in queues]
    for i in range(max(map(len, rest), default=0)):
        out += [q[i] for q in rest if i < len(q)]
    return b"".join(out)


@dataclass
class Stream:
    """A demultiplexed logical stream. granules: the position known at each packet's end, or -1."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    ended: bool = False
    next_page: int = 0
    partial: bytes = b""
    open: bool = False

    def seconds(self, rate: int) -> list[float]:
        """Time at which each packet ends; packets between marks are spread evenly up to the next mark."""
        out, last, since = [0.0] * len(self.packets), 0, 0
        for i, g in enumerate(self.granules):
            if g >= 0:
                for j in range(since, i + 1):
                    out[j] = (last + (g - last) * (j - since + 1) / (i - since + 1)) / rate
                last, since = g, i + 1
        for j in range(since, len(out)):
            out[j] = last / rate
        return out


def demux(data: bytes) -> dict[int, Stream]:
    """Reads a whole file. Raises OggError on a bad checksum, a gap in page numbers, or a cut packet."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError(f"a page header is cut at {at}")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"the page at {at} is cut")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"the checksum of the page at {at} is wrong")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream()
        s = streams.get(serial)
        if s is None or s.ended or number != s.next_page or bool(flags & CONTINUED) != s.open:
            raise OggError(f"the page at {at} does not follow in stream {serial}")
        s.next_page += 1
        begin = byte = at + 27 + n
        finished = len(s.packets)
        for value in lacing:
            byte += value
            if value < 255:
                s.packets.append(s.partial + data[begin:byte] if s.open else data[begin:byte])
                s.granules.append(-1)
                s.partial, s.open, begin = b"", False, byte
        if lacing and lacing[-1] == 255:
            s.partial, s.open = s.partial + data[begin:end], True
        if len(s.packets) > finished:
            s.granules[-1] = granule
        s.ended = bool(flags & LAST)
        at = end
    for serial, s in streams.items():
        if s.open:
            raise OggError(f"the last packet of stream {serial} is cut")
    return streams


def store(payload: bytes, notes: bytes = b"") -> bytes:
    """8-bit mono samples in packets of 576, with a second logical stream of notes."""
    packets = [(b"\x01samples8" + struct.pack("<IB", RATE, 1), 0)]
    packets += [(payload[i : i + FRAME], min(i + FRAME, len(payload))) for i in range(0, len(payload), FRAME)]
    return mux({SAMPLES: packets, NOTES: [(b"\x01notes", 0), (notes, len(payload))]})


def load(data: bytes) -> tuple[bytes, bytes, float]:
    """Payload, notes, seconds of a stored file."""
    streams = demux(data)
    if set(streams) != {SAMPLES, NOTES}:
        raise OggError("samples or notes are missing")
    s = streams[SAMPLES]
    rate = struct.unpack_from("<I", s.packets[0], 9)[0]
    return b"".join(s.packets[1:]), streams[NOTES].packets[1], s.seconds(rate)[-1]


def feature(samples: bytes, seconds: float) -> str:
    """Whole-number features of 8-bit samples: length in ms, mean, spread, frame energies, sign changes, peak."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    energy = np.einsum("ij,ij->i", y := x.reshape(-1, FRAME).astype(np.int64), y)
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    mean = int(x.sum()) * 1000 // len(x)
    return f"ms={round(seconds * 1000)};mean={mean};energy={int(energy.sum()) // len(x)};low={int(energy.min()) // FRAME};high={int(energy.max()) // FRAME};turns={changes};peak={int(np.abs(x).max())}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // FRAME)) * FRAME
    return raw.ljust(size, b"\xff"), len(raw)


def described(texts: Iterable[str | None]) -> Iterator[tuple]:
    for text in texts:
        payload, n = padded(text)
        media = store(payload, n.to_bytes(8, "little"))
        back, _, seconds = load(media)
        yield n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, seconds)


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``media`` (binary): each text as a stored Ogg file. A null text is empty and becomes one frame of padding."""

    def run(batches):
        for b in batches:
            files = []
            for text in b.column("text").to_pylist():
                payload, n = padded(text)
                files.append(store(payload, n.to_bytes(8, "little")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(files, pa.binary())], ["doc_id", "media"])

    small_batches(df.sparkSession)
    return docs_of(df, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its payload is stored as Ogg, read back with every check, and described.

    Null and empty texts give one frame of padding; equal texts give equal values; repeated rows give repeated rows.
    """

    def run(batches):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for b in batches:
            columns = list(zip(*described(b.column("text").to_pylist()), strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    small_batches(df.sparkSession)
    return docs_of(df, id_col, text_col).mapInArrow(run, SCHEMA)

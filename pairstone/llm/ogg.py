"""Media columns in Ogg: texts stored as 8-bit samples in a checked, multiplexed container, and read back.

A stored value holds two logical streams. The sample stream has a header packet (magic, sample
rate, padding) and data packets of FRAME samples; the granule position of its pages is the number
of samples ended so far, so a page's time is granule / rate. The note stream carries one packet,
the payload's unpadded length, so that a reader has to demultiplex. Packets are laid into
segments of 255 bytes by lacing values; a packet that fills a page goes on in the next.

The reader verifies each page's checksum and sequence number, puts packets together across pages,
separates the streams by serial number and derives timestamps from granule positions. It raises
ValueError for damage. Null and empty texts become one block of 64 zero bytes; equal texts give
equal bytes, repeated rows each their own; doc_id may be null; an empty table gives no rows; nothing is compared, so there
are no ties. Other columns, whatever their names, are not read. A very long text is stored whole by the task that holds it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairstone.llm.runtime import map_rows

RATE, FRAME, BLOCK = 8000, 4096, 64
SAMPLES, NOTES = 1, 2  # serial numbers
MAGIC, NOTE_MAGIC = b"\x80pcm8\0", b"\x80note\0"
#: The most segments that a page can hold.
PAGE_SEGMENTS = 255
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = (1 << 64) - 1

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The container's checksum: polynomial 0x04c11db7, most significant bit first, from 0.

    zlib computes the mirrored form of the same polynomial, so bytes and result are mirrored.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def _stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one stream from (packet, granule at its end). The first packet has a page of its own."""
    pages, lacing, body, granule, continued = [], bytearray(), bytearray(), NO_GRANULE, False

    def flush(last: bool, goes_on: bool) -> None:
        nonlocal granule, continued
        flags = CONTINUED * continued | FIRST * (not pages) | LAST * last
        pages.append(_page(serial, len(pages), flags, granule, bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        granule, continued = NO_GRANULE, goes_on

    for i, (packet, end) in enumerate(packets):
        values, done = _lacing(len(packet)), 0
        if len(lacing) == PAGE_SEGMENTS:
            flush(False, False)
        while values:
            room = PAGE_SEGMENTS - len(lacing)
            now, values = values[:room], values[room:]
            size = sum(now)
            lacing += now
            body += packet[done : done + size]
            done += size
            if values:
                flush(False, True)
        granule = end
        if i == 0 and len(packets) > 1:
            flush(False, False)
    flush(True, False)
    return pages


def store(payload: bytes, note: bytes) -> bytes:
    """A container with the payload as 8-bit samples; the pages of the two streams take turns."""
    header = MAGIC + struct.pack("<IB", RATE, 8)
    frames = [(payload[i : i + FRAME], min(i + FRAME, len(payload))) for i in range(0, len(payload), FRAME)]
    samples = _stream(SAMPLES, [(header, 0), *frames])
    notes = _stream(NOTES, [(NOTE_MAGIC, 0), (note, 0)])
    # Every stream's first page comes before any other page.
    return b"".join([samples[0], notes[0], samples[1], *notes[1:], *samples[2:]])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    pages: int = 0
    granule: int = 0
    ended: bool = False
    #: Seconds at which each page with an end of a packet stops.
    times: list[float] = field(default_factory=list)
    open: list[bytes] = field(default_factory=list)


def read(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError("a page is cut short")
        magic, version, flags, granule, serial, number, crc, segments = struct.unpack_from("<4sBBQIIIB", data, at)
        lacing = data[at + 27 : at + 27 + segments]
        begin = at + 27 + segments
        end = begin + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < segments or end > len(data):
            raise ValueError(f"no whole page at byte {at}")
        if page_crc(b"".join((view[at : at + 22], bytes(4), view[at + 26 : end]))) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        if bool(flags & FIRST) != (serial not in streams):
            raise ValueError(f"stream {serial} begins twice or never")
        stream = streams.setdefault(serial, Stream())
        if stream.ended or number != stream.pages or bool(flags & CONTINUED) != bool(stream.open):
            raise ValueError(f"page {number} of stream {serial} is out of order")
        stream.pages += 1
        place = from_ = begin
        for value in lacing:
            place += value
            if value < 255:
                stream.open.append(data[from_:place])
                stream.packets.append(b"".join(stream.open))
                stream.open.clear()
                from_ = place
        if from_ < place or (lacing and lacing[-1] == 255):
            stream.open.append(data[from_:place])
        if granule != NO_GRANULE:
            stream.granule = granule
            stream.times.append(granule / RATE)
        stream.ended = bool(flags & LAST)
        at = end
    if any(x.open or not x.ended for x in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def payload_of(data: bytes) -> tuple[bytes, int, Stream]:
    """Samples, unpadded length and the sample stream of a stored value."""
    streams = read(data)
    sound, notes = streams[SAMPLES], streams[NOTES]
    if not sound.packets[0].startswith(MAGIC) or notes.packets[0] != NOTE_MAGIC:
        raise ValueError("a header is missing")
    payload = b"".join(sound.packets[1:])
    if sound.granule != len(payload):
        raise ValueError("the last granule position isn't the number of samples")
    return payload, int.from_bytes(notes.packets[1], "little"), sound


def features(payload: bytes, sound: Stream) -> str:
    """Pages, seconds, mean, root mean square and zero crossings of the samples around 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    below = x < 0
    crossings = int(np.count_nonzero(below[1:] != below[:-1]))
    rms = float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    return f"pages={sound.pages};seconds={sound.times[-1]:.6f};mean={float(x.mean()):.6f};rms={rms:.6f};crossings={crossings}"


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK or (BLOCK if not raw else 0))


def store_text(text: str) -> bytes:
    raw = text.encode()
    return store(pad(raw), len(raw).to_bytes(8, "little"))


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id and the stored form of each text."""
    return map_rows(docs, lambda batch: {"media": pa.array([store_text(x) for x in batch], pa.binary())}, "media binary")


def media_report(docs: DataFrame) -> DataFrame:
    """Store each text, read it back in the same worker, and keep digests and features only."""

    def run(batch: list[str]) -> dict:
        rows = []
        for text in batch:
            media = store_text(text)
            payload, n_bytes, sound = payload_of(media)
            rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, sound)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}

    return map_rows(docs, run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

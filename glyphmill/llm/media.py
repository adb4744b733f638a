"""Signature sniffing: an Aho-Corasick automaton finds magic bytes in one pass, validators confirm structure and lengths.

`sniff` corrects the declared type of a byte string and carves every embedded medium whose structure holds; what only looks
like a magic number is rejected. `media_columns` stores texts losslessly as 8-bit PCM samples and reads them back.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm.common import byte_slices, one, worker_state

#: Magic bytes of the formats' public specifications.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"RIFF", "riff"),
    (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"),
    (b"fLaC", "audio/flac"),
    (b"OggS", "audio/ogg"),
    (b"\x1f\x8b\x08", "application/gzip"),
]


class Chunks:
    """The chunks of RIFF files. Where a chunk begins decides where the next one does, in whatever file it lies, so all walks are paths of one
    forest; each place is entered once, with a pointer far ahead, and a walk takes a logarithm of its steps."""

    def __init__(self, data: bytes):
        self.data = data
        self.steps: dict[int, tuple[int, int, int, int, int]] = {}  # the next place, one further on, steps to the last, "fmt " and "data" chunks from here on

    def _enter(self, start: int) -> None:
        walked, pos = [], start
        while pos not in self.steps:
            name = self.data[pos : pos + 4]
            if pos + 8 > len(self.data) or not all(0x20 <= c < 0x7F for c in name):
                self.steps[pos] = pos, pos, 0, 0, 0  # no chunk: the last place
                break
            walked.append((pos, name))
            length = struct.unpack_from("<I", self.data, pos + 4)[0]
            pos += 8 + length + length % 2
        for pos_before, name in reversed(walked):
            _, far, depth, formats, datas = self.steps[pos]
            beyond = self.steps[far]
            ahead = beyond[1] if depth - beyond[2] == beyond[2] - self.steps[beyond[1]][2] else pos
            self.steps[pos_before] = pos, ahead, depth + 1, formats + (name == b"fmt "), datas + (name == b"data")
            pos = pos_before

    def until(self, start: int, end: int) -> tuple[int, bool]:
        """Where a walk from `start` is when no further chunk begins before `end` (-1 if something else stands there), and whether it passed a format and data."""
        self._enter(start)
        pos = start
        while pos + 8 <= end:
            following, ahead, depth, _, _ = self.steps[pos]
            if not depth:
                return -1, False
            pos = ahead if ahead + 8 <= end else following
        (*_, f1, d1), (*_, f2, d2) = self.steps[start], self.steps[pos]
        return pos, f1 > f2 and d1 > d2


class Places:
    """What validators have found out about some bytes, so that many starts are not followed over the same stretch again and again."""

    def __init__(self, data: bytes):
        self.data = data
        self.marks: dict[bytes, list[int]] = {}
        self.dead: set[int] = set()  # positions of GIF blocks that lead to no trailer
        self.blocks: dict[int, bool] = {}  # positions of FLAC metadata after the first: whether they lead to the last
        self.chunks = Chunks(data)
        self._archives: dict[int, int] | None = None

    def next(self, mark: bytes, at: int) -> int:
        """The first place of `mark` from `at` on, or -1. The bytes are searched once for each mark."""
        if mark not in self.marks:
            self.marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        found = self.marks[mark]
        i = bisect.bisect_left(found, at)
        return found[i] if i < len(found) else -1

    def archives(self) -> dict[int, int]:
        """The end of the archive that starts at a place, by what each end-of-directory record says; of several the first."""
        if self._archives is None:
            self._archives, data = {}, self.data
            pos = -1
            while (pos := data.find(b"PK\x05\x06", pos + 1)) >= 0 and pos + 22 <= len(data):
                size, offset, note = struct.unpack_from("<IIH", data, pos + 12)
                at = pos - size - offset
                if at >= 0 and data[at + offset : at + offset + 4] == b"PK\x01\x02" and pos + 22 + note <= len(data):
                    self._archives.setdefault(at, pos + 22 + note)
        return self._archives


def _png(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    """Chunks from IHDR, which has 13 bytes, to IEND, each with its checksum."""
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, pos)
        end = pos + 12 + size
        if end > len(data) or first != (kind == b"IHDR") or first and size != 13 or zlib.crc32(data[pos + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        pos, first = end, False
        if kind == b"IEND":
            return "image/png", pos - at
    return None


def _jpeg(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    """Marker segments up to a scan, then entropy-coded data up to the end marker."""
    pos, framed = at + 2, False
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        kind = data[pos + 1]
        size = struct.unpack_from(">H", data, pos + 2)[0]
        if kind < 0xC0 or 0xD0 <= kind <= 0xD9 or size < 2:
            return None
        framed |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        pos += 2 + size
        if kind == 0xDA:
            while framed and (pos := data.find(b"\xff", pos)) >= 0 and pos + 1 < len(data):
                if data[pos + 1] == 0xD9:
                    return "image/jpeg", pos + 2 - at
                if data[pos + 1] and not 0xD0 <= data[pos + 1] <= 0xD7:
                    break
                pos += 2
            if not framed or pos < 0:
                return None
    return None


def _gif(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    """Screen descriptor, then extension and image blocks up to the trailer."""
    if at + 13 > len(data):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    pos, passed = at + 13 + table(data[at + 10]), []
    while pos < len(data) and pos not in places.dead:
        kind = data[pos]
        if kind == 0x3B:
            return "image/gif", pos + 1 - at
        passed.append(pos)
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 <= len(data):
            pos += 11 + table(data[pos + 9])
        else:
            break
        while pos < len(data) and data[pos]:
            pos += data[pos] + 1
        pos += 1
    places.dead.update(passed)
    return None


def _riff(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    """The outer size, the form type, and chunks that fill the outer size (some writers leave out the last pad byte)."""
    if at + 12 > len(data):
        return None
    size, form = struct.unpack_from("<I4s", data, at + 4)
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form)
    end = at + 8 + size
    if kind is None or end > len(data):
        return None
    pos, complete = places.chunks.until(at + 12, end)
    if pos not in (end, end + 1) or kind == "audio/wav" and not complete:
        return None
    return kind, size + 8


def _pdf(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    end = places.next(b"%%EOF", at)
    return ("application/pdf", end + 5 - at) if data[at + 5 : at + 6].isdigit() and at <= places.next(b"startxref", at) < end else None


def _zip(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    """The end-of-directory record whose directory size and offset lead back to this start."""
    end = places.archives().get(at)
    return ("application/zip", end - at) if end is not None else None


def _gzip(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    unpack, pos, rest = zlib.decompressobj(31), at, b""
    try:
        while not unpack.eof and (rest or pos < len(data)):
            if not rest:
                rest, pos = data[pos : pos + 65536], pos + 65536
            unpack.decompress(rest, 1 << 20)  # what comes out is not kept
            rest = unpack.unconsumed_tail
        return ("application/gzip", min(pos, len(data)) - len(unpack.unused_data) - at) if unpack.eof else None
    except zlib.error:
        return None


def _flac(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    """Metadata blocks, the first a stream description of 34 bytes; frames have no total length, so it reaches to the end."""
    pos = at + 4
    if data[pos] & 0x7F if pos + 4 <= len(data) else True:
        return None
    if int.from_bytes(data[pos + 1 : pos + 4], "big") != 34:
        return None
    passed: list[int] = []
    good = None  # whether the blocks from a place on lead to the last one; they do not depend on the start
    while good is None:
        if pos + 4 > len(data) or passed and data[pos] & 0x7F == 0:
            good = False
        elif pos in places.blocks and passed:
            good = places.blocks[pos]
        else:
            after = pos + 4 + int.from_bytes(data[pos + 1 : pos + 4], "big")
            if data[pos] & 0x80:
                good = after <= len(data)
            passed.append(pos)
            pos = after
    places.blocks.update(dict.fromkeys(passed[1:], good))
    return ("audio/flac", len(data) - at) if good else None


def _ogg(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    """Consecutive pages, the first of them marked as the beginning of a stream."""
    pos = at
    while data[pos : pos + 4] == b"OggS" and pos + 27 <= len(data) and data[pos + 4] == 0:
        n = data[pos + 26]
        end = pos + 27 + n + sum(data[pos + 27 : pos + 27 + n])
        if end > len(data) or pos == at and not data[pos + 5] & 2:
            break
        pos = end
    return ("audio/ogg", pos - at) if pos > at else None


_VALID = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "riff": _riff, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "audio/ogg": _ogg}


def _automaton():
    held = worker_state()
    if "automaton" not in held:
        import ahocorasick

        found = ahocorasick.Automaton()
        for magic, kind in MAGIC:
            found.add_word(magic.decode("latin-1"), (len(magic), kind))
        found.make_automaton()
        held["automaton"] = found
    return held["automaton"]


def sniff(data: bytes, declared: str | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """(type, embedded media as (type, start, length)), by content alone: `declared` is only kept where nothing contradicts it.

    The type is that of a valid medium at offset 0; without one it is the declared type if that is none of the known media
    types, else application/octet-stream. Media inside a carved medium are not carved again, except inside the one at offset 0
    if it is a RIFF file, whose samples may hold anything. Equal starts can't occur. Empty input has no media.
    """
    whole, embedded, end, places = None, [], 0, Places(data)
    for last, (size, kind) in _automaton().iter(data.decode("latin-1")):
        at = last - size + 1
        if at < end:
            continue
        got = _VALID[kind](data, at, places)
        if got is None:
            continue
        if at == 0:
            whole = got[0]
            end = 12 if kind == "riff" else got[1]
        else:
            embedded.append((got[0], at, got[1]))
            end = at + got[1]
    if whole is None:
        known = {*_VALID, "audio/wav", "image/webp", "video/avi"}
        whole = declared if declared and declared not in known else "application/octet-stream"
    return whole, embedded


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """Mono 8-bit PCM: one sample a byte; a chunk of odd length gets the format's pad byte."""
    pad = len(payload) % 2
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def from_wav(data: bytes) -> bytes:
    """The samples of the data chunk, found by walking the chunks."""
    pos = 12
    while pos + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, pos)
        if name == b"data":
            return data[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2
    raise ValueError("no data chunk")


def media_columns(docs: DataFrame, *, id: str = "doc_id", text: str = "text", unit: int = 576, declared: str = "image/png", with_bytes: bool = False) -> DataFrame:
    """One row per row of `docs`: the text's UTF-8 bytes, padded with 255 to a positive multiple of `unit`, stored as WAV and read back.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 32 payload bytes), media_bytes,
    media_sha256, feature (corrected type, then embedded media as type@start+length), and `media` with `with_bytes`. Every text
    is stored under the wrong type `declared`, which sniffing corrects. Null text is empty text; null ids stay; rows that share
    an id, and other columns, don't matter. One row is in memory at a time beside its batch; texts have no length limit but
    the container's 4 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                cols: list[list] = [[] for _ in range(8)]
                for value in part.column(1).cast(pa.binary()).to_pylist():
                    raw = value or b""
                    stored = to_wav(raw + b"\xff" * (-len(raw) % unit or unit * (not raw)))
                    back = from_wav(stored)
                    kind, inside = sniff(stored, declared)
                    feature = ";".join([kind, *(f"{k}@{a}+{n}" for k, a, n in inside)])
                    for col, x in zip(cols, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, stored if with_bytes else None), strict=True):
                        col.append(x)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                arrays = [part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays if with_bytes else arrays[:-1], ["doc_id", *NAMES, *["media"] * with_bytes])

    source = one(docs, id, text).toDF("doc_id", "text")
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return source.mapInArrow(run, schema + ", media binary" * with_bytes)


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

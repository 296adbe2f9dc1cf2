"""Media columns: motion-JPEG in AVI files.

Files are read through their RIFF structure: ``hdrl`` gives size and rate, ``idx1`` the place of each frame. Every frame
is a baseline JPEG, decoded on its own (quantisation, Huffman tables, restart intervals, inverse cosine transform).
Luminance histograms of successive frames are compared, and a shot begins where the difference exceeds the running
mean by more than a multiple of the running deviation; shots become timed clip rows.

``encode_payload`` stores bytes without loss as the quantised coefficients of such frames, the unit JPEG holds exactly: each
8x8 block takes 64 bytes, one a coefficient. Byte b is the eight magnitude bits of a coefficient of category 8, whose
256 values are -255..-128 and 128..255, and the only Huffman code (one symbol, eight zero bits) precedes it; each block is
a restart interval, so the prediction of the first coefficient never drifts. Stored so, codes lie on byte
bounds and whole frames are read by slicing; any other baseline file goes through the general decoder.

Edge cases: null and empty texts are 64 zero bytes; payloads are padded with zero bytes to whole frames, and a ``plen``
chunk holds the true length; 0xFF bytes are stuffed; a null or truncated file gives no clip rows; a file without an
index is walked chunk by chunk; equal texts give equal files; an empty table gives an empty result; only the columns named are
read. RIFF sizes are 32 bits, so a payload must stay under 1.9 GB.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillstream.llm.common import table, text_bytes

SIDE = 32  # pixels of a stored frame: 4 by 4 blocks of 64 bytes
BLOCKS = (SIDE // 8) ** 2
FRAME_BYTES = BLOCKS * 64
RATE = 10
#: JPEG's zigzag order: place in the stream to place in the block, along the anti-diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COS = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
#: Coefficients in stream order to the 64 samples of the block.
IDCT = np.einsum("yv,xu->vuyx", _COS, _COS).reshape(64, 64)[ZIGZAG].astype(np.float32)


class BadMedia(ValueError):
    """The bytes are no AVI or JPEG that this module reads."""


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_ONE_CODE = bytes([0] * 7 + [1] + [0] * 8) + b"\x08"  # one code, of eight bits, for symbol 8
JPEG_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _ONE_CODE)
    + _segment(0xC4, b"\x10" + _ONE_CODE)
    + _segment(0xDD, b"\x00\x01")
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
_HEAD = np.frombuffer(JPEG_HEAD, np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, rate: int, extra: bytes = b"") -> bytes:
    """An AVI file of JPEG frames with an idx1 index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    size = np.array([len(f) for f in frames], np.int64)
    step = 8 + size + size % 2
    index = np.empty((len(frames), 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
    index[:, 2], index[:, 3] = 4 + np.cumsum(step) - step, size
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    body = b"AVI " + hdrl + extra + movi + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode_payload(payload: bytes) -> bytes:
    """The payload as an AVI file that holds it without loss."""
    n = max(1, -(-len(payload) // FRAME_BYTES))
    data = np.zeros(n * FRAME_BYTES, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    body = np.zeros((n, BLOCKS, 130), np.uint8)
    body[:, :, 1:128:2] = data.reshape(n, BLOCKS, 64)
    body[:, :, 128] = 0xFF
    body[:, :, 129] = 0xD0 + np.arange(BLOCKS) % 8
    body[:, -1, 129] = 0xD9
    body = body.reshape(n, -1)
    frames = []
    stuffed = (data.reshape(n, -1) == 0xFF).any(1)
    for k in range(n):
        scan = body[k]
        if stuffed[k]:
            at = np.flatnonzero(scan == 0xFF)
            at = at[at % 130 != 128]
            scan = np.insert(scan, at + 1, 0)
        frames.append(JPEG_HEAD + scan.tobytes())
    return write_avi(frames, SIDE, SIDE, RATE, _chunk(b"plen", struct.pack("<Q", len(payload))))


def read_avi(media: bytes) -> dict:
    """Rate, size, the ``plen`` chunk if any, and (offset, size) of each video frame, from idx1 where there is one."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise BadMedia("no RIFF AVI header")
    out: dict = {"rate": 1.0, "width": 0, "height": 0, "plen": None}
    walked, index, movi = [], None, None
    todo = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            inside, stop = at + 8, min(at + 8 + size, end)
            if name == b"LIST":
                kind = media[inside : inside + 4]
                if kind == b"movi":
                    movi = inside
                if kind != b"movi" or b"idx1" not in media[stop : stop + 4096]:
                    todo.append((inside + 4, stop))
            elif name == b"avih" and stop - inside >= 40:
                out["rate"] = 1e6 / max(1, struct.unpack_from("<I", media, inside)[0])
                out["width"], out["height"] = struct.unpack_from("<II", media, inside + 32)
            elif name == b"strh" and media[inside : inside + 4] == b"vids" and stop - inside >= 28:
                scale, rate = struct.unpack_from("<II", media, inside + 20)
                out["rate"] = rate / scale if rate and scale else out["rate"]
            elif name == b"plen" and stop - inside >= 8:
                out["plen"] = struct.unpack_from("<Q", media, inside)[0]
            elif name == b"idx1":
                index = np.frombuffer(media[inside : inside + (stop - inside) // 16 * 16], "<u4").reshape(-1, 4)
            elif name[2:] in (b"dc", b"db") and size:
                walked.append((inside, stop - inside))
            at = stop + size % 2
    if index is not None and movi is not None:
        own = index[np.isin(index[:, 0] >> 16, [int.from_bytes(x, "little") for x in (b"dc", b"db")]) & (index[:, 3] > 0)]
        # offsets count from the word movi, or from the file's start in some files
        base = movi if len(own) and media[movi + int(own[0, 2]) : movi + int(own[0, 2]) + 4][2:] in (b"dc", b"db") else 0
        out["frames"] = np.stack([own[:, 2].astype(np.int64) + base + 8, own[:, 3].astype(np.int64)], 1)
    else:
        out["frames"] = np.array(sorted(walked), np.int64).reshape(-1, 2)
    if len(out["frames"]) and int(out["frames"].sum(1).max()) > len(media):
        raise BadMedia("a frame reaches beyond the file")
    return out


def read_head(jpeg: bytes) -> dict:
    """The segments before the first scan of a baseline JPEG."""
    out: dict = {"quant": {}, "huff": {}, "restart": 0}
    at = 2
    if jpeg[:2] != b"\xff\xd8":
        raise BadMedia("no JPEG")
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise BadMedia("no marker where one must be")
        mark, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                out["quant"][body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[n:]
        elif mark == 0xC4:
            while body:
                counts = body[1:17]
                symbols = body[17 : 17 + sum(counts)]
                codes, code, k = {}, 0, 0
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        codes[length, code] = symbols[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                out["huff"][body[0]] = codes
                body = body[17 + sum(counts) :]
        elif mark in (0xC0, 0xC1):
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["parts"] = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
        elif mark in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise BadMedia("not a baseline JPEG")
        elif mark == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            out["scan"] = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            out["data"] = at + 2 + size
            if "parts" not in out:
                raise BadMedia("a scan before its frame")
            return out
        at += 2 + size
    raise BadMedia("no scan")


def _sliced(head: dict) -> bool:
    """Whether codes lie on byte bounds, as encode_payload stores them."""
    one = {(8, 0): 8}
    return head["restart"] == 1 and len(head["parts"]) == 1 and [head["huff"].get(t) for t in (0, 16)] == [one, one] and head["scan"][0][1:] == (0, 0) and head["width"] % 8 == head["height"] % 8 == 0


def decode_scan(jpeg: bytes, head: dict) -> dict[int, np.ndarray]:
    """Quantised coefficients by component, in stream order: any baseline scan, bit by bit."""
    raw = jpeg[head["data"] :]
    parts, hmax, vmax = head["parts"], max(p[0] for p in head["parts"].values()), max(p[1] for p in head["parts"].values())
    wide, high = -(-head["width"] // (8 * hmax)), -(-head["height"] // (8 * vmax))
    alone = len(head["scan"]) == 1
    out = {c: [] for c, _, _ in head["scan"]}
    place = {c: [] for c, _, _ in head["scan"]}
    if alone:
        c = head["scan"][0][0]
        h, v, _ = parts[c]
        wide, high = -(-head["width"] * h // (8 * hmax)), -(-head["height"] * v // (8 * vmax))
    total, at, done = wide * high, 0, 0
    while done < total:
        stop = at
        while stop + 1 < len(raw) and not (raw[stop] == 0xFF and raw[stop + 1] != 0):
            stop += 2 if raw[stop] == 0xFF else 1
        data = raw[at:stop].replace(b"\xff\x00", b"\xff")
        bits, left = int.from_bytes(data, "big"), len(data) * 8

        def take(n: int) -> int:
            nonlocal left
            if n > left:
                raise BadMedia("the scan ends early")
            left -= n
            return bits >> left & (1 << n) - 1

        def symbol(codes: dict) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (length, code) in codes:
                    return codes[length, code]
            raise BadMedia("no such code")

        def value(n: int) -> int:
            x = take(n) if n else 0
            return x if not n or x >> n - 1 else x - (1 << n) + 1

        last = dict.fromkeys(out, 0)
        for mcu in range(done, min(total, done + (head["restart"] or total))):
            for c, dc, ac in head["scan"]:
                h, v = (1, 1) if alone else parts[c][:2]
                for y in range(v):
                    for x in range(h):
                        block = np.zeros(64, np.int32)
                        last[c] += value(symbol(head["huff"][dc]))
                        block[0], k = last[c], 1
                        while k < 64:
                            s = symbol(head["huff"][16 + ac])
                            if s == 0:
                                break
                            k += s >> 4
                            if s & 15:
                                if k > 63:
                                    raise BadMedia("too many coefficients")
                                block[k] = value(s & 15)
                            k += 1
                        out[c].append(block)
                        place[c].append((mcu // wide * v + y, mcu % wide * h + x))
            done = mcu + 1
        at = stop + 2
    return {c: np.stack(b)[np.lexsort(np.array(place[c]).T[::-1])] for c, b in out.items()}


def coefficients(media: bytes, avi: dict) -> tuple[np.ndarray, dict]:
    """Luminance coefficients of all frames: frames by blocks by 64, in stream order, and the first frame's header."""
    frames = avi["frames"]
    if not len(frames):
        raise BadMedia("no frames")
    head = read_head(media[frames[0, 0] : frames[0].sum()])
    n, blocks = len(frames), head["width"] * head["height"] // 64
    if _sliced(head):
        size = head["data"] + blocks * 130
        raw = np.frombuffer(media, np.uint8)
        first = raw[frames[0, 0] : frames[0, 0] + head["data"]]
        rows = np.empty((n, blocks * 130), np.uint8)
        even = frames[:, 1] == size
        if n > 1 and even.all() and (np.diff(frames[:, 0]) == frames[1, 0] - frames[0, 0]).all():
            view = np.lib.stride_tricks.as_strided(raw[frames[0, 0] :], (n, size), (int(frames[1, 0] - frames[0, 0]), 1))
            same = (view[:, : head["data"]] == first).all()
            rows[:] = view[:, head["data"] :]
        else:
            same = True
            for k, (a, s) in enumerate(frames):
                same &= bool((raw[a : a + head["data"]] == first).all())
                scan = raw[a + head["data"] : a + s]
                keep = np.ones(len(scan), bool)
                keep[1:] = ~((scan[1:] == 0) & (scan[:-1] == 0xFF))
                scan = scan[keep] if len(scan) != blocks * 130 else scan
                if len(scan) != blocks * 130:
                    same = False
                    break
                rows[k] = scan
        if same:
            b = rows.reshape(n, blocks, 130)[:, :, 1:128:2].astype(np.int16)
            return np.where(b >= 128, b, b - 255), head
    out = []
    for a, s in frames:
        jpeg = media[a : a + s]
        own = read_head(jpeg)
        if (own["width"], own["height"]) != (head["width"], head["height"]):
            raise BadMedia("frames differ in size")
        out.append(decode_scan(jpeg, own)[own["scan"][0][0]])
    return np.stack(out), head


def read_payload(media: bytes) -> tuple[bytes, np.ndarray]:
    """What encode_payload stored, from the file alone, and the frames' luminance samples."""
    avi = read_avi(media)
    c, head = coefficients(media, avi)
    data = np.where(c >= 128, c, c + 255).astype(np.uint8).tobytes()
    return data[: avi["plen"] if avi["plen"] is not None else len(data)], samples(c, head)


def samples(c: np.ndarray, head: dict) -> np.ndarray:
    """Samples 0..255 of the luminance blocks: dequantised, transformed, shifted and clamped."""
    quant = head["quant"][head["parts"][head["scan"][0][0]][2]]
    return np.clip(np.rint((c.reshape(-1, 64) * quant) @ IDCT + 128), 0, 255).astype(np.uint8).reshape(len(c), -1)


def shots(luma: np.ndarray, bins: int = 16, factor: float = 2.0, least: float = 0.05, hard: float = 0.5) -> list[int]:
    """First frames of the shots: where the histogram difference exceeds the mean of those in the shot so far by
    ``factor`` deviations, and ``least`` of the samples. A shot's first difference has none before it: it is a cut beyond
    ``hard`` of the samples, or beyond the film's mean by ``factor`` of the film's deviations; so a shot may last one frame."""
    n = len(luma)
    own = (np.arange(n)[:, None] * bins + (luma >> 4 if bins == 16 else luma.astype(np.int64) * bins // 256)).ravel()
    h = np.bincount(own, minlength=n * bins).reshape(n, bins) / max(1, luma.shape[1])
    diff = np.abs(np.diff(h, axis=0)).sum(1) / 2
    first = max(least, min(hard, float(diff.mean() + factor * diff.std()))) if len(diff) else hard
    starts, count, mean, square = [0], 0, 0.0, 0.0
    for k, d in enumerate(diff.tolist(), 1):
        spread = max(0.0, square - mean * mean) ** 0.5
        if d > (mean + factor * spread + least if count else first):
            starts.append(k)
            count, mean, square = 0, 0.0, 0.0
            continue
        count += 1
        mean += (d - mean) / count
        square += (d * d - square) / count
    return starts


def clip_rows(media: bytes | None) -> list[tuple[int, int, int, int, int]]:
    """(clip, first frame, frames, start_ms, end_ms) of each shot; none for what is no readable file."""
    try:
        avi = read_avi(media or b"")
        c, head = coefficients(media, avi)
        luma = samples(c, head)
    except (BadMedia, struct.error, KeyError, IndexError, ValueError):
        return []
    starts = shots(luma)
    ends = [*starts[1:], len(luma)]
    ms = 1000 / avi["rate"]
    return [(k, a, b - a, round(a * ms), round(b * ms)) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]


def clips(df: DataFrame, media: str, key: str) -> DataFrame:
    """Clip rows (key, clip, first_frame, frames, start_ms, end_ms) of a binary column of AVI files."""

    def run(batches):
        for b in batches:
            rows = [(k, *r) for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in clip_rows(m)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    names = [key, "clip", "first_frame", "frames", "start_ms", "end_ms"]
    return df.select(key, media).mapInArrow(run, T.StructType([df.schema[key], *(T.StructField(n, T.LongType()) for n in names[1:])]))


def padded(raw: bytes) -> bytes:
    return raw + b"\x00" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def text_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media): each text's UTF-8 bytes, padded, as an AVI file."""

    def run(batches):
        for b in batches:
            raw, off = text_bytes(b.column(1))
            media = [encode_payload(padded(raw[i:j].tobytes())) for i, j in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], [key, "media"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], T.StructField("media", T.BinaryType())]))


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(raw: bytes) -> tuple:
    """The row of one text: stored as a file, read back from the file, and described."""
    media = encode_payload(padded(raw))
    payload, luma = read_payload(media)
    starts = shots(luma)
    feature = f"frames={len(luma)};luma={int(luma.sum(dtype=np.int64)) // luma.size};shots={len(starts)};clips={','.join(map(str, starts))}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op6_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            raw, off = text_bytes(b.column(1))
            rows = [digest(raw[i:j].tobytes()) for i, j in zip(off[:-1], off[1:], strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [x.split()[0] for x in _DIGEST.split(", ")])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, _DIGEST)

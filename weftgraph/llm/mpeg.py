"""MPEG audio columns: writing payloads as frames, and indexing any MPEG audio bytes.

`payload_to_mpeg` stores bytes as the ancillary data of silent MPEG-1 Layer III frames
(mono, 32 kHz, checksummed), after an ID3v2 tag and a variable-bitrate table.
`index_mpeg` reads MPEG audio: it skips tags, finds frame headers anew wherever the
chain breaks, checks the checksums it can and gives exact durations and frame offsets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.tasks import tidy
from weftgraph.runtime import ship_package

RATES = {  # (version, layer) -> kbit/s by index
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES[(2, 3)] = RATES[(2, 2)]
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SIDE = 17  # side information of a mono MPEG-1 Layer III frame
HEAD = 4 + 2 + SIDE
#: Our frames by bitrate index: at 32 kHz a Layer III frame of b kbit/s has 4.5 * b bytes.
LENGTHS = [int(4.5 * b) for b in RATES[(1, 3)]]
ROWS_OUT = 128

_CRC = []
for _b in range(256):
    _c = _b << 8
    for _ in range(8):
        _c = (_c << 1 ^ 0x8005) & 0xFFFF if _c & 0x8000 else _c << 1
    _CRC.append(_c)


def crc16(data: bytes) -> int:
    """The frames' checksum: polynomial 0x8005, from 0xFFFF."""
    c = 0xFFFF
    for x in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ x]
    return c


def crc16_bits(data: bytes, bits: int) -> int:
    """The same over the first bits of data."""
    c = crc16(data[: bits >> 3])
    for k in range(bits & 7):
        c = (c << 1 ^ (0x8005 if (c >> 15 ^ data[bits >> 3] >> (7 - k)) & 1 else 0)) & 0xFFFF
    return c


#: Runs of (subbands, bits of their allocation) in Layer II by the number of subbands; 0: the low sampling rates.
ALLOCATION = {27: ((11, 4), (12, 3), (4, 2)), 30: ((11, 4), (12, 3), (7, 2)), 8: ((2, 4), (6, 3)), 12: ((2, 4), (10, 3)), 0: ((4, 4), (7, 3), (19, 2))}


def protected_bits(data: bytes, at: int, version: int, layer: int, kbit: int, hertz: int, mode: int, extension: int) -> int:
    """Bits behind the checksum of a Layer I or II frame that it covers: allocations, and in Layer II what says how scale factors are sent."""
    channels = 1 if mode == 3 else 2
    bound = 4 * (extension + 1) if mode == 1 else 32
    if layer == 1:
        return 4 * (channels * bound + 32 - bound) if channels == 2 else 128
    each = kbit // channels
    if version != 3:
        table = 0
    elif hertz == 48000 and each >= 56 or 56 <= each <= 80:
        table = 27
    elif hertz != 48000 and each >= 96:
        table = 30
    else:
        table = 8 if hertz != 32000 and each <= 48 else 12
    value, place, used, band = int.from_bytes(data[at : at + 64], "big"), 512, 0, 0
    for n, bits in ALLOCATION[table]:
        for _ in range(n):
            for _ in range(channels if band < bound else 1):
                place -= bits
                some = value >> place & (1 << bits) - 1 != 0
                used += some * (1 if band < bound else channels)
            band += 1
    return 512 - place + 2 * used


def seek_table(data: bytes, at: int, side: int, size: int) -> dict | None:
    """What the first frame says of the whole: a Xing or Info table behind the side information, or a VBRI table 32 bytes behind the header.

    kind, frames, bytes, quality, delay and padding (samples that the encoder put before and after the sound), and points:
    byte places (from the table's frame) at equal steps of time. What is not there is None, as is a table that does not fit the frame.
    """
    out = dict.fromkeys(("kind", "frames", "bytes", "quality", "delay", "padding", "points"))
    p, end = at + 4 + side, at + size
    for p in (at + 4 + side, at + 6 + side):
        if data[p : p + 4] in (b"Xing", b"Info") and p + 8 <= end:
            out["kind"], flags = data[p : p + 4].decode(), struct.unpack_from(">I", data, p + 4)[0]
            p += 8
            for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "points", 100), (8, "quality", 4)):
                if flags & bit:
                    if p + n > end:
                        return out
                    if name == "points":
                        out["points"] = list(data[p : p + n])
                    else:
                        out[name] = struct.unpack_from(">I", data, p)[0]
                    p += n
            if out["points"] is not None:  # in 256ths of the bytes
                out["points"] = [x * out["bytes"] // 256 for x in out["points"]] if out["bytes"] is not None else None
            if p + 24 <= end and data[p : p + 4] in (b"LAME", b"Lavc", b"Lavf", b"L3.9"):
                bits = int.from_bytes(data[p + 21 : p + 24], "big")
                out["delay"], out["padding"] = bits >> 12, bits & 0xFFF
            return out
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= end:
        _, delay, quality, n_bytes, frames, entries, scale, width, _ = struct.unpack_from(">HHHIIHHHH", data, p + 4)
        out |= {"kind": "VBRI", "frames": frames, "bytes": n_bytes, "quality": quality, "delay": delay}
        if 1 <= width <= 4 and p + 26 + entries * width <= end:
            points, place = [], 0
            for k in range(entries):
                points.append(place)
                place += scale * int.from_bytes(data[p + 26 + k * width : p + 26 + (k + 1) * width], "big")
            out["points"] = points
        return out
    return None


_HEADS = {}
for _i in range(1, 15):
    _h = bytes((0xFF, 0xFA, _i << 4 | 2 << 2, 0xC4))
    _HEADS[_i] = _h + struct.pack(">H", crc16(_h[2:] + bytes(SIDE))) + bytes(SIDE)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_mpeg(payload: bytes) -> bytes:
    """The payload as an MPEG audio file; the last frame takes the smallest bitrate that holds the rest."""
    text = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    frame = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + _syncsafe(len(frame)) + frame
    room, frames, lengths = LENGTHS[14] - HEAD, [], []
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        i = 14 if len(part) == room else next(k for k in range(1, 15) if LENGTHS[k] - HEAD >= len(part))
        frames.append(_HEADS[i] + part + bytes(LENGTHS[i] - HEAD - len(part)))
        lengths.append(LENGTHS[i])
    total = LENGTHS[1] + sum(lengths)
    starts, at = [], LENGTHS[1]
    for n in lengths:
        starts.append(at)
        at += n
    toc = bytes(min(255, 256 * starts[k * len(starts) // 100] // total) if starts else 0 for k in range(100))
    head = bytes((0xFF, 0xFB, 1 << 4 | 2 << 2, 0xC4)) + bytes(SIDE)
    table = head + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"".join([tag, table, bytes(LENGTHS[1] - len(table)), *frames])


def header(data: bytes, at: int) -> tuple[int, int, int, int, int, bool, int, int] | None:
    """(version id, layer, bytes, samples, hertz, checksummed, side bytes, kbit/s) of the frame header at a place, if valid."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] < 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer, rate, hz = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or b3 & 3 == 2:
        return None
    kbit, hertz, pad = RATES[(1 if version == 3 else 2, layer)][rate], HERTZ[version][hz], b2 >> 1 & 1
    if layer == 1:
        size, samples = (12000 * kbit // hertz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples * 125 * kbit // hertz + pad
    mono = b3 >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return version, layer, size, samples, hertz, not b1 & 1, side, kbit


def read_mpeg(data: bytes) -> dict:
    """Frames, tags, checksums and exact length of MPEG audio; see index_mpeg for the fields."""
    tags, at, end, declared = [], 0, len(data), None
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        size = sum(x << s for x, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        tags.append("id3v2")
        body = data[at + 10 : at + 10 + size]
        if (k := body.find(b"payload_bytes\0")) >= 0:
            digits = body[k + 14 : k + 26].split(b"\0")[0]
            declared = int(digits) if digits.isdigit() else None
        at += 10 + size + (10 if data[at + 5] & 16 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags.append("id3v1")
        end -= 128
    offsets, parts, table, samples, good, bad, skipped, hertz, first = [], [], None, 0, 0, 0, 0, 0, True
    seen: dict[tuple[bytes, int], int] = {}
    synced = False
    while at + 4 <= end:
        h = header(data, at)
        if h is None or at + h[2] > end or not synced and at + h[2] + 4 <= end and header(data, at + h[2]) is None:
            at += 1  # look for the next header
            nxt = data.find(b"\xff", at, end)
            nxt = end if nxt < 0 else nxt
            skipped += nxt - at + 1
            at, synced = nxt, False
            continue
        version, layer, size, n, hz, checked, side, kbit = h
        synced = True
        body = at + (6 if checked else 4)
        if first and layer == 3 and (found := seek_table(data, at, side, size)) is not None:
            table, at, first = found, at + size, False
            continue
        first = False
        if checked:
            if layer == 3:
                bits = 8 * side
            else:
                bits = protected_bits(data, body, version, layer, kbit, hz, data[at + 3] >> 6, data[at + 3] >> 4 & 3)
            covered = data[at + 2 : at + 4] + data[body : body + (bits + 7) // 8]
            if (crc := seen.get((covered, bits))) is None:
                crc = crc16_bits(covered, 16 + bits) if len(covered) * 8 >= 16 + bits else -1
                if len(seen) < 4096:
                    seen[covered, bits] = crc
            ok = crc == data[at + 4] << 8 | data[at + 5]
            good, bad = good + ok, bad + (not ok)
        offsets.append(at)
        samples, hertz = samples + n, hertz or hz
        parts.append(data[body + side : at + size])
        at += size
    payload, table = b"".join(parts), table or {}
    silent = (table.get("delay") or 0) + (table.get("padding") or 0)
    return {
        "payload": payload if declared is None else payload[:declared], "frames": len(offsets), "samples": samples, "hertz": hertz, "offsets": offsets, "crc_good": good, "crc_bad": bad,
        "skipped": skipped, "tags": ",".join(tags), "table_frames": table.get("frames"), "table_bytes": table.get("bytes"), "table_kind": table.get("kind"), "table_points": table.get("points"),
        "heard": max(0, samples - silent),
    }


INDEX = (
    "payload binary, frames int, samples long, hertz int, offsets array<int>, crc_good int, crc_bad int, skipped long, tags string, table_frames long, table_bytes long, table_kind string, "
    "table_points array<long>, heard long"
)
_TYPES = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64()]


def _arrow(df: DataFrame, column: str, names: list[str], kinds: str, types: list, fn) -> DataFrame:
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *T.StructType.fromDDL(kinds).fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                rows = [fn(v.as_py()) for v in part.column(column)]
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *cols], names=[*kept, *names])

    return df.mapInArrow(run, schema)


def payload_to_mpeg(df: DataFrame, payload: str = "payload", out: str = "media") -> DataFrame:
    """Append binary `out`: an MPEG audio file whose frames carry the bytes of `payload`.

    Null and empty payloads give a file without audio frames. Other columns stay; one named `out` is replaced.
    """
    return _arrow(df, payload, [out], f"`{out}` binary", [pa.binary()], lambda v: (write_mpeg(bytes(v or b"")),))


def index_mpeg(df: DataFrame, media: str = "media") -> DataFrame:
    """Append what the MPEG audio bytes in `media` hold.

    payload (the bytes after each frame's side information, cut to the length a
    payload_bytes tag declares), frames, samples and hertz (duration is exactly samples / hertz seconds), offsets (byte
    place of each frame, for seeking), crc_good and crc_bad (checksums of all layers), skipped
    (bytes passed over while finding a header anew), tags, table_kind (Xing, Info or VBRI), table_frames, table_bytes and table_points (byte places at
    equal steps of time) of a variable-bitrate table, and heard (samples without the encoder's delay and padding). Bytes without audio, empty and null: no frames and an empty payload. Columns of these names are replaced.
    """
    names = [x.split()[0] for x in INDEX.split(", ")]
    return _arrow(df, media, names, INDEX, _TYPES, lambda v: tuple(read_mpeg(bytes(v or b"")).values()))


def op3_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    """Every document's text stored as MPEG audio and read back; null text counts as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.octet_length("text").cast("long")
    fill = F.greatest(F.lit(64), F.ceil(n / 64) * 64) - n
    padded = docs.select("doc_id", n.alias("n_bytes"), F.concat(F.col("text").cast("binary"), F.unhex(F.repeat(F.lit("00"), fill.cast("int")))).alias("payload"))
    read = index_mpeg(payload_to_mpeg(padded).drop("payload"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string(
            "frames=%d;samples=%d;hertz=%d;crc_good=%d;crc_bad=%d;skipped=%d;tags=%s;table=%d/%d;offsets=%s",
            "frames", "samples", "hertz", "crc_good", "crc_bad", "skipped", "tags", "table_frames", "table_bytes",
            F.lower(F.hex(F.xxhash64("offsets"))),
        ).alias("feature"),
        (F.col("samples") / F.col("hertz")).alias("seconds"),
    )

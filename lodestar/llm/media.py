"""Telephony audio columns: G.711 mu-law and A-law by lookup tables, IMA ADPCM block by block, resampled PCM.

Each row's bytes are one 8-bit telephony stream. It is kept as a WAV file in its own codec (so the bytes come
back unchanged), expanded to 16-bit PCM and resampled through a windowed-sinc low-pass. G.711 expands by one table lookup
over all bytes of a batch; ADPCM, whose samples depend on each other inside a block only, is decoded one nibble position at
a time over all blocks of the batch; resampling runs over the whole batch, its rows kept apart by silence.

Nulls and empty texts become one unit of 255 bytes. Equal inputs give equal outputs; repeated rows stay repeated,
an empty table gives no rows, and further columns of the input are not carried. Texts are read whole; a stream of 4 GB or
more, which RIFF sizes can't tell, is an error (Spark holds no such value either).
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# --- fixed values: WAV format tags and the IMA ADPCM tables -------------------------------------------------
FORMAT_TAG = {"alaw": 6, "mulaw": 7, "adpcm": 17}
IMA_INDEX = [-1, -1, -1, -1, 2, 4, 6, 8]
IMA_STEP = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
    107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
    5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
    27086, 29794, 32767,
]
# -------------------------------------------------------------------------------------------------------------

UNIT = 576
BLOCK = 288


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted byte = sign, 3-bit exponent, 4-bit mantissa; bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    value = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: every second bit inverted; exponent 0 is linear."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 15) << 4
    value = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, value, -value).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
STEP = np.array(IMA_STEP, np.int32)
#: By nibble: change of the step index.
NUDGE = np.array(IMA_INDEX * 2, np.int32)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """(n, BLOCK) bytes to (n, 1 + 2 * (BLOCK - 4)) samples. A block: first sample, step index, a spare byte, nibbles (low first)."""
    head = blocks[:, :2].copy().view("<i2")[:, 0]
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    body = blocks[:, 4:].T
    value = head.astype(np.int32)
    out = np.empty((1 + 2 * len(body), len(blocks)), np.int16)
    out[0] = head
    for i, byte in enumerate(body):
        for half, nibble in ((1, byte & 15), (2, byte >> 4)):
            step = STEP[index]
            # the standard's sum of shifted steps, bit by bit
            delta = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
            value = np.clip(np.where(nibble & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + NUDGE[nibble], 0, 88)
            out[2 * i + half] = value
    return np.ascontiguousarray(out.T)


#: Zero crossings of the sinc on each side, in samples of the lower rate.
LOBES = 8


def low_pass(up: int, down: int) -> np.ndarray:
    """Weights of the input samples about a place between two of them, for each of `up` places: a sinc cut at the lower rate's Nyquist limit, under a Hann window."""
    slow = max(1.0, down / up)
    reach = int(np.ceil(LOBES * slow))
    off = np.arange(-reach + 1, reach + 1)[None, :] - (np.arange(up) / up)[:, None]
    weight = np.sinc(off / slow) * np.where(np.abs(off) < reach, 0.5 + 0.5 * np.cos(np.pi * off / reach), 0)
    return (weight / weight.sum(1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, rate_in: int, rate_out: int, edges: np.ndarray | None = None) -> list[np.ndarray]:
    """Each stretch of pcm between edges (by default all of it) at the other rate: ceil(n * rate_out / rate_in) samples, band-limited."""
    edges = np.array([0, len(pcm)]) if edges is None else edges
    if rate_in == rate_out:
        return [pcm[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    common_rate = math.gcd(rate_in, rate_out)
    up, down = rate_out // common_rate, rate_in // common_rate
    weight = low_pass(up, down)
    reach = weight.shape[1] // 2
    # stretches begin at multiples of `down`, after more silence than the filter is long
    size = np.diff(edges)
    room = -(-(size + 2 * reach) // down) * down
    start = np.cumsum(room) - room
    x = np.zeros(int(room.sum()) + 4 * reach + down, np.float32)
    x[np.repeat(start - edges[:-1], size) + np.arange(len(pcm)) + reach - 1] = pcm
    turns = int(room.sum()) // down
    out = np.empty((turns, up), np.float32)
    for k in range(up):
        # output k of each turn lies k * down / up samples behind the turn's start
        whole, phase = divmod(k * down, up)
        out[:, k] = np.lib.stride_tricks.sliding_window_view(x[whole:], 2 * reach)[::down][:turns] @ weight[phase]
    flat = np.clip(np.rint(out.reshape(-1)), -32768, 32767).astype(np.int16)
    return [flat[a : a + n] for a, n in zip((start // down * up).tolist(), (-(-size * up // down)).tolist(), strict=True)]


def wav(payload: bytes, codec: str, rate: int) -> bytes:
    """A RIFF file with fmt, fact and data chunks."""
    block = BLOCK if codec == "adpcm" else 1
    per_block = 1 + 2 * (BLOCK - 4) if codec == "adpcm" else 1
    extra = struct.pack("<H", per_block) if codec == "adpcm" else b""
    fmt = struct.pack("<HHIIHHH", FORMAT_TAG[codec], 1, rate, rate * block // per_block, block, 4 if codec == "adpcm" else 8, len(extra)) + extra
    fact = struct.pack("<I", len(payload) // block * per_block)
    body = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", fmt), (b"fact", fact), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and payload, by walking the chunks of the stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        found[kind] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    tag, _, rate = struct.unpack_from("<HHI", found[b"fmt "])
    return next(k for k, v in FORMAT_TAG.items() if v == tag), rate, found[b"data"]


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 up to a positive multiple of the unit."""
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def decode(payload: np.ndarray, codec: str) -> np.ndarray:
    if codec == "adpcm":
        return adpcm_decode(payload.reshape(-1, BLOCK)).reshape(-1)
    return (MULAW if codec == "mulaw" else ALAW)[payload]


def levels(pcm: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """Root mean square, peak and sign changes of each stretch that begins at starts."""
    wide = pcm.astype(np.int64)
    count = np.diff(np.append(starts, len(pcm)))
    rms = np.sqrt(np.add.reduceat(wide * wide, starts) / count).astype(np.int64)
    peak = np.maximum.reduceat(np.abs(wide), starts)
    turn = np.empty(len(pcm), np.int64)
    turn[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    turn[starts] = 0
    return list(zip(rms.tolist(), peak.tolist(), np.add.reduceat(turn, starts).tolist(), strict=True))


#: What telephony_media can emit, with Arrow types.
OUTPUTS = {
    "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media": pa.binary(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "pcm": pa.binary(), "pcm_samples": pa.int64(), "pcm_crc32": pa.int64(), "feature": pa.string(),
}
SQL_TYPE = {pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}


def _rows(data: list[bytes], codec: str, rate_in: int, rate_out: int, want: list[str]) -> dict[str, list]:
    """All values of one batch; decoding runs over the whole batch at once."""
    stored = [wav(pad(x), codec, rate_in) for x in data]
    back = [read_wav(x)[2] for x in stored]
    joined = np.frombuffer(b"".join(back), np.uint8)
    units = np.cumsum([0, *(len(x) for x in back)])
    out: dict[str, list] = {
        "n_bytes": [len(x) for x in data], "payload_bytes": [len(x) for x in back], "payload": back, "media": stored, "media_bytes": [len(x) for x in stored],
    }
    if "payload_sha256" in want:
        out["payload_sha256"] = [hashlib.sha256(x).hexdigest() for x in back]
    if "tail_crc32" in want:
        out["tail_crc32"] = [zlib.crc32(x[-32:]) for x in back]
    if "media_sha256" in want:
        out["media_sha256"] = [hashlib.sha256(x).hexdigest() for x in stored]
    pcm = {codec: decode(joined, codec)}
    spread = lambda c: units // BLOCK * (1 + 2 * (BLOCK - 4)) if c == "adpcm" else units
    if {"pcm", "pcm_samples", "pcm_crc32"} & set(want):
        made = resample(pcm[codec], rate_in, rate_out, spread(codec))
        out["pcm_samples"] = [len(x) for x in made]
        if "pcm" in want:
            out["pcm"] = [x.tobytes() for x in made]
        if "pcm_crc32" in want:
            out["pcm_crc32"] = [zlib.crc32(x) for x in made]
    if "feature" in want:
        seen = []
        for c in ("mulaw", "alaw", "adpcm"):
            own = pcm.get(c)
            seen.append(levels(decode(joined, c) if own is None else own, spread(c)[:-1]))
        out["feature"] = [";".join(f"{c}:rms={r},peak={p},turns={t}" for c, (r, p, t) in zip(("mulaw", "alaw", "adpcm"), x, strict=True)) for x in zip(*seen, strict=True)]
    return out


def telephony_media(df: DataFrame, id_col: str = "doc_id", data_col: str = "text", codec: str = "mulaw", rate_in: int = 8000, rate_out: int = 16000, emit: tuple[str, ...] = ("media", "pcm")) -> DataFrame:
    """id_col and the outputs named in emit (keys of OUTPUTS) for each row of df; data_col is a string (taken as UTF-8) or binary.

    media is a WAV file in the codec, pcm the 16-bit samples at rate_out. feature has level, peak and sign changes of
    the payload as read by each of the three codecs.
    """
    if codec not in FORMAT_TAG or not set(emit) <= set(OUTPUTS):
        raise ValueError(f"codec: one of {sorted(FORMAT_TAG)}; emit: of {sorted(OUTPUTS)}")
    common.bounded_batches(df.sparkSession)
    want = list(emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column(0), [x or b"" for x in batch.column(1).to_pylist()]
            # some MB of payload at a time, so that one batch of long texts stays small once decoded
            size = np.cumsum([len(x) + UNIT for x in data]) // (4 << 20) if data else np.empty(0, int)
            for part in np.unique(size):
                a, b = np.searchsorted(size, [part, part + 1])
                made = _rows(data[a:b], codec, rate_in, rate_out, want)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(made[k], OUTPUTS[k]) for k in want)], names=[id_col, *want])

    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{k} {SQL_TYPE[OUTPUTS[k]]}" for k in want)])
    return df.select(id_col, F.col(data_col).cast("binary").alias("data")).mapInArrow(run, schema)


def store(df: DataFrame, path: str, id_col: str = "doc_id", data_col: str = "text", codec: str = "mulaw", rate_in: int = 8000, rate_out: int = 16000) -> DataFrame:
    """Writes media and resampled PCM of each row as a table at path, and returns it as read back."""
    made = telephony_media(df, id_col, data_col, codec, rate_in, rate_out, ("n_bytes", "media", "pcm"))
    made.write.parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


def op9_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    emit = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_samples", "pcm_crc32")
    return telephony_media(common.table(spark, sf_dir, "documents"), emit=emit)


QUERIES = {"op9_telephony_media": op9_telephony_media}
ORACLE_SQL: dict[str, str] = {}

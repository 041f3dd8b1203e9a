"""Chroma audio fingerprints, and the recordings that they align.

A recording is cut into overlapping frames; the power of each frame's spectrum
is summed into the twelve pitch classes, smoothed over time and scaled to length
1. Over windows of this picture sixteen filters compare the means of two areas,
read off an integral image; each difference is cut into four levels, and the
Gray codes make one packed 32-bit integer a frame.

Keys, the higher bits of the levels of three integers SPAN frames apart, make candidates as the grams of the
n-gram join do, with frequent keys star-wise first and in blocks of bounded size
where recordings are not connected yet. Two recordings are linked when
the histogram of offsets at which their keys agree has a peak of MIN_VOTES or
more and, aligned there, they overlap in MIN_OVERLAP integers with a bit error
rate of MAX_BER at most. Recordings with equal fingerprints are one class.

Null, silent or short recordings have a fingerprint without integers or without
keys; without integers they link with nothing, without keys with equal fingerprints alone. Repeated rows and
different recordings under one id keep a row each and link by themselves. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.llm import ngram_join
from twinvec.llm.common import dropped, few, resolve, written

FRAME_S, OVERLAP = 0.12, 4
LOW_HZ, HIGH_HZ = 200.0, 3600.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WIDTH = 16
LEVEL = 0.06
SPAN = 4
MIN_VOTES, MIN_OVERLAP, MAX_BER = 2, 16, 0.15
#: (kind, first pitch class, pitch classes, frames) of each filter, spread over the picture by rule.
FILTERS = tuple((i % 6, (5 * i) % (13 - h), h, w) for i in range(16) for h, w in [((3, 4, 6, 12)[(i // 2) % 4], (8, 16, 12, 16)[i % 4])])
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """samples: a recording, or recordings of one length as rows -> (recordings x)
    frames x 12, rows of length 1 (or 0 where silent)."""
    n = 1 << max(4, math.ceil(math.log2(rate * FRAME_S)))
    hop = n // OVERLAP
    outer = samples.shape[:-1]
    if samples.shape[-1] < n:
        return np.zeros((*outer, 0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, n, axis=-1)[..., ::hop, :]
    window = np.hanning(n).astype(np.float32)
    hz = np.fft.rfftfreq(n, 1 / rate)
    used = np.flatnonzero((hz >= LOW_HZ) & (hz <= min(HIGH_HZ, rate / 2)))
    lo, hi = used[0], used[-1] + 1
    to = np.zeros((len(used), 12), np.float32)
    to[np.arange(len(used)), np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12] = 1
    parts = []
    for k in range(0, frames.shape[-2], 2048):
        f = np.fft.rfft(frames[..., k : k + 2048, :] * window)[..., lo:hi]
        parts.append((f.real**2 + f.imag**2) @ to)
    c = np.concatenate(parts, axis=-2).astype(np.float64)
    m = c.shape[-2] - len(SMOOTH) + 1
    if m < 1:
        return np.zeros((*outer, 0, 12))
    c = sum(w * c[..., k : m + k, :] for k, w in enumerate(SMOOTH))
    norm = np.linalg.norm(c, axis=-1, keepdims=True)
    return np.where(norm > 1e-6, c / np.maximum(norm, 1e-6), 0.0)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """Packed integers, one for each place of the window. samples: a recording, or
    recordings of one length as rows."""
    c = chroma(np.asarray(samples, dtype=np.float32), rate)
    n = c.shape[-2] - WIDTH + 1
    if n <= 0:
        return np.zeros((*c.shape[:-2], 0), dtype=np.uint32)
    image = np.zeros((*c.shape[:-2], c.shape[-2] + 1, 13))
    image[..., 1:, 1:] = c.cumsum(axis=-2).cumsum(axis=-1)

    def total(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return image[..., x1 : x1 + n, y1] - image[..., x0 : x0 + n, y1] - image[..., x1 : x1 + n, y0] + image[..., x0 : x0 + n, y0]

    out = np.zeros((*c.shape[:-2], n), dtype=np.uint32)
    for kind, y, h, w in FILTERS:
        area, every = total(0, w, y, y + h), w * h
        if kind == 0:  # a band against all classes
            a, na, b, nb = area, every, total(0, w, 0, 12), 12 * w
        elif kind == 1:  # lower half against upper half
            a, na = total(0, w, y, y + h // 2), w * (h // 2)
            b, nb = area - a, every - na
        elif kind == 2:  # earlier half against later half
            a, na = total(0, w // 2, y, y + h), (w // 2) * h
            b, nb = area - a, every - na
        elif kind == 3:  # the diagonal quarters against the others
            a = total(0, w // 2, y, y + h // 2) + total(w // 2, w, y + h // 2, y + h)
            na = (w // 2) * (h // 2) + (w - w // 2) * (h - h // 2)
            b, nb = area - a, every - na
        elif kind == 4:  # the middle third of the classes against the outer ones
            a, na = total(0, w, y + h // 3, y + h - h // 3), w * (h - 2 * (h // 3))
            b, nb = area - a, every - na
        else:  # the middle third in time against the outer ones
            a, na = total(w // 3, w - w // 3, y, y + h), (w - 2 * (w // 3)) * h
            b, nb = area - a, every - na
        v = np.log1p(np.maximum(a, 0) / na) - np.log1p(np.maximum(b, 0) / max(nb, 1))
        out = (out << np.uint32(2)) | GRAY[(v > -LEVEL).astype(int) + (v > 0) + (v > LEVEL)]
    return out


#: Samples that are transformed together.
SLAB = 1 << 19


def fingerprint_all(recordings: list[np.ndarray], rate: int) -> list[np.ndarray]:
    """Fingerprints of many recordings; those of one length are computed together."""
    out: list = [None] * len(recordings)
    by: dict[int, list[int]] = {}
    for i, x in enumerate(recordings):
        by.setdefault(len(x), []).append(i)
    for size, at in by.items():
        step = max(1, SLAB // max(size, 1))
        for k in range(0, len(at), step):
            for i, f in zip(at[k : k + step], fingerprint(np.stack([recordings[i] for i in at[k : k + step]]), rate), strict=True):
                out[i] = f
    return out


#: The higher bit of each filter's level, which noise flips least.
HIGHER = np.uint32(0xAAAAAAAA)


def keys(fp: np.ndarray) -> np.ndarray:
    """The key at each place, in 48 bits."""
    if len(fp) <= 2 * SPAN:
        return np.zeros(0, dtype=np.uint64)
    one, two, three = ((fp[k : len(fp) - 2 * SPAN + k] & HIGHER).astype(np.uint64) for k in (0, SPAN, 2 * SPAN))
    both = ((one << np.uint64(32)) | (two >> np.uint64(1)) | one) + three * np.uint64(0x9E3779B97F4A7C15)
    return ngram_join._mix(both) >> np.uint64(16)


def _sorted_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys by place, the places in order of the keys, and the keys in order."""
    k = keys(fp)
    order = np.argsort(k, kind="stable")
    return k, order, k[order]


def align(a: np.ndarray, b: np.ndarray, of_a=None, of_b=None) -> tuple[int, int, int, float]:
    """(votes, offset, overlap, bit error rate) at the peak of the offset histogram;
    of equal peaks the least |offset|, then the least offset. of_a, of_b: _sorted_keys, if there."""
    ka = (of_a or _sorted_keys(a))[0]
    kb, order, known = of_b or _sorted_keys(b)
    if not len(ka) or not len(kb):
        return 0, 0, 0, 1.0
    lo, hi = np.searchsorted(known, ka, side="left"), np.searchsorted(known, ka, side="right")
    n = hi - lo
    total = int(n.sum())
    if not total:
        return 0, 0, 0, 1.0
    ends = np.cumsum(n)
    place = np.repeat(lo - (ends - n), n) + np.arange(total)
    votes = np.bincount(order[place] - np.repeat(np.arange(len(ka)), n) + len(ka), minlength=len(ka) + len(kb))
    most = int(votes.max())
    top = np.flatnonzero(votes == most) - len(ka)
    offset = int(min(top.tolist(), key=lambda o: (abs(o), o)))
    i, j = max(0, -offset), max(0, offset)
    n = min(len(a) - i, len(b) - j)
    ber = float(np.bitwise_count(a[i : i + n] ^ b[j : j + n]).sum()) / (32 * n)
    return most, offset, n, ber


def same_recording(a: np.ndarray, b: np.ndarray, of_a=None, of_b=None) -> bool:
    votes, _, n, ber = align(a, b, of_a, of_b)
    return votes >= MIN_VOTES and n >= MIN_OVERLAP and ber <= MAX_BER


def pcm16(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype="<i2").astype(np.float32) / 32768


def fingerprints(recordings: DataFrame, column: str = "pcm", rate: int = 11025, decode=pcm16) -> DataFrame:
    """(rec_id, column) -> uid (a row number), rec_id, n, fp (little-endian 32-bit integers), digest, prefix
    (the distinct keys, null without any). decode: a value -> samples."""

    def run(batches):
        for whole in batches:
            for k in range(0, len(whole), 256):
                pdf = whole.iloc[k : k + 256]
                none = np.zeros(0, np.float32)
                fps = fingerprint_all([decode(v) if v is not None else none for v in pdf[column]], rate)
                distinct = [np.unique(keys(f)).astype(np.int64) for f in fps]
                yield pd.DataFrame(
                    {"uid": pdf["uid"].to_numpy(), "rec_id": pdf["rec_id"].array, "n": [len(f) for f in fps], "fp": [f.astype("<u4").tobytes() for f in fps],
                     "digest": [xxhash.xxh3_128_digest(f.tobytes()) if len(f) else None for f in fps],
                     "prefix": [k if len(k) else None for k in distinct]}
                )

    # Ids go as text: pandas would make numbers with nulls inexact.
    df = recordings.select(F.monotonically_increasing_id().alias("uid"), F.col("rec_id").cast("long").cast("string").alias("rec_id"), column)
    out = df.mapInPandas(run, "uid long, rec_id string, n long, fp binary, digest binary, prefix array<long>")
    return out.withColumn("rec_id", F.col("rec_id").cast("long"))


def match(recordings: DataFrame, column: str = "pcm", rate: int = 11025, decode=pcm16) -> DataFrame:
    """-> rec_id, n_frames, class_id (least id of an equal fingerprint), component_id
    (least id reachable by links), a row for each row."""
    table = written(fingerprints(recordings, column, rate, decode), "fingerprints")
    total = table.count()
    ranges, files = ngram_join.ranges_for(total), few(total)
    reps = table.where("digest is not null").groupBy("digest").agg(
        F.min("uid").alias("doc_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.min("rec_id").alias("least")
    )
    reps = written(reps, "classes", files)
    found = written(ngram_join.candidates(reps.where("prefix is not null"), ranges, percent=0), "candidates", files)

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_recording(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(a, b, strict=True)])

    prints = reps.where("prefix is not null").select("doc_id", "fp")

    def verify(pairs: DataFrame) -> DataFrame:
        x = prints.select(F.col("doc_id").alias("a"), F.col("fp").alias("fa"))
        y = prints.select(F.col("doc_id").alias("b"), F.col("fp").alias("fb"))
        return pairs.join(x, "a").join(y, "b").where(linked("fa", "fb")).select("a", "b")

    def across(groups: DataFrame, nearest: int) -> DataFrame:
        return ngram_join.block_pairs(groups.join(prints, "doc_id"), _compare, "fp", nearest, files=files)

    comps = resolve(found, total, verify, across)
    dropped(found)
    ends = reps.select("digest", "rows", "least", "doc_id").join(comps, F.col("doc_id") == F.col("id"), "left").where("rows > 1 or id is not null")
    ends = ends.select(F.col("digest").alias("d"), F.coalesce("component_id", "doc_id").alias("c"), "least")
    first = ends.groupBy(F.col("c").alias("k")).agg(F.min("least").alias("component_id"))
    ends = written(ends.join(first, F.col("c") == F.col("k")).select("d", "least", "component_id"), "ends", files)
    slim = table.select("rec_id", "n", "digest")
    out = slim.join(ends, slim["digest"] == ends["d"], "left")
    return out.select("rec_id", F.col("n").alias("n_frames"), F.coalesce("least", "rec_id").alias("class_id"), F.coalesce("component_id", "rec_id").alias("component_id"))


def _compare(rows: pd.DataFrame, nearest: bool):
    """Members of other components that are linked; nearest: the first one."""
    fps = [np.frombuffer(x, "<u4") for x in rows["fp"]]
    comp = rows["component_id"].to_numpy()
    known: dict[int, tuple] = {}

    def sorted_keys(k: int):
        if k not in known:
            known[k] = _sorted_keys(fps[k])
        return known[k]

    def compare(k: int, members: np.ndarray):
        found = []
        for m in members[comp[members] != comp[k]].tolist():
            if same_recording(fps[k], fps[m], sorted_keys(k), sorted_keys(m)):
                found.append(m)
                if nearest:
                    break
        return np.array(found, np.int64), np.zeros(len(found))

    return compare


#: How `melody` renders a vector: a note a component, from two octaves of semitones.
NOTE_RATE, NOTE_SAMPLES, NOTES, NOTE_LOW = 4000, 256, 24, 220.0


def melody(vector) -> np.ndarray:
    """Renders a vector as a recording, for tables without audio: component by
    component, its size against the vector's mean size picks the note."""
    v = np.nan_to_num(np.asarray(vector, dtype=np.float64), posinf=0, neginf=0)
    if not len(v) or not np.abs(v).max():
        return np.zeros(0, np.float32)
    z = np.tanh(v / (1.5 * np.sqrt(np.mean(v * v))))
    note = np.clip(((z + 1) / 2 * NOTES).astype(int), 0, NOTES - 1)
    t = np.arange(NOTE_SAMPLES) / NOTE_RATE
    wave = np.sin(2 * np.pi * NOTE_LOW * 2 ** (np.arange(NOTES) / 12)[:, None] * t) * np.hanning(NOTE_SAMPLES)
    return wave[note].ravel().astype(np.float32)

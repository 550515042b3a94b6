"""Audio columns: chroma fingerprints and their alignment.

A recording (mono samples) is cut into overlapping frames; each frame's spectrum is folded
onto the twelve pitch classes. Filters compare sums of rectangles of the frames-by-classes
image, read from its integral image in four additions each, and their quantised answers
(two bits each) are packed in one 32-bit integer for each frame position. Recordings are
aligned by the histogram of offsets at which integers of both agree in the answers of ten of the
sixteen filters (the first, middle or last ten: a vote for each, so three for equal integers); at
each offset with MIN_VOTES votes the share of differing bits says how close they are.

The tables here have no audio: ``render`` makes a recording of each vector of
``embeddings`` (a note for each component), the same for the same vector anywhere.

Search: queries are the rows whose id is divisible by EVERY, against all rows. Recordings
with equal fingerprints are one class and only classes are compared, so many copies of one
recording cost one comparison. The asked classes meet all classes in blocks of about
BLOCK_BYTES of fingerprints: a pair of blocks counts the votes by pair and offset, MOST_VOTES at
once, and returns matches alone. Only votes at offsets where half of the shorter one may overlap
are made, by look-up of value and position, and a pair's bits are compared until there are more
errors than a match may have. No integer is left out, however common. The work is that of a
stated query set against all rows: it grows with their product. On 10 256 recordings the votes
find 99 % of the pairs whose bit error rate is MAX_BER at most where neither is moved.

Edge cases: null and empty recordings, and ones shorter than a fingerprint needs, have an
empty fingerprint and no match; nulls among samples count as silence; repeated rows give
repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.shipping import ship

from . import common

RATE, FRAME, HOP, NOTE = 4000, 1024, 256, 512
CLASSES, SPAN = 12, 8
EVERY = 50
MAX_BER = 0.30
MIN_VOTES = 4
#: What must agree for a vote: the two bits of each of ten neighbouring filters.
MASKS = tuple(sum(3 << (2 * i) for i in range(k, k + 10)) for k in (0, 3, 6))
#: Pairs and offsets counted in one array, where votes are no rarer than one in RARE of them; else
#: the votes are sorted, with the same counts.
MOST_BINS, RARE = 1 << 18, 3
#: Bytes of fingerprints in a block, votes (or compared integers) held at once, and integers of a
#: pair compared before those beyond the most bit errors are given up.
BLOCK_BYTES = 1 << 19
MOST_VOTES = 1 << 17
STEP = 32
#: Filters: (kind, first class, classes, frames); kinds compare halves of the rectangle.
FILTERS = (
    ("low_high", 0, 6, 8), ("low_high", 4, 8, 6), ("low_high", 2, 4, 4), ("low_high", 6, 6, 8),
    ("past_future", 0, 4, 8), ("past_future", 4, 4, 8), ("past_future", 8, 4, 8), ("past_future", 0, 12, 4),
    ("cross", 0, 6, 8), ("cross", 6, 6, 8), ("cross", 3, 6, 4), ("cross", 0, 12, 6),
    ("middle", 0, 9, 6), ("middle", 3, 9, 6), ("middle", 0, 6, 8), ("middle", 6, 6, 8),
)
#: Frames whose filters are computed at once, if not of one recording.
TOGETHER = 1 << 12
#: Quantisation limits of the filters' log ratios, and the two bits of each level.
LIMITS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
_WINDOW = np.hanning(FRAME)
_FREQ = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = (_FREQ > 60) & (_FREQ < 1900)
_CLASS = (np.round(12 * np.log2(np.maximum(_FREQ, 1) / 440.0)).astype(int)) % CLASSES
_FOLD = np.zeros((len(_FREQ), CLASSES))
_FOLD[np.flatnonzero(_USED), _CLASS[_USED]] = 1.0


_TONES = np.sin(2 * np.pi * (220.0 * 2 ** (np.arange(24) // 2 / 12 + np.arange(24) % 2))[:, None] * (np.arange(NOTE) / RATE)[None, :])


def render(vector: list[float] | None) -> np.ndarray:
    """A note for each component: its size picks the pitch class, its sign the octave."""
    if not vector:
        return np.zeros(0)
    v = np.array([0.0 if x is None else x for x in vector], dtype=float)
    v = np.nan_to_num(v / (np.sqrt(np.nanmean(v * v)) or 1.0))
    pitch = np.clip(np.floor(np.abs(v) * 5), 0, 11).astype(np.int64)
    return _TONES[2 * pitch + (v > 0)].ravel()


def samples_of(values: list[float] | None) -> np.ndarray:
    """Mono samples of a recording; nulls and what isn't a number count as silence."""
    return np.nan_to_num(np.array([0.0 if x is None else x for x in values or ()], dtype=float), posinf=0.0, neginf=0.0)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by pitch classes, each frame's energies scaled to their sum."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n] * _WINDOW
    energy = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ _FOLD
    return energy / (energy.sum(1, keepdims=True) + 1e-9)


def packed(chromas: np.ndarray) -> np.ndarray:
    """The integers of recordings of equally many frames: (recordings, frames, classes) to (recordings, positions)."""
    n = chromas.shape[1] - SPAN + 1
    if n <= 0:
        return np.zeros((len(chromas), 0), dtype=np.uint32)
    image = np.zeros((CLASSES + 1, len(chromas), chromas.shape[1] + 1))
    image[1:, :, 1:] = chromas.cumsum(1).cumsum(2).transpose(2, 0, 1)

    def area(t0, t1, k0, k1):
        return image[k1, :, t1 : t1 + n] - image[k1, :, t0 : t0 + n] - image[k0, :, t1 : t1 + n] + image[k0, :, t0 : t0 + n]

    out = np.zeros((len(chromas), n), dtype=np.uint32)
    for i, (kind, k, h, w) in enumerate(FILTERS):
        if kind == "low_high":
            a, b = area(0, w, k, k + h // 2), area(0, w, k + h // 2, k + h)
        elif kind == "past_future":
            a, b = area(0, w // 2, k, k + h), area(w // 2, w, k, k + h)
        elif kind == "cross":
            a = area(0, w // 2, k, k + h // 2) + area(w // 2, w, k + h // 2, k + h)
            b = area(0, w // 2, k + h // 2, k + h) + area(w // 2, w, k, k + h // 2)
        else:
            third = h // 3
            a, b = area(0, w, k + third, k + 2 * third) * 2, area(0, w, k, k + third) + area(0, w, k + 2 * third, k + h)
        ratio = np.log1p(a) - np.log1p(b)
        level = 3 - sum((ratio <= x).astype(np.int8) for x in LIMITS)
        out |= GRAY[level] << np.uint32(2 * i)
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One packed integer for each position of a span of frames."""
    return packed(chroma(samples)[None])[0]


def fingerprint_all(sounds: list[np.ndarray]) -> list[np.ndarray]:
    """The fingerprint of each recording; the filters run over those of equal length together."""
    images = [chroma(x) for x in sounds]
    alike: dict[int, list[int]] = {}
    for i, c in enumerate(images):
        alike.setdefault(len(c), []).append(i)
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(sounds)
    for length, which in alike.items():
        step = max(1, TOGETHER // max(length, 1))
        for lo in range(0, len(which), step):
            part = which[lo : lo + step]
            for i, fp in zip(part, packed(np.stack([images[i] for i in part]))):
                out[i] = fp
    return out


def fingerprints(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", audio: bool = False) -> DataFrame:
    """id and fingerprint (``fp`` array of integers, ``raw`` their four bytes each) of every row's recording.

    ``vector_col`` holds vectors to render, or with ``audio`` the recordings' samples (RATE a second).
    """
    ship(rows.sparkSession)
    sound = samples_of if audio else render

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                prints = fingerprint_all([sound(v) for v in part.column(1).to_pylist()])
                raw = pa.array([p.astype("<u4").tobytes() for p in prints], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.astype(np.int64) for p in prints], pa.list_(pa.int64())), raw], names=["id", "fp", "raw"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, fp array<bigint>, raw binary")


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Compared bits and differing bits of two fingerprints, b moved by ``offset``."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 0
    x = (a[lo:hi] ^ b[lo - offset : hi - offset]).astype(np.uint32)
    return 32 * (hi - lo), int(np.bitwise_count(x).sum())


BLOCK = T.StructType(
    [T.StructField("block", T.IntegerType()), T.StructField("no", T.ArrayType(T.LongType())), T.StructField("cls", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("raw", T.BinaryType())]
)
FOUND = T.StructType([T.StructField("q", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("off", T.LongType()), T.StructField("ber", T.DoubleType())])


def _blocks(classes: DataFrame) -> tuple[DataFrame, int]:
    """The classes in blocks of about BLOCK_BYTES, a row each, and the number of blocks."""
    total = classes.agg(F.sum(F.length("raw"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))

    def pack(key, table):
        raw = table["raw"].to_pylist()
        row = {"block": [key[0].as_py()], "no": [table["no"].to_pylist()], "cls": [table["class_id"].to_pylist()], "sizes": [[len(r) // 4 for r in raw]], "raw": [b"".join(raw)]}
        return pa.table(row, schema=pa.schema([("block", pa.int32()), ("no", pa.list_(pa.int64())), ("cls", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("raw", pa.binary())]))

    dealt = classes.select(F.pmod(F.xxhash64("raw"), F.lit(n)).cast("int").alias("block"), "no", "class_id", "raw")
    return dealt.groupBy("block").applyInArrow(pack, BLOCK), n


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. in each of the runs."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _split(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Slices of runs that hold MOST_VOTES together at most; a longer run is a slice of its own."""
    out, lo, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > MOST_VOTES:
            out.append((lo, i))
            lo, total = i, 0
        total += n
    return [*out, (lo, len(sizes))] if len(sizes) else out


class Prints:
    """The fingerprints of a block, one after the other."""

    def __init__(self, table: pa.Table) -> None:
        row = table.to_pylist()[0]
        self.no, self.cls, self.sizes = (np.array(row[k], dtype=np.int64) for k in ("no", "cls", "sizes"))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ints = np.frombuffer(row["raw"], dtype="<u4")
        self.owner, self.pos = np.repeat(np.arange(len(self.sizes)), self.sizes), _runs(self.sizes)


def _votes(asks: Prints, all_: Prints) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ask, class, offset) with MIN_VOTES votes, of different classes that overlap by half of the shorter; in parts."""
    # Offsets at which a recording of each size may overlap some class of the block by half of the shorter.
    short, long = int(all_.sizes.min()), int(all_.sizes.max())
    ahead = asks.sizes - (np.minimum(asks.sizes, short) + 1) // 2
    behind = long - (np.minimum(asks.sizes, long) + 1) // 2
    back = int(behind.max())
    width = back + int(ahead.max()) + 1
    span = len(all_.no) * width
    kind = np.uint32 if len(asks.no) * span < 1 << 32 else np.int64
    found = (all_.owner * width - all_.pos + back).astype(np.int64)  # a vote's key is the sum of both
    # A class's integers stand by value and position, so those at a possible offset are neighbours.
    bits = long.bit_length()
    nearest = np.maximum(asks.pos - np.repeat(ahead, asks.sizes), 0)
    farthest = np.minimum(asks.pos + np.repeat(behind, asks.sizes), long)
    places, first, total = [], np.zeros((len(asks.ints), len(MASKS)), dtype=np.int64), np.zeros((len(asks.ints), len(MASKS)), dtype=np.int64)
    for k, mask in enumerate(MASKS):
        ints = (all_.ints & np.uint32(mask)).astype(np.int64) << bits | all_.pos
        order = np.argsort(ints)
        ints, ask = ints[order], (asks.ints & np.uint32(mask)).astype(np.int64) << bits
        by = np.argsort(ask | asks.pos)  # neighbours are looked up after each other
        first[by, k] = np.searchsorted(ints, (ask | nearest)[by], "left")
        total[by, k] = np.searchsorted(ints, (ask | farthest)[by], "right")
        places.append(found[order].astype(kind))
    total -= first
    first += np.arange(len(MASKS)) * len(all_.ints)
    place = np.concatenate(places)
    for lo, hi in _split(np.add.reduceat(total.sum(1), asks.starts)):
        begin, end = asks.starts[lo], asks.starts[hi - 1] + asks.sizes[hi - 1]
        own = (asks.pos[begin:end] + (asks.owner[begin:end] - lo) * span).astype(kind)
        own, starts, n = np.repeat(own, len(MASKS)), first[begin:end].ravel(), total[begin:end].ravel()
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        parts = _split(n) if n.sum() > MOST_VOTES else [(0, len(n))]
        whole = len(parts) == 1  # more only where one recording has more votes
        for a, b in parts:
            m = n[a:b]
            at = np.repeat(starts[a:b] - np.cumsum(m) + m, m)
            at += np.arange(len(at))
            key = place[at]
            key += np.repeat(own[a:b], m)
            bins = (hi - lo) * span
            if bins <= MOST_BINS and bins <= RARE * len(key):
                sums = np.bincount(key, minlength=bins)
                key = np.flatnonzero(sums)
                count = sums[key]
            else:
                key.sort()
                if whole:  # the keys that stand MIN_VOTES times; of each more one is left for each more vote
                    early = key[: max(0, len(key) - MIN_VOTES + 1)]
                    key = early[key[MIN_VOTES - 1 :] == early]
                ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], np.ones(min(len(key), 1), dtype=bool)]))
                key, count = key[ends], np.diff(ends, prepend=-1) + (MIN_VOTES - 1) * whole
            if whole:
                keys, counts = key, count
                break
            keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, count]), minlength=len(keys)).astype(np.int64)
        keys = keys[counts >= MIN_VOTES].astype(np.int64)
        pair, off = keys // width, keys % width - back
        q, c = lo + pair // len(all_.no), pair % len(all_.no)
        n = np.minimum(asks.sizes[q], all_.sizes[c] + off) - np.maximum(0, off)
        good = (asks.no[q] != all_.no[c]) & (2 * n >= np.minimum(asks.sizes[q], all_.sizes[c]))
        yield q[good], c[good], off[good]


#: Of STEP integers, those before the end of an overlap.
_BEFORE = np.where(np.arange(STEP) < np.arange(STEP + 1)[:, None], np.uint32(0xFFFFFFFF), np.uint32(0))


def _errors(windows: list[np.ndarray], a_from: np.ndarray, b_from: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Differing bits of n integers from each start in both blocks' windows of STEP; -1 beyond ``most``."""
    bad, left = np.zeros(len(n), dtype=np.int64), np.arange(len(n))
    for at in range(0, int(n.max(initial=0)), STEP):
        size = n[left] - at
        x = windows[0][a_from[left] + at]
        x ^= windows[1][b_from[left] + at]
        short = np.flatnonzero(size < STEP)
        x[short] &= _BEFORE[np.maximum(size[short], 0)]
        bad[left] += np.bitwise_count(x.view(np.uint64)).sum(1, dtype=np.uint16)
        over = bad[left] > most[left]
        bad[left[over]] = -1
        left = left[~over & (size > STEP)]
    return bad


def matches(asks: Prints, all_: Prints) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches of two blocks: the asking class, the class found, its offset and bit error rate.

    Of a pair's offsets the one of the fewest bit errors counts, of several such the smallest, of
    two such the positive one.
    """
    windows = [np.lib.stride_tricks.sliding_window_view(np.concatenate([x.ints, np.zeros(STEP, dtype=np.uint32)]), STEP) for x in (asks, all_)]
    kept = []
    for q, c, off in _votes(asks, all_):
        lo, hi = np.maximum(0, off), np.minimum(asks.sizes[q], all_.sizes[c] + off)
        n = hi - lo
        for k in range(0, len(q), max(1, MOST_VOTES // STEP)):
            part = slice(k, k + max(1, MOST_VOTES // STEP))
            bad = _errors(windows, (asks.starts[q] + lo)[part], (all_.starts[c] + lo - off)[part], n[part], MAX_BER * 32 * n[part])
            good = np.flatnonzero(bad >= 0)
            kept.append((q[part][good], c[part][good], off[part][good], np.round(bad[good] / (32 * n[part][good]), 6)))
    q, c, off, ber = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, dtype=np.int64),) * 4
    best = np.lexsort((-off, np.abs(off), ber, c, q))
    best = best[np.flatnonzero(np.diff(q[best] * len(all_.no) + c[best], prepend=-1))]
    return asks.no[q[best]], all_.cls[c[best]], off[best], ber[best].astype(float)


def match(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, audio: bool = False) -> DataFrame:
    """vec_id, n_frames, fp_crc32, class_id, is_query, n_matches, best_class, best_offset, best_ber.

    A match is another class with an offset that has MIN_VOTES votes and whose bit error rate is
    MAX_BER at most, over half of the shorter one at least. ``audio``: see ``fingerprints``.
    """
    fps = common.staged(fingerprints(rows, id_col, vector_col, audio), "audio")
    keyed = fps.withColumn("key", F.sha2("raw", 256))
    classes = keyed.where(F.size("fp") > 0).groupBy("key").agg(F.min("id").alias("class_id"), F.first("raw").alias("raw"), F.max(F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False))).alias("asked"))
    # Short numbers stand for the long keys; being written, they don't change.
    classes = common.staged(classes.withColumn("no", F.monotonically_increasing_id()), "audio-classes")
    asks, n_asks = _blocks(classes.where("asked"))
    all_, n_all = _blocks(classes)
    asks = asks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_all - 1))))
    all_ = all_.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))

    def run(key, left, right):
        if left.num_rows and right.num_rows:  # a block may have no class
            return pa.table(list(matches(Prints(left), Prints(right))), names=FOUND.names)
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=FOUND.names)

    found = asks.groupBy("block", "other").cogroup(all_.groupBy("other", "block")).applyInArrow(run, FOUND)
    per = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ber", "cls", "off")).alias("m"))
    ids = classes.select("key", "class_id", "no")
    named = keyed.join(ids, "key", "left").join(per, F.col("no") == per["q"], "left")
    asked = F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False))
    crc = F.crc32(F.concat_ws(",", "fp").cast("binary"))
    return named.select(
        F.col("id").alias("vec_id"), F.size("fp").cast("long").alias("n_frames"), crc.alias("fp_crc32"), "class_id", asked.alias("is_query"),
        F.when(asked, F.coalesce("n", F.lit(0))).alias("n_matches"), F.when(asked, F.col("m.cls")).alias("best_class"),
        F.when(asked, F.col("m.off")).alias("best_offset"), F.when(asked, F.col("m.ber")).alias("best_ber"),
    )

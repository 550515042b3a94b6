"""Mixture-controlled packing of token streams into windows.

Each source has a queue: its documents' tokens, one after the other. Deficit round-robin
serves the queues so that every window holds the target proportions; what a queue is owed
or has had too much of (less than one token) is carried to the next window. Served one
window after the other this is sequential. Here it is a closed form: with integer weights
``a_1..a_S`` (sum A) the first g tokens of the mixture hold ``floor(g * A_s / A)`` tokens
of the first s queues together (A_s: sum of the first s weights). Differences of these
floors are each window's quota of each queue, always sum to the window, and carry the
deficits exactly, across windows and across partitions. So a document's place follows from the
number of its queue's tokens before it, and all documents are cut in parallel.

Named sources get the stated weights, all other sources together one more; inside that share
they are mixed by their numbers of tokens, so they end together. Without weights all sources
are mixed so. The floors need queues that are owed a token or more: others are served by turns
of 2^k windows, k being the least for which the source is owed SURE tokens a turn. Sources of
one k (below 0 for those owed more a window) are a group; the upper level serves the named
sources and the groups (as many as the stated weights, and about 64) window by window, and
inside a group's share its sources are served turn by turn, by the same floors. So a source
that is owed four tokens in 1000 windows gets them once in 1024 windows. Groups that are owed
less than two tokens a window together go with the next larger one. The upper level's queues may run out early, and the
remaining ones then share the windows by their weights: it is a list of phases. The lower level
needs only each source's running sum, a table; any number of sources have queues of their own.
A stated weight below a token a window counts as a token a window.

The last, incomplete window is cut into sequences whose lengths are powers of two, so no
sequence needs padding.

Documents are cut wherever a quota ends. Every token is in exactly one piece.

Edge cases: null and empty texts are a single separator token; a null source is a queue of
its own; a source without a weight is one of the others, a weighted one without tokens is left
out; texts of any length are taken whole; repeated rows are packed once each; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

#: Bytes of words, and of their parts, whose ids a worker remembers.
WORD_BYTES, PART_BYTES = 64 << 20, 96 << 20
#: Tokens that a source is owed in a turn, at least.
SURE = 4
#: Tokens of a document that are placed at once; longer documents are placed in segments.
SEGMENT = 1 << 18
#: The table of running sums is broadcast up to this many rows and bytes of names, and joined by key beyond.
SMALL_ROWS, SMALL_BYTES = 200_000, 8 << 20

#: What the plain path below knows how to do without the library's
#: normaliser and splitter. Another tokenizer takes the library's whole path for all words.
PLAIN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words with more than printable ASCII and the Latin-1 letters, which NFC leaves as they are
#: and which are lower-cased letter by letter.
NOT_PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*[^\n!-~\xc0-\xd6\xd8-\xf6\xf8-\xff][^\n]*")
PLAIN_PARTS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\na-z0-9\xdf-\xf6\xf8-\xff]+")


class Ragged:
    """Sequences of token ids by key, in one growing array."""

    def __init__(self, limit: int = WORD_BYTES) -> None:
        self.row = common.Words(limit)
        self.clear()

    def clear(self) -> None:
        self.row.clear()
        self.ids = np.empty(0, dtype=np.uint32)
        self.starts = np.empty(0, dtype=np.int64)
        self.sizes = np.empty(0, dtype=np.int64)

    def remember(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add sequences of new keys; the memory starts afresh where they are too many."""
        if self.row.full(keys):
            self.clear()
        self.row.used += self.row.cost(keys)
        self.add(keys, ids, sizes)

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.row.update(zip(keys, range(len(self.sizes), len(self.sizes) + len(keys))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def rows(self, keys: list[str]) -> np.ndarray:
        """Places of keys, which must all be known."""
        return np.fromiter(map(self.row.__getitem__, keys), dtype=np.int64, count=len(keys))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of many rows, one after the other, and the size of each."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - ends + sizes, sizes)
        return self.ids[at], sizes


class WordEncoder:
    """Token ids of texts, by white-space separated words.

    The tokenizer's normaliser turns every run of white space into one space, which its
    pre-tokenizer drops, and nothing crosses it: words can be encoded one by one, and each
    different word once. Words of plain letters are lower-cased and split here, and the
    library merges their different parts, many in a call: a part's last token bears the
    vocabulary's mark of a word end, which tells the parts' ids apart. All other words,
    and those with a special token's string, go through the whole library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words, self.parts = Ragged(), Ragged(PART_BYTES)
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix, splits = spec["model"].get("end_of_word_suffix"), (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = bool(suffix) and (spec["normalizer"] or {}).get("normalizers") == PLAIN_NORMALIZER
        self.plain = self.plain and splits[0].get("pattern") == {"Regex": PLAIN_SPLIT} and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        if self.plain:
            vocab = spec["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.last[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
            spec |= {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, splits[1]]}}
            self.merge = Tokenizer.from_str(json.dumps(spec))

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and their sizes, by the whole library."""
        ids, sizes = [np.empty(0, dtype=np.uint32)], [np.empty(0, dtype=np.int64)]
        for lo in range(0, len(words), 20_000):
            found = [e.ids for e in self.t.encode_batch_fast(words[lo : lo + 20_000], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(found), dtype=np.uint32))
            sizes.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn_parts(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.parts.row]
        if self.parts.row.full(new):
            self.parts.clear()
            new = list(parts)
        self.parts.row.used += self.parts.row.cost(new)
        if "\n" not in self.parts.row:  # the border between words has no ids
            self.parts.add(["\n"], np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64))
        new = [p for p in new if p != "\n"]
        for lo in range(0, len(new), 2_000):
            some = new[lo : lo + 2_000]
            ids = np.array(self.merge.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(some):
                raise ValueError("this vocabulary does not mark the end of each part")
            self.parts.add(some, ids, np.diff(ends, prepend=-1))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after the other, and their sizes."""
        if not self.plain or not words:
            return self._whole(words)
        joined = "\n".join(words)
        other, plain = set(NOT_PLAIN.findall(joined)), words
        for special in self.special:
            if special in joined:
                other.update(w for w in words if special in w)
        if other:
            odd = np.fromiter((w in other for w in words), dtype=bool, count=len(words))
            plain = [w for w in words if w not in other]
            joined = "\n".join(plain)
        ids, sizes = self._plain(joined) if plain else (np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64))
        if not other:
            return ids, sizes
        rest, rest_sizes = self._whole([w for w in words if w in other])
        both, at = Ragged(), np.empty(len(words), dtype=np.int64)
        both.add([], ids, sizes)
        both.add([], rest, rest_sizes)
        at[~odd] = np.arange(len(sizes))
        at[odd] = len(sizes) + np.arange(len(rest_sizes))
        return both.gather(at)

    def _plain(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of plain words, given joined by line feeds."""
        found = PLAIN_PARTS.findall(joined.lower())
        self._learn_parts(set(found))
        rows = self.parts.rows(found)
        ids, sizes = self.parts.gather(rows)
        ends = np.cumsum(sizes)
        border = np.flatnonzero(rows == self.parts.row["\n"])
        return ids, np.diff(np.concatenate([[0], ends[border], [len(ids)]]))

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end`` behind each, one after the other, and their sizes; null is empty."""
        # Only separators that are white space to every library; words may hold others.
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = coded.indices.to_numpy()
        known = self.words.row
        at = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            keys = [words[i] for i in new.tolist()]
            ids, sizes = self.encode(keys)
            here = Ragged()
            here.add([], ids, sizes)
            # Only words that are found again are remembered; the others' ids last for this batch.
            again = np.flatnonzero(np.bincount(places, minlength=len(words))[new] > 1)
            old, old_sizes = self.words.gather(at[at >= 0])
            here.add([], old, old_sizes)
            at[at >= 0] = len(new) + np.arange(len(words) - len(new))
            at[new] = np.arange(len(new))
            self.words.remember([keys[i] for i in again.tolist()], *here.gather(again))
        else:
            here = self.words
        ids, sizes = here.gather(at[places])
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        cuts = np.concatenate([[0], np.cumsum(sizes)])[at]
        return np.insert(ids, cuts[1:], end), np.diff(cuts) + 1


TOKENS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("part", T.LongType()),
        T.StructField("before", T.LongType()),
    ]
)


def tokenised(docs: DataFrame, tokenizer_path: str, end: int) -> DataFrame:
    """Token bytes of each document, with the tokens of its source before it in its partition.

    Ids take two bytes each here where all of a batch fit, else four.
    """

    def run(batches):
        enc, part = common.held(f"packing {tokenizer_path}", lambda: WordEncoder(tokenizer_path)), TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}
        for batch in batches:
            for lo, hi in common.sub_ranges(batch, 1):
                docs_, sources = batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo).to_pylist()
                ids, n = enc.batch(batch.column(1).slice(lo, hi - lo), end)
                kind = np.dtype("<u2" if ids.max() < 1 << 16 else "<u4")
                before = []
                for s, k in zip(sources, n.tolist()):
                    before.append(seen.get(s, 0))
                    seen[s] = before[-1] + k
                offsets = np.concatenate([[0], np.cumsum(n)]) * kind.itemsize
                blobs = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(kind))])
                arrays = [docs_, pa.array(sources, pa.string()), pa.array(n), blobs.cast(pa.binary()), pa.array(np.full(len(n), part)), pa.array(before, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=TOKENS.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col("source").cast("string")).mapInArrow(run, TOKENS)


def share(x: np.ndarray, part, whole) -> np.ndarray:
    """floor(x * part / whole), exactly, also where the product needs more than 64 bits."""
    if not len(x):
        return x
    most = int(np.max(x)) * int(np.max(part))
    if most < 1 << 62:
        return x * part // whole
    return (x.astype(object) * part // whole).astype(np.int64)


class Schedule:
    """The phases of the upper level: from which token on which queues share by which weights."""

    def __init__(self, totals: list[int], weights: list[int], window: int) -> None:
        self.window, self.total = window, sum(totals)
        self.windows = -(-self.total // window)
        self.phases: list[tuple[int, list[int], list[int]]] = []  # start, cumulative weights, tokens served of each queue before
        if weights == totals:
            self._phase(0, totals, [0] * len(totals))
        else:
            self._phases(list(totals), weights)
        self.starts = [p[0] for p in self.phases]
        self.start = np.array(self.starts, dtype=np.int64)
        self.cum, self.served = (np.array([p[k] for p in self.phases], dtype=np.int64) for k in (1, 2))

    def _phase(self, start: int, counts: list[int], served: list[int]) -> None:
        cum = [0]
        for a in counts:
            cum.append(cum[-1] + a)
        self.phases.append((start, cum, list(served)))

    def _phases(self, left: list[int], weights: list[int]) -> None:
        """Whole windows by weight as long as every queue lasts, then one window by what is left."""
        served, start, size = [0] * len(left), 0, self.window
        while any(left):
            w = [a * size if r else 0 for a, r in zip(weights, left)]
            if not any(w):
                w = [size if r else 0 for r in left]
            least = -(-sum(w) // size) + len(w)
            w = [max(a, least) if r else 0 for a, r in zip(w, left)]  # a token a window at least
            whole = sum(w)
            n = min(r * whole // a for r, a in zip(left, w) if a) // size * size
            cum = [0]
            for a in w:
                cum.append(cum[-1] + a)
            while n and any(n * cum[i + 1] // whole - n * cum[i] // whole > r for i, r in enumerate(left)):
                n -= size
            if n:
                self._phase(start, w, served)
                got = [n * cum[i + 1] // whole - n * cum[i] // whole for i in range(len(left))]
            else:
                n = min(size, sum(left))
                got = [min(r, n * a // whole) for r, a in zip(left, w)]
                for i, r in enumerate(left):
                    got[i] += min(r - got[i], n - sum(got))
                self._phase(start, got, served)
            for i, g in enumerate(got):
                left[i] -= g
                served[i] += g
            start += n

    def upto(self, queue: int, g: int) -> int:
        """Tokens of a queue among the first g of the mixture."""
        start, cum, served = self.phases[max(0, bisect_right(self.starts, g) - 1)]
        d, whole = g - start, cum[-1]
        return served[queue] + d * cum[queue + 1] // whole - d * cum[queue] // whole

    def _at(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phase of each window's first token, and that token's number in the phase."""
        g = np.minimum(w * self.window, self.total)
        phase = np.maximum(np.searchsorted(self.start, g, "right") - 1, 0)
        return phase, g - self.start[phase]

    def before(self, queue: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Tokens of each queue before each window."""
        phase, d = self._at(w)
        cum, whole = self.cum[phase], self.cum[phase, -1]
        at = np.arange(len(w))
        return self.served[phase, queue] + share(d, cum[at, queue + 1], whole) - share(d, cum[at, queue], whole)

    def place(self, queue: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Where each queue's quota begins inside each window: phases begin with a window, so the
        quotas of the queues before it add up to a difference of two floors."""
        phase, d = self._at(w)
        cum, whole = self.cum[phase, queue], self.cum[phase, -1]
        end = np.minimum(d + self.window, self.total - self.start[phase])
        return share(end, cum, whole) - share(d, cum, whole)

    def tail(self) -> list[tuple[int, int]]:
        """Sequences of the incomplete last window: (offset in the window, length)."""
        left, at, out = self.total % self.window, 0, []
        while left:
            size = 1 << (left.bit_length() - 1)
            out.append((at, size))
            at, left = at + size, left - size
        return out


@dataclass
class Streams:
    """Tokens of sources, an array each: the upper queue, its total and the windows of its turn as
    a power of two; the source's running sums (lo, hi) in the queue; the first token's number in the
    source, and the number of tokens."""

    queue: np.ndarray
    whole: np.ndarray
    turn: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    x: np.ndarray
    n: np.ndarray

    def take(self, rows) -> Streams:
        return Streams(*(getattr(self, f)[rows] for f in ("queue", "whole", "turn", "lo", "hi", "x", "n")))


def before_turn(s: Schedule, t: Streams, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Before each turn: tokens of the queue, of the source, and of the queue's earlier sources."""
    y = s.before(t.queue, np.minimum(j << t.turn, s.windows))
    below = share(y, t.lo, t.whole)
    return y, share(y, t.hi, t.whole) - below, below


def _first(most: np.ndarray, beyond) -> np.ndarray:
    """The least number up to ``most`` after which ``beyond`` holds, for each row, by bisection."""
    lo, hi = np.zeros(len(most), dtype=np.int64), most
    while (lo < hi).any():
        mid = (lo + hi) // 2
        there = beyond(mid + 1)
        lo, hi = np.where(there, lo, np.minimum(mid + 1, hi)), np.where(there, mid, hi)
    return lo


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for each number from first to last of each row."""
    count = last - first + 1
    row = np.repeat(np.arange(len(count)), count)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def cut(s: Schedule, t: Streams) -> tuple[np.ndarray, ...]:
    """Pieces of the streams: (stream, start in it, length, sequence, offset), in order.

    A stream is cut by its queue's turns, each of which holds a token of it at least, and
    these runs by windows.
    """
    turns = (s.windows - 1) >> t.turn
    ends = [_first(turns, lambda j, x=x: before_turn(s, t, j)[1] > x) for x in (t.x, t.x + t.n - 1)]
    row, j = _spread(*ends)
    own = t.take(row)
    (y, lo, below), (_, hi, above) = before_turn(s, own, j), before_turn(s, own, j + 1)
    if (hi < lo).any():
        raise ArithmeticError("a source's tokens must not decrease")
    start, stop = np.maximum(lo, own.x), np.minimum(hi, own.x + own.n)
    good = stop > start
    row, j, own, start, stop = row[good], j[good], own.take(good), start[good], stop[good]
    y = (y + above - below - lo)[good] + start  # the run's first token's number in the queue
    single, many = j, np.flatnonzero(own.turn)
    first, last = single.copy(), single.copy()
    if len(many):  # a turn of one window is that window
        q, most = own.queue[many], np.full(len(many), s.windows - 1)
        for at, x in ((first, y[many]), (last, (y + stop - start - 1)[many])):
            at[many] = _first(most, lambda w, x=x: s.before(q, w) > x)
    run, w = _spread(first, last)
    queue, y, n = own.queue[run], y[run], (stop - start)[run]
    lo, hi = s.before(queue, w), s.before(queue, w + 1)
    begin, end = np.maximum(lo, y), np.minimum(hi, y + n)
    off = s.place(queue, w) + begin - lo
    out = [row[run], (start - own.x)[run] + begin - y, end - begin, w, off]
    good = end > begin
    out = [a[good] for a in out]
    full = s.total // s.window
    ragged = np.flatnonzero(out[3] == full)
    if len(ragged):  # pieces of the last window, which is shorter
        rest = [a[out[3] != full] for a in out]
        more = []
        for r, begin, n, _, o in zip(*(a[ragged].tolist() for a in out)):
            for k, (at, size) in enumerate(s.tail()):
                a, b = max(o, at), min(o + n, at + size)
                if b > a:
                    more.append((r, begin + a - o, b - a, full + k, a - at))
        out = [np.concatenate([a, np.array(b, dtype=np.int64)]) for a, b in zip(rest, zip(*more))]
        by = np.lexsort((out[1], out[0]))
        out = [a[by] for a in out]
    return tuple(out)


PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [T.StructField("ids", T.BinaryType())]
)


def groups(levels: list[tuple[int, int]], window: int, part: float) -> list[tuple[int, int, set[int]]]:
    """(windows of a turn as a power of two, tokens, levels) of the groups of unnamed sources.

    ``levels`` has each level and its tokens; levels that are owed less than two tokens a window,
    of the ``part`` of a window that unnamed sources get, go with the next ones.
    """
    total, out = sum(n for _, n in levels), []
    turn, tokens, held = 0, 0, set()  # levels below 0 have turns of one window
    for k, n in sorted(levels, reverse=True):
        turn, tokens, held = max(turn, k), tokens + n, held | {k}
        if tokens * window * part >= 2 * total:
            out.append((turn, tokens, held))
            turn, tokens, held = 0, 0, set()
    if held:  # what is left goes with the last group
        last = out.pop() if out else (0, 0, set())
        out.append((max(turn, last[0]), tokens + last[1], held | last[2]))
    return out


def _running(sums: DataFrame, named: dict[str, int], window: int, part: float) -> tuple[DataFrame, list[int], list[int]]:
    """(source, part, base, queue, lo, hi), and the upper queues' totals and turns.

    ``base`` counts tokens of the source in earlier parts, lo and hi tell its place among the
    tokens of its upper queue. Sources with a null name compare equal.
    """
    spark = sums.sparkSession
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sources = sums.groupBy("source").agg(F.sum("n").alias("n"))
    others = sources.where(~F.coalesce(F.col("source").isin(list(named)), F.lit(False))) if named else sources
    total = others.agg(F.sum("n")).first()[0] or 0
    level = F.ceil(F.log2(F.lit(SURE * float(total)) / (F.lit(window * part) * F.col("n")))).cast("int")
    others = others.withColumn("level", level).withColumn("bin", F.pmod(F.xxhash64("source"), F.lit(256)).cast("int"))
    bins = others.groupBy("level", "bin").agg(F.sum("n").alias("n")).collect()  # about 64 levels of 256 bins
    levels: dict[int, int] = {}
    for r in bins:
        levels[r["level"]] = levels.get(r["level"], 0) + r["n"]
    grouped = groups(list(levels.items()), window, part)
    at = []
    for q, (_, _, held) in enumerate(grouped, len(named)):
        total = 0
        for r in sorted((r for r in bins if r["level"] in held), key=lambda r: (r["level"], r["bin"])):
            at.append((r["level"], r["bin"], q, total))
            total += r["n"]
    inside = Window.partitionBy("level", "bin").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    others = others.withColumn("lo", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    others = others.join(F.broadcast(spark.createDataFrame(at, "level int, bin int, queue int, at long")), ["level", "bin"])
    places = others.select("source", "queue", (F.col("lo") + F.col("at")).alias("lo"), "n")
    if named:
        places = places.unionByName(spark.createDataFrame([(s, q, 0, n) for q, (s, n) in enumerate(named.items())], "source string, queue int, lo long, n long"))
    places = places.select(F.col("source").alias("_source"), "queue", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    joined = parts.join(places, F.col("source").eqNullSafe(F.col("_source"))).select("source", "part", "base", "queue", "lo", "hi")
    return joined, [*named.values(), *(n for _, n, _ in grouped)], [0] * len(named) + [k for k, _, _ in grouped]


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end: int = 1, weights: dict[str, int] | None = None, others: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places; ``ids`` holds each piece's ids as bytes.

    ``weights`` are the named sources' target weights and ``others`` (1 or more) that of all
    other sources together; without ``weights`` all are mixed by their tokens. No more than a
    quarter of ``window`` may be named. ``with_ids=False`` leaves out the ids.
    """
    if others < 1 or len(weights or ()) > window // 4:
        raise ValueError("too many weights for the window, or none for the other sources")
    spark = docs.sparkSession
    rows = common.staged(tokenised(docs, tokenizer_path, end), "tokens")
    sums = common.staged(rows.groupBy("source", "part").agg(F.sum("n").alias("n")), "token-sums")
    out = PIECES if with_ids else T.StructType(PIECES.fields[:-1])
    size = sums.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum(F.length("source")).alias("names")).first()
    if not size["n"]:
        return spark.createDataFrame([], out)
    named = {r["source"]: r["n"] for r in sums.where(F.col("source").isin(list(weights))).groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").collect()} if weights else {}
    stated = sum(weights[s] for s in named)
    running, totals, turns = _running(sums, named, window, others / (stated + others))
    rest = size["n"] - sum(named.values())
    scale = [weights[s] * rest for s in named] + [others * n for n in totals[len(named) :]] if named and rest else [weights[s] for s in named] or totals
    schedule = Schedule(totals, scale, window)
    wholes, turns = np.array(totals, dtype=np.int64), np.array(turns, dtype=np.int64)
    if size["rows"] <= SMALL_ROWS and (size["names"] or 0) <= SMALL_BYTES:
        running = F.broadcast(running)
    running = running.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "base", "queue", "lo", "hi")
    joined = rows.join(running, rows["source"].eqNullSafe(F.col("_source")) & (rows["part"] == F.col("_part")))
    placed = joined.select("doc_id", "n", "ids", (F.col("base") + F.col("before")).alias("x"), "queue", "lo", "hi")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, x, queue, lo, hi = (batch.column(i).to_numpy() for i in (1, 3, 4, 5, 6))
            ends = np.cumsum(n)
            blob = batch.column(2)
            raw = b"".join(blob.to_pylist())
            ids = np.frombuffer(raw, dtype="<u2").astype("<u4") if len(raw) == 2 * ends[-1] else np.concatenate([np.frombuffer(b, dtype=f"<u{len(b) // k}").astype("<u4") for b, k in zip(blob.to_pylist(), n.tolist())])
            parts = -(-n // SEGMENT)
            row = np.repeat(np.arange(len(n)), parts)
            skip = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
            t = Streams(queue[row].astype(np.int64), wholes[queue[row]], turns[queue[row]], lo[row], hi[row], x[row] + skip, np.minimum(n[row] - skip, SEGMENT))
            stops, at = np.cumsum(t.n), 0
            while at < len(row):  # streams of about SEGMENT tokens at once
                to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + SEGMENT, "right")))
                which, start, length, seq, off = cut(schedule, t.take(slice(at, to)))
                doc = row[at + which]
                start = start + skip[at + which]
                view = memoryview(ids).cast("B")
                begin = (ends[doc] - n[doc] + start) * 4
                slices = [view[a:b] for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
                crc = np.fromiter(map(zlib.crc32, slices), dtype=np.int64, count=len(slices))
                arrays = [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, length, crc, n[doc], seq, off))]
                if with_ids:
                    arrays.append(pa.array(slices, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)
                at = to

    return placed.mapInArrow(run, out)

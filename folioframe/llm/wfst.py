"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (a space mark in front, spaces to
space marks; one state), the pieces (a trie whose final states emit ids), and the byte fallback
(a character that no piece holds goes through one arc for each UTF-8 byte). The normaliser is
composed with the pieces' input alphabet when compiling. The composition with an input is a
lattice over its positions, built lazily by walking the trie from every position; the encoding
is the lattice's shortest path in the tropical semiring (weights add along a path, the least of
parallel paths counts). Many words are composed and relaxed at once, in arrays.

For a unigram model an arc weighs its piece's negative score, and an unknown character as much
as the worst piece and UNKNOWN more. For a merge (BPE) model the scores rank merges and a least
sum of them isn't the encoding, so states are (position, last piece), an arc weighs one, and the
step from one piece to the next has no weight where the two may be neighbours in an encoding and
an infinite one elsewhere. Two pieces may be neighbours if no merge crosses their border at any
time: their merges are undone one by one, the latest first, and at each stage the two symbols at
the border must not form a piece that would have been merged before. A prefix of an encoding is
the prefix's encoding, so one state of each position is at a finite distance; that is checked.

No piece holds a space mark behind another character, so the lattice falls apart at words and a
word's shortest path is found once. Runs of space marks, all pieces of one score, are merged
from the left.

Edge cases: null and empty texts encode to no ids and decode to ""; unknown characters become
bytes; an incomplete byte sequence decodes to U+FFFD for each byte; texts of any length are taken
whole; repeated rows give repeated rows; an empty table gives an empty table; other columns are
ignored, and ``with_ids`` raises where its new column exists.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .spm_model import BPE, BYTE, NORMAL, SPACE, SpmModel, read_model

#: Bytes of words whose ids a worker remembers, and pairs of pieces (a power of two).
WORD_BYTES, PAIRS = 64 << 20, 1 << 20
#: Words composed at once, and the longest of them; longer words are relaxed one by one.
WORDS, LONGEST = 10_000, 64
#: Fixed value of the public library: what an unknown character weighs beyond the worst piece.
UNKNOWN = 10.0
INF = float("inf")
NEVER = np.int64(1 << 60)


class Table:
    """Whole numbers by whole number: a hash table in arrays, for many keys at once."""

    def __init__(self, room: int) -> None:
        self.bits = max(4, int(room * 2 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int64)
        self.n = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> Table:
        """Add different keys, none of which is there."""
        self.n += len(keys)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for a slot the last stays
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)
        return self

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], missing)
        on = np.flatnonzero((found != keys) & (found != -1))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[on]]
            hit = found == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (found != -1)]
        return out


def _table(pairs: dict[int, int]) -> Table:
    return Table(len(pairs)).put(np.fromiter(pairs, dtype=np.int64, count=len(pairs)), np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs)))


class Transducer:
    """The compiled machines of a model."""

    def __init__(self, model: SpmModel | str) -> None:
        self.m = read_model(model) if isinstance(model, str) else model
        self.m.check_plain()
        self.ids = self.m.normal()
        self.bpe = self.m.model_type == BPE
        self.bytes = np.array(self.m.byte_ids(), dtype=np.int64)
        self.high = {i for b, i in enumerate(self.bytes.tolist()) if b > 127}
        self.shown = ["" if k not in (NORMAL, BYTE) else p.replace(SPACE, " ") for p, k in zip(self.m.pieces, self.m.kinds)]
        for b, i in enumerate(self.bytes.tolist()):
            if i >= 0:
                self.shown[i] = chr(b)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("this vocabulary's pieces cross spaces")
        self.longest_run = max((len(p) for p in self.ids if not p.strip(SPACE)), default=1)
        self._compile()
        self.pairs = Table(PAIRS)
        self.words = common.Words(WORD_BYTES)
        self._store = _Store()

    # -- compiling ------------------------------------------------------------------------

    def _compile(self) -> None:
        """Symbols (pieces of words, and their characters), trie, weights, merges."""
        chars = sorted({c for p in self.ids for c in p})
        self.sym = {p: k for k, p in enumerate(p for p in self.ids if not p.startswith(SPACE * 2))}
        for c in chars:
            self.sym.setdefault(c, len(self.sym))
        self.n = len(self.sym)  # the symbol of every unknown character
        texts = list(self.sym)
        self.id_of = np.array([self.ids.get(p, -1) for p in texts] + [-1], dtype=np.int64)
        worst = min((self.m.scores[i] for i in self.ids.values()), default=0.0)
        self.weight = np.array([1.0 if self.bpe else -self.m.scores[self.ids[p]] if p in self.ids else UNKNOWN - worst for p in texts] + [1.0 if self.bpe else UNKNOWN - worst])
        # The normaliser, composed with the pieces' input alphabet: raw code points to characters.
        self.width = len(chars) + 1
        self.alphabet = np.full(0x110000, len(chars), dtype=np.int32)
        for k, c in enumerate(chars):
            self.alphabet[ord(c)] = k
        self.alphabet[ord(" ")] = self.alphabet[ord(SPACE)]
        order = sorted({self.m.scores[i] for i in self.ids.values()}, reverse=True)
        place = {x: r for r, x in enumerate(order)}
        self.rank = np.array([place[self.m.scores[self.ids[p]]] if len(p) > 1 else -1 for p in texts] + [-1], dtype=np.int64)
        self.left = np.full(self.n + 1, -1, dtype=np.int64)
        self.right = self.left.copy()
        usable = np.ones(self.n + 1, dtype=bool)
        if self.bpe:
            self._compile_merges(texts, usable)
        nodes: list[int] = [-1]  # symbol that each state of the trie emits
        edges: dict[int, int] = {}
        index = {c: k for k, c in enumerate(chars)}
        for p, k in self.sym.items():
            if usable[k]:
                node = 0
                for c in p:
                    key = node * self.width + index[c]
                    if key not in edges:
                        edges[key] = len(nodes)
                        nodes.append(-1)
                    node = edges[key]
                nodes[node] = k
        self.edges, self.final = _table(edges), np.array(nodes, dtype=np.int64)

    def _compile_merges(self, texts: list[str], usable: np.ndarray) -> None:
        """Ranks of all pairs, and each piece's last merge, the shorter pieces first.

        Of the cuts of a piece, the last merge joins the two that are neighbours as long as only
        merges of a lower rank than the piece's are made. The few pieces for which that finds none
        or several are merged literally: they may have a part of a higher rank, and are then odd,
        or never come out of merging, and are left out.
        """
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        ranks: dict[int, int] = {}
        for p, k in self.sym.items():
            for cut in range(1, len(p)):
                a, b = self.sym.get(p[:cut]), self.sym.get(p[cut:])
                if a is not None and b is not None:
                    by_size.setdefault(len(p), []).append((k, a, b))
                    ranks[a * (self.n + 1) + b] = int(self.rank[k])
        self.ranks, self.texts = _table(ranks), texts
        self.odd = np.zeros(self.n + 1, dtype=bool)
        for size in range(2, max(map(len, texts), default=1) + 1):
            of = np.array([k for k in range(self.n) if len(texts[k]) == size], dtype=np.int64)
            usable[of] = False
            k, a, b = np.array(by_size.get(size, []), dtype=np.int64).reshape(-1, 3).T
            some = usable[a] & usable[b] & ~self.odd[a] & ~self.odd[b] & (np.maximum(self.rank[a], self.rank[b]) < self.rank[k])
            k, a, b = k[some], a[some], b[some]
            ok = self.neighbours(a, b, self.rank[k])
            k, a, b = k[ok], a[ok], b[ok]
            once = np.bincount(k, minlength=self.n)[k] == 1
            k, a, b = k[once], a[once], b[once]
            self.left[k], self.right[k], usable[k] = a, b, True
            for k in of[~usable[of]].tolist():
                parts, last = self._merged(texts[k])
                if len(parts) == 1:
                    self.left[k], self.right[k], usable[k], self.odd[k] = self.sym[last[0]], self.sym[last[1]], True, True

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging leaves of a short text, step by step, and the two parts joined last."""
        parts, last = list(text), None
        while True:
            found = [(-self.m.scores[self.ids[p]], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ids]
            if not found:
                return parts, last
            i = min(found)[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def neighbours(self, p: np.ndarray, q: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of a lower rank than ``limit`` crosses the border of two symbols."""
        ok = np.ones(len(p), dtype=bool)
        literal = np.flatnonzero(self.odd[p] | self.odd[q])
        for i in literal.tolist():
            if p[i] < self.n and q[i] < self.n:
                x, y = self.texts[p[i]], self.texts[q[i]]
                ok[i] = self._merged(x + y)[0] == [x, y]
        live = np.flatnonzero(~(self.odd[p] | self.odd[q]))
        p, q = p[live], q[live]
        limit = np.full(len(p), NEVER) if limit is None else limit[live]
        while len(live):
            crossed = self.ranks.get(p * (self.n + 1) + q, NEVER) < limit
            ok[live[crossed]] = False
            mine, other = self.rank[p], self.rank[q]
            go = ~crossed & ((mine >= 0) | (other >= 0))
            live, p, q, mine, other = live[go], p[go], q[go], mine[go], other[go]
            # Of merges of one rank the left one is made first: before the right symbol's, the border's; after the left symbol's.
            first = mine > other
            limit = np.where(first, mine, other + 1)
            p, q = np.where(first, self.right[p], p), np.where(first, q, self.left[q])
        return ok

    def allowed(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """``neighbours``, remembered."""
        key = p * (self.n + 1) + q
        known = self.pairs.get(key, -1)
        new = np.unique(key[known < 0])
        if len(new):
            ok = self.neighbours(new // (self.n + 1), new % (self.n + 1))
            if self.pairs.n + len(new) > PAIRS:
                self.pairs = Table(max(PAIRS, len(new)))
            self.pairs.put(new, ok.astype(np.int64))
            at = np.flatnonzero(known < 0)
            known[at] = ok[np.searchsorted(new, key[at])]
        return known > 0

    # -- composition and shortest paths ---------------------------------------------------

    def arcs(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, symbol) of all arcs of the lattices; ``ends``: where each position's word ends."""
        at, node = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
        lone = np.flatnonzero(chars == self.width - 1)
        out = [(lone, lone + 1, np.full(len(lone), self.n))]
        step = 0
        while len(at):
            inside = at + step < ends[at]
            at, node = at[inside], node[inside]
            node = self.edges.get(node * self.width + chars[at + step], -1)
            at, node = at[node >= 0], node[node >= 0]
            step += 1
            found = self.final[node]
            hit = found >= 0
            out.append((at[hit], at[hit] + step, found[hit]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def relaxed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and their sizes: all lattices at once, by position."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        begin = np.cumsum(sizes) - sizes
        start, end, sym = self.arcs(self.alphabet[codes], (begin + sizes)[owner])
        rel = end - begin[owner[start]]
        order = np.argsort(rel, kind="stable")
        start, sym, rel, word = start[order], sym[order], rel[order], owner[start[order]]
        # A word of n characters has n + 1 positions.
        end, char, start = end[order] + word, start, start + word
        head = begin + np.arange(len(words))
        cost = np.full(len(codes) + len(words), INF)
        cost[head] = 0.0
        last, arc = np.full(len(cost), -1, dtype=np.int64), np.full(len(cost), -1, dtype=np.int64)
        cuts = np.searchsorted(rel, np.arange(1, (rel[-1] if len(rel) else 0) + 2))
        for lo, hi in zip(cuts, cuts[1:]):
            here = np.arange(lo, hi)
            far = cost[start[here]] + self.weight[sym[here]]
            here = here[far < INF]
            if self.bpe:
                prev = last[start[here]]
                ok = prev < 0
                on = np.flatnonzero(~ok)
                ok[on] = self.allowed(prev[on], sym[here[on]])
                here = here[ok]
            far = cost[start[here]] + self.weight[sym[here]]
            by = np.lexsort((far, end[here]))
            best = by[np.flatnonzero(np.diff(end[here][by], prepend=-1))]
            if self.bpe and len(best) < len(here):
                raise ArithmeticError("two states of a position are at a finite distance")
            cost[end[here[best]]], last[end[here[best]]], arc[end[here[best]]] = far[best], sym[here[best]], here[best]
        at, live = head + sizes, np.flatnonzero(sizes > 0)
        if (cost[at] == INF).any():
            raise ArithmeticError("the lattice has no path")
        steps = []
        while len(live):  # from the end of each word back
            a = arc[at[live]]
            steps.append((live, sym[a], codes[char[a]]))
            at[live] = start[a]
            live = live[at[live] > head[live]]
        if not steps:
            return np.zeros(0, dtype=np.uint32), sizes
        word, sym, code = (np.concatenate(x[::-1]) for x in zip(*steps))
        by = np.argsort(word, kind="stable")
        return self._emit(word[by], sym[by], code[by], len(words))

    def _emit(self, word: np.ndarray, sym: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the paths' arcs; a symbol without an id is one character and becomes bytes."""
        ids = self.id_of[sym]
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            raw = [chr(c).encode() for c in code[lone].tolist()]
            many = np.ones(len(ids), dtype=np.int64)
            many[lone] = [len(r) for r in raw]
            place = np.repeat(ids < 0, many)
            ids, word = np.repeat(ids, many), np.repeat(word, many)
            ids[place] = self.bytes[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return ids.astype(np.uint32), np.bincount(word, minlength=n)

    def shortest(self, word: str) -> list[int]:
        """One word's ids: the same lattice, relaxed state by state; linear in the word."""
        chars = self.alphabet[np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)]
        start, end, sym = self.arcs(chars, np.full(len(chars), len(chars)))
        order = np.lexsort((start, end))
        # Of each position: distance, last symbol, and where its arc starts.
        best: list[tuple[float, int, int] | None] = [None] * (len(word) + 1)
        best[0] = (0.0, -1, -1)
        pair: dict[tuple[int, int], bool] = {}
        for a, b, k in zip(start[order].tolist(), end[order].tolist(), sym[order].tolist()):
            state = best[a]
            if state is None:
                continue
            if self.bpe and state[1] >= 0:
                key = (state[1], k)
                if key not in pair:
                    pair[key] = bool(self.allowed(np.array([state[1]]), np.array([k]))[0])
                if not pair[key]:
                    continue
            far = state[0] + float(self.weight[k])
            if best[b] is None or far < best[b][0]:
                best[b] = (far, k, a)
        at, path = len(word), []
        while at:
            if best[at] is None:
                raise ArithmeticError("the lattice has no path")
            _, k, a = best[at]
            path.append((k, ord(word[a])))
            at = a
        sym, code = np.array([k for k, _ in path[::-1]], dtype=np.int64), np.array([c for _, c in path[::-1]], dtype=np.int64)
        return self._emit(np.zeros(len(sym), dtype=np.int64), sym, code, 1)[0].tolist()

    # -- whole texts --------------------------------------------------------------------

    def learn(self, words) -> None:
        """Ids of different words into the memory."""
        if self.words.full([w for w in words if w not in self.words]):
            self.words.clear()
            self._store = _Store()
        new = self.words.missing(words)
        for w in (w for w in new if len(w) > LONGEST):
            ids = self.shortest(w)
            self.words.update(self._store.add([w], np.array(ids, dtype=np.uint32), np.array([len(ids)])))
        new = [w for w in new if len(w) <= LONGEST]
        new.sort(key=len)
        for lo in range(0, len(new), WORDS):
            self.words.update(self._store.add(new[lo : lo + WORDS], *self.relaxed(new[lo : lo + WORDS])))

    def space_run(self, n: int) -> list[int]:
        """Ids of n space marks: all their pieces tie, so merges run from the left.

        Blocks of the longest piece come first; what is left is merged as a short text.
        """
        blocks = max(0, n // self.longest_run - 1)
        parts = [SPACE] * (n - blocks * self.longest_run)
        while True:
            at = next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.ids), None)
            if at is None:
                return [self.ids[SPACE * self.longest_run]] * blocks + [self.ids[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _odd(self, text: str) -> list[tuple[str, str]]:
        """(run of space marks, word) of a text with runs, by the normaliser."""
        out = (SPACE if self.m.add_dummy_prefix and text else "") + text.replace(" ", SPACE)
        return [x for x in re.findall(f"({SPACE}*)([^{SPACE}]*)", out) if x[0] or x[1]]

    def _odd_ids(self, runs: list[tuple[str, str]]) -> np.ndarray:
        out: list[int] = []
        lone = self.ids.get(SPACE)
        for run, word in runs:
            if not word:
                out += self.space_run(len(run))
                continue
            ids = self._store.one(self.words[SPACE + word if run else word])
            if len(run) > 1:
                if ids[:1] == [lone]:
                    out += self.space_run(len(run))
                    ids = ids[1:]
                else:
                    out += self.space_run(len(run) - 1)
            out += ids
        return np.array(out, dtype=np.uint32)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the words of all of them are composed together."""
        plain = [bool(t) and self.m.add_dummy_prefix and SPACE not in t and "  " not in t and t[0] != " " and t[-1] != " " for t in texts]
        odd = [None if p else self._odd(t) for p, t in zip(plain, texts)]
        split = pc.split_pattern(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = [SPACE + w for w in coded.dictionary.to_pylist()]
        self.learn({*words, *(SPACE + w if run else w for runs in odd if runs for run, w in runs if w)})
        rows = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        ids, sizes = self._store.gather(rows[coded.indices.to_numpy()])
        at = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split) else 0)]
        found = iter([ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist())])
        return [next(found) if p else self._odd_ids(o) for p, o in zip(plain, odd)]

    def encode(self, text: str) -> list[int]:
        return self.batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The inverse machine: pieces to text, byte runs to characters."""
        if self.high.isdisjoint(ids):  # ASCII bytes are characters by themselves
            text = "".join(map(self.shown.__getitem__, ids))
            return text[1:] if self.m.add_dummy_prefix and text[:1] == " " else text
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.m.kinds[i] == BYTE:
                held.append(int(self.m.pieces[i][3:5], 16))
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i is not None and self.m.kinds[i] == NORMAL:
                out.append(self.m.pieces[i])
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.m.add_dummy_prefix and text[:1] == " " else text


class _Store:
    """Sequences of ids in one array, by number."""

    def __init__(self) -> None:
        self.parts, self.ids = [], np.zeros(0, dtype=np.uint32)
        self.ends = np.zeros(1, dtype=np.int64)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> zip:
        """(word, number) of new sequences."""
        first = len(self.ends) - 1
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return zip(words, range(first, first + len(words)))

    def one(self, row: int) -> list[int]:
        return self.ids[self.ends[row] : self.ends[row + 1]].tolist()

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.ends[rows + 1] - self.ends[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[rows] - ends + sizes, sizes)
        return self.ids[at], sizes


def _utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def transducer(path: str) -> Transducer:
    """The worker's machines for a model."""
    return common.held(f"wfst {path}", lambda: Transducer(path))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded_sha1 and round_trip.

    ``round_trip`` says that the ids decode to the text itself, with space marks in it
    read as spaces.
    """

    def make():
        machine = transducer(model_path)

        def fn(texts):
            ids = machine.batch(texts)
            back = [machine.decode(i.tolist()) for i in ids]
            return [
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                pa.array([hashlib.sha1(b.encode()).hexdigest() for b in back], pa.string()),
                pa.array([b == t.replace(SPACE, " ") for b, t in zip(back, texts)], pa.bool_()),
            ]

        return fn

    fields = [T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_sha1", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    return common.map_rows(docs.select(id_col, text_col), 1, fields, make, keep=[id_col])


def with_ids(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of each text appended as ``out_col``, which must not exist."""
    if out_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"a column {out_col} exists")

    def make():
        machine = transducer(model_path)
        return lambda texts: [pa.array([i.tolist() for i in machine.batch(texts)], pa.list_(pa.int32()))]

    return common.map_rows(docs, docs.columns.index(text_col), [T.StructField(out_col, T.ArrayType(T.IntegerType()))], make)

"""Token counts by rank-synchronous array merging.

Pre-tokens (a word with the space mark before it) of a batch of texts lie in one ragged
numpy array. In every round each sequence finds the lowest rank among its adjacent pairs
and merges all its pairs of that rank at once; sequences without a pair left drop out.
Surviving symbols are counted: a piece is one token, an unknown character as many tokens
as it has UTF-8 bytes.

Why merging all pairs of a rank at once is right: merges run in order of rank, leftmost
first. Two pairs of one rank interact only where they overlap (then the leftmost of each
chain wins, every second one) or where the merged symbol could at once take part in a
merge that comes no later. Symbols for which such a merge exists in the vocabulary are
found when the tables are compiled, and for them a round merges the leftmost pair alone.

Splitting at spaces is right because no piece holds a space mark after another character
(checked when compiling); runs of space marks form pieces of the worst score and are
counted from a table of short runs, as the merges would leave them.

Edge cases: null and empty texts have 0 tokens and 0 bytes; repeated rows give repeated
results; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .spm_model import BPE, SPACE, read_model

#: Bytes of pre-tokens whose counts a worker remembers; beyond it the memory starts afresh.
WORD_BYTES = 96 << 20
INF = np.int64(1 << 60)


class MergeTables:
    """Vocabulary compiled to arrays: symbols, pair keys, merged symbols and ranks."""

    def __init__(self, path: str) -> None:
        model = read_model(path)
        model.check_plain()
        if model.model_type != BPE:
            raise ValueError("rank-synchronous merging needs a BPE model")
        normal = model.normal()
        chars = sorted({c for p in normal for c in p})
        texts = sorted(normal, key=lambda p: normal[p])
        sym = {p: i for i, p in enumerate(texts)}
        for c in chars:
            sym.setdefault(c, len(sym))
        self.dummy = model.add_dummy_prefix
        self.n = len(sym)
        self.width = np.int64(self.n + 4)
        order = sorted({model.scores[normal[p]] for p in normal}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        rank = {p: place[model.scores[i]] for p, i in normal.items()}
        self.char_sym = np.empty(0x110000, dtype=np.int32)
        codes = np.arange(0x110000)
        self.char_sym[:] = self.n + np.select([codes < 0x80, codes < 0x800, codes < 0x10000], [0, 1, 2], 3)
        for c in chars:
            self.char_sym[ord(c)] = sym[c]
        self.weight = np.ones(self.n + 4, dtype=np.int64)
        self.weight[self.n :] = (1, 2, 3, 4)
        for c in chars:
            if c not in normal:
                self.weight[sym[c]] = len(c.encode())
        keys, outs, ranks = [], [], []
        self.alone = np.zeros(self.n + 4, dtype=bool)
        for p in texts:
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if a in sym and b in sym:
                    keys.append(sym[a] * int(self.width) + sym[b])
                    outs.append(sym[p])
                    ranks.append(rank[p])
                    for part in (a, b):
                        if len(part) > 1 and rank[p] <= rank.get(part, 1 << 60):
                            self.alone[sym[part]] = True
        by = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.append(np.array(keys, dtype=np.int64)[by], np.int64(1 << 62))
        self.outs = np.append(np.array(outs, dtype=np.int32)[by], 0)
        self.ranks = np.append(np.array(ranks, dtype=np.int64)[by], INF)
        runs = [p for p in normal if p.startswith(SPACE * 2)]
        sizes = sorted(len(p) for p in runs)
        self.run = sizes[-1] if sizes else 1
        worst = max(rank.values())
        if any(SPACE in p.lstrip(SPACE) for p in normal) or any(p.strip(SPACE) or rank[p] != worst for p in runs):
            raise ValueError("this vocabulary's pieces cross spaces")
        allowed = {1, *sizes}
        self.run_counts = [self._merged_run(n, allowed) for n in range(4 * self.run + 1)]
        if any(self.run_counts[n] != self.run_counts[n - self.run] + 1 for n in range(self.run, len(self.run_counts))):
            raise ValueError("runs of space marks don't merge in blocks of the longest piece")
        self.space = sym[SPACE]

    @staticmethod
    def _merged_run(n: int, allowed: set[int]) -> int:
        """Symbols left of n space marks when the leftmost possible pair merges each time."""
        parts = [1] * n
        while True:
            for i in range(len(parts) - 1):
                if parts[i] + parts[i + 1] in allowed:
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                    break
            else:
                return len(parts)

    def spaces(self, n: int) -> int:
        """Tokens of a run of n space marks: blocks of the longest piece, then the rest."""
        if n < len(self.run_counts):
            return self.run_counts[n]
        blocks = (n - 2 * self.run) // self.run
        return blocks + self.run_counts[n - blocks * self.run]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in the pair tables; the last place stands for no pair."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return at

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each non-empty pre-token, and whether its first symbol is a lone space mark."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.char_sym[codes]
        seq = np.repeat(np.arange(len(words)), lens)
        place = np.full(len(sym), len(self.keys) - 1, dtype=np.int64)
        same = np.flatnonzero(seq[1:] == seq[:-1])
        place[same] = self.pairs(sym[same], sym[same + 1])
        counts = np.zeros(len(words), dtype=np.int64)
        lone = np.zeros(len(words), dtype=bool)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            rank = self.ranks[place]
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            done = best == INF
            if done.any():
                gone = seq[starts[done]]
                counts[gone] = np.add.reduceat(self.weight[sym], starts)[done]
                lone[gone] = sym[starts[done]] == self.space
                stay = np.repeat(~done, sizes)
                sym, seq, place, rank = sym[stay], seq[stay], place[stay], rank[stay]
                if not len(sym):
                    break
                best, sizes = best[~done], sizes[~done]
            hit = rank == np.repeat(best, sizes)
            at = np.flatnonzero(hit)
            head = np.r_[True, np.diff(at) != 1] | np.r_[True, seq[at[1:]] != seq[at[:-1]]]
            chain = np.flatnonzero(head)
            step = np.arange(len(at)) - np.repeat(chain, np.diff(np.r_[chain, len(at)]))
            take = step % 2 == 0
            first = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
            take &= first | ~self.alone[self.outs[place[at]]]
            # a leftmost-only merge also holds back what follows it in its sequence
            held = np.repeat(self.alone[self.outs[place[at[first]]]], np.diff(np.r_[np.flatnonzero(first), len(at)]))
            at = at[take & (first | ~held)]
            sym = sym.copy()
            sym[at] = self.outs[place[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            sym, seq, place = sym[keep], seq[keep], place[keep]
            touched = np.unique(np.r_[new, new[new > 0] - 1])
            nxt = np.minimum(touched + 1, len(sym) - 1)
            ok = (touched + 1 < len(sym)) & (seq[nxt] == seq[touched])
            place[touched] = len(self.keys) - 1
            place[touched[ok]] = self.pairs(sym[touched[ok]], sym[nxt[ok]])
        return counts, lone


class Counter:
    """Counts tokens of texts; remembers a bounded number of pre-tokens."""

    def __init__(self, tables: MergeTables) -> None:
        self.t = tables
        self.count = common.Words(WORD_BYTES)
        self.lone: set[str] = set()

    def learn(self, words: set[str]) -> None:
        new = self.count.missing(words)
        if not self.count:
            self.lone.clear()
        for lo in range(0, len(new), 50_000):
            part = new[lo : lo + 50_000]
            counts, lone = self.t.merge([SPACE + w for w in part])
            self.count.update(zip(part, counts.tolist()))
            self.lone.update(w for w, x in zip(part, lone.tolist()) if x)

    def batch(self, texts: list[str]) -> list[int]:
        """Counts of many texts; the pre-tokens of all of them are merged together."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*(words for _, words in split)) - {""})
        return [self.total(first, words) for first, words in split]

    def of(self, text: str) -> int:
        return self.batch([text])[0]

    def split(self, text: str) -> tuple[str, list[str]]:
        if not text:
            return "", []
        text = text.replace(SPACE, " ")
        if self.t.dummy:
            text = " " + text
        words = text.split(" ")
        return words[0], words[1:]

    def total(self, first: str, words: list[str]) -> int:
        head = 0
        if first:
            head = int(self.t.merge([first])[0][0])
        if "" not in words:
            return head + sum(map(self.count.__getitem__, words))
        total, run = head, 0
        spaces = self.t.spaces
        for gap, word in re.findall(r"( +)([^ ]*)", " " + " ".join(words) if words else ""):
            run = len(gap)
            if not word:
                total += spaces(run)
            elif run == 1:
                total += self.count[word]
            elif word in self.lone:
                total += spaces(run) + self.count[word] - 1
            else:
                total += spaces(run - 1) + self.count[word]
        return total


def counter_of(path: str) -> Counter:
    """The process's counter for a model; a reused worker keeps its tables and memory."""
    return common.held(f"token counts {path}", lambda: Counter(MergeTables(path)))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every whole text."""

    def make():
        counter = counter_of(model_path)

        def fn(texts):
            n = counter.batch(texts)
            return [
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_()),
            ]

        return fn

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return common.map_rows(docs.select(id_col, text_col), 1, fields, make, keep=[id_col])

"""Personal data: candidate spans, gradient-boosted trees, calibrated thresholds.

High-recall generators propose overlapping spans. Spans of the base definitions (format plus
checksum) are candidates that are always personal data. The other candidates (addresses written
out with "at" and "dot", phone numbers without a plus, social security numbers, international
bank account numbers, and secrets: long runs of letters and digits) are scored by boosted
regression trees over features of their format and of the words around them; a span is selected
when its calibrated probability reaches its kind's threshold. Overlapping selections are resolved
in favour of the more likely one, base spans first. The trees are trained on the driver, on drawn
sentences and decoys with a fixed seed, and go to the workers with the task; a held-out part of
the same draw sets the thresholds for a precision.

Scanning is linear in the text: local parts are found from the "@" leftwards, digit runs
are only tried at their starts.

Offsets are code points, ends are exclusive.

Edge cases: null and empty texts have no spans (``spans`` is ""); texts are scanned whole;
of candidates of one probability the first counts; repeated rows give repeated rows; an empty
table gives an empty table; other columns are ignored by ``find``, and ``redact`` keeps all
columns, whatever their names, and replaces spans by ``[KIND]``.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Base kinds in their order; kinds that the model adds follow.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("email_text", "phone_local", "ssn", "iban", "secret")
KINDS = BASE_KINDS + MORE_KINDS
ORDER = {k: i for i, k in enumerate(KINDS)}
PRECISION = 0.98
SEED = 20240601

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: High-recall generators of further candidates; none can run over long stretches.
_CANDIDATES = {
    "email_text": re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40} ?[\[({]? ?(?:at|AT) ?[\])}]? ?[A-Za-z0-9-]{2,40} ?[\[({]? ?(?:dot|DOT) ?[\])}]? ?[A-Za-z]{2,12}(?![A-Za-z])"),
    "phone_local": re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,60}[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"),
}
#: What a text must hold for a generator to be worth running; each is part of every match.
_HINT = {"email_text": re.compile("dot|DOT"), "phone_local": re.compile("[0-9]{3}[ .-][0-9]{4}"), "ssn": re.compile("-[0-9]{2}-"), "iban": re.compile("[A-Z]{2}[0-9]{2}"), "secret": re.compile("[A-Za-z0-9+/_-]{16}")}
_CONTEXT = re.compile(r"e-?mail|mail|contact|reach|call|phone|tel|mobile|cell|fax|ssn|social|security|iban|account|bank|transfer|write|token|secret|passw|api.?key|key|auth|bearer|credential", re.I)
_DECOY = re.compile(r"version|order|invoice|part|ticket|isbn|sku|serial|build|model|ref|item|code|price|total|page|commit|sha|hash|digest|checksum|revision|uuid|id|file|path|http|www", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base definitions, by start, then kind."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                end = m.end()
                out.append(("email", start, end))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    out.sort(key=lambda s: (s[1], ORDER[s[0]], s[2]))
    return out


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    left, right = text[max(0, start - 40) : start], text[end : end + 20]
    digits = sum(c.isdigit() for c in s)
    cues = [m.end() for m in _CONTEXT.finditer(left)]
    decoys = [m.end() for m in _DECOY.finditer(left)]
    first3 = s.strip("(")[:3]
    return [
        float(ORDER[kind]),
        float(len(s)),
        digits / len(s),
        float(sum(c in "[](){}" for c in s)),
        float(s.count(" ")),
        float(bool(cues)),
        float(len(left) - cues[-1]) if cues else 99.0,
        float(bool(decoys)),
        float(len(left) - decoys[-1]) if decoys else 99.0,
        float(left[-1:].isalnum()),
        float(right[:1].isalnum()),
        float(kind == "iban" and iban_ok(s)),
        float(int(first3)) if first3.isdigit() else -1.0,
        float(any(w in s.lower().split() for w in ("the", "a", "is", "was", "of", "be", "look", "meet"))),
        float(len(set(s))) / len(s),
        float("$" in left[-3:] or "#" in left[-3:] or "/" in left[-2:]),
        _entropy(s),
        sum(c in "0123456789abcdefABCDEF" for c in s) / len(s),
        float(any(c.islower() for c in s)) + float(any(c.isupper() for c in s)) + float(digits > 0),
        sum(c in "/-_" for c in s) / len(s),
        float(left[-1:] in "\"'" and left != "") + 2.0 * float(any(c in "=:" for c in left[-4:])),
    ]


def _entropy(s: str) -> float:
    """Bits a character, by the characters of the string itself."""
    p = np.array(list(Counter(s[:4096]).values())) / min(len(s), 4096)
    return float(-(p * np.log2(p)).sum())


# -- training ---------------------------------------------------------------------------


def _draw(rng: random.Random) -> tuple[str, str, int, int, int]:
    """A training sentence: kind, text, span, label."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 8)))
    kind, label = rng.choice(MORE_KINDS), rng.random() < 0.5
    if kind == "secret":
        return _draw_secret(rng, label, num, word)
    cues = {"email_text": ("email me:", "write to", "contact", "mail"), "phone_local": ("call", "phone:", "tel", "mobile", "reach me on"), "ssn": ("ssn", "social security number", "SSN:"), "iban": ("iban", "account", "bank transfer to")}
    decoys = ("version", "order", "invoice no", "part", "ticket", "serial", "model", "ref", "item code", "build")
    if kind == "email_text":
        br = rng.choice((("[", "]"), ("(", ")"), (" ", " ")))
        s = f"{word()}.{word()} {br[0]}at{br[1]} {word()} {br[0]}dot{br[1]} {rng.choice(('com', 'org', 'net', 'de'))}" if label else f"{rng.choice(('the', 'look', 'was', word()))} at {rng.choice(('the', 'a', word()))} dot {word()}"
        s = re.sub(" +", " ", s)
    elif kind == "phone_local":
        s = rng.choice(("{0}-{1}-{2}", "({0}) {1}-{2}", "{0} {1} {2}", "{0}.{1}.{2}")).format(num(3), num(3), num(4))
    elif kind == "ssn":
        s = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" if label else f"{rng.choice(('000', '666', '9' + num(2), num(3)))}-{num(2)}-{num(4)}"
    else:
        body = rng.choice(("DE", "FR", "GB", "ES")), num(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body[1] + body[0] + "00")) % 97
        if not label:
            check = (check + rng.randint(1, 90)) % 98
        s = f"{body[0]}{check:02d}{body[1]}"
        if rng.random() < 0.5:
            s = " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    if label:
        left = rng.choice(cues[kind]) if kind != "iban" or rng.random() < 0.7 else word()
    else:
        left = rng.choice(decoys) if rng.random() < 0.5 else word()
    left = f"{word()} {word()} {left} {'' if rng.random() < 0.7 else word() + ' '}"
    return kind, left + s + " " + word(), len(left), len(left) + len(s), int(label)


def _draw_secret(rng: random.Random, label: bool, num, word) -> tuple[str, str, int, int, int]:
    """Keys and passwords as configuration and prose hold them; digests, names and paths as decoys."""
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    if label:
        s = rng.choice((pick(hexa, 32, 64), pick(mixed, 20, 48), f"{word()}_{pick(mixed, 20, 32)}", pick(mixed + "+/", 24, 60) + rng.choice(("", "=", "=="))))
        name = rng.choice(("token", "secret", "password", "api_key", "apikey", "access key", "auth", "client_secret", "passwd", "credentials", "private key", "bearer"))
        left = name + rng.choice((" = ", "=", ": ", ":", " is ", " ")) + rng.choice(('"', "'", "", '"'))
    else:
        s = rng.choice((pick(hexa, 40, 40), pick(hexa, 64, 64), f"{word()}-{word()}-{num(4)}-{word()}", f"{word()}/{word()}/{word()}{num(2)}/{word()}", word() + word() + word() + num(4), num(rng.randint(16, 20)),
                        f"{pick(hexa, 8, 8)}-{pick(hexa, 4, 4)}-{pick(hexa, 4, 4)}-{pick(hexa, 12, 12)}", "_".join(word() for _ in range(4)) + num(1)))
        left = rng.choice(("commit ", "sha256: ", "checksum ", "revision ", "file ", "path ", "uuid ", "www.", "digest: ", "page ", "", word() + " ", word() + " "))
    left = f"{word()} {word()} {left}"
    text = f"{left}{s}{rng.choice((chr(34), '', ' '))} {word()}"
    if rng.random() < 0.15:
        text = text.upper()
    return "secret", text, len(left), len(left) + len(s), int(label)


class Boosted:
    """Gradient boosting with logistic loss and depth-limited regression trees."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2) -> None:
        self.n, self.depth, self.rate, self.trees, self.bias = trees, depth, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.bias = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
        f = np.full(len(y), self.bias)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25))) for j in range(x.shape[1])]
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self.rate * np.array([self._leaf(tree, r) for r in x])
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        value = float(g[rows].sum() / (h[rows].sum() + 1.0))
        best = (1e-6, None, None)
        if depth:
            base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for j, cs in enumerate(cuts):
                for c in cs:
                    left = x[rows, j] <= c
                    if 5 <= left.sum() <= len(rows) - 5:
                        a, b = rows[left], rows[~left]
                        gain = g[a].sum() ** 2 / (h[a].sum() + 1.0) + g[b].sum() ** 2 / (h[b].sum() + 1.0) - base
                        if gain > best[0]:
                            best = (gain, j, float(c))
        if best[1] is None:
            return value
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, cuts, rows[left], depth - 1), self._grow(x, g, h, cuts, rows[~left], depth - 1)

    @staticmethod
    def _leaf(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, row) -> float:
        return self.bias + self.rate * sum(self._leaf(t, row) for t in self.trees)


@lru_cache(1)
def model(n: int = 2000, seed: int = SEED) -> tuple[Boosted, dict[str, float], list[float], list[float]]:
    """The trees, each kind's threshold, and the calibration curve (scores, probabilities)."""
    rng = random.Random(seed)
    rows = [_draw(rng) for _ in range(n)]
    x = np.array([features(k, t, a, b) for k, t, a, b, _ in rows])
    y = np.array([r[4] for r in rows], dtype=float)
    half = n * 2 // 3
    trees = Boosted().fit(x[:half], y[:half])
    s = np.array([trees.score(r) for r in x[half:]])
    order = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []  # isotonic: pool adjacent violators
    for v, t in zip(s[order], y[half:][order]):
        blocks.append([v, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            v, t, k = blocks.pop()
            blocks[-1] = [blocks[-1][0], blocks[-1][1] + t, blocks[-1][2] + k]
    at, prob = [b[0] for b in blocks], [b[1] / b[2] for b in blocks]
    limits = {}
    for kind in MORE_KINDS:
        mine = x[half:, 0] == ORDER[kind]
        p = np.interp(s[mine], at, prob)
        limits[kind] = next((t for t in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95) if y[half:][mine][p >= t].mean() >= PRECISION), 0.99)
    return trees, limits, at, prob


def candidates(text: str, trained=None) -> list[tuple[float, int, str, int]]:
    """(probability, start, kind, end) of what the generators propose beside the base spans."""
    out = []
    for kind, pattern in _CANDIDATES.items():
        if _HINT[kind].search(text):
            for m in pattern.finditer(text):
                trees, _, at, prob = trained or model()
                out.append((float(np.interp(trees.score(features(kind, text, m.start(), m.end())), at, prob)), m.start(), kind, m.end()))
    return out


def added_spans(text: str, base: list[tuple[str, int, int]], trained=None) -> list[tuple[str, int, int]]:
    """Selected candidates that overlap no base span and no more likely candidate."""
    found = candidates(text, trained)
    limits = (trained or model())[1] if found else {}
    starts: list[int] = []  # disjoint taken stretches, in order
    ends: list[int] = []
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out: list[tuple[str, int, int]] = []
    for _, a, kind, b in sorted((-p, a, kind, b) for p, a, kind, b in found if p >= limits[kind]):
        i = bisect_right(starts, a)
        if (i == 0 or ends[i - 1] <= a) and (i == len(starts) or starts[i] >= b):
            starts.insert(i, a)
            ends.insert(i, b)
            out.append((kind, a, b))
    return out


def spans(text: str, trained=None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, each by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, trained), key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _join(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of the base kinds, the base spans' SHA-256, and all spans."""
    trained = model()

    def make():
        def fn(texts):
            both = [spans(t, trained) for t in texts]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in both], pa.int64()) for kind in BASE_KINDS]
            sha = [hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in both]
            return counts + [pa.array(sha, pa.string()), pa.array([_join(x) for _, x in both], pa.string())]

        return fn

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return common.map_rows(docs.select(id_col, text_col), 1, fields, make, keep=[id_col])


def redacted(text: str, trained=None) -> str:
    out, at = [], 0
    for kind, a, b in spans(text, trained)[1]:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind; null texts stay null, columns stay."""
    index, schema, trained = docs.columns.index(text_col), docs.schema, model()

    def run(batches):
        for batch in batches:
            for lo, hi, texts in common.sub_batches(batch, index):
                part = batch.slice(lo, hi - lo)
                nulls = part.column(index).is_null().to_pylist()
                new = pa.array([None if none else redacted(t, trained) for t, none in zip(texts, nulls)], pa.string())
                arrays = [new if i == index else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)

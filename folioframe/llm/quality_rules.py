"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once for each document; the ledger stores the measurements and
one integer whose bit r says that rule r failed. Policies are versioned sets of rules and
are applied to the stored bits alone, so a changed policy or an ablation (what would be
kept without rule r) needs no second look at the texts: both are bitwise operations and
sums over the ledger.

Words are runs of characters other than space and the characters 9 to 13.

Edge cases: a null text has no words and fails the length rule; empty texts likewise;
texts of any length are measured whole; repeated rows give repeated rows; an empty table
gives an empty ledger; other columns go through ``apply_policy`` untouched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SYMBOLS = "#*$%&|<>"
#: Thresholds of the rules, in the order of the bits.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 6
MIN_DUP_LINES = 3
MAX_DUP_LINE_PERCENT = 30
MAX_SHOUT_PERCENT = 40
MAX_MEAN_WORD_CHARS = 30
RULES = ("short", "repeats", "symbols", "dup_lines", "shouting", "long_words")
#: version: names of the rules whose failure rejects a document.
POLICIES = {
    "base": ("short", "repeats"),
    "v1": ("short", "repeats", "symbols", "dup_lines", "shouting", "long_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shout_words")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=n)
    k = len(codes)
    pair = ids[:-2] * k + ids[1:-1]
    if k > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, counts = np.unique(pair * k + ids[2:], return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def words_of(text: str) -> list[str]:
    """Words between spaces and the characters 9 to 13; other white space belongs to words."""
    for c in "\t\n\v\f\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def measure(text: str) -> tuple[int, ...]:
    words = words_of(text)
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\v\f"):
            lines += 1
            if line in seen:
                dups += 1
            seen.add(line)
    shout = sum(1 for w in words if len(w) > 1 and w.isupper())
    return len(words), chars, symbols, dups, repeated_words(words), lines, shout


def failure_bits(prefix: str = "") -> Column:
    """The bitmask of failed rules, from the measurements, whose columns' names begin with ``prefix``."""
    c = lambda name: F.col(prefix + name)
    failed = {
        "short": c("n_words") < MIN_WORDS,
        "repeats": c("n_repeat_words") * 100 > c("n_words") * MAX_REPEAT_PERCENT,
        "symbols": c("n_symbols") * 100 > c("word_chars") * MAX_SYMBOL_PERCENT,
        "dup_lines": (c("n_dup_lines") >= MIN_DUP_LINES) & (c("n_dup_lines") * 100 > c("n_lines") * MAX_DUP_LINE_PERCENT),
        "shouting": c("n_shout_words") * 100 > c("n_words") * MAX_SHOUT_PERCENT,
        "long_words": c("word_chars") > c("n_words") * MAX_MEAN_WORD_CHARS,
    }
    bits = [F.when(failed[name], F.lit(1 << r)).otherwise(F.lit(0)) for r, name in enumerate(RULES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def policy_mask(version: str) -> int:
    return sum(1 << RULES.index(name) for name in POLICIES[version])


def _measured(docs: DataFrame, text_col: str, keep: list[str], prefix: str = "") -> DataFrame:
    """``docs`` with the measurements of each text appended."""

    def make():
        return lambda texts: [pa.array(list(r), pa.int64()) for r in zip(*(measure(t) for t in texts))]

    fields = [T.StructField(prefix + m, T.LongType()) for m in MEASURES]
    return common.map_rows(docs, docs.columns.index(text_col), fields, make, keep=keep)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements and ``failed_bits`` of every document."""
    return _measured(docs.select(id_col, text_col), text_col, [id_col]).withColumn("failed_bits", failure_bits())


def kept(version: str, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy_mask(version))) == 0


def ablations(led: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents it fails, fails alone, and kept without it."""
    mask = policy_mask(version)
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask))
    sums = [F.count(F.lit(1)).alias("n_docs"), F.sum((bits == 0).cast("long")).alias("n_kept")]
    for name in POLICIES[version]:
        bit = 1 << RULES.index(name)
        sums += [
            F.sum((bits.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"fails_{name}"),
            F.sum((bits == bit).cast("long")).alias(f"alone_{name}"),
            F.sum((bits.bitwiseAND(F.lit(~bit)) == 0).cast("long")).alias(f"without_{name}"),
        ]
    wide = led.agg(*sums)
    rows = [
        F.struct(F.lit(name).alias("rule"), *(F.coalesce(F.col(f"{k}_{name}"), F.lit(0)).alias(v) for k, v in (("fails", "n_failed"), ("alone", "n_failed_alone"), ("without", "n_kept_without"))))
        for name in POLICIES[version]
    ]
    return wide.select("n_docs", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.explode(F.array(*rows)).alias("r")).select("r.*", "n_docs", "n_kept")


def apply_policy(docs: DataFrame, version: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose ledger bits the policy accepts, all columns unchanged."""
    prefix = "_rule_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    rows = _measured(docs, text_col, docs.columns, prefix).withColumn(f"{prefix}bits", failure_bits(prefix))
    return rows.where(kept(version, f"{prefix}bits")).select(*docs.columns)

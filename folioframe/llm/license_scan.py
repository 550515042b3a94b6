"""Licence scans: a trained paragraph classifier in DataFrame operations.

A paragraph is a line of a text, or the place where two or three lines meet, as notices are
wrapped: the words of the first line's last PART characters, those of the last line's first PART
characters, and between them a whole line of PART characters at most. It is a sparse vector of its distinct word n-grams (one to three words, ASCII
lower-cased, runs of letters, digits and ``+ . -``). Multinomial logistic regression gives each
licence family a score; the weights are trained here on drawn variants of the families' phrases
and on prose, and most n-grams weigh nothing, so the model is a table of a few thousand rows at
most (MAX_WEIGHTS). An "unknown" class takes paragraphs that look like no family; the
probability that a family needs is set on drawn paragraphs held out of training and on all real
ones: every different candidate paragraph of the table that holds nearly all or few of a
template's n-grams, counted by the executors at each probability of STEPS. A prediction is confirmed by comparison with the family's
templates: the share of a template's n-grams that the paragraph holds must reach TEMPLATE_SHARE.
Of found paragraphs that overlap, the one of fewest lines counts, then the first.

The main path has only DataFrame functions: lines and n-grams are array expressions, the
weights join as a broadcast table whose size is bounded by the trained vocabulary. The texts are
read once: candidate paragraphs are staged with a number for each row, so the numbers stay as they
are whatever is joined to them; a row's candidates come from that row alone, so no group is larger
than a document.

Lines without any trigger word are "unknown" without n-grams. The triggers are derived from
the templates: without the trigger words of a template, fewer than TEMPLATE_SHARE of its
n-grams are left, so no paragraph without a trigger can reach that share of any template.

Edge cases: null and empty texts have no paragraph and no licence; texts are scanned
whole; repeated rows give repeated rows (rows are told apart by a staged number, not by
their id); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_WEIGHTS = 5000
#: Lines of a paragraph at most, and characters that the lines of a longer one than a line give.
LINES = 3
PART = 240
TEMPLATE_SHARE = 0.6
PRECISION = 0.99
#: Probabilities that may become the threshold; STRICT is taken if none is precise enough.
STEPS = (0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)
STRICT = 0.95
SEED = 5
#: Families and phrases of public licences; ``{v}`` is a version.
TEMPLATES = {
    "apache": ("licensed under the apache license, version {v}", "apache license version {v} january 2004", "spdx-license-identifier: apache-{v}"),
    "mit": ("released under the mit license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "spdx-license-identifier: mit", "licensed under the mit license"),
    "gpl": ("this work is licensed under the gnu general public license, version {v}", "gnu general public license as published by the free software foundation", "spdx-license-identifier: gpl-{v}"),
    "lgpl": ("licensed under the gnu lesser general public license, version {v}", "spdx-license-identifier: lgpl-{v}"),
    "bsd": ("redistribution and use in source and binary forms, with or without modification, are permitted", "licensed under the bsd license", "spdx-license-identifier: bsd-3-clause"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license, v. {v}", "spdx-license-identifier: mpl-{v}"),
    "cc-by": ("licensed under cc by {v}", "this work is licensed under a creative commons attribution {v} international license"),
    "cc-by-nc": ("licensed under cc by-nc {v}", "this work is licensed under a creative commons attribution-noncommercial {v} international license"),
    "cc-by-sa": ("licensed under cc by-sa {v}", "this work is licensed under a creative commons attribution-sharealike {v} international license"),
    "proprietary": ("all rights reserved", "all rights reserved. no part of this publication may be reproduced without permission",),
}
VERSIONS = ("1.0", "2.0", "2.1", "3", "3.0", "4.0", "2")
#: Words taken as triggers only when a template's other words don't suffice.
COMMON = frozenset("the a of to in is and on for with by from that this be are as or not no any all under may use without mit".split())
FAMILIES = (*TEMPLATES, "unknown")
_PROSE = (
    "the a of to in and on for with by from that this is was be are or not under use work works source code form free any person part public general terms version software copy "
    "license plate number fishing license fee driver license office permission to speak granted by the teacher rights of way reserved seats copyright law lecture"
).split()


def words_py(line: str) -> list[str]:
    return [w for w in (x.strip(".-") for x in re.findall(r"[a-z0-9+.\-]+", line.lower())) if w]


def grams_py(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@lru_cache(1)
def triggers() -> tuple[str, ...]:
    """Words of which a line holds one at least if it reaches TEMPLATE_SHARE of any template."""
    out: set[str] = set()
    for t in (t for ts in TEMPLATES.values() for t in ts):
        ws = words_py(t.replace("{v}", ""))
        all_grams = grams_py(ws)

        def enough(chosen) -> bool:
            left = sum(not chosen & set(g.split(" ")) for g in all_grams)
            return left / len(all_grams) < TEMPLATE_SHARE

        chosen = out & set(ws)
        for w in sorted(set(ws) - chosen, key=lambda w: (w in COMMON, -len(w), w)):
            if enough(chosen):
                break
            chosen.add(w)
        for w in sorted(chosen - out):
            if enough(chosen - {w}):
                chosen.discard(w)
        out |= chosen
    return tuple(sorted(out))


def may_hold(text: Column) -> Column:
    """Whether a trigger stands as a word in a text; a word's borders are no wider than in ``words``."""
    found = "|".join(re.escape(t) for t in triggers())
    return F.lower(text).rlike(f"(?<![a-z0-9+])(?:{found})(?![a-z0-9+])")


def may_contain(text: Column) -> Column:
    """Whether a trigger's characters stand anywhere in a text: cheaper, and true wherever ``may_hold`` is."""
    return reduce(lambda a, b: a | b, [F.lower(text).contains(t) for t in triggers()])


def _draw(rng: random.Random) -> tuple[str, str]:
    """A paragraph and its family."""
    noise = lambda n: " ".join(rng.choice(_PROSE) for _ in range(n))
    if rng.random() < 0.4:
        return noise(rng.randint(3, 30)), "unknown"
    family = rng.choice(tuple(TEMPLATES))
    line = rng.choice(TEMPLATES[family]).format(v=rng.choice(VERSIONS))
    if rng.random() < 0.5:
        line = f"{noise(rng.randint(1, 8))} {line} {noise(rng.randint(0, 8))}"
    return line, family


@lru_cache(1)
def train(n: int = 3000, seed: int = SEED, epochs: int = 150) -> tuple[dict[str, list[float]], list[float], list[tuple[float, bool]]]:
    """n-gram weights of each family, biases, and (probability, is right) of drawn paragraphs held out."""
    rng = random.Random(seed)
    rows = [_draw(rng) for _ in range(n)]
    half = n * 2 // 3
    counts: dict[str, int] = {}
    for line, _ in rows[:half]:
        for g in grams_py(words_py(line)):
            counts[g] = counts.get(g, 0) + 1
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, c in counts.items() if c >= 8))}

    def matrix(part):
        x = np.zeros((len(part), len(vocabulary)))
        for i, (line, _) in enumerate(part):
            for g in grams_py(words_py(line)):
                if g in vocabulary:
                    x[i, vocabulary[g]] = 1.0
        return x, np.array([FAMILIES.index(f) for _, f in part])

    x, y = matrix(rows[:half])
    w, b = np.zeros((x.shape[1], len(FAMILIES))), np.zeros(len(FAMILIES))
    onehot = np.eye(len(FAMILIES))[y]
    for _ in range(epochs):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - onehot) / len(x)
        w -= 4.0 * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.0015, 0)  # sparse: small weights vanish
        b -= 4.0 * g.sum(0)
    x, y = matrix(rows[half:])
    z = x @ w + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    top, sure = p[:, :-1].argmax(1), p[:, :-1].max(1)
    held = list(zip(sure.tolist(), (top == y).tolist()))
    weights = {g: [round(float(v), 6) for v in w[i]] for g, i in vocabulary.items() if np.abs(w[i]).max() > 0}
    if len(weights) > MAX_WEIGHTS:
        raise ValueError("the trained vocabulary is larger than the broadcast bound")
    return weights, [round(float(v), 6) for v in b], held


def threshold(counts: list[tuple[int, int]]) -> float:
    """The least of STEPS from which PRECISION of the predictions of held-out and counted paragraphs are right.

    ``counts``: the table's paragraphs from each step on, and how many of them are right.
    """
    held = train()[2]
    for t, (n, n_right) in zip(STEPS, counts, strict=True):
        drawn = [ok for p, ok in held if p >= t]
        n, n_right = n + len(drawn), n_right + sum(drawn)
        if n and n_right >= PRECISION * n:
            return t
    return STRICT


def words(line: Column) -> Column:
    """The line's words, as ``words_py`` finds them."""
    found = F.regexp_extract_all(F.lower(line), F.lit(r"[a-z0-9+.\-]+"), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", "")), lambda w: w != "")


def grams(ws: Column) -> Column:
    """Distinct n-grams of one to three words."""
    n = F.size(ws)

    def of(k: int) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, k), " "))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def tail_py(line: str) -> str:
    return line if len(line) <= PART else re.sub("^[^ ]* ?", "", line[-PART:])


def head_py(line: str) -> str:
    return line if len(line) <= PART else re.sub(" ?[^ ]*$", "", line[:PART])


def _tail(line: Column) -> Column:
    """The words of a line's last PART characters, as ``tail_py`` finds them."""
    return F.when(F.char_length(line) <= PART, line).otherwise(F.regexp_replace(F.right(line, F.lit(PART)), "^[^ ]* ?", ""))


def _head(line: Column) -> Column:
    return F.when(F.char_length(line) <= PART, line).otherwise(F.regexp_replace(F.left(line, F.lit(PART)), " ?[^ ]*$", ""))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, doc_id and ``found`` (first line, lines, text) of every row: paragraphs with a trigger word."""
    lines = F.split("text", "\n", -1)
    hit = F.filter(F.transform("lines", lambda x, i: F.when(may_contain(x) & may_hold(x), i)), lambda i: i.isNotNull())
    n = F.size("lines")
    at = lambda i: F.element_at("lines", i + 1)

    def of(k: int) -> Column:
        """Paragraphs of k lines, one of which has a trigger."""
        if k == 1:
            return F.transform("hit", lambda i: F.struct(i.alias("line"), F.lit(1).alias("lines"), at(i).alias("paragraph")))
        first = F.array_distinct(F.flatten(F.transform("hit", lambda t: F.sequence(t - (k - 1), t))))
        first = F.filter(first, lambda i: (i >= 0) & (i + k <= n))
        if k == 3:
            first = F.filter(first, lambda i: F.char_length(at(i + 1)) <= PART)
        text = lambda i: F.concat_ws(" ", _tail(at(i)), *[at(i + 1)] * (k == 3), _head(at(i + (k - 1))))
        made = F.transform(first, lambda i: F.struct(i.alias("line"), F.lit(k).alias("lines"), text(i).alias("paragraph")))
        return F.filter(made, lambda x: may_hold(x["paragraph"]))

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("lines", F.when(may_contain(F.col("text")), lines).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("hit", hit).select("_row", "doc_id", F.concat(*[of(k) for k in range(1, LINES + 1)]).alias("found"))
    return common.staged(rows, "licence-paragraphs")


def scored(found: DataFrame) -> DataFrame:
    """_row, line, lines, paragraph, family, probability and template_share of candidate paragraphs."""
    spark = found.sparkSession
    weights, bias, _ = train()
    table = spark.createDataFrame([(g, v) for g, v in weights.items()], "gram string, weights array<double>")
    templates = [(f"{f}|{i}", f, g, float(len(gs))) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for gs in [grams_py(words_py(t.replace("{v}", "")))] for g in sorted(gs)]
    shape = spark.createDataFrame(templates, "template string, t_family string, gram string, size double").groupBy("gram").agg(F.collect_list(F.struct("template", "t_family", "size")).alias("in_templates"))
    # Candidates are few bytes beside the texts but much work: dealt out anew, not read as few files.
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    each = found.where(F.size("found") > 0).repartition(spread).select("_row", F.explode("found").alias("f")).select("_row", "f.line", "f.lines", "f.paragraph")
    rows = each.select("_row", "line", "lines", "paragraph", F.explode(grams(words(F.col("paragraph")))).alias("gram"))
    keys = ("_row", "line", "lines")
    sums = [F.coalesce(F.sum(F.col("weights")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(len(FAMILIES))]
    joined = rows.join(F.broadcast(table.join(shape, "gram", "full")), "gram")
    out = joined.groupBy(*keys).agg(F.first("paragraph").alias("paragraph"), F.flatten(F.collect_list("in_templates")).alias("t"), *sums)
    logits = [F.round(F.col(f"s{i}") + F.lit(b), 9) for i, b in enumerate(bias)]
    top = F.greatest(*logits)
    out = out.withColumn("z", F.array(*[F.exp(v - top) for v in logits]))
    best = F.array_max(F.slice("z", 1, len(FAMILIES) - 1))
    out = out.withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position(F.slice("z", 1, len(FAMILIES) - 1), best).cast("int")))
    out = out.withColumn("probability", F.round(best / F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 6))
    of_family = F.filter("t", lambda x: x["t_family"] == F.col("family"))
    share = F.transform(F.array_distinct(of_family), lambda d: F.size(F.filter(of_family, lambda x: x["template"] == d["template"])) / d["size"])
    return out.select(*keys, "paragraph", "family", "probability", F.round(F.coalesce(F.array_max(share), F.lit(0.0)), 6).alias("template_share"))


def calibration(rows: DataFrame) -> list[tuple[int, int]]:
    """For each of STEPS, the different scored paragraphs from it on, and how many of them are right.

    Those that hold most of a template of the family are right, those that hold little are wrong;
    the ones between say nothing. Every paragraph of the table is counted, copies once.
    """
    clear = rows.where("template_share >= 0.9 or template_share < 0.3")
    clear = clear.select(F.sha2("paragraph", 256).alias("h"), "probability", (F.col("template_share") >= 0.9).alias("right")).dropDuplicates(["h"])
    counts = [x for t in STEPS for above in [F.col("probability") >= t] for x in (F.count_if(above), F.count_if(above & F.col("right")))]
    got = clear.agg(*counts).first()
    return list(zip(got[::2], got[1::2]))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line, lines, paragraph, family, probability, template_share of each licence paragraph."""
    found = candidates(docs, id_col, text_col)
    return _accepted(found).join(found.select("_row", "doc_id"), "_row").select("doc_id", "p.line", "p.lines", "p.paragraph", "p.family", "p.probability", "p.template_share")


def _accepted(found: DataFrame) -> DataFrame:
    """_row and ``p``: the accepted paragraphs that overlap no better one."""
    rows = common.staged(scored(found), "licence-scores")
    least = threshold(calibration(rows))
    rows = rows.where((F.col("probability") >= least) & (F.col("template_share") >= TEMPLATE_SHARE))
    p = F.struct("lines", "line", "paragraph", "family", "probability", "template_share")
    per = rows.groupBy("_row").agg(F.sort_array(F.collect_list(p)).alias("p"))  # of one document
    apart = lambda a, x: ~F.exists(a, lambda y: (y["line"] < x["line"] + x["lines"]) & (x["line"] < y["line"] + y["lines"]))
    kept = F.aggregate("p", F.slice("p", 1, 0), lambda a, x: F.when(apart(a, x), F.concat(a, F.array(x))).otherwise(a))
    return per.select("_row", F.explode(kept).alias("p"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_licenses and families (sorted, comma-joined; "" without any) of every row."""
    found = candidates(docs, id_col, text_col)
    by = _accepted(found).groupBy("_row").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("p.family")), ",").alias("f"))
    return found.select("_row", "doc_id").join(by, "_row", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_licenses"), F.coalesce("f", F.lit("")).alias("families"))

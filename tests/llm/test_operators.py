"""The training-data operators against libraries, brute force, SQL, and odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe.llm.spm_model import SpmModel
from folioframe.llm import license_scan, media_fingerprint, near_dedup, packing, pii, quality_classifier, quality_rules, queries, token_counts, warc, wfst

SF = "/root/testdata/sf0.001"
PIECE, WORD = queries.tokenizer_path("piece_bpe_32k.model"), queries.tokenizer_path("word_bpe_49k.json")
ODD = "ab the  ▁\n\té漢字😀<s>thinning.,!!  aaaa--==  @1.2+-()"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(1, "a b c d e f", None, "x", 0), (1, "a b c d e f", None, "x", 0), (2, None, "en", None, 1), (3, "", "en", "x", 2), (None, "a b c d e f", "en", "y", 3), (4, "word " * 60_000, "en", "x", 4), (5, " \n\t ", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int").withColumns({"score": F.lit(1), "kept": F.lit("q"), "n": F.lit(2), "cls": F.lit("c")})


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_token_counts(spark, docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, PIECE).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in texts}
    c = token_counts.counter_of(PIECE)
    more = [*fuzz(3000), " " * 100, "a" * 5000, "=-" * 900, " " * 35 + "x"]
    assert c.batch(more) == [len(x) for x in sp.encode(more)]


def test_wfst(spark, texts):
    """The library's ids and texts; many words at once and one by one; memories that start afresh."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    t = wfst.Transducer(PIECE)
    more = [x for _, x in texts] + [*fuzz(1500), " " * 100, "a" * 3000, "the" * 700, "-" * 200, "▁▁the ▁", " x", ""]
    want = sp.encode(more)
    assert [x.tolist() for x in t.batch(more)] == want
    assert [t.decode(x) for x in want[:300]] == [sp.decode(x) for x in want[:300]]
    t.words.limit, t.pairs = 0, wfst.Table(1 << 21)
    assert [t.encode(x) for x in more[-400:]] == want[-400:]
    words = [w for x in more[:3] for w in x.split() if w] + ["漢a", "standing", "a😀b", "x" * 90]
    ids, sizes = t.relaxed(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [t.shortest(w) for w in words]
    df = spark.createDataFrame([(x,) for x in more[:5]], "text string")
    assert [r["piece_ids"] for r in wfst.with_ids(df.coalesce(1), PIECE).collect()] == want[:5]
    with pytest.raises(ValueError):
        wfst.with_ids(df.withColumn("Piece_Ids", F.lit(1)), PIECE)


def segmentations(t, word):
    """Every way to cut a word into symbols: (symbol, characters) each."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        k = t.sym.get(word[:n], t.n if n == 1 else None)
        if k is not None:
            for rest in segmentations(t, word[n:]):
                yield [(k, word[:n]), *rest]


def test_shortest_path_is_the_least_of_all():
    """Against all segmentations: merge models by literal merging of neighbours, unigram models by their weights."""
    t = wfst.Transducer(PIECE)
    assert all(t._merged(p)[0] == [p] for p in list(t.sym)[::40] if t.left[t.sym[p]] >= 0)
    for w in ("▁standing", "▁the,", "漢ab", "▁----", "▁/***/", "▁aaaaaa", "▁......", "in😀g"):
        fits = [x for x in segmentations(t, w) if all(t._merged(a)[0] == [a] for _, a in x) and all(t._merged(a + b)[0] == [a, b] for (_, a), (_, b) in zip(x, x[1:]))]
        assert len(fits) == 1
        assert t.shortest(w) == [i for k, c in fits[0] for i in ([int(t.id_of[k])] if t.id_of[k] >= 0 else t.bytes[list(c.encode())].tolist())]
    rng = random.Random(5)
    m = SpmModel(model_type=1, remove_extra_whitespaces=False)
    for p in ["▁", *"abc", "ab", "bc", "▁a", "abc", "cab", "▁ab", "aa", "ca", *(f"<0x{b:02X}>" for b in range(256))]:
        m.pieces.append(p)
        m.scores.append(-rng.random() * 5)
        m.kinds.append(6 if p[0] == "<" else 1)
    u = wfst.Transducer(m)
    for w in ["▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(150)] + ["▁aéb", "漢"]:
        best = min(sum(float(u.weight[k]) for k, _ in x) for x in segmentations(u, w))
        for ids in (u.shortest(w), u.relaxed([w])[0].tolist()):  # of paths of one weight any will do
            got = sum(-m.scores[i] for i in ids if m.kinds[i] == 1) + sum(float(u.weight[u.n]) for c in w if c not in u.sym)
            assert abs(got - best) < 1e-9 and u.decode(ids) == w[1:] if w[0] == "▁" else u.decode(ids) == w
    assert u.decode(u.encode("ab cab")) == "ab cab"


def brute_components(rows, threshold):
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^ \t-\r]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
        sets[i] = frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if inter and 100 * inter >= threshold * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_dedup(spark, docs, texts):
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(120)]
    rows = list(texts[:80])
    for k in range(60):  # variants with few or many edits: components only some of them reach
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((10_000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(rows, 85)


def test_near_pairs_at_the_threshold_are_found(spark):
    """Recall of planted pairs of similarity 0.85 to 0.90 (and 0.80 to 0.85), of several lengths."""
    rng = random.Random(9)
    for threshold in (85, 80):
        rows, wanted = [], 0
        while wanted < 250:
            n = rng.choice((60, 150, 400))
            words = [f"w{rng.randrange(10**7)}" for _ in range(n)]
            other = list(words)
            for k in rng.sample(range(0, n - 5, 6), rng.randint(1, max(1, n // 40))):
                other[k] = f"x{rng.randrange(10**7)}"
            a, b = (set(zip(*[w[k:] for k in range(5)])) for w in (words, other))
            j = 100 * len(a & b) / len(a | b)
            if threshold <= j < threshold + 5:
                rows += [(2 * wanted, " ".join(words)), (2 * wanted + 1, " ".join(other))]
                wanted += 1
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).where("kept").count()
        assert got == wanted


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = h[:2400], h[300:]
    r = near_dedup.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    j = near_dedup.estimate(np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]), np.array([2400.0]), np.array([2700.0]))[0]
    assert abs(j - 2100 / 3000) < 0.12


def brute_pii(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.ORDER[s[0]]))


def test_pii(spark, docs, texts):
    rng = random.Random(8)
    more = ["".join(rng.choice("ab@@.1234567890 -+()..é%") for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    assert all(pii.base_spans(t) == brute_pii(t) for t in [*more, *(t for _, t in texts)])
    rows = pii.find(docs).collect()
    by = dict(texts)
    for r in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(by[r["doc_id"]]))
        kept = ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in pii.BASE_KINDS)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and kept == base


def test_pii_planted_secrets(spark):
    """Every planted key is found, documents without personal data are left alone, and hand-written text too."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    trained, n = pii.model(), 0
    for r in rows:
        text = r["text"] or ""
        keys = {m.start(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text)}
        base, found = pii.spans(text, trained)
        assert base == brute_pii(text) and keys <= {a for k, a, _ in found if k == "secret"}
        n += len(keys)
        if not keys and not re.search(r"[0-9]{16}", text):
            assert found == base
    assert n > 5
    for text, want in {
        "password: hunter2hunter2hunter2A": "password: [SECRET]",
        'AUTH_TOKEN="Zm9vYmFyYmF6cXV4MTIzNDU2"': 'AUTH_TOKEN="[SECRET]"',
        "fixed in commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 today": "fixed in commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 today",
        "see www.example.com/a-very-long-path-with-2024-posts/today": "see www.example.com/a-very-long-path-with-2024-posts/today",
        "at root@host.example.org or 10.0.0.7": "at [EMAIL] or [IP]",
    }.items():
        assert pii.redacted(text, trained) == want


def test_pii_overlaps():
    """A taken stretch keeps every later candidate off, whatever its kind; base spans may overlap each other."""
    trained = pii.model()
    text = " ".join(["call 555-123-4567 or mail jane.roe [at] mail [dot] org, secret = 'a8f5f167f44f4964e6c998dee827110c', +1 555 010 9999"] * 40)
    base, found = pii.spans(text, trained)
    more = [s for s in found if s not in base]
    assert more and all(b <= c or d <= a for i, (_, a, b) in enumerate(more) for _, c, d in [*more[:i], *base])
    assert pii.spans("x" * 3_000_000, trained) == ([], [])


def test_pii_added_spans_and_redaction():
    assert pii.redacted("write to jane.roe [at] mail [dot] org now") == "write to [EMAIL_TEXT] now"
    assert "[IBAN]" in pii.redacted("bank transfer to DE89370400440532013000 please")
    assert pii.redacted("call +1 (555) 010-9999 or a@b.co") == "call [PHONE] or [EMAIL]"
    for clean in ("version 123-45-6789", "they met at the dot line", "order 555-010-9999 items", "look at a dot map"):
        assert pii.redacted(clean) == clean


def test_quality_classifier(spark, docs):
    big = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    held = quality_classifier.score(d, lab).join(lab, "doc_id").where("held_out")
    n, right = held.count(), held.where("predicted = quality").count()
    assert n > 50 and right / n > 0.95


def test_classifier_equals_a_plain_fit(spark, monkeypatch):
    """Features, ridge weights and isotonic calibration against numpy over all rows at once, in one level or many."""
    q = quality_classifier
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    label = [(r["doc_id"], r["quality"]) for r in lab.collect() if r["quality"] is not None and r["doc_id"] in text]
    part = lambda i: zlib.crc32(str(i).encode()) % 3
    x = {i: np.array(q.statistics(t)) for i, t in text.items()}
    known = [(x[i], y, part(i)) for i, y in label if part(i) != 1]
    all_x = np.array([a for a, _, _ in known])
    mean, scale = all_x.mean(0), np.maximum(all_x.std(0), 1e-3)
    w, b = q._fourier()
    z = lambda a: np.hstack([np.ones((len(a), 1)), np.sqrt(2 / q.N_FEATURES) * np.cos(np.clip((a - mean) / scale, -6, 6) @ w + b)])
    fit = [(a, y) for a, y, p in known if p == 0]
    zz, yy = z(np.array([a for a, _ in fit])), np.array([y for _, y in fit], dtype=float)
    weights = np.linalg.solve(zz.T @ zz + q.RIDGE * np.eye(zz.shape[1]), zz.T @ yy)
    held = [(a, y) for a, y, p in known if p == 2]
    raw = z(np.array([a for a, _ in held])) @ weights
    place = np.clip((raw - q.LOW) / (q.HIGH - q.LOW) * q.BINS, 0, q.BINS - 1).astype(int)
    pools = []  # of neighbouring bins, until the means rise
    for k in sorted(set(place)):
        pools.append([[k], [y for (_, y), p in zip(held, place) if p == k]])
        while len(pools) > 1 and np.mean(pools[-2][1]) >= np.mean(pools[-1][1]):
            bins, ys = pools.pop()
            pools[-1] = [pools[-1][0] + bins, pools[-1][1] + ys]
    at = [q.LOW + (k + 0.5) * (q.HIGH - q.LOW) / q.BINS for bins, _ in pools for k in sorted({bins[0], bins[-1]})]
    level = [(sum(ys) + 0.5) / (len(ys) + 1) for bins, ys in pools for _ in sorted({bins[0], bins[-1]})]
    want = dict(zip(x, np.interp(z(np.array(list(x.values()))) @ weights, at, np.maximum.accumulate(level))))
    for fan in (16, 2):
        monkeypatch.setattr(q, "FAN_IN", fan)
        got = {r["doc_id"]: r["score"] for r in q.score(d.repartition(7), lab).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_classifier_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_classifier.score(odd, none).collect()
    assert len(rows) == 7 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    assert quality_classifier.filter_documents(odd, none).columns == odd.columns


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in texts}
    rows = packing.pack(docs, WORD).collect()
    by, seqs = collections.defaultdict(dict), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["doc_tokens"] == len(want[r["doc_id"]])
        by[r["doc_id"]][r["start"]] = ids
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in by.items()} == want
    for pieces in seqs.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_word_encoder():
    """Nulls, empty and long texts, special strings, contractions, other scripts and spaces."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    texts = [None, "", " ", "don't I'LL 'southern x's y'tt O'Reilly's''ss", "<|endoftext|> a<|startoftext|>b <|EndOfText|>", "\u00c9 E\u0301 \xdf\u1e9e\xd8 \u0130stanbul \u03a3\u0391\u03a3", ODD,
             "a\x1cb\x0bc\x0cd\xa0e\u3000f\u200b \x00 a\x00 \x85q", "123 a1b2-3_4 \xd7\xf7 \xb5\xaa \u00b2\u2167", "x" * 9000 + "!?" * 900, *fuzz(40, 3)]
    want = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for x in texts]
    enc = packing.WordEncoder(WORD)

    def batch(rows):
        ids, sizes = enc.batch(rows, 1)
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []

    assert enc.plain and batch(pa.array(texts, pa.string())) == want
    assert batch(pa.array([], pa.string())) == []
    assert batch(pa.array([*texts, "z"], pa.string()).slice(2, 6)) == want[2:8]
    for memory in (enc.words, enc.parts):  # memories that start afresh with every batch
        memory.row.limit = 0
    assert batch(pa.array(texts, pa.string())) == want and batch(pa.array(texts[3:], pa.string())) == want[3:]
    enc.plain = False
    enc.words.clear()
    assert batch(pa.array(texts, pa.string())) == want


def streams(totals, window, named=(), others=1):
    """The schedule and a stream for each source: named ones by weights, the rest mixed by their tokens."""
    n, rest = len(named), sum(totals[len(named) :])
    part = others / (sum(named) + others)
    level = [int(np.ceil(np.log2(packing.SURE * rest / (window * part * t)))) for t in totals[n:]]
    tokens = collections.Counter()
    for k, t in zip(level, totals[n:]):
        tokens[k] += t
    grouped = packing.groups(list(tokens.items()), window, part)
    upper = [*totals[:n], *(g[1] for g in grouped)]
    queue, lo, turn = list(range(n)), [0] * n, [0] * n
    used = [0] * len(grouped)
    for k, t in zip(level, totals[n:]):
        q = next(i for i, g in enumerate(grouped) if k in g[2])
        queue.append(n + q)
        turn.append(grouped[q][0])
        lo.append(used[q])
        used[q] += t
    scale = [a * rest for a in named] + [others * g[1] for g in grouped] if n else upper
    s = packing.Schedule(upper, scale, window)
    hi = [a + t for a, t in zip(lo, totals)]
    return s, packing.Streams(*(np.array(v, dtype=np.int64) for v in (queue, [upper[q] for q in queue], turn, lo, hi, [0] * len(totals), totals)))


def placed(s, t):
    """Each stream's tokens' places; asserts that no place is taken twice."""
    seen = {}
    for r, start, n, seq, off in zip(*(a.tolist() for a in packing.cut(s, t))):
        for k in range(n):
            assert (seq, off + k) not in seen
            seen[seq, off + k] = (r, int(t.x[r]) + start + k)
    return seen


def test_mixture_proportions(monkeypatch):
    """Each window's quotas are the targets to a token, and what a queue is owed is carried; also with wide products."""
    totals = [9000, 3000, 1500, 700, 30, 1]
    s, t = streams(totals, 512)
    place = placed(s, t)
    assert sorted(place.values()) == [(q, k) for q, n in enumerate(totals) for k in range(n)]
    per = collections.Counter((seq, r) for (seq, _), (r, _) in place.items())
    for w in range(s.total // 512):
        for q, n in enumerate(totals[:3]):
            assert abs(per[w, q] - 512 * n / s.total) <= 3
    small = [20_000, 9000, *([25] * 40), *([3] * 60)]  # all owed less than a token a window: by turns
    s, t = streams(small, 512)
    seen = collections.defaultdict(list)
    for (seq, _), (r, _) in sorted(placed(s, t).items()):
        seen[r].append(seq)
    for r in range(2, 42):
        turn = 1 << int(t.turn[r])
        assert max(collections.Counter(w // turn for w in seen[r]).values()) <= 2 * packing.SURE + 1
    s, t = streams([9000, 3000, 2204], 512, (1, 2), 5)
    for w in range(s.phases[1][0] // 512):  # until the first queue ends
        got = [s.upto(q, (w + 1) * 512) - s.upto(q, w * 512) for q in range(3)]
        assert sum(got) == 512 and all(abs(g - 512 * a / 8) <= 1 for g, a in zip(got, (1, 2, 5)))
    rng = random.Random(2)
    for k in range(60):
        totals = [rng.choice((rng.randint(1, 5), rng.randint(1, 900), rng.randint(1, 9000))) for _ in range(rng.randint(2, 40))]
        named = [rng.randint(1, 9) for _ in range(rng.choice((0, 0, 1, 3)))][: len(totals) - 1]
        s, t = streams(totals, 64, named, rng.randint(1, 9))
        whole = placed(s, t)
        assert sorted(whole.values()) == [(q, i) for q, m in enumerate(totals) for i in range(m)]
        if k < 5:  # the same places where every product is taken as wide, and by segments
            wide = lambda x, part, whole: (x.astype(object) * part // whole).astype(np.int64) if len(x) else x
            with monkeypatch.context() as m:
                m.setattr(packing, "share", wide)
                assert placed(s, t) == whole
        for r in range(min(5, len(totals))):
            cut = [(x, min(7, totals[r] - x)) for x in range(0, totals[r], 7)]
            part = packing.Streams(*(np.repeat(a[r : r + 1], len(cut)) for a in (t.queue, t.whole, t.turn, t.lo, t.hi)), np.array([x for x, _ in cut]), np.array([m for _, m in cut]))
            assert {p: x for p, (_, x) in placed(s, part).items()} == {p: x for p, (q, x) in whole.items() if q == r}
    big = np.array([(1 << 44) + 12345, 7], dtype=np.int64)
    assert packing.share(big, np.array([1 << 43, 3]), np.array([1 << 44, 1 << 44])).tolist() == [int(a) * p // (1 << 44) for a, p in zip(big, (1 << 43, 3))]


def test_many_small_sources(spark, monkeypatch):
    """3000 sources, most owed less than a token a window: each token has one place, whatever the join."""
    rows = [(i, "w " * (2 + i % 5), None if i % 9 == 0 else f"s{i}" if i % 3 else "big") for i in range(4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for kw, small in (({}, 200_000), ({"weights": {"big": 3, "s1": 2, "none": 9}, "others": 1}, 0)):
        monkeypatch.setattr(packing, "SMALL_ROWS", small)
        got = packing.pack(df, WORD, window=64, **kw).collect()
        assert len({(r["sequence_id"], r["offset"] + k) for r in got for k in range(r["length"])}) == sum(len(x.split()) + 1 for _, x, _ in rows)
        tokens = collections.Counter()
        for r in got:
            tokens[r["doc_id"]] += r["length"]
        assert dict(tokens) == {i: len(x.split()) + 1 for i, x, _ in rows}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL])
def test_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got == sorted(db.sql(f"select {','.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall(), key=str)


def test_warc_files(spark):
    big = "x" * 2000
    rows = [(1, "u", big), (2, None, big), (3, "u\r\n", None), (4, "v", "short"), (5, "v", "short"), (None, "w", big), (6, "z", "é" * 600)]
    got = {r["page_id"]: r for r in warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))).collect()}
    assert got[1]["refers_to"] == 2 and got[2]["record_type"] == "response" and got[None]["refers_to"] == 2
    import io

    rec = warc.parse_record(warc.record(7, "u", b"x" * 2000, "d", "revisit", 9))[0]
    assert rec["WARC-Refers-To"] == warc.parse_record(warc.record(9, "v", b"x" * 2000, "d", "response", None))[0]["WARC-Record-ID"]
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    for r in (warc.info_record("p"), warc.record(1, "u", b"abc", "d", "response", None)):
        writer.add(r)
    writer.close()
    assert out.getvalue()[:4] == b"\x5d\x2a\x4d\x18"
    out.seek(0)
    assert [warc.parse_record(r)[0]["WARC-Type"] for r in warc.read_records(out)] == ["warcinfo", "response"]
    assert got[3]["payload_bytes"] == 0 and got[4]["record_type"] == got[5]["record_type"] == "response" and got[6]["payload_bytes"] == 1200


def test_license_scan(spark, docs):
    want = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}
    rows = [(i, f"Some prose.\n{line}\nmore") for i, line in enumerate(want)] + [(90, "a fishing license plate number"), (91, "the driver has permission to speak"), (92, None)]
    got = {r["doc_id"]: r["families"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(want.values())), 90: "", 91: "", 92: ""}
    line = "  The GNU-GPL, v. 3.0 -- É-license."
    assert spark.range(1).select(license_scan.words(F.lit(line))).first()[0] == license_scan.words_py(line)
    assert set(spark.range(1).select(license_scan.grams(license_scan.words(F.lit(line)))).first()[0]) == license_scan.grams_py(license_scan.words_py(line))


def brute_scores(text):
    """(lines, line, family, probability, share) of every paragraph of up to three lines of a text."""
    weights, bias, _ = license_scan.train()
    lines = (text or "").split("\n")
    out = []
    for k in range(1, license_scan.LINES + 1):
        for no in range(len(lines) - k + 1):
            part = lines[no : no + k]
            if k == 3 and len(part[1]) > license_scan.PART:
                continue
            if k > 1:
                part = [license_scan.tail_py(part[0]), *part[1:-1], license_scan.head_py(part[-1])]
            gs = license_scan.grams_py(license_scan.words_py(" ".join(part)))
            z = np.array(bias) + sum((np.array(weights[g]) for g in gs if g in weights), np.zeros(len(bias)))
            p = np.exp(z - z.max())
            family = license_scan.FAMILIES[int(p[:-1].argmax())]
            templates = [license_scan.grams_py(license_scan.words_py(t.replace("{v}", ""))) for t in license_scan.TEMPLATES[family]]
            out.append((k, no, family, float(p[:-1].max() / p.sum()), max(len(gs & t) / len(t) for t in templates)))
    return out


def brute_licenses(text, least):
    """(line number, family) of a text's licence paragraphs, every paragraph scored."""
    kept = []
    for k, no, family, p, share in brute_scores(text):
        if p >= least and share >= license_scan.TEMPLATE_SHARE and not any(no < b + m and b < no + k for m, b, _ in kept):
            kept.append((k, no, family))
    return sorted((no, f) for _, no, f in kept)


def test_license_whole_table(spark, docs, texts):
    """All planted lines, and every paragraph of the table scored; the same however the rows are dealt."""
    planted = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary"}
    least = license_scan.threshold(license_scan.calibration(license_scan.scored(license_scan.candidates(docs))))
    got = collections.defaultdict(list)
    for r in license_scan.classify(docs).collect():
        got[r["doc_id"]].append((r["line"], r["family"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, t in texts if (x := brute_licenses(t, least))}
    for i, t in texts:
        assert {(no, planted[x]) for no, x in enumerate((t or "").split("\n")) if x in planted} <= set(got[i])
    whole = sorted(map(tuple, license_scan.scan(docs).collect()))
    assert whole == sorted(map(tuple, license_scan.scan(docs.repartition(8)).collect())) == sorted(map(tuple, license_scan.scan(docs.repartition(3, "lang")).collect()))
    lines = spark.createDataFrame([*enumerate(planted), *enumerate(planted)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["families"]) for r in license_scan.scan(lines).collect()) == sorted([*enumerate(planted.values())] * 2)


def test_license_triggers_lose_nothing(spark):
    """Wrapped notices, and the parts of templates that reach the share without a word of the old list."""
    wrapped = {
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not": "mpl",
        "free of charge, to any person obtaining a copy of this software\nand associated documentation files": "mit",
        "prose " * 90 + "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this\nsoftware and associated documentation": "mit",
    }
    cut = []
    for t in (t.replace("{v}", "2.0") for ts in license_scan.TEMPLATES.values() for t in ts):
        ws = t.split(" ")
        cut += [" ".join(ws[i:j]) for i in range(len(ws)) for j in range(i + 1, len(ws) + 1)]
        cut += [" ".join(w for w in ws if w not in (x, y)) for x in ws for y in ws]
        cut += ["\n".join([" ".join(ws[:i]), " ".join(ws[i:])]) for i in range(1, len(ws))]
    rows = list(enumerate([*wrapped, *dict.fromkeys(cut), "\n", "license\n", "x\n\nlicense\n\n"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    least = license_scan.threshold(license_scan.calibration(license_scan.scored(license_scan.candidates(df))))
    got = collections.defaultdict(list)
    for r in license_scan.classify(df).collect():
        got[r["doc_id"]].append((r["line"], r["family"]))
    assert [[f for _, f in got[i]] for i, _ in rows[:3]] == [[f] for f in wrapped.values()]
    assert {i: sorted(x) for i, x in got.items() if x} == {i: x for i, t in rows if (x := brute_licenses(t, least))}


def test_license_threshold_counts_all(spark):
    """The threshold is that of all clear paragraphs, also where a third of them, by hash, are all right."""
    rows = spark.range(5000).selectExpr("concat('paragraph ', id) AS paragraph").withColumn("template_share", F.when(F.pmod(F.xxhash64("paragraph"), F.lit(3)) == 0, 1.0).otherwise(0.0))
    rows = rows.withColumn("probability", F.when(F.col("template_share") == 1, 0.97).otherwise(0.62))
    between = spark.range(5000).selectExpr("concat('between ', id) AS paragraph", "0.5D AS template_share", "0.97D AS probability")
    rows = rows.union(rows).union(between)
    clear = {r["paragraph"]: (r["probability"], r["template_share"] >= 0.9) for r in rows.collect() if not 0.3 <= r["template_share"] < 0.9}
    both = [*license_scan.train()[2], *clear.values()]
    want = next((t for t in license_scan.STEPS if (right := [ok for p, ok in both if p >= t]) and sum(right) >= license_scan.PRECISION * len(right)), license_scan.STRICT)
    assert license_scan.threshold(license_scan.calibration(rows)) == want == 0.65
    assert license_scan.threshold(license_scan.calibration(rows.where("false"))) < 0.65


def test_media(spark):
    rng = random.Random(1)
    v = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(0, v[0]), (1, v[0]), (2, [*v[1][:8], *v[0][:56]]), (3, v[2]), (4, None), (5, []), (50, v[3]), (51, [x + 1e-4 for x in v[3]])]
    got = {r["vec_id"]: r for r in media_fingerprint.match(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0]["class_id"] == got[1]["class_id"] == 0 and got[4]["n_frames"] == 0 and got[5]["class_id"] is None
    assert got[0]["best_class"] == 2 and got[0]["best_offset"] == -16
    a, b = (media_fingerprint.fingerprint(media_fingerprint.render(x)) for x in (v[0], rows[2][1]))
    errors = {o: media_fingerprint.align(a, b, o) for o in range(-60, 61)}
    assert min((bad / bits, o) for o, (bits, bad) in errors.items() if bits > 32 * len(a) / 2)[1] == -16


def brute_matches(fps, every):
    """The best match of each asked class: number of matches, class, offset, share of differing bits."""
    classes = {}
    for i, fp in fps:
        if len(fp):
            classes.setdefault(fp.tobytes(), []).append(i)
    prints = {min(ids): np.frombuffer(raw, dtype=np.uint32) for raw, ids in classes.items()}
    out = {}
    for ids in classes.values():
        if any(i % every == 0 for i in ids):
            found, a = [], prints[min(ids)]
            for c, b in prints.items():
                votes = collections.Counter(p - q for p, x in enumerate(a) for q, y in enumerate(b) for m in media_fingerprint.MASKS if (x ^ y) & m == 0) if c != min(ids) else {}
                fits = []
                for off in (o for o, n in votes.items() if n >= media_fingerprint.MIN_VOTES):
                    bits, bad = media_fingerprint.align(a, b, off)
                    if bits * 2 >= 32 * min(len(a), len(b)) and bad <= media_fingerprint.MAX_BER * bits:
                        fits.append((round(bad / bits, 6), abs(off), -off))
                if fits:
                    found.append((min(fits)[0], c, -min(fits)[2]))
            out[min(ids)] = (len(found), *(min(found) if found else (None, None, None)))
    return out


def test_media_blocks(spark, monkeypatch):
    """Copies, near copies, silence of many lengths and moved parts, over many blocks and small slices of votes."""
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(40)] for _ in range(8)]
    vectors = [*base, *base[:3], *([x + rng.gauss(0, 0.05) for x in base[k % 4]] for k in range(30)), *([0.0] * n for n in range(12, 24)), *([*base[7][:6], *b[:30]] for b in base)]
    rows = [(i * 5, v) for i, v in enumerate(vectors)]
    want = brute_matches([(i, media_fingerprint.fingerprint(media_fingerprint.render(v))) for i, v in rows], 50)
    assert any(n > 3 for n, *_ in want.values())
    for block in (1 << 18, 900):
        monkeypatch.setattr(media_fingerprint, "BLOCK_BYTES", block)
        found = media_fingerprint.match(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("is_query").collect()
        assert {r["class_id"]: (r["n_matches"], r["best_ber"], r["best_class"], r["best_offset"]) for r in found} == want
    fps = [fp for fp in (media_fingerprint.fingerprint(media_fingerprint.render(v)) for v in vectors) if len(fp)]
    no = list(range(len(fps)))
    prints = media_fingerprint.Prints(pa.table({"no": [no], "cls": [no], "sizes": [[len(f) for f in fps]], "raw": [b"".join(f.astype("<u4").tobytes() for f in fps)]}))
    whole = [x.tolist() for x in media_fingerprint.matches(prints, prints)]
    for votes in (7, 400):  # here, as workers don't see what is changed in this process
        for bins in (0, 1 << 22):
            monkeypatch.setattr(media_fingerprint, "MOST_VOTES", votes)
            monkeypatch.setattr(media_fingerprint, "MOST_BINS", bins)
            assert [x.tolist() for x in media_fingerprint.matches(prints, prints)] == whole


def test_media_work(monkeypatch):
    """No vote is made where less than half would overlap, filters run once for equal lengths; the results are those of single ones."""
    rng = random.Random(8)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(20)]
    vectors = [*base, *([x + rng.gauss(0, 0.1) for x in base[k]] for k in range(10)), *(v[:40] for v in base[:5]), None, [], [0.5]]
    sounds = [media_fingerprint.render(v) for v in vectors]
    alone = [media_fingerprint.fingerprint(x) for x in sounds]

    def prints(fps):
        no = list(range(len(fps)))
        return media_fingerprint.Prints(pa.table({"no": [no], "cls": [no], "sizes": [[len(f) for f in fps]], "raw": [b"".join(f.astype("<u4").tobytes() for f in fps)]}))

    votes, split = [], media_fingerprint._split
    monkeypatch.setattr(media_fingerprint, "_split", lambda sizes: votes.append(int(sizes.sum())) or split(sizes))
    list(media_fingerprint._votes(prints(alone[:30]), prints(alone[:30])))
    monkeypatch.setattr(media_fingerprint, "_split", split)
    size = len(alone[0])
    near = abs(np.arange(size)[:, None] - np.arange(size)) * 2 <= size
    x = np.array(alone[:30])
    assert votes[0] == sum(int(((u[:, None] ^ v) & m == 0)[near].sum()) for u in x for v in x for m in map(np.uint32, media_fingerprint.MASKS))

    calls, log1p = [], np.log1p
    monkeypatch.setattr(np, "log1p", lambda x: calls.append(x.size) or log1p(x))
    fps = media_fingerprint.fingerprint_all(sounds)
    assert [f.tolist() for f in fps] == [f.tolist() for f in alone] and len(calls) == 2 * 2 * len(media_fingerprint.FILTERS)
    fps = [f for f in fps if len(f)]
    found = list(zip(*(x.tolist() for x in media_fingerprint.matches(prints(fps), prints(fps)))))
    best = {i: (sum(q == i for q, *_ in found), *min(((ber, c, off) for q, c, off, ber in found if q == i), default=(None, None, None))) for i in range(len(fps))}
    assert best == brute_matches(list(enumerate(fps)), 1)


def test_media_recall(spark):
    """Of the pairs that brute force finds close without any vote, nine in ten or more are found; also by samples."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    vectors = [*base, *(base[k % 40] + rng.normal(scale=0.1 + 0.007 * (k % 30), size=64) for k in range(160))]
    prints = [media_fingerprint.fingerprint(media_fingerprint.render(list(v))) for v in vectors]
    close = {(i, j) for i in range(0, 200, 5) for j in range(200) if i != j and np.bitwise_count(prints[i] ^ prints[j]).sum() <= media_fingerprint.MAX_BER * 32 * len(prints[i])}
    df = spark.createDataFrame([(10 * i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {r["vec_id"] // 10: r["n_matches"] for r in media_fingerprint.match(df).where("is_query").collect()}
    want = collections.Counter(i for i, _ in close)
    assert len(close) > 60 and sum(min(found[i], n) for i, n in want.items()) >= 0.9 * len(close)
    sounds = spark.createDataFrame([(10 * i, [None, *media_fingerprint.render(list(v)).tolist()]) for i, v in enumerate(vectors[:6])] + [(990, None), (991, []), (992, [0.5])], "id long, s array<double>")
    got = {r["vec_id"]: r["n_frames"] for r in media_fingerprint.match(sounds, "id", "s", audio=True).collect()}
    assert got[0] > 100 and got[990] == got[991] == got[992] == 0


def test_ledger_ablation(spark, docs):
    led = quality_rules.ledger(docs).cache()
    bits = [r["failed_bits"] for r in led.collect()]
    for r in quality_rules.ablations(led, "v1").collect():
        bit = 1 << quality_rules.RULES.index(r["rule"])
        assert (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
    kept = {r["doc_id"] for r in led.where(quality_rules.kept("v1")).collect()}
    assert {r["doc_id"] for r in quality_rules.apply_policy(docs, "v1").collect()} == kept


def test_one_row_a_component(spark):
    """Near copies that share an id, or have none, leave one row; other components with the same id stay."""
    rng = random.Random(3)

    def group(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        return [" ".join([*base[:k], "edited", *base[k + 1 :]]) for k in range(10, 10 + 40 * n, 40)]

    same, null, mixed, other = group(3), group(3), group(2), group(1)
    rows = [*((1, t) for t in same), (1, same[0]), *((None, t) for t in null), (None, mixed[0]), (7, mixed[1]), (1, other[0])]
    left = [tuple(r) for r in near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    least = lambda ts: min(ts, key=lambda t: near_dedup.class_key(near_dedup.words_of(t)))
    assert sorted(left, key=str) == sorted([(1, least(same)), (None, least(null)), (7, mixed[1]), (1, other[0])], key=str)


def test_odd_rows(spark, odd):
    assert token_counts.token_counts(odd, PIECE).count() == 7
    assert wfst.encode_decode(odd, PIECE).where("not round_trip").count() == 0
    assert pii.find(odd).where("spans <> ''").count() == 0
    assert quality_rules.ledger(odd).count() == 7
    assert license_scan.scan(odd).where("n_licenses > 0").count() == 0
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == 7 and {r["component_id"] for r in rows if r["doc_id"] in (1, None)} == {1}
    left = near_dedup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3", "4", "5"]
    assert pii.redact(odd).where("text is null").count() == 1
    packed = packing.pack(odd, WORD).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed}[4] == 60_001


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (token_counts.token_counts(none, PIECE), wfst.encode_decode(none, PIECE), pii.find(none), quality_rules.ledger(none), license_scan.scan(none), near_dedup.near_duplicates(none), packing.pack(none, WORD), warc.archive_and_read(pages), media_fingerprint.match(vectors), quality_classifier.score(none, labels)):
        assert df.collect() == []

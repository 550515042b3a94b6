"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct shingles of five words (A-Z lower-cased, words are
runs of characters other than space and the characters 9 to 13); with fewer words the
whole sequence is its one shingle, without words the set is empty and linked with nothing.

1. Documents with the same word sequence are one class; only classes go on.
2. A class has M registers. Register i is the exponentially spaced, truncated minimum
   ``clamp(floor(1 - log_b(min_d x_i(d))))`` of exponential values of the set's elements.
   Registers of a union are the maxima of the parts' registers, and two sets agree in a
   register with a probability close to their Jaccard similarity.
3. Bands of R registers are bucket keys; R is the largest for which two sets at the
   threshold t share no bucket with a probability of (1 - t^R)^(M // R) <= MISS: 8 registers
   (40 bands, 3e-6) at 0.85, 6 registers (53 bands, 1e-7) at 0.80.
4. In each bucket every class is paired with one hub, the member that shares the largest
   buckets. A joint maximum-likelihood estimate from the registers and the set sizes drops
   pairs far below the threshold (SIGMAS standard errors, a share of 3e-7 of those at the
   threshold); the others are confirmed on the full sets. Links give components.
5. Buckets whose members are then still in several components are searched completely:
   blocks of members are compared register by register, and pairs of different components
   near the threshold are confirmed on the full sets, inside the block. No bucket is capped,
   and large ones are split in blocks, bounded by members and by bytes of their sets.

So hot groups cost a star each, and only members that no star explains are compared more.

A class goes by a key that starts with its smallest id, so the smallest key of a component
holds its ``component_id`` and no hot component is gathered to find it.

Edge cases: null and empty texts are their own component (``component_id`` is the row's
own id, ``n_shingles`` 0); texts of any length are taken whole; rows that repeat an id are
documents of their own, and ``component_id`` is the smallest id of the component; rows with
a null id take part, but never name a component unless all ids of it are null, and then they
are kept, as their id is null-safe equal to the component's; an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE = 5
#: Registers of a class, and the share of pairs at the threshold that may share no bucket.
M = 320
MISS = 5e-6
#: SetSketch parameters: base, rate and largest register value.
BASE, RATE, Q = 1.001, 20.0, 65534
SIGMAS = 5.0
#: Members of a block, and bytes of their full sets.
BLOCK = 512
BLOCK_BYTES = 8 << 20
#: Files a core of staged links and keys, which are small beside the texts.
FEW = 2
SEED = 11
_RNG = np.random.default_rng(SEED)
_MULT = (_RNG.integers(0, 1 << 32, M, dtype=np.uint64) | 1).astype(np.uint32)
_POLY = (_RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BANDMUL = (_RNG.integers(0, 1 << 63, M, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Bytes of words whose hashes a worker remembers.
WORD_BYTES = 48 << 20


def band_rows(threshold: int) -> int:
    """Registers of a band: the most that lose no more than MISS of the pairs at the threshold."""
    t = threshold / 100
    return max((r for r in range(1, 9) if (1 - t**r) ** (M // r) <= MISS), default=1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words as bytes; both lower-casing and splitting of bytes are ASCII-only."""
    return text.encode().lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the set's elements."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    memory = common.held("shingles", lambda: common.Words(WORD_BYTES))
    different = set(words)
    if not different <= memory.keys():
        for w in memory.missing(different):
            memory[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=n)
    k = n - SHINGLE + 1
    out = h[:k] * _POLY[0]
    for i in range(1, SHINGLE):
        out = _mix(out) + h[i : i + k] * _POLY[i]
    return np.unique(_mix(out))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (rows: sets); the sets must not be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]].astype(np.int64)
    out = np.empty((len(sets), M), dtype=np.uint32)
    lo = 0
    while lo < len(sets):  # pieces that stay in the processor's cache
        hi = lo + 1
        while hi < len(sets) and starts[hi] - starts[lo] < 16_384:
            hi += 1
        part = flat[starts[lo] : starts[hi] if hi < len(sets) else len(flat)]
        at = starts[lo:hi] - starts[lo]
        buf = np.empty_like(part)
        for i in range(M):
            np.multiply(part, _MULT[i], out=buf)
            out[lo:hi, i] = np.maximum.reduceat(buf, at) if hi - lo > 1 else buf.max()
        lo = hi
    u = (out.astype(np.float64) + 0.5) / 4294967296.0
    smallest = -np.log(u) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)) - 1000, 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of ``rows`` registers; registers left over are in no band."""
    n = M // rows
    v = regs[:, : n * rows].reshape(len(regs), n, rows).astype(np.uint64) + np.uint64(1)
    mul = _BANDMUL[: n * rows].reshape(n, rows)
    h = np.zeros((len(regs), n), dtype=np.uint64)
    for r in range(rows):
        h = _mix(h + v[:, :, r] * mul[None, :, r])
    return _mix(h + np.arange(n, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))


def estimate(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint likelihood estimate of the Jaccard similarity.

    ``more`` and ``less`` count registers where the first or the second set's is larger.
    The likelihood is concave in the similarity: its maximum is found by bisection of the
    derivative, under the bound that the set sizes set.
    """
    u = na / (na + nb)
    v = 1 - u
    equal = M - more - less
    c = (BASE - 1) / BASE
    ln = np.log(BASE)

    def p(x):
        return -np.log1p(-np.maximum(x, 1e-12) * c) / ln

    def dp(x):
        return c / (1 - np.maximum(x, 1e-12) * c) / ln

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        j = (lo + hi) / 2
        a, b = u - v * j, v - u * j
        slope = -more * v * dp(a) / p(a) - less * u * dp(b) / p(b) + equal * (v * dp(a) + u * dp(b)) / np.maximum(1 - p(a) - p(b), 1e-9)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


def _cut(threshold: int) -> float:
    t = threshold / 100
    return t - SIGMAS * (t * (1 - t) / M) ** 0.5


SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("cls", T.BinaryType()),
        T.StructField("n", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("regs", T.BinaryType()),
    ]
)


def class_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def sketches(docs: DataFrame, id_col: str, text_col: str, rows: int = 8) -> DataFrame:
    """Id, class key, set size, band keys and registers of every document."""

    def make():
        def fn(texts):
            split = [words_of(t) for t in texts]
            sets = [shingles(w) for w in split]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands, regs = [None] * len(texts), [None] * len(texts)
            if full:
                r = registers([sets[i] for i in full])
                for i, key, reg in zip(full, band_keys(r, rows).view(np.int64), r):
                    bands[i], regs[i] = key, reg.tobytes()
            return [
                pa.array([class_key(w) for w in split], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(regs, pa.binary()),
            ]

        return fn

    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_rows(rows_, 1, SKETCH.fields[1:], make, keep=["doc_id"])


_SIGN = -(1 << 63)


def node_key(rep: Column, cls: Column) -> Column:
    """A class's key: binary order is that of its smallest id (null last), then of its words."""
    place = F.unhex(F.lpad(F.hex(rep.bitwiseXOR(F.lit(_SIGN))), 16, "0"))
    head = F.when(rep.isNull(), F.unhex(F.lit("01" + "00" * 8))).otherwise(F.concat(F.unhex(F.lit("00")), place))
    return F.concat(head, cls)


def node_id(node: Column) -> Column:
    """The smallest id that a class's key starts with."""
    place = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    return F.when(F.substring(node, 1, 1) == F.unhex(F.lit("00")), place)


def _likely(pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose estimate isn't far below the threshold; needs na, ra, nb, rb."""
    cut = _cut(threshold)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (np.array(batch.column(i).to_pylist(), dtype=float) for i in (2, 4))
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, M) for i in (3, 5))
            j = estimate((ra > rb).sum(1), (ra < rb).sum(1), na, nb)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(j >= cut))

    return pairs.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, used: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Full sets of the classes in ``used`` (node, rep, cls), one row each, from one document each."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(used, F.col("id").eqNullSafe(F.col("rep"))).select("node", "cls", "text")

    def run(batches):
        for batch in batches:
            for lo, hi, texts in common.sub_batches(batch, 2):
                part = batch.slice(lo, hi - lo)
                split = [words_of(t) for t in texts]
                same = [i for i, (w, c) in enumerate(zip(split, part.column(1).to_pylist())) if class_key(w) == c]
                sets = [shingles(split[i]).view(np.int64) for i in same]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(same, pa.int64())), pa.array(sets, pa.list_(pa.int64()))], names=["node", "els"])

    # Rows that repeat an id with other words are gone by now; exact repeats have equal sets.
    return rows.mapInArrow(run, "node binary, els array<bigint>").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: 100 * intersection >= threshold * union."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("els").alias("ea")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("els").alias("eb")), "b")
    inter = F.size(F.array_intersect("ea", "eb"))
    both = both.select("a", "b", inter.alias("i"), (F.size("ea") + F.size("eb")).alias("s"))
    return both.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * threshold).select("a", "b")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, comp): the smallest key of each node's component, for nodes with links.

    Alternating large-star and small-star steps: edges are rewritten to point at smaller
    keys until nothing changes; no node's neighbours are ever gathered, and joins on a hub's
    key are inner joins of exchanged rows, which adaptive execution splits where they are large.
    """
    e = common.staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name, FEW)
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        old, e = e, common.staged(small.where("u <> v").distinct(), name, FEW)
        common.discard(old)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    stars = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    out = common.staged(stars.unionByName(roots).distinct(), name, FEW)
    common.discard(e)
    return out


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without Python objects."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    off = lists.offsets.to_numpy()
    return lists.values.to_numpy()[off[0] : off[-1]], off - off[0]


def _candidates(key, table: pa.Table, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Likely pairs of different components in a pair of blocks of a bucket.

    Returns both members' places, the estimates, and the components as numbers. A pair is
    looked at in its first common bucket alone.
    """
    cut = _cut(threshold)
    comp = table["comp"].to_pylist()
    mine, n = table["mine"].to_numpy(), table["n"].to_numpy().astype(float)
    regs = np.frombuffer(b"".join(table["regs"].to_pylist()), dtype=np.uint16).reshape(-1, M)
    bands = _numbers(table["bands"])[0].reshape(len(comp), -1)
    names = {c: i for i, c in enumerate(dict.fromkeys(comp))}
    label = np.array([names[c] for c in comp])
    bucket, x, y = (k.as_py() for k in key)
    band = int(np.flatnonzero((bands == bucket).all(0))[0])
    left, right = (np.flatnonzero(mine == x), np.flatnonzero(mine == y)) if x != y else (np.arange(len(comp)),) * 2
    ii, jj = [], []
    for i in left:
        js = right[right > i] if x == y else right
        js = js[label[js] != label[i]]
        js = js[np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * threshold]
        if len(js):  # agreement alone falls as far below the threshold for unlikely pairs
            js = js[np.count_nonzero(regs[js] == regs[i], axis=1) >= M * (cut - 0.03)]
        if band and len(js):
            js = js[~(bands[js, :band] == bands[i, :band]).any(1)]
        if len(js):
            ii.append(np.full(len(js), i))
            jj.append(js)
    ii, jj = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (ii, jj))
    est = np.zeros(len(ii))
    for lo in range(0, len(ii), 8192):
        i, j = ii[lo : lo + 8192], jj[lo : lo + 8192]
        est[lo : lo + 8192] = estimate((regs[i] > regs[j]).sum(1), (regs[i] < regs[j]).sum(1), n[i], n[j])
    good = est >= cut
    return ii[good], jj[good], est[good], label


def _mixed_links(buckets: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """Confirmed links between different components inside buckets that hold several.

    First, members with a likely partner are found; only their full sets are fetched, and
    only for the bucket that their pair is dealt to. Then pairs are confirmed inside the
    blocks, the likeliest first, and a pair whose members a confirmed link already connects
    is passed over. Neither pass emits pairs: members, then the links of a spanning forest.
    """
    number = classes.select(F.col("node").alias("comp"), F.col("no").alias("comp_no"))
    linked = comps.join(classes.select("node", "no"), "node").join(number, "comp").select("no", "comp_no")
    labelled = buckets.join(linked, "no", "left").select("bucket", "no", F.coalesce("comp_no", "no").alias("comp"))
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("bucket", "size")
    rows = labelled.join(mixed, "bucket").join(classes.select("no", "n"), "no")
    load = rows.groupBy("bucket").agg(F.sum("n").alias("load"), F.first("size").alias("size"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("load") * 8 / BLOCK_BYTES)).cast("int")
    rows = rows.select("bucket", "no", "comp").join(load.select("bucket", blocks.alias("blocks")), "bucket")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", "no", "comp", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    sketch = classes.select("no", "node", "n", "regs", "bands")

    def likely(key, table):
        ii, jj, _, _ = _candidates(key, table, threshold)
        return table.take(pa.array(np.unique(np.r_[ii, jj]).astype(np.int64))).select(["bucket", "x", "y", "mine", "no", "comp"])

    members = rows.join(sketch.drop("node"), "no").groupBy("bucket", "x", "y").applyInArrow(likely, "bucket long, x int, y int, mine int, no long, comp long")
    members = common.staged(members, "dedup-members", FEW)
    if not members.take(1):
        return common.staged(members.select(F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b")).where(F.lit(False)), "dedup-more", FEW)
    used = members.select("no").distinct().join(classes.select("no", "node", "rep", "cls"), "no").select("node", "rep", "cls")
    sets = common.staged(_sets(docs, used, id_col, text_col), "dedup-sets")

    def confirmed(key, table):
        ii, jj, est, label = _candidates(key, table, threshold)
        values, off = _numbers(table["els"])
        root = np.arange(label.max() + 1)

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        a, b = [], []
        node = table["node"]
        for at in np.argsort(-est, kind="stable"):
            i, j = int(ii[at]), int(jj[at])
            p, q = find(label[i]), find(label[j])
            if p != q:
                one, two = values[off[i] : off[i + 1]], values[off[j] : off[j + 1]]
                inter = len(np.intersect1d(one, two, assume_unique=True))
                if inter * 100 >= (len(one) + len(two) - inter) * threshold:
                    root[p] = q
                    a.append(node[i].as_py())
                    b.append(node[j].as_py())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    full = members.join(sketch, "no").join(sets, "node")
    out = common.staged(full.groupBy("bucket", "x", "y").applyInArrow(confirmed, "a binary, b binary"), "dedup-more", FEW)
    common.discard(members, sets)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sketches, their classes, and (node, comp) of the classes with links."""
    sk = common.staged(sketches(docs, id_col, text_col, band_rows(threshold)), "dedup-sketch")
    # Documents of a class have the same words, so any one's sketch will do.
    classes = sk.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "bands", "regs")])
    # Short numbers stand for the keys in the buckets; being written, they don't change.
    classes = classes.withColumn("node", node_key(F.col("rep"), F.col("cls"))).withColumn("no", F.monotonically_increasing_id())
    classes = common.staged(classes, "dedup-classes")
    buckets = classes.select("no", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = common.staged(buckets.join(sizes, "bucket"), "dedup-buckets")
    popular = buckets.groupBy("no").agg(F.sum("size").alias("pop"))
    hubs = buckets.join(popular, "no").groupBy("bucket").agg(F.max(F.struct("pop", "no")).alias("top")).select("bucket", F.col("top.no").alias("hub"))
    pairs = buckets.join(hubs, "bucket").where("no <> hub").select(F.least("no", "hub").alias("x"), F.greatest("no", "hub").alias("y")).distinct()
    pairs = pairs.join(classes.select(F.col("no").alias("x"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "x")
    pairs = pairs.join(classes.select(F.col("no").alias("y"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "y")
    pairs = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold)
    stars = common.staged(_likely(pairs, threshold), "dedup-stars", FEW)
    used = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct().join(classes.select("node", "rep", "cls"), "node")
    sets = common.staged(_sets(docs, used, id_col, text_col), "dedup-sets")
    links = common.staged(_confirm(stars, sets, threshold), "dedup-links", FEW)
    common.discard(stars, sets)
    comps = components(links)
    more = _mixed_links(buckets.select("bucket", "no"), comps, classes, docs, id_col, text_col, threshold)
    if more.take(1):
        first, comps = comps, components(links.unionByName(more))
        common.discard(first)
    common.discard(buckets, links, more)
    return sk, classes, comps


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85) -> DataFrame:
    """doc_id, cls, comp (the component's key), n_shingles, component_id and kept of every document.

    ``threshold`` is the least Jaccard similarity of a link in percent.
    """
    sk, classes, comps = _grouped(docs, id_col, text_col, threshold)
    # Classes of one document and without links are their own components: no join is needed.
    named = classes.select("cls", "node", "copies").join(comps, "node", "left").where("copies > 1 or comp is not null")
    named = named.select("cls", F.coalesce("comp", "node").alias("comp"))
    own = node_key(F.col("doc_id"), F.col("cls"))
    out = sk.select("doc_id", "cls", "n").join(named, "cls", "left").select("doc_id", "cls", F.when(F.col("n") > 0, F.coalesce("comp", own)).otherwise(own).alias("comp"), F.col("n").alias("n_shingles"))
    component = F.when(F.col("n_shingles") > 0, node_id(F.col("comp"))).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85) -> DataFrame:
    """One row of each component of ``docs``, all columns unchanged.

    The row with the component's smallest id stays; where that id stands on rows of several word
    sequences of the component, those of the smaller class key, and of rows that repeat both,
    one. Documents without words are linked with nothing and all stay. Columns of ``docs`` may
    have any names; an empty table stays empty.
    """
    sk, classes, comps = _grouped(docs, id_col, text_col, threshold)
    # A component's smallest key is that of the class to keep.
    roots = classes.select("node", "rep", "cls").join(comps, "node", "left").where("comp is null or comp = node")
    repeats = sk.where("n > 0").groupBy("doc_id", "cls").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    repeats = repeats.select(F.col("doc_id").alias("_id"), F.col("cls").alias("_cls"), F.col("rows").alias("_rows"))
    kept = roots.join(repeats, F.col("rep").eqNullSafe(F.col("_id")) & (F.col("cls") == F.col("_cls")), "left")
    kept = common.staged(kept.select(F.col("rep").alias("_id"), F.col("cls").alias("_cls"), F.coalesce("_rows", F.lit(1)).alias("_rows")), "dedup-kept", FEW)
    common.discard(sk, classes, comps)
    schema = docs.schema
    name = "_class"
    while name in {c.lower() for c in docs.columns}:
        name += "_"

    def make():
        def fn(texts):
            split = [words_of(t) for t in texts]
            return [pa.array([class_key(w) if w else None for w in split], pa.binary())]

        return fn

    keyed = common.map_rows(docs, docs.columns.index(text_col), [T.StructField(name, T.BinaryType())], make)
    empty = keyed.where(F.col(name).isNull()).drop(name)
    on = keyed[id_col].cast("long").eqNullSafe(kept["_id"]) & (keyed[name] == kept["_cls"])
    single = keyed.join(kept.where("_rows = 1"), on, "left_semi").drop(name)
    several = kept.where("_rows > 1")
    if several.take(1):
        again = keyed.join(several, on, "left_semi").dropDuplicates([id_col, name]).drop(name)
        single = single.unionByName(again)
    return single.unionByName(empty).select(*schema.names)

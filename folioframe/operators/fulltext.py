"""Full-text search: tokens, stored postings, BM25 over weighted columns, phrases and prefixes.

Corpus statistics (rows, mean length, document frequencies) are taken over all fragments;
scope and filters apply to scored rows, so they don't change scores.

``Postings.build`` writes an inverted index in one pass and without an exchange: each task writes a
segment, a file of its rows' words sorted by term, of which a query reads the pages that hold its
terms. In a segment the rows lie in blocks (an Arrow batch each): a row for each block and term has
the term's places, and one without a term has the block's ids and numbers of words. Places count
on through a block, with a gap behind each column of a fragment, so a phrase's words are neighbours
in it only where they are in the text. ``bm25`` scores without an index, in one pass over the texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.errors import query_error
from folioframe.functions.porter import stem
from folioframe.shipping import ship
from folioframe.storage import staged

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
WEIGHTS = {"body": 2.0, "code": 0.5, "headings": 3.0}
MAX_QUERY = 1024
TOKEN, BETWEEN = r"[\p{L}\p{N}_-]+", r"[^\p{L}\p{N}_-]+"


def fold(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits, ``_`` and ``-``."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def spaced(text: Column) -> Column:
    """The same words as ``tokens`` gives, with a space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(BETWEEN), F.lit(" ")))


@lru_cache(200_000)
def root(word: str) -> str:
    """A folded and stemmed word; a worker remembers the words it has seen."""
    return stem(fold(word))


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [root(w) for w in ws])


def stemmed(words: Column) -> Column:
    """Folded and stemmed words; an Arrow function, as Spark has no stemmer."""
    return F.pandas_udf(_stems, "array<string>")(words)


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False


def sanitize(query: str) -> list[Phrase]:
    """Quoted phrases, ``word*`` prefixes, and plain words; punctuation alone is dropped."""
    if len(query) > MAX_QUERY:
        raise query_error("the query is too long")
    if re.search(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", query):
        raise query_error("the query holds control characters")
    out = []
    for quoted, bare in re.findall(r'"([^"]*)"|([^\s"]+)', query):
        words = re.findall(r"[^\W_]+(?:[\w-]*)|[\w-]+", (quoted or bare).lower())
        words = [w for w in words if re.search(r"\w", w)]
        if words:
            star = not quoted and re.fullmatch(r"[\w-]{3,}\*", bare) is not None
            out.append(Phrase(tuple(words), star))
    return out


def _phrases(query: str, stem_words: bool) -> list[Phrase]:
    found = sanitize(query)
    return [Phrase(tuple(root(t) for t in p.terms), p.prefix) for p in found] if stem_words else found


def _in_text(words: Column, p: Phrase) -> Column:
    """Occurrences of a phrase in words that each have a space before and behind; the words behind the first are only looked at, so occurrences may overlap."""
    behind = "".join(f" {re.escape(t)}" for t in p.terms[1:]) + ("" if p.prefix else " ")
    return F.regexp_count(words, F.lit(f" {re.escape(p.terms[0])}(?={behind})"))


def _scored(per: DataFrame, phrases: list[Phrase], id_col: str, n_rows: Column, avgdl: Column, stats: list[Column]) -> DataFrame:
    """(id, score) of rows (id, d, f0, f1, ..) where each phrase's weighted count is above 0."""
    counts = [F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(phrases))]
    one = per.agg(*counts, *stats)  # one row
    rows = per.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(phrases))])).crossJoin(F.broadcast(one))
    parts = []
    for i in range(len(phrases)):
        idf = F.log((n_rows - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(IDF_FLOOR)
        parts.append(idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("d") / avgdl)))
    return rows.select(id_col, reduce(lambda a, b: a + b, parts).alias("score"))


def bm25(fragments: DataFrame, query: str, id_col: str = "frag_id", stem_words: bool = False) -> DataFrame:
    """(id, score) of the fragments that hold all phrases of the query, by reading all of them."""
    phrases = _phrases(query, stem_words)
    if not phrases:
        return fragments.select(id_col, F.lit(0.0).alias("score")).where(F.lit(False))
    rows = fragments.select(id_col, *[(stemmed(tokens(F.col(c))) if stem_words else spaced(F.col(c))).alias(c) for c in WEIGHTS])
    if stem_words:
        number, words = F.size, lambda w: F.array_join(w, " ")
    else:
        number, words = lambda w: F.when(w == "", 0).otherwise(F.length(w) - F.length(F.replace(w, F.lit(" "))) + 1), lambda w: w
    d = reduce(lambda a, b: a + b, [number(F.col(c)) for c in WEIGHTS])
    texts = {c: F.concat(F.lit(" "), words(F.col(c)), F.lit(" ")) for c in WEIGHTS}
    f = [reduce(lambda a, b: a + b, [_in_text(texts[c], p) * w for c, w in WEIGHTS.items()]).alias(f"f{i}") for i, p in enumerate(phrases)]
    # Staged, as both the counts and the scores read it: the texts are read once.
    per = staged(rows.select(id_col, d.alias("d"), *f), "bm25")
    return _scored(per, phrases, id_col, F.col("n_rows"), F.col("avgdl"), [F.count(F.lit(1)).alias("n_rows"), F.avg("d").alias("avgdl")])


def _flat(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of spaced texts in a row, and how many each text has."""
    words = pc.split_pattern(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts), " ")
    return words.flatten().cast(pa.string()), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _inverted(stem_words: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block for each batch of (id, spaced texts): its directory, then its terms with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(b for b in batches if b.num_rows):
            flat, number = zip(*[_flat(batch.column(c)) for c in WEIGHTS])
            number = np.stack(number, axis=1)
            starts = (np.cumsum(number + 1) - (number.ravel() + 1)).reshape(number.shape)
            places = [np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum()) for at, n in zip(starts.T, number.T)]
            found = pa.concat_arrays(flat).dictionary_encode()
            terms, codes = found.dictionary, found.indices.to_numpy().astype(np.int64)
            if stem_words:
                roots = pa.array(map(root, terms.to_pylist()), pa.string()).dictionary_encode()
                terms, codes = roots.dictionary, roots.indices.to_numpy().astype(np.int64)[codes]
            both = np.sort(codes << 32 | np.concatenate(places))  # by term, then by place
            codes, places = both >> 32, both & 0xFFFFFFFF
            ends = np.cumsum(np.bincount(codes, minlength=len(terms)))
            gaps = np.diff(places, prepend=0)  # from place to place; they take less than half the room
            gaps[ends[:-1]] = places[ends[:-1]]
            n = number.size
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(1, pa.string()), terms]),
                    pa.array(np.full(len(terms) + 1, TaskContext.get().partitionId() << 32 | k)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0, n], n + ends]).astype(np.int32)), pa.array(np.concatenate([number.ravel(), gaps]).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(np.array([0, *[batch.num_rows] * (len(terms) + 1)], np.int32)), batch.column("id")),
                ],
                names=["term", "block", "gaps", "ids"],
            )

    return run


def _counted(phrases: list[Phrase], id_col: str) -> Callable[[pa.Table], pa.Table]:
    """(id, d, f0, f1, ..) of a block's rows that hold a phrase, from its directory and its terms' places."""
    weights = np.array(list(WEIGHTS.values()))

    def run(block: pa.Table) -> pa.Table:
        terms = block["term"].to_pylist()
        at = terms.index(None)
        ids, values = block["ids"][at].values, [block["gaps"][i].values.to_numpy() for i in range(len(terms))]
        number = values[at].astype(np.int64)
        starts = np.cumsum(number + 1) - (number + 1)
        d = number.reshape(-1, len(weights)).sum(axis=1)
        counts = []
        for p in phrases:
            begins = None
            for k, t in enumerate(p.terms):
                star = p.prefix and k == len(p.terms) - 1
                fit = [np.cumsum(v, dtype=np.int64) - k for v, x in zip(values, terms) if x is not None and (x.startswith(t) if star else x == t)]
                here = np.concatenate(fit) if fit else np.array([], np.int64)
                begins = here if begins is None else np.intersect1d(begins, here, assume_unique=True)
            column = np.searchsorted(starts, begins, side="right") - 1
            counts.append(np.bincount(column // len(weights), weights[column % len(weights)], len(d)))
        kept = np.flatnonzero(np.any(counts, axis=0))
        return pa.table({id_col: ids.take(pa.array(kept)), "d": pa.array(d[kept].astype(np.int32)), **{f"f{i}": pa.array(f[kept], pa.float64()) for i, f in enumerate(counts)}})

    return run


class Postings:
    """A stored inverted index over fragments (id, body, code, headings)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        about = spark.read.parquet(f"{folder}/about").first()
        self.n_rows, self.avgdl, self.stem_words, self.id_type = about["n_rows"], about["avgdl"], about["stem_words"], about["id_type"]

    @staticmethod
    def _schema(id_type: str) -> str:
        return f"term string, block long, gaps array<int>, ids array<{id_type}>"

    @classmethod
    def build(cls, fragments: DataFrame, folder: str, id_col: str = "frag_id", stem_words: bool = False) -> Postings:
        """Write the index of all fragments in one pass over the texts."""
        spark = ship(fragments.sparkSession)
        rows = fragments.select(F.col(id_col).alias("id"), *[spaced(F.col(c)).alias(c) for c in WEIGHTS])
        id_type = rows.schema["id"].dataType.simpleString()
        blocks = rows.mapInArrow(_inverted(stem_words), cls._schema(id_type)).sortWithinPartitions("term", "block")
        blocks.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{folder}/postings")
        directory = spark.read.schema(cls._schema(id_type)).parquet(f"{folder}/postings").where("term is null")
        words = F.aggregate("gaps", F.lit(0).cast("long"), lambda a, x: a + x)
        about = directory.agg(F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(words), F.lit(0)).alias("words"))
        avgdl = F.when(F.col("n_rows") > 0, F.col("words") / F.col("n_rows")).otherwise(0.0)
        about.select("n_rows", avgdl.alias("avgdl"), F.lit(stem_words).alias("stem_words"), F.lit(id_type).alias("id_type")).coalesce(1).write.parquet(f"{folder}/about")
        return cls(spark, folder)

    def _read(self, phrases: list[Phrase]) -> DataFrame:
        """The blocks' directories and the places of the phrases' words."""
        exact = sorted({t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)})
        prefixes = sorted({p.terms[-1] for p in phrases if p.prefix})
        wanted = [F.col("term").isNull()] + [F.col("term").isin(exact)] * bool(exact) + [F.col("term").startswith(t) for t in prefixes]
        return self.spark.read.schema(self._schema(self.id_type)).parquet(f"{self.folder}/postings").where(reduce(lambda a, b: a | b, wanted))

    def search(self, query: str, id_col: str = "frag_id") -> DataFrame:
        """(id, score) of the fragments that hold all phrases of the query."""
        phrases = _phrases(query, self.stem_words)
        if not phrases:
            return self.spark.createDataFrame([], f"{id_col} {self.id_type}, score double")
        schema = f"{id_col} {self.id_type}, d int, " + ", ".join(f"f{i} double" for i in range(len(phrases)))
        per = self._read(phrases).groupBy("block").applyInArrow(_counted(phrases, id_col), schema)
        return _scored(per, phrases, id_col, F.lit(self.n_rows), F.lit(self.avgdl), [])

"""What the search reads, moves and counts: one pass over the texts, no exchange of the words, the same matches."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from folioframe import driver_queries
from folioframe.operators import fulltext
from folioframe.plans import paging
from folioframe.storage import shared_dir


def _moved(spark) -> tuple[int, int]:
    """Bytes of shuffles written and of tables read so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    each = [found.apply(i) for i in range(found.size())]
    return sum(x.totalShuffleWrite() for x in each), sum(x.totalInputBytes() for x in each)


@pytest.fixture(scope="module")
def texts(spark):
    """Fragments with 600 000 words in 2 files."""
    r, words = random.Random(7), [f"w{i}" for i in range(5000)]
    rows = [(i, " ".join(r.choices(words, k=300)) + " of the src3", "src3", "en") for i in range(2000)]
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, "frag_id long, body string, code string, headings string").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def _built(spark, frags, **how) -> fulltext.Postings:
    return fulltext.Postings.build(frags, f"{shared_dir(spark)}/search-{uuid.uuid4().hex}", **how)


def test_build_moves_no_words(spark, texts):
    before, _ = _moved(spark)
    index = _built(spark, texts)
    assert _moved(spark)[0] - before < 100_000  # 2.4 MB of text
    assert (index.n_rows, index.avgdl) == (2000, 305.0)


ODD = ["", " ", "a", "--", "_x- y", "Of THE of the", "café́ xİy", "\U0001d49cof the", "a b　c\td\n", "١٢ 3²", "of\U0001f600the", "x" * 3000, None]


def test_spaced_words_are_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select(fulltext.tokens(F.col("t")).alias("ws"), fulltext.spaced(F.col("t")).alias("s")).collect()
    assert all((r["s"].split(" ") if r["s"] else []) == r["ws"] for r in rows)


def test_matches_over_blocks_and_segments(spark, monkeypatch):
    """Phrases with repeated words, prefixes and several phrases, by the index of many blocks and without it."""
    r = random.Random(3)
    cell = lambda: r.choice([None, "", r.choice(ODD), *[" ".join(r.choices(["of", "the", "ant", "anti", "antic"], k=r.randint(1, 9))) for _ in range(4)]])
    rows = [(f"n#{i}", cell(), cell(), cell()) for i in range(90)]
    frags = spark.createDataFrame(rows, "frag_id string, body string, code string, headings string").repartition(3)
    words = {x["frag_id"]: [x[c] for c in fulltext.WEIGHTS] for x in frags.select("frag_id", *[fulltext.tokens(F.col(c)).alias(c) for c in fulltext.WEIGHTS]).collect()}
    rule = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = _built(spark, frags)
        assert spark.read.parquet(f"{index.folder}/postings").where("term is null").count() >= 12
        for query, terms, star in (("of", ["of"], False), ('"of the"', ["of", "the"], False), ('"of of"', ["of", "of"], False), ('"the of the"', ["the", "of", "the"], False), ("anti*", ["anti"], True), ("nowhere", ["nowhere"], False)):
            fits = lambda got: all(g.startswith(t) if star and k == len(terms) - 1 else g == t for k, (g, t) in enumerate(zip(got, terms)))  # noqa: E731,B023
            f = {i: sum(w * sum(fits(c[p : p + len(terms)]) for p in range(len(c) - len(terms) + 1)) for c, w in zip(ws, fulltext.WEIGHTS.values())) for i, ws in words.items()}
            d = {i: sum(map(len, ws)) for i, ws in words.items()}
            want = {i: n * 2.2 / (n + 1.2 * (0.25 + 0.75 * d[i] / (sum(d.values()) / len(d)))) for i, n in f.items() if n}
            for found in (index.search(query), fulltext.bm25(frags, query)):
                got = {x["frag_id"]: x["score"] for x in found.collect()}
                assert got.keys() == want.keys()
                assert len({round(got[i] / want[i], 9) for i in got}) <= 1  # all have the same idf
        two = [{x["frag_id"]: round(x["score"], 9) for x in found.collect()} for found in (index.search('the "of anti" ant*'), fulltext.bm25(frags, 'the "of anti" ant*'))]
        assert two[0] and two[0] == two[1]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rule)


def test_empty_index(spark, texts):
    index = _built(spark, texts.limit(0))
    assert (index.n_rows, index.avgdl, index.search("the").count()) == (0, 0.0, 0)


def test_build_stems_a_word_once_in_a_block(monkeypatch):
    """The stemmer sees a block's different words, not each of its words."""
    import types

    import pyarrow as pa

    seen, known = [], fulltext.root
    monkeypatch.setattr(fulltext, "root", lambda w: seen.append(w) or known(w))
    monkeypatch.setattr(fulltext, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.record_batch({"id": [1, 2], "body": ["runs running " * 500 + "runs", "running"], "code": ["", "runs"], "headings": ["caf\u00e9s", ""]})
    (block,) = fulltext._inverted(True)(iter([batch]))
    assert sorted(seen) == ["caf\u00e9s", "running", "runs"]
    assert block.column("term").to_pylist() == [None, "run", "cafe"]
    assert [len(x) for x in block.column("gaps").to_pylist()] == [6, 1003, 1]


def test_unindexed_search_reads_the_texts_once(spark, texts):
    reads = []
    for run in (lambda: texts.write.format("noop").mode("overwrite").save(), lambda: fulltext.bm25(texts, 'w17 "of the"').collect()):
        _, before = _moved(spark)
        run()
        reads.append(_moved(spark)[1] - before)
    assert reads[1] < 1.5 * reads[0]


def test_common_words_of_columns_move_little(spark, texts):
    """Words that each row holds, with the build of the index: b6_bm25_columns."""
    before, _ = _moved(spark)
    assert _built(spark, texts).search("src3 en").count() == 2000
    assert _moved(spark)[0] - before < 200_000


def test_next_page_of_a_common_word_moves_little(spark, texts):
    """The build, a word of each row and a page behind a cursor: o6_keyset_next_page."""
    before, _ = _moved(spark)
    scored = _built(spark, texts).search("the")
    rows = paging.page(scored, [(F.col("score"), True), (F.col("frag_id"), False)], 20, [1.0, -1]).collect()
    assert [r["frag_id"] for r in rows] == list(range(20))
    assert _moved(spark)[0] - before < 200_000

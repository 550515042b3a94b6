"""Every registered query of the vault engine that has SQL agrees with DuckDB."""

import duckdb
import pytest

from folioframe.driver_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    want = sorted(db.sql(f"select {','.join(cols)} from ({ORACLE_SQL[name]})").fetchall(), key=str)
    assert got == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_stemmed_search(spark):
    """Stemmed, folded search of the stored index against plain Python, with and without the index."""
    import math
    import re
    import uuid

    from folioframe import driver_queries
    from folioframe.operators import fulltext

    rows = [(r["frag_id"], (r["body"], r["code"], r["headings"])) for r in driver_queries.fragments(spark, SF).collect()]
    rows += [(10_000, ("Caf\u00e9 tables, a running table", "x", "Tables")), (10_001, ("the caf\u00e9s ran", None, "cafe table"))]
    frags = spark.createDataFrame([(i, *cols) for i, cols in rows], "frag_id long, body string, code string, headings string")
    words = {i: [[fulltext.root(w) for w in re.findall(r"[\w-]+", (c or "").lower())] for c in cols] for i, cols in rows}

    def brute(phrases):
        d = {i: sum(map(len, ws)) for i, ws in words.items()}
        avg, f = sum(d.values()) / len(d), {}
        for k, (terms, star) in enumerate(phrases):
            terms = [fulltext.root(t) for t in terms]
            fits = lambda got: all(g.startswith(t) if star and n == len(terms) - 1 else g == t for n, (g, t) in enumerate(zip(got, terms)))  # noqa: E731,B023
            for i, ws in words.items():
                n = sum(w * sum(fits(c[p : p + len(terms)]) for p in range(len(c) - len(terms) + 1)) for c, w in zip(ws, (2.0, 0.5, 3.0)))
                if n:
                    f.setdefault(k, {})[i] = n
        out = {}
        for i in words:
            if all(i in f.get(k, {}) for k in range(len(phrases))):
                score = 0.0
                for k in range(len(phrases)):
                    df = len(f[k])
                    idf = math.log((len(words) - df + 0.5) / (df + 0.5))
                    score += (idf if idf > 0 else 1e-6) * f[k][i] * 2.2 / (f[k][i] + 1.2 * (0.25 + 0.75 * d[i] / avg))
                out[i] = score
        return out

    from folioframe.storage import shared_dir

    index = fulltext.Postings.build(frags, f"{shared_dir(spark)}/search-{uuid.uuid4().hex}", stem_words=True)
    for text, phrases in (("heing", [(["heing"], False)]), ("cafe tables", [(["cafe"], False), (["tables"], False)]), ('"running tables" cafe', [(["running", "tables"], False), (["cafe"], False)]), ("the*", [(["the"], True)]), ("xyzzy", [(["xyzzy"], False)])):
        want = brute(phrases)
        assert want or text == "xyzzy"
        for found in (index.search(text), fulltext.bm25(frags, text, stem_words=True)):
            got = {r["frag_id"]: r["score"] for r in found.collect()}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)

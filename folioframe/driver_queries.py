"""The registered queries of the vault engine and their SQL.

The driver's tables hold no vault, so each operator runs on a projection of them that SQL
can state too: documents as notes with metadata, page addresses as paths, conversations as
outlines, synthetic edges between pages as links.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import scalars
from folioframe.operators import diff, fulltext, fuzzy, links, outline, snippets, tree
from folioframe.plans import filters, paging
from folioframe.storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- projections --------------------------------------------------------------------------


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: path, tags, typed fields, dates."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.select("doc_id", "lang", "source", "n_chars").join(lab, "doc_id", "left")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'")
    return rows.select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("file"),
        F.array(F.lower("lang"), F.lower(F.concat_ws("/", "lang", "source"))).alias("tags"),
        F.to_json(F.struct("quality", "toxic", F.col("n_chars").alias("n.chars"), "lang", F.array("lang", "source").alias("aliases"), F.struct("source").alias("origin"), F.expr("CASE WHEN n_chars % 2 = 1 THEN parse_json('[1, \"x\"]') ELSE parse_json('[1, 1.0, true]') END").alias("sizes"), F.when(F.col("doc_id") % 5 == 0, "").alias("note"))).alias("fields"),
        F.when(F.col("doc_id") % 3 == 0, day).alias("created"),
        F.lit(None).cast("string").alias("updated"),
        (F.col("doc_id") * 86400000.0).alias("mtime"),
    )


_NOTES = """
SELECT d.doc_id, d.source || '/' || d.lang || '/' || d.doc_id || '.md' AS file, d.lang, d.source, d.n_chars, l.quality, l.toxic,
       CASE WHEN d.doc_id % 3 = 0 THEN strftime(DATE '2024-01-01' + CAST(d.doc_id % 400 AS INTEGER), '%Y-%m-%dT00:00:00Z') END AS created,
       strftime(make_timestamp(d.doc_id * 86400000000), '%Y-%m-%dT%H:%M:%SZ') AS modified,
       CASE WHEN d.doc_id % 5 = 0 THEN '' END AS note
FROM documents d LEFT JOIN labels l USING (doc_id)
"""


def _filter_query(name: str, filter_tree: dict, where: str) -> None:
    predicate = filter_tree

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return notes(spark, sf_dir).where(filters.compile_filter(predicate)).select("doc_id", "file")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT doc_id, file FROM ({_NOTES}) WHERE {where}"


_filter_query("f1_tags_has", {"tags": {"has": "EN"}}, "lower(lang) = 'en'")
_filter_query("f1_tags_has_prefix", {"tags": {"has": "de/src1"}}, "lang = 'de' AND source = 'src1'")
_filter_query("f2_tags_has_any", {"tags": {"has_any": ["fr", "es/src2"]}}, "lang = 'fr' OR (lang = 'es' AND source = 'src2')")
_filter_query("f2_tags_has_any_empty", {"tags": {"has_any": []}}, "false")
_filter_query("f3_tags_has_all", {"tags": {"has_all": ["en", "en/src3"]}}, "lang = 'en' AND source = 'src3'")
_filter_query("f4_date_range", {"date": {"gte": "2024-03-01", "lt": "2024-09-01"}}, "coalesce(created, modified) >= '2024-03-01T00:00:00Z' AND coalesce(created, modified) < '2024-09-01T00:00:00Z'")
_filter_query("f5_date_whole_day", {"date": {"lte": "1971-06-01"}}, "coalesce(created, modified) <= '1971-06-01T23:59:59Z'")
_filter_query("f6_eq", {"fields": {"quality": {"eq": 1}}}, "quality = 1")
_filter_query("f6_eq_type", {"fields": {"quality": {"eq": "1"}}}, "false")
_filter_query("f6_eq_null", {"fields": {"quality": {"eq": None}}}, "quality IS NULL")
_filter_query("f6_ne", {"fields": {"quality": {"ne": 1}}}, "quality <> 1")
_filter_query("f7_in_null", {"fields": {"quality": {"in": [0, None]}}}, "quality = 0 OR quality IS NULL")
_filter_query("f7_nin", {"fields": {"quality": {"nin": [1]}}}, "quality IS NULL OR quality <> 1")
_filter_query("f7_nin_null", {"fields": {"quality": {"nin": [0, None]}}}, "quality IS NOT NULL AND quality <> 0")
_filter_query("f8_contains", {"fields": {"lang": {"contains": "E"}}}, "lang LIKE '%e%'")
_filter_query("f9_is_empty", {"fields": {"note": {"is_empty": True}}}, "note IS NULL OR note = ''")
_filter_query("f10_number_range", {"fields": {"n\\.chars": {"gte": 500, "lt": 2500}}}, "n_chars >= 500 AND n_chars < 2500")
_filter_query("f11_string_range", {"fields": {"lang": {"gt": "en"}}}, "lang > 'en'")
_filter_query("f12_string_range_on_number", {"fields": {"quality": {"lt": "a"}}}, "quality IS NOT NULL")
_filter_query("f13_field_has", {"fields": {"aliases": {"has": "src7"}}}, "source = 'src7'")
_filter_query("f13_field_has_any", {"fields": {"aliases": {"has_any": ["fr", "src4"]}}}, "lang = 'fr' OR source = 'src4'")
_filter_query("f13_field_has_typed", {"fields": {"sizes": {"has": "1"}}}, "false")
_filter_query("f13_field_has_string", {"fields": {"sizes": {"has_any": ["1", "x"]}}}, "n_chars % 2 = 1")
_filter_query("f14_boolean_tree", {"or": [{"not": {"tags": {"has": "en"}}}, {"and": [{"fields": {"quality": {"eq": 0}}}, {"tags": {"has": "en"}}]}]}, "lang <> 'en' OR (quality = 0 AND lang = 'en')")
_filter_query("f14_not_null", {"not": {"fields": {"quality": {"eq": 1}}}}, "quality <> 1")
_filter_query("f15_nested_path", {"fields": {"origin.source": {"eq": "src9"}}}, "source = 'src9'")


@query("f21_scope_subtree", f"SELECT doc_id, file FROM ({_NOTES}) WHERE file LIKE 'src1/%'")
def f21(spark, sf_dir):
    return notes(spark, sf_dir).where(filters.scope("subtree", "src1")).select("doc_id", "file")


@query("f18_iso_calendar_valid", "SELECT doc_id, CASE WHEN doc_id % 28 + 1 <= CASE doc_id % 12 + 1 WHEN 2 THEN 29 ELSE 30 END THEN '2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:00Z' END AS valid, doc_id % 2 = 1 AS feb30_null FROM documents")
def f18(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    s = F.format_string("2024-%02d-%02dT10:00:00Z", F.col("doc_id") % 12 + 1, F.col("doc_id") % 28 + 1)
    odd = F.when(F.col("doc_id") % 2 == 1, F.lit("2024-02-30T10:00:00Z")).otherwise(F.lit("2024-02-29T10:00:00Z"))
    return d.select("doc_id", scalars.iso_calendar_valid(s).alias("valid"), scalars.iso_calendar_valid(odd).isNull().alias("feb30_null"))


# -- full text ----------------------------------------------------------------------------


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("frag_id"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("file"), F.col("text").alias("body"), F.col("source").alias("code"), F.col("lang").alias("headings"))


_TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_-]+')"


def _bm25_sql(phrases: list[tuple[list[str], bool]], tail: str) -> str:
    """BM25 written out: positions of each phrase's last term whose earlier terms precede it."""
    cols = (("body", "text", 2.0), ("code", "source", 0.5), ("headings", "lang", 3.0))
    toks = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS col, {w} AS w, {_TOK.format(c=s)} AS t FROM documents" for c, s, w in cols)
    hits = []
    for i, (terms, star) in enumerate(phrases):
        tests = [f"t[p - {len(terms) - 1 - k}] = '{x}'" if not (star and k == len(terms) - 1) else f"starts_with(t[p], '{x}')" for k, x in enumerate(terms)]
        hits.append(f"SELECT {i} AS phrase, doc_id, sum(w * len(list_filter(range({len(terms)}, len(t) + 1), lambda p: {' AND '.join(tests)}))) AS f FROM tok GROUP BY doc_id HAVING f > 0")
    return f"""
WITH tok AS ({toks}), len_ AS (SELECT doc_id, sum(len(t)) AS d FROM tok GROUP BY doc_id),
st AS (SELECT count(*) AS n, avg(d) AS a FROM len_), hits AS ({" UNION ALL ".join(hits)}),
idf AS (SELECT phrase, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf FROM hits, st GROUP BY phrase, n),
score AS (SELECT doc_id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / a))) AS s, count(*) AS k FROM hits JOIN idf USING (phrase) JOIN len_ USING (doc_id), st GROUP BY doc_id)
SELECT doc_id AS frag_id, source || '/' || doc_id || '.md' AS file, round(s, 6) AS score FROM score JOIN documents USING (doc_id) WHERE k = {len(phrases)} {tail}
"""


_INDEXES: dict[tuple[str, str, bool], fulltext.Postings] = {}


def search_index(spark: SparkSession, sf_dir: str, stem_words: bool = False) -> fulltext.Postings:
    """The stored index of the fragments, built by the first query of an application that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, stem_words)
    if key not in _INDEXES:
        folder = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
        _INDEXES[key] = fulltext.Postings.build(fragments(spark, sf_dir), folder, stem_words=stem_words)
    return _INDEXES[key]


def _search(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search_index(spark, sf_dir).search(text)
    return scored.join(fragments(spark, sf_dir).select("frag_id", "file"), "frag_id").select("frag_id", "file", F.round("score", 6).alias("score"))


@query("b6_bm25_unindexed", _bm25_sql([(["idiot"], False), (["of", "the"], False)], ""))
def b6_unindexed(spark, sf_dir):
    frags = fragments(spark, sf_dir)
    scored = fulltext.bm25(frags, 'idiot "of the"')
    return scored.join(frags.select("frag_id", "file"), "frag_id").select("frag_id", "file", F.round("score", 6).alias("score"))


for _name, _text, _phrases in (
    ("b6_bm25_one_term", "idiot", [(["idiot"], False)]),
    ("b6_bm25_rare_term", "clown", [(["clown"], False)]),
    ("b3_bm25_all_terms", "the that", [(["the"], False), (["that"], False)]),
    ("b4_bm25_phrase", '"of the"', [(["of", "the"], False)]),
    ("b5_bm25_prefix", "anti*", [(["anti"], True)]),
    ("b6_bm25_columns", "src3 en", [(["src3"], False), (["en"], False)]),
):
    QUERIES[_name] = lambda spark, sf_dir, _t=_text: _search(_t, spark, sf_dir)
    ORACLE_SQL[_name] = _bm25_sql(_phrases, "")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search with a filter: scored over the corpus, filtered, first page."""
    found = _search("the that", spark, sf_dir)
    kept = notes(spark, sf_dir).where(filters.compile_filter({"tags": {"has": "en"}, "fields": {"quality": {"eq": 1}}})).select(F.col("doc_id").alias("frag_id"))
    rows = found.join(kept, "frag_id", "left_semi")
    return paging.page(rows, [(F.col("score"), True), (F.col("file"), False)], 50)


QUERIES["q4_search_filtered_page"] = flagship
ORACLE_SQL["q4_search_filtered_page"] = _bm25_sql([(["the"], False), (["that"], False)], "AND lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY round(s, 6) DESC, file LIMIT 50")


@query("o6_keyset_next_page", _bm25_sql([(["the"], False)], "AND (round(s, 6) < 0.000003 OR (round(s, 6) = 0.000003 AND file > 'src1/')) ORDER BY round(s, 6) DESC, file LIMIT 20"))
def o6(spark, sf_dir):
    rows = _search("the", spark, sf_dir)
    return paging.page(rows, [(F.col("score"), True), (F.col("file"), False)], 20, [0.000003, "src1/"])


@query("o2_filter_page", f"SELECT doc_id, file FROM ({_NOTES}) WHERE quality = 1 AND file > 'src12/' ORDER BY file LIMIT 200")
def o2(spark, sf_dir):
    rows = notes(spark, sf_dir).where(filters.compile_filter({"fields": {"quality": {"eq": 1}}})).select("doc_id", "file")
    return paging.page(rows, [(F.col("file"), False)], 500, ["src12/"])


@query("b1_token_stats", "SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, " + _TOK.format(c="text") + " AS t FROM documents)")
def b1(spark, sf_dir):
    t = fulltext.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("b10_bm25_stemmed")
def b10(spark, sf_dir):
    return search_index(spark, sf_dir, stem_words=True).search("heing theres").select("frag_id", F.round("score", 6).alias("score"))


@query("b11_snippets")
def b11(spark, sf_dir):
    top = paging.page(_search("idiot", spark, sf_dir), [(F.col("score"), True), (F.col("file"), False)], 50)
    return snippets.with_snippets(top.join(fragments(spark, sf_dir).select("frag_id", "body", "code"), "frag_id"), "idiot").select("frag_id", "snippet")


# -- scalars ------------------------------------------------------------------------------


@query("p3_stable_id", "SELECT doc_id, 'h:' || substr(sha1(source || ':' || 'h1[' || (doc_id % 7) || ']'), 1, 14) AS stable_id, 't:' || substr(sha1(source), 1, 14) AS tree_id FROM documents")
def p3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.stable_id(F.col("source"), F.format_string("h1[%d]", F.col("doc_id") % 7)).alias("stable_id"), tree.tree_id(F.col("source")).alias("tree_id"))


@query("p7_estimate_tokens", r"SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[^\x00-\x20]') THEN 0 ELSE greatest(1, floor(length(text) / 3.5 + 0.5)) END::BIGINT AS tokens FROM documents")
def p7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.estimate_tokens(F.col("text")).alias("tokens"))


@query("p4_heading_text_and_slug", r"SELECT doc_id, regexp_replace(trim(text), '\s+', ' ', 'g') AS heading, regexp_replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}\s_-]', '', 'g'), '\s', '-', 'g') AS slug FROM documents")
def p4(spark, sf_dir):
    head = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.heading_text(head).alias("heading"), scalars.slug(head).alias("slug"))


_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '/*([?#].*)?$', '')"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/*([?#].*)?$", "").alias("file"))


@query("s5_path_policy", f"""
SELECT page_id, file, CASE WHEN trim(file) = '' THEN 'EMPTY' WHEN length(file) > 1024 THEN 'TOO_LONG' WHEN regexp_matches(file, '%[0-9A-Fa-f]{{2}}') THEN 'PERCENT_ENCODED'
  WHEN starts_with(file, '/') THEN 'ABSOLUTE' WHEN list_contains(string_split(file, '/'), '.') OR list_contains(string_split(file, '/'), '..') THEN 'DOT_SEGMENT'
  WHEN len(string_split(file, '/')) > 32 THEN 'TOO_DEEP' END AS reason
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || f WHEN 1 THEN f || '/../x' WHEN 2 THEN f || '%2e' ELSE f END AS file FROM (SELECT page_id, {_PATH} AS f FROM pages))""")
def s5(spark, sf_dir):
    f, k = F.col("file"), F.col("page_id") % 5
    odd = F.when(k == 0, F.concat(F.lit("/"), f)).when(k == 1, F.concat(f, F.lit("/../x"))).when(k == 2, F.concat(f, F.lit("%2e"))).otherwise(f)
    return paths(spark, sf_dir).select("page_id", odd.alias("file")).withColumn("reason", scalars.path_policy(F.col("file")))


@query("s6_extension_and_names", rf"SELECT page_id, lower(regexp_extract(regexp_extract(file, '[^/]*$'), '.\.([^.]*)$', 1)) AS ext, regexp_extract(file, '[^/]*$') AS base, regexp_replace(file, '/?[^/]*$', '') AS dir FROM (SELECT page_id, {_PATH} || '.MD' AS file FROM pages)")
def s6(spark, sf_dir):
    f = F.concat("file", F.lit(".MD"))
    return paths(spark, sf_dir).select("page_id", scalars.extension(f).alias("ext"), scalars.basename(f).alias("base"), scalars.dirname(f).alias("dir"))


# -- tree ---------------------------------------------------------------------------------

_ITEMS = f"""
f AS (SELECT DISTINCT {_PATH} AS path FROM pages),
dirs AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS path FROM (SELECT string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS i FROM f)),
items AS (SELECT path, 'file' AS type FROM f UNION ALL SELECT path, 'directory' FROM dirs)
"""


@query("s3_tree_items", f"WITH {_ITEMS} SELECT path, regexp_extract(path, '[^/]*$') AS name, type, len(string_split(path, '/'))::INT AS depth, regexp_replace(path, '/?[^/]*$', '') AS parent FROM items")
def s3(spark, sf_dir):
    return tree.items(paths(spark, sf_dir))


@query("a11_children_counts", f"WITH {_ITEMS} SELECT regexp_replace(path, '/?[^/]*$', '') AS parent, count(*) AS n_children FROM items GROUP BY 1")
def a11(spark, sf_dir):
    return tree.children(paths(spark, sf_dir))


@query("o5_tree_dfs", f"WITH {_ITEMS} SELECT path, type, row_number() OVER (ORDER BY list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: {{'f': (i = len(string_split(path, '/')) AND type = 'file')::INT, 'n': string_split(path, '/')[i]}}))::INT AS dfs_rank FROM items")
def o5(spark, sf_dir):
    return tree.ranked(paths(spark, sf_dir)).select("path", "type", "dfs_rank")


# -- outlines -----------------------------------------------------------------------------


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("pos"), level.alias("level"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"), F.col("text").alias("heading_text"))


_HEAD = "h AS (SELECT conv_id::VARCHAR AS file, turn AS pos, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, length(coalesce(text, '')) AS tokens, text AS heading_text FROM conversations)"
_PARENT = f"{_HEAD}, p AS (SELECT *, (SELECT max(b.pos) FROM h b WHERE b.file = a.file AND b.pos < a.pos AND b.level < a.level) AS parent_pos FROM h a)"
_SIB = f"{_PARENT}, s AS (SELECT *, row_number() OVER (PARTITION BY file, parent_pos, level ORDER BY pos) - 1 AS sibling FROM p)"


@query("p1_heading_parents", f"WITH {_PARENT} SELECT file, pos, level, parent_pos FROM p")
def p1(spark, sf_dir):
    return outline.parents(headings(spark, sf_dir)).select("file", "pos", "level", "parent_pos")


@query("p2_structural_paths", f"""WITH RECURSIVE {_SIB}, up AS (
  SELECT file, pos, parent_pos, 'h' || level || '[' || sibling || ']' AS sp FROM s
  UNION ALL SELECT up.file, up.pos, s.parent_pos, 'h' || s.level || '[' || s.sibling || ']/' || up.sp FROM up JOIN s ON s.file = up.file AND s.pos = up.parent_pos)
SELECT file, pos, sp AS structural_path, 'h:' || substr(sha1(file || ':' || sp), 1, 14) AS stable_id FROM up WHERE parent_pos IS NULL""")
def p2(spark, sf_dir):
    return outline.structural_paths(headings(spark, sf_dir)).select("file", "pos", "structural_path", "stable_id")


_END = "e AS (SELECT *, (SELECT min(b.pos) FROM h b WHERE b.file = a.file AND b.pos > a.pos AND b.level <= a.level) AS section_end FROM h a)"


@query("p6_section_ends", f"WITH {_HEAD}, {_END} SELECT file, pos, section_end FROM e")
def p6(spark, sf_dir):
    return outline.section_ends(headings(spark, sf_dir)).select("file", "pos", "section_end")


@query("p12_descendant_tokens", f"WITH {_HEAD}, {_END} SELECT file, pos, (SELECT sum(b.tokens) FROM h b WHERE b.file = e.file AND b.pos >= e.pos AND (e.section_end IS NULL OR b.pos < e.section_end))::BIGINT AS descendant_tokens FROM e")
def p12(spark, sf_dir):
    return outline.descendant_tokens(headings(spark, sf_dir)).select("file", "pos", "descendant_tokens")


@query("j14_fuzzy_recovery")
def j14(spark, sf_dir):
    rows = outline.structural_paths(headings(spark, sf_dir))
    return fuzzy.recover(rows.where("level = 2"), rows.where("level = 3"))


# -- links --------------------------------------------------------------------------------


def link_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select(F.concat(F.regexp_replace("file", "[.]html$", ""), F.lit(".md")).alias("file")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link from each page to another's address: its last segment or two, with an extension, relative
    to the page's folder or the one above, an anchor of the page itself, an asset, or dangling."""
    p = paths(spark, sf_dir).withColumn("file", F.regexp_replace("file", "[.]html$", ""))
    n = F.broadcast(p.agg(F.count(F.lit(1)).alias("pages")))  # one row
    last, two = F.substring_index("file", "/", -1), F.substring_index("file", "/", -2)
    target = p.select(F.col("page_id").alias("t"), F.when(F.col("page_id") % 3 == 0, two).otherwise(last).alias("name"), two.alias("two"), last.alias("last"))
    rows = p.crossJoin(n).select(F.col("page_id").alias("link_id"), F.concat("file", F.lit(".md")).alias("source_file"), ((F.col("page_id") * 7 + 3) % F.col("pages")).alias("t"))
    rows = rows.join(target, "t")
    k, id_ = F.col("link_id") % 11, F.col("link_id")
    plain = F.concat("name", F.when(id_ % 7 == 0, ".html").when(id_ % 5 == 0, "-gone").otherwise(""))
    raw = F.when(k == 1, F.concat(F.lit("./"), "last")).when(k == 2, F.concat(F.lit("../"), "two")).when(k == 3, F.concat(plain, F.lit(".md"))).when(k == 4, "").otherwise(plain)
    anchor = F.when((id_ % 4 == 0) | (k == 4), "#Top").otherwise("")
    return links.parse_target(rows.select("link_id", "source_file", F.concat(raw, anchor).alias("raw_target")))


_EDGES = rf"""
p AS (SELECT page_id, regexp_replace({_PATH}, '[.]html$', '') AS f FROM pages),
files AS (SELECT DISTINCT f || '.md' AS path FROM p),
s AS (SELECT page_id, f, string_split(f, '/') AS x FROM p),
e AS (SELECT a.page_id AS link_id, a.f || '.md' AS source_file, a.page_id % 11 AS k, regexp_replace(a.f, '/?[^/]*$', '') AS dir, b.x[-1] AS last,
   CASE WHEN len(b.x) > 1 THEN array_to_string(b.x[-2:], '/') ELSE b.f END AS two,
   CASE WHEN b.page_id % 3 = 0 AND len(b.x) > 1 THEN array_to_string(b.x[-2:], '/') ELSE b.x[-1] END
   || CASE WHEN a.page_id % 7 = 0 THEN '.html' WHEN a.page_id % 5 = 0 THEN '-gone' ELSE '' END AS plain
   FROM s a JOIN s b ON b.page_id = (a.page_id * 7 + 3) % (SELECT count(*) FROM p)),
t AS (SELECT link_id, source_file, k, k IN (1, 2) AS rel,
   CASE k WHEN 1 THEN CASE WHEN dir = '' THEN last ELSE dir || '/' || last END
          WHEN 2 THEN CASE WHEN dir = '' THEN NULL WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') || '/' || two ELSE two END
          WHEN 3 THEN plain || '.md' WHEN 4 THEN '' ELSE plain END AS target FROM e),
u AS (SELECT *, lower(regexp_extract(regexp_extract(target, '[^/]*$'), '.\.([^.]*)$', 1)) AS ext, regexp_replace(lower(target), '\.md$', '') || '.md' AS want, contains(target, '/') AS slash FROM t),
c AS (SELECT link_id, source_file, k, rel, slash, ext, want, path, len(string_split(path, '/')) AS depth
   FROM u LEFT JOIN files ON ext IN ('', 'md') AND target <> '' AND ends_with('/' || lower(path), '/' || want)),
r AS (SELECT link_id, source_file, k, rel, slash OR rel AS slash, max(CASE WHEN lower(path) = want AND (slash OR rel OR ext = 'md') THEN path END) AS root, count(path) AS n_all,
      count(path) FILTER (depth = md) AS n_min, min(path) FILTER (depth = md) AS one, min(path) AS any_one
      FROM (SELECT *, min(depth) OVER (PARTITION BY link_id) AS md FROM c) GROUP BY ALL),
res AS (SELECT link_id, source_file, CASE WHEN k = 4 THEN source_file WHEN root IS NOT NULL THEN root WHEN rel THEN NULL WHEN slash THEN CASE WHEN n_all = 1 THEN any_one END WHEN n_min = 1 THEN one END AS path,
        NOT rel AND CASE WHEN slash THEN n_all ELSE n_min END > 1 AS several FROM r)
"""


@query("j9_resolve_links", f"WITH {_EDGES} SELECT link_id, source_file, CASE WHEN path IS NOT NULL THEN 'resolved' WHEN several THEN 'ambiguous' ELSE 'unresolved' END AS status, path FROM res")
def j9(spark, sf_dir):
    return links.resolve(edges(spark, sf_dir), link_files(spark, sf_dir)).select("link_id", "source_file", "status", "path")


@query("j11_backlink_counts", f"WITH {_EDGES} SELECT path, count(*) AS n FROM res WHERE path IS NOT NULL AND path <> source_file GROUP BY path")
def j11(spark, sf_dir):
    found = links.resolve(edges(spark, sf_dir), link_files(spark, sf_dir))
    return found.where("path is not null and path <> source_file").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("l12_expand_embeds")
def l12(spark, sf_dir):
    found = links.resolve(edges(spark, sf_dir), link_files(spark, sf_dir))
    first = found.agg(F.min("source_file")).first()[0]
    return links.expand(found.select("source_file", "path"), first)


@query("l1_extract_hrefs", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages")
def l1(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@query("l9_embed_kinds", f"WITH p AS (SELECT page_id, {_PATH} || CASE page_id % 4 WHEN 0 THEN '.PNG#x' WHEN 1 THEN '.pdf' WHEN 2 THEN '.mp3' ELSE '' END AS t FROM pages) SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' WHEN 2 THEN 'media' ELSE 'note' END AS kind FROM p")
def l9(spark, sf_dir):
    k = F.col("page_id") % 4
    t = F.concat("file", F.when(k == 0, ".PNG#x").when(k == 1, ".pdf").when(k == 2, ".mp3").otherwise(""))
    return paths(spark, sf_dir).select("page_id", t.alias("raw_target")).select("page_id", links.embed_kind().alias("kind"))


# -- snapshots ----------------------------------------------------------------------------


def snapshot(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    d = notes(spark, sf_dir).where(F.col("doc_id") % 7 != (1 if new else 2))
    return d.select("file", (F.col("mtime") + (F.when(F.col("doc_id") % 11 == 0, 1.0).otherwise(0.0) if new else F.lit(0.0))).alias("mtime"), F.length("file").cast("long").alias("size"))


_SNAP = f"n AS ({_NOTES}), old AS (SELECT file, doc_id FROM n WHERE doc_id % 7 <> 2), cur AS (SELECT file, doc_id FROM n WHERE doc_id % 7 <> 1)"


@query("j7_reconcile", f"WITH {_SNAP} SELECT coalesce(c.file, o.file) AS file, CASE WHEN o.file IS NULL THEN 'new' WHEN c.file IS NULL THEN 'removed' ELSE 'drift' END AS change FROM cur c FULL JOIN old o ON c.file = o.file WHERE o.file IS NULL OR c.file IS NULL OR c.doc_id % 11 = 0")
def j7(spark, sf_dir):
    return diff.reconcile(snapshot(spark, sf_dir, True), snapshot(spark, sf_dir, False))


@query("j8_vanished_not_failed", f"WITH {_SNAP} SELECT file FROM old WHERE file NOT IN (SELECT file FROM cur) AND NOT starts_with(file, 'src1/') AND NOT starts_with(file, 'src2/en/')")
def j8(spark, sf_dir):
    failed = spark.createDataFrame([("src1",), ("src2/en",)], "prefix string")
    return diff.vanished(snapshot(spark, sf_dir, False).select("file"), snapshot(spark, sf_dir, True).select("file"), failed)


@query("j6_retired_headings", f"WITH {_HEAD} SELECT file, pos FROM h WHERE pos % 2 = 0 AND NOT EXISTS (SELECT 1 FROM h b WHERE b.file = h.file AND b.pos = h.pos AND b.pos % 4 = 0)")
def j6(spark, sf_dir):
    rows = headings(spark, sf_dir).withColumn("stable_id", F.col("pos").cast("string"))
    return diff.retired(rows.where("pos % 2 = 0"), rows.where("pos % 4 = 0").select("file", "stable_id")).select("file", "pos")


@query("k1_replace_files", f"WITH {_SNAP} SELECT file, 1 AS version FROM old WHERE doc_id % 11 <> 0 UNION ALL SELECT file, 2 FROM cur WHERE doc_id % 11 = 0")
def k1(spark, sf_dir):
    old = snapshot(spark, sf_dir, False).select("file").withColumn("version", F.lit(1))
    cur = notes(spark, sf_dir).where("doc_id % 7 <> 1 and doc_id % 11 = 0").select("file").withColumn("version", F.lit(2))
    return diff.replace_files(old, cur, notes(spark, sf_dir).where("doc_id % 11 = 0").select("file"))


@query("t3_last_event_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def t3(spark, sf_dir):
    return diff.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


# -- aggregations -------------------------------------------------------------------------


@query("a2_conditional_counts", "SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS n_en, count(DISTINCT lang) AS n_langs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def a2(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.countDistinct("lang").alias("n_langs"), F.sum("n_chars").alias("chars"))


@query("a5_status_row", "SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM labels) AS labelled, (SELECT max(n_chars) FROM documents) AS longest")
def a5(spark, sf_dir):
    a = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("files"), F.max("n_chars").alias("longest"))
    return a.crossJoin(table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("labelled"))).select("files", "labelled", "longest")  # one row each


@query("a6_basename_buckets", f"SELECT base, array_to_string(list(f ORDER BY depth, f), ',') AS files FROM (SELECT DISTINCT f, lower(regexp_extract(f, '[^/]*$')) AS base, len(string_split(f, '/')) AS depth FROM (SELECT {_PATH} AS f FROM pages)) GROUP BY base")
def a6(spark, sf_dir):
    f = paths(spark, sf_dir).select("file").distinct().select("file", F.lower(scalars.basename(F.col("file"))).alias("base"), F.size(F.split("file", "/")).alias("depth"))
    return f.groupBy("base").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "file"))), lambda s: s["file"]), ",").alias("files"))


@query("a7_case_insensitive_min", f"SELECT lower(f) AS low, min(f) AS path FROM (SELECT {_PATH} AS f FROM pages) GROUP BY 1")
def a7(spark, sf_dir):
    return paths(spark, sf_dir).groupBy(F.lower("file").alias("low")).agg(F.min("file").alias("path"))


@query("a9_kind_union", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id")
def a9(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("a10_duplicates_having", "SELECT text_hash, count(*) AS n FROM (SELECT sha1(text) AS text_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def a10(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("text_hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("a12_shape_hash", f"SELECT sha1(string_agg(f, chr(10) ORDER BY f)) AS shape FROM (SELECT DISTINCT {_PATH} AS f FROM pages)")
def a12(spark, sf_dir):
    return paths(spark, sf_dir).select("file").distinct().agg(F.sha1(F.array_join(F.sort_array(F.collect_list("file")), "\n").cast("binary")).alias("shape"))


@query("a15_nearest_rank", "SELECT lang, quantile_disc(n_chars, 0.5)::BIGINT AS p50, quantile_disc(n_chars, 0.95)::BIGINT AS p95 FROM documents GROUP BY lang")
def a15(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.expr("percentile_disc(0.5) within group (order by n_chars)").cast("long").alias("p50"), F.expr("percentile_disc(0.95) within group (order by n_chars)").cast("long").alias("p95"))


@query("a16_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def a16(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (-F.col("o_orderkey")).alias("neg"), "o_orderkey")
    return diff.last_wins(o, ["o_custkey"], "neg").select("o_custkey", "o_orderkey")


@query("j2_left_join_stats", "SELECT c_custkey, coalesce(count(o_orderkey), 0) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j2(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(per, c["c_custkey"] == per["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("j4_semi_and_existence", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) OR o_orderpriority LIKE '1%'")
def j4(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("large", F.lit(True))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(large, "o_orderkey", "left").where(F.col("large") | F.col("o_orderpriority").startswith("1")).select("o_orderkey")

"""A small vault end to end: parse, index, search, links, outline, history, tree."""

import pytest

from folioframe.errors import VaultError
from folioframe.functions.porter import stem
from folioframe.parse import markdown, prisma, specs, yaml12
from folioframe.parse.model import ParseError
from folioframe.plans import paging
from folioframe.sources.index import VaultIndex
from folioframe.vault import Vault

NOTES = {
    "index.md": "Start [[auth]] and ![[notes/oauth#Flow]]\n\nText here ^toc\n",
    "notes/auth.md": "---\ntitle: Auth\ntags: [Security/Login, api]\ncreated: 2024-01-05\npriority: 5\n---\nIntro\n\n# Auth\n\nTokens are `[[not a link]]` renewed.\n\n```ts\n# not a heading [[x]]\n```\n\n## Flow\n\nlogin flow with tokens\n\n## Flow\n\nsecond\n",
    "notes/oauth.md": "# OAuth\n\nSee [[auth#Flow]] and [[missing]].\n\nFlow\n----\n\n- item ^b1\n",
    "_u/e.md": "plain\n",
    ".hidden.md": "# no\n",
    "bad.md": "---\na: 1\na: 2\n---\nx\n",
    "api.yaml": "openapi: 3.0.3\ninfo: {title: Pets, version: '1'}\npaths:\n  /pets:\n    parameters: [{name: a, in: query}]\n    get: {operationId: list, summary: All, responses: {'200': {description: ok}}}\n    post: {responses: {'201': {description: made}}}\n",
    "ev.yml": "asyncapi: 3.0.0\ninfo: {title: Ev, version: '1'}\nchannels:\n  c: {address: lights/on, messages: {m: {}}}\noperations:\n  onLight: {action: receive, channel: {$ref: '#/channels/c'}}\n",
    "schema.prisma": '/// A user\nmodel User {\n  id Int @id\n  /// mail\n  email String // x\n  @@map("users")\n}\n/* note */\ndatasource db {\n  provider = "pg"\n}\n',
}


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for name, text in NOTES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    index = VaultIndex(spark, str(root), str(tmp_path_factory.mktemp("index")))
    with pytest.raises(VaultError):
        Vault(index).get_metadata("index.md")
    index.refresh()
    return Vault(index)


def test_files(vault):
    rows = {r["file"]: r["error"] for r in vault.index.table("files").collect()}
    assert set(rows) == set(NOTES) - {".hidden.md"}
    assert rows["bad.md"] == "syntax" and rows["_u/e.md"] is None


def test_outline_and_ids(vault):
    rows = vault.get_file_outline("notes/auth.md").collect()
    assert [r["heading_text"] for r in rows] == ["Auth", "Flow", "Flow"]
    assert [r["structural_path"] for r in rows] == ["h1[0]", "h1[0]/h2[0]", "h1[0]/h2[1]"]
    assert [r["slug"] for r in rows] == ["auth", "flow", "flow-1"]
    assert rows[0]["kinds"] == ["code"]


def test_links(vault):
    rows = {r["raw_target"]: r for r in vault.get_links("notes/auth.md").collect()}
    assert rows["auth"]["path"] == "notes/auth.md" and rows["auth"]["source_file"] == "index.md"
    assert rows["auth#Flow"]["duplicate_heading"] and rows["auth#Flow"]["target_stable_id"]
    status = {r["raw_target"]: r["status"] for r in vault.resolved_links().collect()}
    assert status["missing"] == "unresolved" and "not a link" not in status and status["notes/oauth#Flow"] == "resolved"


def test_relative_and_own_links(spark):
    """Targets from the source file's folder, and anchors of the source file itself."""
    from folioframe.operators import links

    files = ["a.md", "x.md", "notes/x.md", "notes/a.md", "notes/Deep/y.yaml", "notes/d.png.md", "other/x.md", "z/q/x.md", "b/only.md", "c/d/only.md", "b/twin.md", "c/twin.md"]
    want = {
        ("notes/a.md", "./x"): "notes/x.md",
        ("notes/a.md", "./X.md#Top"): "notes/x.md",
        ("notes/a.md", "../x"): "x.md",
        ("notes/a.md", "./deep/../x"): "notes/x.md",
        ("notes/a.md", "./deep/y"): None,
        ("notes/a.md", "./deep/y.yaml"): None,
        ("a.md", "only.md"): "b/only.md",
        ("a.md", "only"): "b/only.md",
        ("a.md", "twin"): None,
        ("a.md", "twin.md"): None,
        ("a.md", "q/x.md"): "z/q/x.md",
        ("a.md", "q/x.yaml"): None,
        ("a.md", "d.png"): None,
        ("a.md", "notes/d.png"): None,
        ("notes/Deep/y.yaml", "../../other/x#^b"): "other/x.md",
        ("notes/Deep/y.yaml", "../a"): "notes/a.md",
        ("a.md", "./x"): "x.md",
        ("a.md", "../x"): None,
        ("notes/a.md", "../../notes/x"): None,
        ("notes/a.md", "./q/x"): None,
        ("notes/a.md", "./d.png"): None,
        ("notes/a.md", "./x/"): None,
        ("notes/a.md", "./x.md/.."): None,
        ("notes/a.md", "./"): None,
        ("notes/a.md", "#Top"): "notes/a.md",
        ("notes/a.md", "#^b"): "notes/a.md",
        ("notes/a.md", "#"): None,
        ("notes/a.md", "# > "): None,
        ("notes/a.md", ""): None,
        ("a.md", "notes/x"): "notes/x.md",
        ("a.md", "q/x"): "z/q/x.md",
    }
    rows = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(want)], "link_id long, source_file string, raw_target string")
    found = links.resolve(links.parse_target(rows), spark.createDataFrame([(f,) for f in files], "file string")).cache()
    assert {(r["source_file"], r["raw_target"]): r["path"] for r in found.collect()} == want
    assert found.where("(status = 'resolved') <> (path is not null)").count() == 0
    assert {r["source_file"] for r in links.backlinks(found, "notes/a.md").collect()} == {"notes/Deep/y.yaml"}
    status = {r["raw_target"]: r["status"] for r in found.collect()}
    assert status["twin"] == status["twin.md"] == "ambiguous" and status["d.png"] == "unresolved"
    heads = spark.createDataFrame([("notes/a.md", "Top", "h:1", 0)], "file string, heading_text string, stable_id string, pos int")
    assert {r["raw_target"] for r in links.resolve_headings(found, heads).where("target_stable_id = 'h:1'").collect()} == {"#Top"}


def test_heading_paths_and_blocks(spark):
    """``A > B`` asks for a path, a single segment for a text; a block leads to the heading that holds it."""
    from folioframe.operators import links

    targets = ["x#A > B", "x#B", "x#a", "x#A > C", "x#^b1", "x#^gone", "x# A  ›  B "]
    rows = spark.createDataFrame([(i, "s.md", t) for i, t in enumerate(targets)], "link_id long, source_file string, raw_target string")
    found = links.resolve(links.parse_target(rows), spark.createDataFrame([("x.md",)], "file string"))
    heads = spark.createDataFrame([("x.md", "B", ["B"], "h:0", 0), ("x.md", "A", ["A"], "h:1", 1), ("x.md", "B", ["A", "B"], "h:2", 2)], "file string, heading_text string, heading_path array<string>, stable_id string, pos int")
    blocks = spark.createDataFrame([("x.md", "b1", 9, "h:2"), ("x.md", "b1", 20, "h:0")], "file string, block_id string, range_start int, stable_id string")
    got = {r["raw_target"]: (r["target_stable_id"], r["duplicate_heading"], r["block_stable_id"]) for r in links.resolve_blocks(links.resolve_headings(found, heads), blocks).collect()}
    assert got == {"x#A > B": ("h:2", False, None), "x#B": ("h:0", True, None), "x#a": ("h:1", False, None), "x#A > C": (None, False, None), "x#^b1": (None, False, "h:2"), "x#^gone": (None, False, None), "x# A  ›  B ": ("h:2", False, None)}


def test_pages(vault):
    """Pages of links and of the tree, one after the other, are the whole in its order."""
    for page, whole in ((lambda c: vault.get_links_page("notes/auth.md", page_size=1, cursor=c), vault.get_links("notes/auth.md")), (lambda c: vault.get_vault_tree_page("", 5, page_size=2, cursor=c), vault.get_vault_tree("", 5))):
        rows, cursor = [], None
        while True:
            found, cursor = page(cursor)
            rows += found.collect()
            if cursor is None:
                break
        assert len(rows) > 1 and [tuple(r) for r in rows] == [tuple(r) for r in whole.select(found.columns).collect()]
    with pytest.raises(VaultError):
        vault.get_vault_tree_page("notes", 5, cursor=vault.get_vault_tree_page("", 5, page_size=2)[1])


def test_reader_errors_are_kept(spark):
    """A file that its reader couldn't give is a row with its error and size, and has no fragments."""
    from folioframe.parse import shred

    rows = spark.createDataFrame([("a.md", None, 1.0, 99, "too_large"), ("b.md", bytearray(b"# B\n"), 1.0, 4, None)], "file string, content binary, mtime double, size long, error string")
    t = shred.tables(shred.shred(rows))
    assert {(r["file"], r["error"], r["size"]) for r in t["files"].collect()} == {("a.md", "too_large", 99), ("b.md", None, 4)}
    assert {r["file"] for r in t["fragments"].collect()} == {"b.md"}


def test_written_targets():
    from folioframe.parse.model import wikilinks

    text = "[[./../target]] [[./x]] [[a/./b]] [[../y]]"
    assert [x["raw_target"] for x in wikilinks(text, 0, len(text), [])] == ["../target", "./x", "a/b", "../y"]


def test_search(vault):
    page, _ = vault.search("token")
    assert page.first()["file"] == "notes/auth.md" and "**" in page.first()["snippet"]
    only, _ = vault.search("", {"tags": {"has": "security"}, "fields": {"priority": {"gte": 4}}})
    assert {r["file"] for r in only.collect()} == {"notes/auth.md"}
    assert vault.search("")[0].count() == 0
    one, cursor = vault.search("flow", page_size=1)
    two, _ = vault.search("flow", page_size=1, cursor=cursor)
    assert one.collect() != two.collect()
    with pytest.raises(VaultError):
        vault.search("other", page_size=1, cursor=cursor)


def test_specs(vault):
    heads = [r["heading_text"] for r in vault.get_file_outline("api.yaml").collect()]
    assert heads == ["Pets", "GET /pets", "POST /pets", "Spec metadata"]
    assert "RECEIVE lights/on" in [r["heading_text"] for r in vault.get_file_outline("ev.yml").collect()]
    rows = vault.get_fragment("schema.prisma").collect()
    assert [r["heading_text"] for r in rows] == ["model User", "datasource db", "Schema notes"]
    assert "Table: users" in rows[0]["body"] and "mail" in rows[0]["body"]


def test_tree_and_info(vault):
    rows = vault.get_vault_tree("", 0).collect()
    assert [r["name"] for r in rows][:2] == ["_u", "notes"] and rows[1]["n_children"] == 2
    assert vault.get_server_info()["state"] == "warm"
    assert vault.read_note("_u/e.md") == "plain\n"


def test_refresh_and_history(vault):
    import os

    before = vault.index.manifest["snapshot"]
    assert vault.index.refresh() == before
    path = os.path.join(vault.index.vault, "notes/oauth.md")
    old = vault.get_file_outline("notes/oauth.md").collect()
    with open(path, "w") as f:
        f.write("# OAuth\n\nnew text\n")
    os.utime(path, (2e9, 2e9))
    os.remove(os.path.join(vault.index.vault, "_u/e.md"))
    assert vault.index.refresh() > before
    assert [r["stable_id"] for r in vault.index.history().collect()] == [old[1]["stable_id"]]
    assert vault.get_fragment("notes/oauth.md", stable_id=old[1]["stable_id"]).first()["heading_text"] == "OAuth"
    assert not vault.index.table("files").where("file = '_u/e.md'").take(1)


def test_markdown_shapes():
    p = markdown.parse("Title\n=====\n\n> # quoted\n\n- # in list\n\n    # code\n\n### Deep **bold** `x` ^id\n\n| a |\n|---|\n| b |\n", "f.md")
    assert [(h.level, h.text) for h in p.headings] == [(1, "Title"), (3, "Deep bold x ^id")]
    assert p.headings[1].kinds == ["table"]


def test_yaml_is_1_2():
    assert yaml12.load("a: yes\nb: 2024-01-01\nc: 010\nd: 0o10\ne: .nan\nf: null") == {"a": "yes", "b": "2024-01-01", "c": 10, "d": 8, "e": None, "f": None}
    with pytest.raises(ParseError):
        yaml12.load("a: 1\na: 2")


def test_opaque_yaml_and_empty_prisma():
    assert specs.parse("a: 1", "x.yaml").headings == [] and prisma.parse("", "x.prisma").headings == []


@pytest.mark.parametrize("word,root", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("falling", "fall"), ("relational", "relat"), ("happy", "happi"), ("controlling", "control"), ("adjustment", "adjust"), ("probate", "probat"), ("rate", "rate")])
def test_porter(word, root):
    assert stem(word) == root


def test_cursor_round_trip():
    c = {"sort": "s", "request_hash": "r", "snapshot": 1, "last": ["é"]}
    assert paging.decode(paging.encode(c), "s", "r", 1) == c
    with pytest.raises(VaultError):
        paging.decode("!!", "s", "r", 1)


def test_stream_of_changes(spark, tmp_path):
    from folioframe.streaming.changes import follow

    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.md").write_text("# A\n")
    index = VaultIndex(spark, str(tmp_path / "v"), str(tmp_path / "i"))
    follow(index, str(tmp_path / "c")).awaitTermination(120)
    assert [r["file"] for r in index.table("files").collect()] == ["a.md"]

"""The link graph as joins: targets, resolution in phases, backlinks, headings, embeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.functions.scalars import basename, dirname, extension
from folioframe.storage import staged

#: Extensions that a link may lead to; a target with another one is an asset.
LINKABLE = ("md",)
HEADING_SPLIT = r"\s+(?:(?<!\\)[›>]\s+)+"


def parse_target(links: DataFrame, col: str = "raw_target") -> DataFrame:
    """Adds target_file, target_heading and target_block of ``file#heading`` or ``file#^block``."""
    t = F.col(col)
    sub = F.when(t.contains("#"), F.substring(t, F.instr(t, "#") + 1, F.length(t)))
    block = sub.startswith("^")
    return links.withColumns(
        {
            "target_file": F.trim(F.substring_index(t, "#", 1)),
            "target_heading": F.when(~block, F.trim(sub)),
            "target_block": F.when(block, F.substring(F.trim(sub), 2, 1 << 20)),
        }
    )


def embed_kind(target: str = "raw_target"):
    ext = extension(F.substring_index(F.col(target), "#", 1))
    return (
        F.when(ext.isin("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "avif"), "image")
        .when(ext == "pdf", "pdf")
        .when(ext.isin("mp3", "wav", "ogg", "m4a", "flac", "mp4", "webm", "mov", "mkv", "ogv"), "media")
        .otherwise("note")
    )


def _suffix_keys(files: DataFrame) -> DataFrame:
    """(key, typed, n, least, n_least, path, least_path): files by each suffix of their path.

    A file has a row for each of its last 1, 2, .. segments without its extension, and with it
    (``typed``). All files of a key are one row, so a link meets one row, however common its name.
    """
    low = F.lower("file")
    parts = F.split(F.regexp_replace(low, r"\.[^./]*$", ""), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    rows = files.select(F.col("file").alias("path"), F.size(parts).alias("depth"), extension(F.col("file")).alias("ext"), F.explode(ends).alias("end"))
    both = F.array(F.struct(F.col("end").alias("key"), F.lit(False).alias("typed")), F.struct(F.concat_ws(".", "end", "ext").alias("key"), F.lit(True).alias("typed")))
    rows = rows.select("path", "depth", F.explode(both).alias("k")).select("path", "depth", "k.*")
    per = rows.groupBy("key", "typed", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    return per.groupBy("key", "typed").agg(F.sum("n").alias("n"), F.min("path").alias("path"), F.min(F.struct("depth", "n", "path")).alias("l")).select("key", "typed", "n", "path", F.col("l.n").alias("n_least"), F.col("l.path").alias("least_path"))


def source_relative(target, source):
    """The vault path of a ``./`` or ``../`` target of a source file; NULL if empty or outside the vault."""
    parts = F.split(F.concat_ws("/", dirname(source), target), "/")
    up = lambda a: F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x.isin("", "."), a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    return F.when(~target.endswith("/") & (F.size(kept) > 0), F.array_join(kept, "/"))


def resolve(links: DataFrame, files: DataFrame, key: str = "link_id") -> DataFrame:
    """link key, status (resolved, ambiguous, unresolved) and path of every link.

    A target that starts with ``./`` or ``../`` is looked up from the source file's folder
    alone; an anchor without a file is the source file's own, whatever ``files`` holds. A target
    with an extension that isn't LINKABLE is an asset and unresolved. Others with a slash or an
    extension are looked up as a path (as it is, or with one of the extensions in order); then,
    with a slash, as a path suffix that one file alone has; a bare name, with or without
    extension, by its base name, where the strictly shallowest path wins. All links go through
    the same two equality joins, each with one row a key; what the phase before left open counts
    in the next.
    """
    files = files.where(extension(F.col("file")).isin(*LINKABLE)).select("file").distinct()
    exact = files.groupBy(F.lower("file").alias("want")).agg(F.min("file").alias("root"))
    target = F.col("target_file")
    relative = target.rlike(r"^\.\.?/")
    low = F.when(relative, F.lower(source_relative(target, F.col("source_file")))).otherwise(F.lower(target))
    todo = links.withColumns({"_low": low, "_relative": relative, "_slash": target.contains("/")})
    ext = extension(F.coalesce("_low", F.lit("")))
    todo = todo.withColumn("_typed", ext.isin(*LINKABLE)).withColumn("_open", (target != "") & F.col("_low").isNotNull() & (F.col("_typed") | (ext == "")))
    tries = F.when(F.col("_typed"), F.array(F.struct(F.lit(0).alias("nth"), F.col("_low").alias("want")))).otherwise(F.array(*[F.struct(F.lit(i).alias("nth"), F.concat("_low", F.lit(f".{e}")).alias("want")) for i, e in enumerate(LINKABLE)]))
    wanted = todo.where("_open and (_slash or _typed)").select(key, F.explode(tries).alias("t")).select(key, "t.*")
    root = wanted.join(exact, "want").groupBy(key).agg(F.min(F.struct("nth", "root")).alias("b")).select(key, F.col("b.root").alias("_root"))
    bare = F.when(F.col("_typed"), F.regexp_replace("_low", r"\.[^./]*$", "")).otherwise(F.col("_low"))
    names = todo.where("_open and not _relative").select(key, F.col("_slash").alias("slash"), F.when(F.col("_slash"), F.col("_low")).otherwise(bare).alias("key"), (F.col("_slash") & F.col("_typed")).alias("typed"))
    by_name = names.join(_suffix_keys(files), ["key", "typed"]).select(key, F.when(F.col("slash"), F.col("n")).otherwise(F.col("n_least")).alias("_n"), F.when(F.col("slash"), F.col("path")).otherwise(F.col("least_path")).alias("_name"))
    out = todo.join(root, key, "left").join(by_name, key, "left")
    own = (target == "") & (F.coalesce(F.col("target_heading").rlike(r"[^\s>]"), F.lit(False)) | F.col("target_block").isNotNull())
    path = F.coalesce("_root", F.when(F.col("_n") == 1, F.col("_name")), F.when(own, F.col("source_file")))
    status = F.when(path.isNotNull(), "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("unresolved")
    return out.select(*links.columns, status.alias("status"), F.when(status == "resolved", path).alias("path"))


def backlinks(resolved: DataFrame, file: str) -> DataFrame:
    """Links that resolve to a file, without those inside it."""
    return resolved.where((F.col("path") == file) & (F.col("source_file") != file))


def heading_path(heading):
    """The segments of ``A > B`` as a target writes it, white space collapsed, empty ones left out."""
    parts = F.transform(F.split(heading, HEADING_SPLIT), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\\([>›\\])", "$1"), r"\s+", " ")))
    return F.filter(parts, lambda x: x != "")


def resolve_headings(links: DataFrame, headings: DataFrame, key: str = "link_id") -> DataFrame:
    """The first heading of the target file with the linked text, and whether it is the only one.

    Several segments (``A > B``) ask for the heading of exactly that path, where ``headings`` has
    ``heading_path``; a single one for any heading of that text.
    """
    parts = heading_path(F.col("target_heading"))
    want = F.when(F.size(parts) > 1, F.concat(F.lit("p:"), F.to_json(parts))).otherwise(F.concat(F.lit("t:"), F.lower(F.element_at(parts, 1))))
    asked = links.where("path is not null and target_heading is not null").where(F.size(parts) > 0).select(key, "path", want.alias("want"))
    have = headings.select(F.col("file").alias("path"), F.concat(F.lit("t:"), F.lower("heading_text")).alias("want"), "stable_id", "pos")
    if "heading_path" in headings.columns:
        have = have.unionByName(headings.select(F.col("file").alias("path"), F.concat(F.lit("p:"), F.to_json("heading_path")).alias("want"), "stable_id", "pos"))
    have = have.groupBy("path", "want").agg(F.min(F.struct("pos", "stable_id")).alias("h"), F.count(F.lit(1)).alias("n"))
    hit = asked.join(have, ["path", "want"]).select(key, "h", "n")
    return links.join(hit, key, "left").select(*links.columns, F.col("h.stable_id").alias("target_stable_id"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("duplicate_heading"))


def resolve_blocks(links: DataFrame, blocks: DataFrame, key: str = "link_id") -> DataFrame:
    """The heading that holds the linked block (the first of its name), as ``block_stable_id``."""
    first = blocks.groupBy(F.col("file").alias("path"), F.col("block_id").alias("target_block")).agg(F.min(F.struct("range_start", "stable_id")).alias("b"))
    hit = links.where("path is not null and target_block is not null").select(key, "path", "target_block").join(first, ["path", "target_block"]).select(key, F.col("b.stable_id").alias("block_stable_id"))
    return links.join(hit, key, "left").select(*links.columns, "block_stable_id")


def expand(embeds: DataFrame, source: str, max_depth: int = 10) -> DataFrame:
    """(target, depth, outcome) of the embeds reachable from a file; cycles end a path.

    Each level is a join on the last level's targets alone; levels are staged, so the plan
    doesn't grow, and the walk ends with the first empty one.
    """
    graph = staged(embeds.select("source_file", F.col("path").alias("next")), "embeds")
    level = graph.where(F.col("source_file") == source).select(F.col("next").alias("target"), F.lit(1).alias("depth"), F.array(F.lit(source)).alias("way"))
    level = out = staged(level, "embeds")
    for depth in range(2, max_depth + 1):
        open_ = level.where("target is not null and not array_contains(way, target)")
        step = open_.join(graph, open_["target"] == graph["source_file"]).select(F.col("next").alias("target"), F.lit(depth).alias("depth"), F.concat("way", F.array("target")).alias("way"))
        level = staged(step, "embeds")
        if not level.take(1):
            break
        out = out.unionByName(level)
    outcome = F.when(F.col("target").isNull(), "unresolved").when(F.expr("array_contains(way, target)"), "cycle").otherwise("ok")
    return out.select("target", "depth", outcome.alias("outcome"), F.array_join("way", ">").alias("way"))

"""Operators on layered file trees: entries (layer, seq, path, typeflag, ...), later layers on top.

Markers: a name `.wh.X` removes X with its subtree from lower layers, `.wh..wh..opq` empties its directory of them. Prefixes meet by an
equi-join on a path's ancestors, so no path is compared with every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerframe.functions.scalars import basename, clean_path, dirname, remove_last_slash
from layerframe.plans.ordered import running_sum
from layerframe.sources import layer_files

MARK, OPAQUE = ".wh.", ".wh..wh..opq"


def ancestors(path: Column) -> Column:
    """Proper prefixes of a clean rooted path, the root left out: /a/b/c gives /a and /a/b."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))


def _up(path: Column) -> Column:
    return F.when(F.size(F.filter(F.split(path, "/"), lambda x: x != "")) > 1, ancestors(path)).otherwise(F.array().cast("array<string>"))


def split_markers(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries without markers, markers as (target, opaque, layer))."""
    base, folder = basename(F.col("path")), dirname(F.col("path"))
    is_mark = base.startswith(MARK)
    marks = entries.where(is_mark).select(
        F.when(base == OPAQUE, remove_last_slash(folder)).otherwise(F.concat(folder, F.substring(base, len(MARK) + 1, 1 << 20))).alias("target"),
        (base == OPAQUE).alias("opaque"), "layer")
    return entries.where(~is_mark), marks


def apply_whiteouts(entries: DataFrame) -> DataFrame:
    """Entries that no marker of a higher layer removes; those of the marker's own layer survive."""
    kept, marks = split_markers(entries)
    top = marks.groupBy("target", "opaque").agg(F.max("layer").alias("mark_layer"))
    key = ["layer", "seq", "path"]
    selfs = kept.select(*key, F.col("path").alias("target"), F.lit(False).alias("proper"))
    ups = kept.select(*key, F.explode(_up(F.col("path"))).alias("target"), F.lit(True).alias("proper"))
    dead = selfs.union(ups).join(top, "target").where("mark_layer > layer AND (proper OR NOT opaque)").select(*key).distinct()
    return kept.join(dead, key, "left_anti")


def latest(entries: DataFrame) -> DataFrame:
    """One row per path: the entry that is applied last."""
    row = F.struct("layer", "seq", *[c for c in entries.columns if c not in ("path", "layer", "seq")])
    return entries.groupBy("path").agg(F.max_by(row, F.struct("layer", "seq")).alias("r")).select("path", "r.*")


def replace_types(entries: DataFrame) -> DataFrame:
    """Without the entries below a path that something other than a directory took over later."""
    blocks = entries.where("typeflag <> '5'").groupBy(F.col("path").alias("up")).agg(F.max(F.struct("layer", "seq")).alias("at"))
    key = ["layer", "seq", "path"]
    dead = entries.select(*key, F.explode(_up(F.col("path"))).alias("up")).join(blocks, "up").where(F.col("at") > F.struct("layer", "seq")).select(*key).distinct()
    return entries.join(dead, key, "left_anti")


def merge(entries: DataFrame) -> DataFrame:
    """The tree that all layers make: markers, type changes, last entry per path."""
    return latest(replace_types(apply_whiteouts(entries)))


def implicit_directories(entries: DataFrame, mode: int = 0o755) -> DataFrame:
    """Parents that no entry names, with the default mode, and whether something else than a directory stands in their place."""
    ups = entries.select(F.explode(_up(F.col("path"))).alias("path")).distinct()
    named = entries.groupBy("path").agg(F.max(F.col("typeflag") == "5").alias("_dir"))
    return ups.join(named, "path", "left").where("_dir IS NULL OR NOT _dir").select("path", F.lit(mode).alias("mode"), F.col("_dir").isNotNull().alias("conflict"))


def resolve(paths: DataFrame, links: DataFrame, rounds: int = 40) -> DataFrame:
    """(path, resolved) after following symbolic links (path, linkname) in any component; null behind `rounds` links.

    Every round is written to a folder of its own, so that plans stay short; the round before goes.
    """
    spark = paths.sparkSession
    work = layer_files.shared_folder(spark, "resolve")
    done = paths.select("path", clean_path(F.col("path")).alias("resolved"), F.lit(False).alias("done"))
    to = links.select(F.col("path").alias("_l"), "linkname")
    for i in range(rounds + 1):
        now = layer_files.written(done, f"{work}/{i}")
        if i:
            layer_files.remove(f"{work}/{i - 1}")
        if i == rounds or now.where("NOT done").isEmpty():
            return now.select("path", F.when(F.col("done"), F.col("resolved")).alias("resolved"))
        todo = now.where("NOT done").select("path", "resolved", F.explode(F.concat(_up(F.col("resolved")), F.array("resolved"))).alias("_p"))
        hit = todo.join(to, F.col("_p") == F.col("_l"), "left")
        first = hit.groupBy("path", "resolved").agg(F.min_by(F.struct("_l", "linkname"), F.when(F.col("_l").isNotNull(), F.length("_p"))).alias("h"))
        base = F.when(F.col("h.linkname").startswith("/"), F.col("h.linkname")).otherwise(F.concat(dirname(F.col("h._l")), F.col("h.linkname")))
        rest = F.expr("substring(resolved, length(h._l) + 1)")
        moved = first.select("path", F.when(F.col("h._l").isNotNull(), clean_path(F.concat(base, rest))).otherwise(F.col("resolved")).alias("resolved"), F.col("h._l").isNull().alias("done"))
        done = now.where("done").unionByName(moved)


#: Prefix of extended attributes among PAX records (fixed value).
XATTR = "SCHILY.xattr."


def attributes(entries: DataFrame) -> DataFrame:
    """(path, uid, gid, mtime, mode, xattrs) that entries (path, typeflag, uid, gid, mtime, mode, pax) give their files.

    A symbolic link keeps its mode (null here). Names in `user.` go to regular files and directories only. pax is a map, or null.
    """
    solid = F.col("typeflag").isin("0", "\x00", "7", "1", "5")
    named = F.map_filter(F.coalesce("pax", F.expr("cast(map() AS map<string, string>)")), lambda k, _: k.startswith(XATTR))
    bare = F.transform_keys(named, lambda k, _: F.substring(k, len(XATTR) + 1, 1 << 20))
    xattrs = F.map_filter(bare, lambda k, _: solid | ~k.startswith("user."))
    return entries.select("path", "uid", "gid", "mtime", F.when(F.col("typeflag") != "2", F.col("mode").bitwiseAND(F.lit(0o7777).cast("long"))).alias("mode"), xattrs.alias("xattrs"))


def read_directories(merged: DataFrame) -> DataFrame:
    """(folder, name, kind) of every directory of a merged tree, implicit directories included; the root is /.

    kind: the entry's type flag, 5 for directories that no entry names.
    """
    paths = merged.select("path", "typeflag").union(implicit_directories(merged).where("NOT conflict").select("path", F.lit("5")))
    return paths.where("path <> '/'").select(F.when(dirname(F.col("path")) == "/", "/").otherwise(remove_last_slash(dirname(F.col("path")))).alias("folder"), basename(F.col("path")).alias("name"), F.col("typeflag").alias("kind"))


def header_dump(entries: DataFrame, width: int = 1 << 12) -> DataFrame:
    """Header blocks of an archive one after the other: where each entry's header and data lie when data follow headers.

    An archive is read in the order of seq (one entry each); its offsets are summed inside bins of `width` numbers.
    """
    blocks = F.when(F.col("typeflag") == "0", F.ceil(F.col("size") / 512)).otherwise(F.lit(0)).cast("long")
    placed = running_sum(entries, ["layer"], "seq", blocks + 1, width, "_before")
    return placed.select("layer", "seq", "path", "typeflag", "size", (F.col("_before") * 512).alias("header_offset"), ((F.col("_before") + 1) * 512).alias("data_offset"))


def remote_ranges(dumped: DataFrame, width: int = 1 << 12) -> DataFrame:
    """Regular files as ranges of the archive: (layer, path, offset in the tree's file space, count, roffset)."""
    files = dumped.where("typeflag = '0' AND size > 0")
    padded = (F.ceil(F.col("size") / 4096) * 4096).cast("long")
    return running_sum(files, ["layer"], "seq", padded, width, "offset").select("layer", "path", "offset", F.col("size").alias("count"), F.col("data_offset").alias("roffset"))

"""Roll-ups and statistics of an archive."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fmt, paths
from .layout import running_before


def tree(files: DataFrame) -> DataFrame:
    """(path, parent, depth, size, total_files, folder_count, descendant_count, share) of every folder, duplicates left out.

    ``descendant_count`` counts files and folders below; ``share`` is the percentage of all bytes.
    """
    kept = files.filter("not is_duplicate").withColumn("above", F.explode(paths.ancestors(F.col("path_rel"))))
    sums = kept.groupBy(F.col("above").alias("path")).agg(F.sum("size").alias("size"), F.count("*").alias("total_files"))
    folders = sums.filter("path <> ''").select(F.explode(paths.ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    total = kept.filter("above = ''").agg(F.sum("size").alias("total"))
    joined = sums.join(folders, "path", "left").join(F.broadcast(total))  # one row
    n = F.coalesce("n", F.lit(0).cast("long"))
    return joined.select(
        "path", paths.parent_path(F.col("path")).alias("parent"), paths.depth(F.col("path")).alias("depth"), "size", "total_files",
        n.alias("folder_count"), (n + F.col("total_files")).alias("descendant_count"), F.round(fmt.percent(F.col("size"), F.col("total")), 1).alias("share"),
    )


def largest_children(tree_table: DataFrame) -> DataFrame:
    """Adds ``place``: a folder's rank by size among its siblings."""
    return tree_table.filter("path <> ''").withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("size"), "path")))


def tree_nodes(files: DataFrame) -> DataFrame:
    """(path, parent, name, is_folder, size, size_text, descendant_count, share) of every folder and every file that is no duplicate."""
    folders = tree(files)
    total = files.filter("not is_duplicate").agg(F.sum("size").alias("total"))  # one row
    p = F.col("path_rel")
    own = files.filter("not is_duplicate").join(F.broadcast(total)).select(
        p.alias("path"), paths.parent_path(p).alias("parent"), F.lit(False).alias("is_folder"), "size",
        F.lit(0).cast("long").alias("descendant_count"), F.round(fmt.percent(F.col("size"), F.col("total")), 1).alias("share"),
    )
    both = folders.select("path", "parent", F.lit(True).alias("is_folder"), "size", "descendant_count", "share").union(own)
    return both.select("path", "parent", paths.base_name(F.col("path")).alias("name"), "is_folder", "size", fmt.format_bytes(F.col("size"), 2).alias("size_text"), "descendant_count", "share")


def html(nodes: DataFrame, title: str, limit: int = 5000) -> str:
    """A page of the ``limit`` largest nodes, folders that unfold; the table of nodes itself holds all."""
    rows = nodes.orderBy(F.desc("size"), "path").limit(limit).collect()
    below: dict[str, list] = {}
    for r in rows:
        if r["path"]:
            below.setdefault(r["parent"], []).append(r)
    out = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    stack: list = [iter(below.get("", []))]
    while stack:
        r = next(stack[-1], None)
        if r is None:
            stack.pop()
            out.append("</ul></details></li>" if stack else "")
            continue
        text = f"{escape(r['name'])} <small>{r['size_text']}, {r['share']} %</small>"
        if r["is_folder"]:
            out.append(f"<li><details><summary>{text}, {r['descendant_count']} below</summary><ul>")
            stack.append(iter(below.get(r["path"], [])))
        else:
            out.append(f"<li>{text}</li>")
    return "".join(out)


def overview(files: DataFrame, frame_table: DataFrame) -> DataFrame:
    """One row: an archive's folders beside its statistics."""
    folders = tree(files).filter("path <> ''").agg(F.count("*").alias("folders"))  # one row each
    return compression_stats(files, frame_table).join(F.broadcast(folders))


def progress(frame_table: DataFrame) -> DataFrame:
    """(frame_id, mode, done_bytes, percent): how much of the original bytes is done with each frame, in order."""
    running = running_before(frame_table.select("frame_id", "mode", "original_size"), "original_size", [F.col("frame_id")], "before")
    total = frame_table.agg(F.sum("original_size").alias("total"))  # one row
    done = F.col("before") + F.col("original_size")
    return running.join(F.broadcast(total)).select("frame_id", "mode", done.alias("done_bytes"), fmt.percent(done, F.col("total")).alias("percent"))


def stream_stats(frame_table: DataFrame) -> DataFrame:
    """One row: frames packed and raw, bytes before and after, ratio."""
    raw = F.col("mode") == "raw"
    g = frame_table.agg(
        F.count_if(~raw).alias("packed_frames"), F.count_if(raw).alias("raw_frames"),
        F.coalesce(F.sum("original_size"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("compressed_bytes"),
    )
    return g.withColumn("ratio", fmt.ratio(F.col("original_bytes"), F.col("compressed_bytes")))


def run_summary(restored: DataFrame, seconds: float) -> DataFrame:
    """One row for a restore's report (size, how): files by how they came back, megabytes and their rate."""
    by = {"written": "written", "linked": "linked", "copied": "copied", "failed": "failed"}
    counts = [F.count_if(F.col("how") == how).alias(name) for name, how in by.items()]
    done = restored.agg(*counts, (F.coalesce(F.sum(F.when(F.col("how") != "failed", F.col("size"))), F.lit(0)) / float(1 << 20)).alias("megabytes"))
    rate = F.when(F.col("seconds") > 0, F.col("megabytes") / F.col("seconds")).otherwise(F.lit(0.0))
    return done.withColumn("seconds", F.lit(float(seconds))).withColumn("megabytes_a_second", rate)


def volume_rates(volumes: DataFrame) -> DataFrame:
    """Adds the rate of each volume (bytes, seconds) in megabytes a second, 0 where no time passed."""
    return volumes.withColumn("megabytes_a_second", F.when(F.col("seconds") > 0, F.col("bytes") / float(1 << 20) / F.col("seconds")).otherwise(F.lit(0.0)))


def log_progress(lines: DataFrame) -> DataFrame:
    """(value, percent, rate) of log lines: the last percentage and the last rate in MB/s that a line names, else null."""
    last = lambda pattern: F.try_element_at(F.regexp_extract_all("value", F.lit(pattern), 1), F.lit(-1)).cast("double")
    return lines.select("value", last(r"([0-9]+(?:\.[0-9]+)?) ?%").alias("percent"), last(r"([0-9]+(?:\.[0-9]+)?) ?MB/s").alias("rate"))


def mode_stats(frame_table: DataFrame) -> DataFrame:
    """(mode, label, frames, original_bytes, compressed_bytes, ratio) of (frame_id, mode, original_size, size)."""
    g = frame_table.groupBy("mode").agg(
        F.count("*").alias("frames"), F.sum("original_size").alias("original_bytes"),
        F.sum("size").alias("compressed_bytes"), F.max("frame_id").alias("last_frame"),
    )
    return g.withColumn("label", fmt.mode_label(F.col("mode"))).withColumn("ratio", fmt.ratio(F.col("original_bytes"), F.col("compressed_bytes")))


def volume_stats(frame_table: DataFrame) -> DataFrame:
    """Per volume and mode, with totals running over volumes."""
    g = frame_table.groupBy("volume_no", "mode").agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"))
    running = Window.partitionBy("mode").orderBy("volume_no").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("frames_so_far", F.sum("frames").over(running)).withColumn("bytes_so_far", F.sum("bytes").over(running))


def compression_stats(files: DataFrame, frame_table: DataFrame) -> DataFrame:
    """One row: sizes, counts, volumes, ratio and saving of an archive."""
    f = files.agg(
        F.count("*").alias("files"), F.count_if("is_duplicate").alias("duplicates"),
        F.coalesce(F.sum(F.when(~F.col("is_duplicate"), F.col("size"))), F.lit(0)).alias("original_bytes"),
        F.coalesce(F.sum(F.when(F.col("is_duplicate"), F.col("size"))), F.lit(0)).alias("duplicate_bytes"),
    )
    names = F.array_join(F.sort_array(F.collect_set(F.col("volume_no").cast("string"))), ",")
    v = frame_table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("compressed_bytes"), F.countDistinct("volume_no").alias("volumes"), names.alias("volume_list"))
    both = f.join(F.broadcast(v))  # one row each
    before, after = F.col("original_bytes"), F.col("compressed_bytes")
    return both.withColumn("ratio", fmt.ratio(before, after)).withColumn("saved_percent", fmt.percent(before - after, before))

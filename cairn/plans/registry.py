"""Every archive query by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import ship
from ..functions import fmt, paths
from ..operators import catalog, codecs, dedup, layout, report
from ..sources.corpus import documents_as_files, pages_as_files, table
from ..staging import stage
from ..streaming import frames as frame_stream
from . import archive
from .oracle import CTE, FRAME, VOLUME, bytes_text, next_fit

OLD = StructType().add("path_rel", "string").add("size", "long").add("attrs", "long").add("mtime", "double")
PATTERNS, DICTIONARY = [b"the ", b"ing"], [32, 101, 116]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL after the common table expressions."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {CTE} {sql}"
        return f

    return add


# What the queries start from


def _files(s: SparkSession, d: str) -> DataFrame:
    ship(s)
    return documents_as_files(table(s, d, "documents"))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d).select("path_rel", "size")


def _catalog(s: SparkSession, d: str) -> DataFrame:
    """Computed once a query, however often it is read."""
    return stage(dedup.find_duplicates(_files(s, d)), "catalog")


def _offsets(s: SparkSession, d: str) -> DataFrame:
    return layout.file_offsets(_catalog(s, d))


def _frames(s: SparkSession, d: str, offsets: DataFrame | None = None) -> DataFrame:
    """Frames of an archive without packing: each as large as its bytes."""
    f = layout.frames(_offsets(s, d) if offsets is None else offsets, FRAME)
    return f.withColumn("mode", F.lit("raw")).withColumn("size", F.col("original_size"))


def _volumes(s: SparkSession, d: str, offsets: DataFrame | None = None) -> DataFrame:
    f = _frames(s, d, offsets)
    return f.join(layout.next_fit(f, VOLUME).drop("size"), "frame_id")


def _packed(s: SparkSession, d: str) -> DataFrame:
    """Frames as a codec packs them: (frame_id, mode, original_size, size, payload, volume_no, volume_offset)."""
    return stage(archive.pack(_files(s, d), FRAME, VOLUME).frames, "packed")


def _attrs(s: SparkSession, d: str) -> DataFrame:
    """Columns that the documents lack, derived from their ids."""
    k = F.col("doc_id")
    return table(s, d, "documents").select(
        "doc_id", (k * 37 % 4096).cast("int").alias("attrs"), (k * 86_399.0 + 1.5e9).alias("mtime"), (k % 3 == 0).alias("flag"),
        F.when(k % 7 != 0, k * k * 4099).alias("size"), F.concat("source", F.lit("-"), "lang").alias("sddl"),
    )


def _doc_id(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1).cast("long")


def _entries(s: SparkSession, d: str) -> DataFrame:
    """Catalog rows with frame, volume, packed size, attributes, time and descriptor."""
    files = _catalog(s, d)
    offsets = layout.file_offsets(files)
    placed = catalog.entries(files, offsets, _volumes(s, d, offsets), FRAME)
    own = _attrs(s, d).select("doc_id", "attrs", "mtime", "sddl")
    return stage(placed.withColumn("doc_id", _doc_id(F.col("path_rel"))).join(own, "doc_id").drop("doc_id"), "entries")


def _sample(s: SparkSession, d: str) -> DataFrame:
    """Paths as they come: slashes of both kinds, anchors and doubled separators."""
    parts = [F.lit("C:\\data\\"), "source", F.lit("\\"), "lang", F.lit("//"), F.col("doc_id").cast("string"), F.lit(".txt")]
    return table(s, d, "documents").select("doc_id", F.concat(*parts).alias("p"))


def _sddl_files(s: SparkSession, d: str) -> DataFrame:
    return _sizes(s, d).withColumn("sddl", F.substring_index(F.substring_index("path_rel", "/", 2), "/", -1))


def _digest(column: str = "data") -> Column:
    return F.sha2(column, 256).alias("digest")


# Sources, filters and counts


@query("SELECT path_rel, size FROM files")
def S1_scan(s, d):
    return _sizes(s, d)


@query("""
, g AS (SELECT trim(regexp_replace(url, '^[a-z]+://', ''), '/') AS p, strlen(html) AS z FROM pages)
SELECT CASE WHEN p LIKE '%/%' THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS parent_path,
  count(*) AS n, CAST(sum(z) AS BIGINT) AS bytes FROM g GROUP BY 1""")
def S2_page_tree(s, d):
    pages = catalog.with_parent(pages_as_files(table(s, d, "pages")))
    return pages.groupBy("parent_path").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("""
SELECT path_rel, size, substr(h, 1, 4) AS first2, CASE WHEN size < 2 THEN h ELSE right(h, 4) END AS last2,
  CASE WHEN size < 8 THEN h ELSE substr(h, CAST((size // 2 - 4) * 2 + 1 AS BIGINT), 16) END AS center8
FROM (SELECT *, hex(encode(text)) AS h FROM files)""")
def S4_byte_probes(s, d):
    return dedup.probes(_files(s, d)).drop("digest")


@query("""
SELECT path_rel, size, array_to_string(list_transform(range(0, greatest(1, (size + 1023) // 1024)),
  lambda i: sha256(unhex(substr(h, CAST(i * 2048 + 1 AS BIGINT), 2048)))), ',') AS digests
FROM (SELECT *, hex(encode(text)) AS h FROM files)""")
def S5_chunk_digests(s, d):
    return dedup.chunk_digests(_files(s, d), 1024).select("path_rel", "size", F.array_join("digests", ",").alias("digests"))


@query("SELECT DISTINCT path_rel FROM files")
def S14_selection_lines(s, d):
    lines = F.concat(F.lit("  C:\\"), F.translate("path_rel", "/", "\\"), F.lit(" "))
    return catalog.read_selection(_files(s, d).select(lines.alias("value")))


@query("SELECT path_rel, size FROM files WHERE size > 0")
def P1_non_empty(s, d):
    return _sizes(s, d).filter("size > 0")


@query("SELECT path_rel, size FROM cat WHERE NOT is_duplicate")
def P2_unique_files(s, d):
    return _catalog(s, d).filter("not is_duplicate").select("path_rel", "size")


@query("SELECT path_rel FROM cat WHERE NOT is_duplicate AND size > 0")
def P3_framed_files(s, d):
    return _catalog(s, d).filter("not is_duplicate and size > 0").select("path_rel")


@query("SELECT path_rel, 'src1/en' AS parent_path, size FROM files WHERE regexp_replace(path_rel, '/[^/]*$', '') = 'src1/en'")
def P4_children(s, d):
    return catalog.with_parent(_sizes(s, d)).filter("parent_path = 'src1/en'").select("path_rel", "parent_path", "size")


@query("SELECT DISTINCT regexp_replace(path_rel, '/[^/]*$', '') AS parent_path FROM files WHERE path_rel LIKE 'src1/%'")
def P5_parent_prefix(s, d):
    return catalog.with_parent(_sizes(s, d)).filter(F.col("parent_path").startswith("src1/")).select("parent_path").distinct()


@query("SELECT path_rel FROM files WHERE path_rel LIKE '%/%'")
def P6_non_root(s, d):
    return catalog.with_parent(_sizes(s, d)).filter("parent_path <> ''").select("path_rel")


@query("SELECT path_rel, size FROM files WHERE path_rel ILIKE 'SRC_/%/0000%5.TXT' ORDER BY path_rel LIMIT 200")
def P7_Q18_wildcards(s, d):
    return catalog.search(_sizes(s, d), "SRC_/%/0000%5.TXT", 200)


@query("SELECT path_rel, size FROM files")
def P9_root_folder(s, d):
    return catalog.files_in_folder(_sizes(s, d), "/")


@query("SELECT path_rel, original_path FROM cat WHERE is_duplicate AND original_path IS NOT NULL")
def P10_named_originals(s, d):
    return _catalog(s, d).filter("is_duplicate and original_path is not null").select("path_rel", "original_path")


@query("SELECT frame_id, frame_end - frame_start AS original_size, true AS stored, true AS chosen FROM fr0")
def P12_raw_choice(s, d):
    """Frames that a codec packed: what is stored has the size that is told, and is raw exactly where packing gains nothing."""
    raw = F.col("mode") == "raw"
    chosen = (F.col("size") > 0) & (raw == (F.col("size") == F.col("original_size"))) & (F.col("size") <= F.col("original_size"))
    return _packed(s, d).select("frame_id", "original_size", (F.octet_length("payload") == F.col("size")).alias("stored"), chosen.alias("chosen"))


@query("SELECT count(*) AS frames, true AS agree FROM fr0")
def P13_frame_routes(s, d):
    """Frames by route, packed or raw: the routes' numbers add up to all frames and agree with the sizes."""
    packed = _packed(s, d)
    routes = packed.groupBy(F.col("mode").startswith("lz").alias("packed")).agg(F.count("*").alias("n"))
    smaller = packed.groupBy((F.col("size") < F.col("original_size")).alias("packed")).agg(F.count("*").alias("m"))
    return routes.join(smaller, "packed", "full").agg(F.sum("n").alias("frames"), F.every(F.coalesce(F.col("n") == F.col("m"), F.lit(False))).alias("agree"))


@query("SELECT CASE WHEN size <= 52428800 THEN 'small' ELSE 'large' END AS class, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def P14_size_classes(s, d):
    return _sizes(s, d).groupBy(dedup.size_class(F.col("size")).alias("class")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT CASE WHEN size <= 4096 THEN 'small' ELSE 'large' END AS class, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def P14_size_classes_at_4096(s, d):
    """With a limit that these files pass."""
    return _sizes(s, d).groupBy(dedup.size_class(F.col("size"), 4096).alias("class")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT path_rel, size, CAST(NULL AS BIGINT) AS attrs, CAST(NULL AS DOUBLE) AS mtime FROM files")
def P15_missing_columns(s, d):
    return catalog.conform(_sizes(s, d), OLD)


@query(f"""
SELECT path_rel, split_part(path_rel, '/', 3) AS name, {bytes_text('size', 2)} AS size_text, {bytes_text('compressed_size', 2)} AS packed_text,
  strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS modified, volume_name AS volume,
  '0x' || upper(lpad(to_hex(attrs), 8, '0')) AS attributes, CAST(frame_id AS VARCHAR) AS frame,
  CASE WHEN is_duplicate THEN 'Yes' ELSE 'No' END AS duplicate FROM ent""")
def P16_display(s, d):
    return _entries(s, d).select(
        "path_rel", paths.base_name(F.col("path_rel")).alias("name"), fmt.format_bytes(F.col("size"), 2).alias("size_text"),
        fmt.format_bytes(F.col("compressed_size"), 2).alias("packed_text"), fmt.epoch_text(F.col("mtime")).alias("modified"),
        F.col("volume_name").alias("volume"), fmt.hex_attributes(F.col("attrs")).alias("attributes"),
        F.col("frame_id").cast("string").alias("frame"), fmt.yes_no(F.col("is_duplicate")).alias("duplicate"),
    )


@query("SELECT path_rel AS path, size, is_duplicate, original_path AS original FROM cat")
def P17_index_rows(s, d):
    """The columns that the older indexes hold of a file."""
    return _catalog(s, d).select(F.col("path_rel").alias("path"), "size", "is_duplicate", F.col("original_path").alias("original"))


@query("SELECT doc_id, coalesce(length(sddl) > 0, false) AS has_acls FROM attr")
def P18_has_acls(s, d):
    return _attrs(s, d).select("doc_id", F.coalesce(F.length("sddl") > 0, F.lit(False)).alias("has_acls"))


@query("SELECT DISTINCT 'archive.' || lpad(CAST(volume_no AS VARCHAR), 3, '0') AS name FROM vol")
def P19_volume_names(s, d):
    names = _volumes(s, d).select(paths.volume_name("archive", F.col("volume_no")).alias("name")).distinct()
    return names.filter(F.col("name").rlike(r".*\.\d{3}$"))


@query("SELECT CAST(sum(size) AS BIGINT) AS total FROM files")
def A1_total_size(s, d):
    return _sizes(s, d).agg(F.sum("size").alias("total"))


@query("SELECT size, count(*) AS n FROM files GROUP BY size HAVING count(*) > 1")
def A2_size_groups(s, d):
    return _sizes(s, d).groupBy("size").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT * FROM cat")
def A4_chunked_duplicates(s, d):
    """Duplicates by the digests of small chunks: the same catalog."""
    return dedup.find_duplicates(_files(s, d), 1024)


@query("""
, r AS (
  SELECT size, round, md5(substr(h, 1, CAST((round - 1) * 2048 AS BIGINT))) AS before, md5(substr(h, 1, CAST(round * 2048 AS BIGINT))) AS after
  FROM (SELECT size, hex(encode(text)) AS h, unnest(range(1, (size + 1023) // 1024 + 1)) AS round FROM files WHERE size > 0)),
n AS (SELECT round, count(*) OVER (PARTITION BY size, round, before) AS a, count(*) OVER (PARTITION BY size, round, after) AS b FROM r)
SELECT CAST(round AS INT) AS round, count(*) AS candidates, count(*) FILTER (b > 1) AS remaining FROM n WHERE a > 1 GROUP BY 1""")
def A5_chunk_rounds(s, d):
    return dedup.chunk_rounds(_files(s, d), 1024)


@query("""
, h AS (SELECT *, hex(encode(text)) AS x FROM files WHERE size > 0),
p AS (
  SELECT size, substr(x, 1, 4) AS f2, CASE WHEN size < 2 THEN x ELSE right(x, 4) END AS l2,
    CASE WHEN size < 8 THEN x ELSE substr(x, CAST((size // 2 - 4) * 2 + 1 AS BIGINT), 16) END AS c8, md5(text) AS dg FROM h),
n AS (
  SELECT count(*) OVER (PARTITION BY size) a, count(*) OVER (PARTITION BY size, f2) b, count(*) OVER (PARTITION BY size, f2, l2) c,
    count(*) OVER (PARTITION BY size, f2, l2, c8) d, count(*) OVER (PARTITION BY size, f2, l2, c8, dg) e FROM p),
k AS (
  SELECT count(*) k0, count(*) FILTER (a > 1) k1, count(*) FILTER (b > 1) k2, count(*) FILTER (c > 1) k3, count(*) FILTER (d > 1) k4,
    count(*) FILTER (e > 1) k5 FROM n)
SELECT 1 AS stage, 'size' AS name, k1 AS candidates, k0 - k1 AS removed FROM k UNION ALL SELECT 2, 'first2', k2, k1 - k2 FROM k
UNION ALL SELECT 3, 'last2', k3, k2 - k3 FROM k UNION ALL SELECT 4, 'center8', k4, k3 - k4 FROM k
UNION ALL SELECT 5, 'digest', k5, k4 - k5 FROM k""")
def A6_funnel(s, d):
    return dedup.funnel_counts(_files(s, d))


@query("""
SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (is_duplicate) AS duplicates,
  CAST(coalesce(sum(size) FILTER (is_duplicate), 0) AS BIGINT) AS saved_bytes,
  coalesce(sum(size) FILTER (is_duplicate), 0) * 100.0::DOUBLE / sum(size) AS saved_percent FROM cat""")
def A7_A8_savings(s, d):
    return dedup.duplicate_summary(_catalog(s, d))


@query("SELECT count(*) AS n FROM files")
def A9_file_count(s, d):
    return _files(s, d).agg(F.count("*").alias("n"))


@query("SELECT c.path_rel, coalesce(n, 0) AS duplicate_count, coalesce(n, 0) > 0 AS has_duplicates FROM cat c LEFT JOIN dups o ON o.original_path = c.path_rel")
def A10_J3_duplicate_counts(s, d):
    return catalog.with_duplicate_counts(_catalog(s, d)).select("path_rel", "duplicate_count", "has_duplicates")


@query("""
SELECT mode, count(*) AS frames, CAST(sum(original_size) AS BIGINT) AS original_bytes, CAST(sum(size) AS BIGINT) AS compressed_bytes,
  max(frame_id) AS last_frame, CASE mode WHEN 'raw' THEN 'RAW (Sem compressão)' ELSE mode END AS label,
  CASE WHEN sum(size) > 0 THEN CAST(sum(original_size) AS DOUBLE) / sum(size) ELSE 1 END AS ratio FROM fr GROUP BY mode""")
def A12_mode_stats(s, d):
    return report.mode_stats(_frames(s, d))


@query("SELECT CAST(count(*) AS BIGINT) AS frames, CAST(sum(original_size) AS BIGINT) AS original_bytes, max(frame_id) AS last_frame, true AS agree FROM fr")
def A12_A13_packed_mode_stats(s, d):
    """The report on frames that a codec packed: its sums are those of what is stored, its ratios follow from them."""
    packed = _packed(s, d)
    stored = packed.groupBy("mode").agg(F.sum(F.octet_length("payload")).alias("stored"))
    stats = report.mode_stats(packed).join(stored, "mode")
    right = (F.col("stored") == F.col("compressed_bytes")) & (F.abs(F.col("ratio") * F.col("stored") - F.col("original_bytes")) < 1e-3)
    right &= F.when(F.col("mode") == "raw", F.col("ratio") == 1.0).otherwise(F.col("ratio") > 1.0)
    return stats.agg(F.sum("frames").alias("frames"), F.sum("original_bytes").alias("original_bytes"), F.max("last_frame").alias("last_frame"), F.every(right).alias("agree"))


@query("""
SELECT frame_id, mode, CAST(sum(original_size) OVER (ORDER BY frame_id) AS BIGINT) AS done_bytes,
  sum(original_size) OVER (ORDER BY frame_id) * 100.0::DOUBLE / (SELECT total FROM tot) AS percent FROM fr""")
def A15_progress(s, d):
    return report.progress(_frames(s, d))


@query("SELECT (SELECT CAST(sum(size) AS BIGINT) FROM talk_frames) AS original_bytes, (SELECT count(*) FROM talk_frames) AS frames, true AS agree")
def A17_A25_stream_stats(s, d):
    """Statistics of a stream's packed frames: packed and raw ones, their bytes, and the ratio as stored."""
    frames = stage(codecs.encode_frames(frame_stream.batch_frames(table(s, d, "conversations"), 4096)), "talk")
    stored = frames.agg(F.sum(F.octet_length("payload")).alias("stored"))  # one row
    g = report.stream_stats(frames).join(F.broadcast(stored))
    agree = (F.col("compressed_bytes") == F.col("stored")) & (F.abs(F.col("ratio") - F.col("original_bytes") / F.col("stored")) < 1e-9)
    return g.select("original_bytes", (F.col("packed_frames") + F.col("raw_frames")).alias("frames"), agree.alias("agree"))


@query("SELECT DISTINCT split_part(path_rel, '/', 1) AS name FROM files")
def A19_child_folders(s, d):
    return catalog.list_dir(_catalog(s, d)).filter("is_folder").select("name")


@query("SELECT DISTINCT frame_id FROM sl WHERE path_rel LIKE 'src1/%'")
def A20_Q10_needed_frames(s, d):
    return layout.needed_frames(_sizes(s, d).filter(F.col("path_rel").startswith("src1/")), _offsets(s, d), FRAME)


@query("""
, f AS (SELECT split_part(path_rel, '/', 2) AS value, min({'l': lower(path_rel), 'p': path_rel}) AS m FROM files GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY m) AS INT) AS id, value FROM f""")
def A22_dictionary(s, d):
    return catalog.dictionary(_sddl_files(s, d), "sddl")


# Duplicates and joins


@query("SELECT * FROM cat")
def Q1_find_duplicates(s, d):
    return dedup.find_duplicates(_files(s, d))


@query("SELECT c.path_rel, c.original_path, o.size AS original_size FROM cat c JOIN cat o ON c.original_path = o.path_rel")
def W3_originals(s, d):
    return catalog.with_originals(_catalog(s, d))[0]


_FEWER = """
, k AS (SELECT * FROM cat WHERE size < 2000 OR is_duplicate)
SELECT path_rel, original_path FROM k WHERE is_duplicate AND original_path NOT IN (SELECT path_rel FROM k WHERE NOT is_duplicate)"""


@query(_FEWER)
def J9_missing_originals(s, d):
    return catalog.with_originals(_catalog(s, d).filter("size < 2000 or is_duplicate"))[1]


@query(_FEWER + " ORDER BY path_rel LIMIT 5")
def O10_first_missing(s, d):
    return catalog.with_originals(_catalog(s, d).filter("size < 2000 or is_duplicate"))[1].orderBy("path_rel").limit(5)


@query("""
, f AS (SELECT split_part(path_rel, '/', 2) AS value, min({'l': lower(path_rel), 'p': path_rel}) AS m FROM files GROUP BY 1),
k AS (SELECT CAST(row_number() OVER (ORDER BY m) AS INT) AS id, value FROM f)
SELECT path_rel, id AS sddl_id, value AS sddl FROM files JOIN k ON value = split_part(path_rel, '/', 2)""")
def J1_descriptors(s, d):
    files = _sddl_files(s, d)
    known = catalog.dictionary(files, "sddl").select(F.col("value").alias("sddl"), F.col("id").alias("sddl_id"))
    return files.join(known, "sddl", "left").select("path_rel", "sddl_id", "sddl")


@query(f"""
SELECT path_rel, start // {FRAME} AS start_frame, volume_no FROM offs LEFT JOIN vol ON frame_id = start // {FRAME} WHERE offs.size > 0
UNION ALL SELECT path_rel, NULL, NULL FROM offs WHERE size = 0""")
def J2_file_volumes(s, d):
    offsets = _offsets(s, d)
    volumes = _volumes(s, d, offsets).select(F.col("frame_id").alias("start_frame"), "volume_no")
    return layout.start_frames(offsets, FRAME).join(volumes, "start_frame", "left").select("path_rel", "start_frame", "volume_no")


@query("SELECT * FROM sl")
def J4_slices(s, d):
    return layout.slices(_offsets(s, d), FRAME)


@query("SELECT path_rel, min(frame_id) AS frame_id, min(frame_end) AS frame_end FROM offs JOIN fr0 ON frame_end > start WHERE size > 0 GROUP BY 1")
def J5_first_frame(s, d):
    offsets = _offsets(s, d)
    return layout.first_frame_after(offsets.filter("size > 0"), _frames(s, d, offsets), FRAME).select("path_rel", "frame_id", "frame_end")


@query("SELECT path_rel FROM files WHERE doc_id IN (SELECT doc_id FROM labels)")
def J6_selected_files(s, d):
    labelled = table(s, d, "labels").select(F.col("doc_id").alias("k"))
    return _sizes(s, d).join(labelled, _doc_id(F.col("path_rel")) == F.col("k"), "left_semi").select("path_rel")


@query("SELECT frame_id, true AS agree FROM fr0")
def J7_frame_modes(s, d):
    """The recorded modes name only packed frames; what they don't name is raw, as it was stored."""
    packed = _packed(s, d)
    recorded = packed.filter("mode <> 'raw'").select("frame_id", F.col("mode").alias("recorded"))
    return packed.join(recorded, "frame_id", "left").select("frame_id", (F.coalesce("recorded", F.lit("raw")) == F.col("mode")).alias("agree"))


@query("SELECT 'backup/' || path_rel AS path_rel, 'backup/' || original_path AS resolved FROM cat WHERE is_duplicate")
def J8_F11_rooted_originals(s, d):
    return catalog.resolve_originals(_catalog(s, d).withColumn("path_rel", F.concat(F.lit("backup/"), "path_rel")))


@query("""
, there AS (SELECT path_rel FROM files WHERE size >= 2000),
t AS (
  SELECT path_rel AS p FROM there UNION SELECT split_part(path_rel, '/', 1) || '/' || split_part(path_rel, '/', 2) FROM there
  UNION SELECT split_part(path_rel, '/', 1) FROM there UNION SELECT ''),
a AS (SELECT path_rel AS p FROM files UNION ALL SELECT source || '/' || lang FROM documents UNION ALL SELECT 'gone/' || source FROM documents)
SELECT p, count(*) AS n FROM a WHERE p IN (SELECT p FROM t) GROUP BY p""")
def J10_existing_targets(s, d):
    """Access-list rows of files and folders that are there."""
    docs = table(s, d, "documents")
    rows = _sizes(s, d).select(F.col("path_rel").alias("p")).union(docs.select(F.concat_ws("/", "source", "lang"))).union(docs.select(F.concat_ws("/", F.lit("gone"), "source")))
    return catalog.existing(rows, _sizes(s, d).filter("size >= 2000")).groupBy("p").agg(F.count("*").alias("n"))


@query(f"SELECT path_rel, CASE WHEN size > 0 THEN start // {FRAME} END AS sframe_id FROM offs")
def J13_Q9_frame_map(s, d):
    """A catalog in which two files of three lack their frame number gets it from the computed map."""
    offsets = _offsets(s, d)
    frame_map = stage(layout.start_frames(offsets, FRAME), "map")
    known = F.when(_doc_id(F.col("path_rel")) % 3 == 0, F.col("start_frame"))
    return catalog.with_frame_map(frame_map.select("path_rel", known.alias("sframe_id")), frame_map)


# Layout


@query("SELECT * FROM offs")
def W1_offsets(s, d):
    return _offsets(s, d)


@query("SELECT frame_id, frame_start, frame_end, frame_end - frame_start AS original_size FROM fr0")
def W2_frames(s, d):
    return layout.frames(_offsets(s, d), FRAME)


@query(f"""
SELECT path_rel, size, start, CASE WHEN size > 0 THEN start // {FRAME} END AS start_frame,
  CASE WHEN size > 0 THEN (start + size - 1) // {FRAME} END AS end_frame FROM offs""")
def W4_start_frames(s, d):
    return layout.start_frames(_offsets(s, d), FRAME)


@query(next_fit("SELECT row_number() OVER (ORDER BY lower(path_rel), path_rel) - 1 AS frame_id, size FROM offs", 30_000)
       + "SELECT frame_id, size, volume_no, volume_offset FROM own WHERE frame_id >= 0")
def W5_next_fit(s, d):
    """Every unique file as one stored item, in order, in volumes that some of them overfill."""
    numbered = catalog.surrogate_ids(_catalog(s, d).filter("not is_duplicate").select("path_rel", "size"))
    return layout.next_fit(numbered.select((F.col("id") - 1).alias("frame_id"), "size"), 30_000)


@query("""
SELECT *, CAST(sum(frames) OVER w AS BIGINT) AS frames_so_far, CAST(sum(bytes) OVER w AS BIGINT) AS bytes_so_far
FROM (SELECT volume_no, mode, count(*) AS frames, CAST(sum(size) AS BIGINT) AS bytes FROM fv GROUP BY 1, 2)
WINDOW w AS (PARTITION BY mode ORDER BY volume_no)""")
def W7_A16_volume_stats(s, d):
    return report.volume_stats(_volumes(s, d))


@query("SELECT path_rel, row_number() OVER (ORDER BY lower(path_rel), path_rel) AS id FROM files")
def W9_surrogate_ids(s, d):
    return catalog.surrogate_ids(_sizes(s, d).select("path_rel"))


@query("""
SELECT volume_no, bytes, volume_no % 3 * 0.5::DOUBLE AS seconds,
  CASE WHEN volume_no % 3 > 0 THEN bytes / 1048576.0::DOUBLE / (volume_no % 3 * 0.5::DOUBLE) ELSE 0 END AS megabytes_a_second
FROM (SELECT volume_no, CAST(sum(size) AS BIGINT) AS bytes FROM fv GROUP BY 1)""")
def W10_A18_volume_rates(s, d):
    timed = _volumes(s, d).groupBy("volume_no").agg(F.sum("size").alias("bytes")).withColumn("seconds", F.col("volume_no") % 3 * 0.5)
    return report.volume_rates(timed)


# Catalog

_DETAILS = "compressed_size, volume_name, frame_id, sddl, attrs, mtime"


@query("SELECT DISTINCT split_part(path_rel, '/', 2) AS name, true AS is_folder, CAST(NULL AS BIGINT) AS size FROM cat WHERE path_rel LIKE 'src1/%'")
def Q2_list_dir(s, d):
    return catalog.list_dir(_catalog(s, d), "src1")


@query(f"SELECT split_part(path_rel, '/', 3) AS name, false AS is_folder, size, {_DETAILS} FROM ent WHERE path_rel LIKE 'src1/en/%'")
def Q2_list_dir_details(s, d):
    """A listing with volume, frame, packed size, descriptor, attributes and time."""
    return catalog.list_dir(_entries(s, d), "src1/en")


@query("SELECT split_part(path_rel, '/', 3) AS name, false AS is_folder, size FROM cat WHERE path_rel LIKE 'src1/en/%' AND NOT is_duplicate")
def Q3_list_unique(s, d):
    return catalog.list_dir(_catalog(s, d), "src1/en", hide_duplicates=True)


@query("SELECT path_rel, size FROM files WHERE path_rel ILIKE '%SRC1/%' ORDER BY path_rel LIMIT 100")
def Q4_search(s, d):
    return catalog.search(_sizes(s, d), "SRC1/", 100)


@query(f"SELECT path_rel, size, is_duplicate, original_path, start, {_DETAILS} FROM ent WHERE path_rel ILIKE '%SRC1/%' ORDER BY path_rel LIMIT 100")
def Q4_search_details(s, d):
    return catalog.search(_entries(s, d), "SRC1/", 100)


@query(f"SELECT path_rel, size, is_duplicate, original_path, start, {_DETAILS} FROM ent WHERE path_rel = 'src1/en/00000001.txt'")
def Q5_get_file(s, d):
    return catalog.get_file(_entries(s, d), "src1\\en\\00000001.txt")


@query("SELECT path_rel, size FROM files WHERE path_rel LIKE 'src2/%'")
def Q6_folder(s, d):
    return catalog.files_in_folder(_sizes(s, d), "src2")


@query("SELECT frame_id, volume_no, volume_offset, size, original_size FROM fv")
def Q7_frames(s, d):
    return _volumes(s, d).select("frame_id", "volume_no", "volume_offset", "size", "original_size").orderBy("frame_id")


@query(f"""
SELECT path_rel, size, is_duplicate, e.original_path, start, {_DETAILS}, coalesce(n, 0) AS duplicate_count, coalesce(n, 0) > 0 AS has_duplicates
FROM ent e LEFT JOIN dups k ON k.original_path = e.path_rel""")
def Q8_details(s, d):
    return catalog.with_duplicate_counts(_entries(s, d))


@query("""
SELECT c.path_rel, coalesce(n, 0) AS duplicate_count, coalesce(n, 0) > 0 AS has_duplicates, length(split_part(c.path_rel, '/', 2)) > 0 AS has_acls
FROM cat c LEFT JOIN dups o ON o.original_path = c.path_rel""")
def Q14_badges(s, d):
    counted = catalog.with_duplicate_counts(_catalog(s, d)).join(_sddl_files(s, d).select("path_rel", "sddl"), "path_rel", "left")
    return counted.select("path_rel", "duplicate_count", "has_duplicates", F.coalesce(F.length("sddl") > 0, F.lit(False)).alias("has_acls"))


@query("SELECT path_rel, row_number() OVER (ORDER BY lower(path_rel), path_rel) AS id FROM files ORDER BY id")
def O5_files_by_id(s, d):
    return catalog.by_id(catalog.surrogate_ids(_sizes(s, d).select("path_rel")))


@query("SELECT path_rel, size FROM files WHERE path_rel LIKE 'src2/%' OR path_rel = 'src1/en/00000001.txt'")
def U1_Q17_selection(s, d):
    return catalog.expand_selection(_sizes(s, d), ["src1/en/00000001.txt"], ["src2", "src2/en"])


@query("SELECT path_rel FROM files WHERE path_rel NOT LIKE 'src2/%'")
def U3_deselected(s, d):
    files = _sizes(s, d).select("path_rel")
    return files.exceptAll(files.filter(F.col("path_rel").startswith("src2/")))


@query("SELECT path_rel FROM files WHERE (path_rel LIKE 'src1/%' OR path_rel LIKE 'src2/%') AND path_rel NOT LIKE '%/en/%'")
def U3_selection_steps(s, d):
    """A folder selected twice, another added, some of both discarded; what was selected before a clearing is gone."""
    files = _sizes(s, d).select("path_rel")
    below = lambda p: files.filter(F.col("path_rel").startswith(p))
    chosen = catalog.select_add(catalog.select_clear(files), below("src1/"))
    chosen = catalog.select_add(catalog.select_add(chosen, below("src1/")), below("src2/"))
    return catalog.select_discard(chosen, files.filter(F.col("path_rel").contains("/en/")))


@query("SELECT n_nationkey, array_to_string(list_filter(range(255), lambda x: x <> n_nationkey), ',') AS rest FROM nation")
def U4_other_bytes(s, d):
    rest = F.array_except(F.sequence(F.lit(0), F.lit(255)), F.array(F.col("n_nationkey").cast("int"), F.lit(255)))
    return table(s, d, "nation").select("n_nationkey", F.array_join(rest, ",").alias("rest"))


# Reports

_FOLDERS = """
, u AS (SELECT path_rel, size, string_split(path_rel, '/') AS p FROM cat WHERE NOT is_duplicate),
a AS (
  SELECT '' AS path, '' AS parent, 0 AS depth, size FROM u UNION ALL SELECT p[1], '', 1, size FROM u
  UNION ALL SELECT p[1] || '/' || p[2], p[1], 2, size FROM u),
g AS (SELECT path, parent, depth, CAST(sum(size) AS BIGINT) AS size, count(*) AS total_files FROM a GROUP BY ALL),
c AS (SELECT g.*, (SELECT count(*) FROM g x WHERE x.path <> '' AND (g.path = '' OR x.path LIKE g.path || '/%')) AS folder_count FROM g)"""


@query(_FOLDERS + "SELECT *, folder_count + total_files AS descendant_count, round(size * 100.0::DOUBLE / (SELECT total FROM tot), 1) AS share FROM c")
def Q12_A14_tree(s, d):
    return report.tree(_catalog(s, d))


@query(_FOLDERS + f"""
SELECT *, {bytes_text('size', 2)} AS size_text, round(size * 100.0::DOUBLE / (SELECT total FROM tot), 1) AS share FROM (
  SELECT path, parent, regexp_replace(path, '^.*/', '') AS name, true AS is_folder, size, folder_count + total_files AS descendant_count FROM c
  UNION ALL SELECT path_rel, p[1] || '/' || p[2], p[3], false, size, 0 FROM u)""")
def Q12_tree_nodes(s, d):
    """Folders and files."""
    return report.tree_nodes(_catalog(s, d))


@query("""
, u AS (SELECT size, string_split(path_rel, '/') AS p FROM cat WHERE NOT is_duplicate),
a AS (SELECT p[1] AS path, '' AS parent, size FROM u UNION ALL SELECT p[1] || '/' || p[2], p[1], size FROM u),
g AS (SELECT path, parent, sum(size) AS size FROM a GROUP BY ALL)
SELECT path, CAST(row_number() OVER (PARTITION BY parent ORDER BY size DESC, path) AS INT) AS place FROM g""")
def O6_largest_children(s, d):
    return report.largest_children(report.tree(_catalog(s, d))).select("path", "place")


_FILE_SUMS = """
SELECT count(*) AS files, count(*) FILTER (is_duplicate) AS duplicates,
  CAST(coalesce(sum(size) FILTER (NOT is_duplicate), 0) AS BIGINT) AS original_bytes,
  CAST(coalesce(sum(size) FILTER (is_duplicate), 0) AS BIGINT) AS duplicate_bytes FROM cat"""


_STATS = f"""
SELECT f.*, v.*, CASE WHEN compressed_bytes > 0 THEN original_bytes::DOUBLE / compressed_bytes ELSE 1 END AS ratio,
  CASE WHEN original_bytes > 0 THEN (original_bytes - compressed_bytes) * 100.0::DOUBLE / original_bytes ELSE 0 END AS saved_percent
FROM ({_FILE_SUMS}) f, (
  SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS compressed_bytes, count(DISTINCT volume_no) AS volumes,
    string_agg(DISTINCT CAST(volume_no AS VARCHAR), ',' ORDER BY CAST(volume_no AS VARCHAR)) AS volume_list FROM fv) v"""


@query(_FOLDERS + f"SELECT *, (SELECT count(*) FROM c WHERE path <> '') AS folders FROM ({_STATS})")
def Q19_overview(s, d):
    files = _catalog(s, d)
    return report.overview(files, _volumes(s, d, layout.file_offsets(files)))


@query(_STATS)
def Q13_compression_stats(s, d):
    files = _catalog(s, d)
    return report.compression_stats(files, _volumes(s, d, layout.file_offsets(files)))


@query(f"SELECT f.*, true AS agree FROM ({_FILE_SUMS}) f")
def Q13_A11_packed_stats(s, d):
    """The statistics of an archive that a codec packed: the packed bytes are those stored, ratio and saving follow from them."""
    packed = archive.pack(_files(s, d), FRAME, VOLUME)
    frames = stage(packed.frames, "packed")
    stored = frames.agg(F.sum(F.octet_length("payload")).alias("stored"), F.max("volume_no").alias("last"))  # one row
    g = report.compression_stats(packed.files, frames).join(F.broadcast(stored))
    saved = (F.col("original_bytes") - F.col("stored")) * 100.0 / F.col("original_bytes")
    agree = (F.col("compressed_bytes") == F.col("stored")) & (F.abs(F.col("ratio") - F.col("original_bytes") / F.col("stored")) < 1e-9)
    agree &= (F.abs(F.col("saved_percent") - saved) < 1e-9) & (F.col("volumes") == F.col("last"))
    return g.select("files", "duplicates", "original_bytes", "duplicate_bytes", agree.alias("agree"))


# Archives: codecs, packing and restoring, streams


@query("SELECT path_rel, size, sha256(text) AS digest FROM files")
def Q15_Q11_pack_restore(s, d):
    return archive.restore(archive.pack(_files(s, d), FRAME, VOLUME)).select("path_rel", "size", _digest("content"))


@query("SELECT mode, frame_id, digest FROM frame_digests, (VALUES ('lz4'), ('lz_ext3_cpu')) m(mode)")
def X1_X2_codec_round_trip(s, d):
    """All frames packed and unpacked by both codecs, down to the last byte."""
    frames = stage(archive.frame_bytes(_files(s, d), FRAME), "frames")
    back = lambda mode: codecs.decode_frames(codecs.encode_frames(frames, mode)).select(F.lit(mode).alias("mode"), "frame_id", _digest())
    return back("lz4").union(back("lz_ext3_cpu"))


@query("SELECT mode, frame_id, digest FROM frame_digests, (VALUES ('rle1'), ('rle2'), ('pattern_rle'), ('delta_rle')) m(mode)")
def X6_X12_legacy_round_trip(s, d):
    """All frames in each of the older modes and back, down to the last byte."""
    frames = stage(archive.frame_bytes(_files(s, d), FRAME), "frames")

    def back(mode: str) -> DataFrame:
        packed = codecs.encode_legacy(frames, mode, DICTIONARY, PATTERNS)
        return codecs.decode_frames(packed, DICTIONARY, PATTERNS).select(F.lit(mode).alias("mode"), "frame_id", _digest())

    return reduce(DataFrame.union, map(back, ("rle1", "rle2", "pattern_rle", "delta_rle")))


@query("""
SELECT path_rel, lower(lpad(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT,
  list_transform(regexp_extract_all(h, '..'), lambda x: CAST(CAST('0x' || x AS INTEGER) AS UHUGEINT))),
  lambda x, y: (xor(x, y) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS UBIGINT)), 16, '0')) AS fnv1a
FROM (SELECT path_rel, size, hex(encode(text)) AS h FROM files)""")
def F19_fnv(s, d):
    return _files(s, d).select("path_rel", codecs.fnv1a_hex("content").alias("fnv1a"))


@query()
def F20_fnv_blocks(s, d):
    return _files(s, d).select("path_rel", codecs.fnv_blocks_hex("content").alias("blocks"))


@query("SELECT frame_id, size, digest FROM talk_frames")
def T1_stream_frames(s, d):
    return frame_stream.batch_frames(table(s, d, "conversations"), 4096).select("frame_id", F.octet_length("data").cast("long").alias("size"), _digest())


@query(next_fit("SELECT frame_id, size FROM talk_frames", 10_000) + "SELECT frame_id, size, volume_no, volume_offset FROM own WHERE frame_id >= 0")
def T6_roll_volumes(s, d):
    """A streaming query whose volumes close by their bytes."""
    frames = frame_stream.batch_frames(table(s, d, "conversations"), 4096)
    sizes = frames.select(F.lit("-").alias("stream"), "frame_id", F.octet_length("data").cast("long").alias("size"))
    return frame_stream.rolled(s, sizes, 10_000).drop("stream")


@query("SELECT '<stdin>' AS path_rel, CAST(sum(size) AS BIGINT) AS size, count(*) AS frames FROM talk_frames")
def T4_T5_A25_stream_catalog(s, d):
    frames = frame_stream.batch_frames(table(s, d, "conversations"), 4096)
    return frame_stream.stream_catalog(frames.select(F.octet_length("data").cast("long").alias("original_size")))


# Functions


@query(r"""
, p AS (SELECT doc_id, 'C:/data/' || source || '/' || lang || '//' || doc_id || '.txt' AS p, source, lang FROM documents)
SELECT doc_id, substr(p, 4) AS path, doc_id || '.txt' AS name, 'C:/data/' || source || '/' || lang || '/' AS parent,
  'C:|data|' || source || '|' || lang || '|' || doc_id || '.txt' AS parts, source || '/' || lang AS trimmed, source AS first,
  lang AS below FROM p""")
def F1_F7_paths(s, d):
    whole = paths.normalize_separators(F.col("p"))
    folder = F.concat(F.lit("//"), F.element_at(F.split(whole, "/"), 3), F.lit("/"), F.element_at(F.split(whole, "/"), 4), F.lit("/"))
    trimmed = paths.trim_slashes(folder)
    return _sample(s, d).select(
        "doc_id", paths.normalize_separators(paths.strip_anchor(F.col("p"))).alias("path"), paths.base_name(whole).alias("name"),
        paths.parent_path(whole).alias("parent"), F.array_join(paths.path_parts(whole), "|").alias("parts"), trimmed.alias("trimmed"),
        paths.first_component(trimmed).alias("first"), paths.first_component(F.concat(F.lit("data/"), F.substring_index(trimmed, "/", -1)), "data/").alias("below"),
    )


@query(f"SELECT path_rel, {bytes_text('size', 1)} AS text FROM files")
def F8_format_bytes(s, d):
    return _sizes(s, d).select("path_rel", fmt.format_bytes(F.col("size")).alias("text"))


@query(f"SELECT path_rel, {bytes_text('size', 2)} AS text FROM files")
def F9_format_two_decimals(s, d):
    return _sizes(s, d).select("path_rel", fmt.format_bytes(F.col("size"), 2).alias("text"))


@query("SELECT frame_id, CASE WHEN volume_no < 1000 THEN CAST(volume_no AS INT) END AS number FROM vol")
def F10_volume_numbers(s, d):
    return _volumes(s, d).select("frame_id", paths.volume_number(paths.volume_name("archive", F.col("volume_no"))).alias("number"))


@query("""
SELECT doc_id, '0x' || upper(lpad(to_hex(attrs), 8, '0')) AS hex, attrs & 39 AS kept, CASE WHEN flag THEN 'Yes' ELSE 'No' END AS label,
  coalesce(size, 0) AS size FROM attr""")
def F12_attributes(s, d):
    kept = F.col("attrs").bitwiseAND(F.lit(fmt.ATTRIBUTE_MASK))
    size = F.coalesce("size", F.lit(0))
    return _attrs(s, d).select("doc_id", fmt.hex_attributes(F.col("attrs")).alias("hex"), kept.alias("kept"), fmt.yes_no(F.col("flag")).alias("label"), size.alias("size"))


@query("SELECT doc_id, strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS text FROM attr")
def F13_epoch_text(s, d):
    return _attrs(s, d).select("doc_id", fmt.epoch_text(F.col("mtime")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS text FROM documents")
def F17_truncate(s, d):
    return table(s, d, "documents").select("doc_id", fmt.truncate(F.col("text"), 40).alias("text"))


@query("SELECT path_rel, md5(text) AS digest FROM files")
def F21_md5(s, d):
    return _files(s, d).select("path_rel", F.md5("content").alias("digest"))


@query("""
SELECT path_rel, CASE WHEN size >= 4 THEN CAST((CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT)::HUGEINT
  * 2654435761 % 4294967296) // 4096 AS BIGINT) END AS place FROM (SELECT path_rel, size, hex(encode(text)) AS h FROM files)""")
def F22_lz_hash(s, d):
    """The hash table's place of each content's first four bytes."""
    return _files(s, d).select("path_rel", codecs.hash4("content").alias("place"))


@query("SELECT volume_no, sum(size) / 500000.0 > 0.4 AS full FROM fv GROUP BY 1")
def F26_occupancy(s, d):
    return _volumes(s, d).groupBy("volume_no").agg((F.sum("size") / F.lit(float(VOLUME)) > 0.4).alias("full"))


@query("""
SELECT 'frame ' || doc_id || ': 1 % then ' || doc_id % 100 || '.5 %' || CASE WHEN doc_id % 2 = 0 THEN ' at ' || doc_id || ' MB/s' ELSE '' END AS value,
  doc_id % 100 + 0.5::DOUBLE AS percent, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS DOUBLE) END AS rate FROM documents""")
def F28_log_progress(s, d):
    k = F.col("doc_id")
    number = lambda x: x.cast("string")
    rate = F.when(k % 2 == 0, F.concat(F.lit(" at "), number(k), F.lit(" MB/s"))).otherwise("")
    line = F.concat(F.lit("frame "), number(k), F.lit(": 1 % then "), number(k % 100), F.lit(".5 %"), rate)
    return report.log_progress(table(s, d, "documents").select(line.alias("value")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

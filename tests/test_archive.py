import gzip
import io
import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn import ship
from cairn.functions import fmt, paths
from cairn.operators import catalog, codecs, dedup, layout, report
from cairn.plans import archive, registry
from cairn.sources import corpus, index_io
from cairn.streaming import frames as stream

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    got = registry.queries()[name](spark, DATA)
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def files(spark, rows):
    return ship(spark).createDataFrame([(p, len(c), c) for p, c in rows], "path_rel string, size long, content binary")


def test_duplicates_canonical_and_empty(spark):
    rows = [("b/x", b"same"), ("A/x", b"same"), ("a/x", b"same"), ("e1", b""), ("e2", b""), ("c", b"samf"), ("d", b"1"), ("f", b"1")]
    got = {r.path_rel: r.original_path for r in dedup.find_duplicates(files(spark, rows)).collect()}
    assert got == {"b/x": "A/x", "A/x": None, "a/x": "A/x", "e1": None, "e2": None, "c": None, "d": None, "f": "d"}


def test_duplicates_do_not_depend_on_order_and_are_idempotent(spark):
    rows = [(f"p{i}", bytes([i % 5]) * (i % 3)) for i in range(40)]
    a = plain(dedup.find_duplicates(files(spark, rows)).collect())
    random.Random(1).shuffle(rows)
    assert plain(dedup.find_duplicates(files(spark, rows)).collect()) == a
    kept = {r.path_rel for r in dedup.find_duplicates(files(spark, rows)).filter("not is_duplicate").collect()}
    again = dedup.find_duplicates(files(spark, [r for r in rows if r[0] in kept]))
    assert again.filter("is_duplicate").count() == 0


def test_unread_contents_are_no_duplicates(spark):
    df = ship(spark).createDataFrame([("a", 3, None), ("b", 3, None), ("c", 3, b"abc"), ("d", 3, b"abc")], "path_rel string, size long, content binary")
    for chunk in (None, 2):
        assert {r.path_rel: r.original_path for r in dedup.find_duplicates(df, chunk).collect()} == {"a": None, "b": None, "c": None, "d": "c"}


def test_funnel_on_disk_equals_contents(spark, tmp_path):
    rng = random.Random(8)
    base = rng.randbytes(5000)
    many = {"e1": b"", "e2": b"", "one": b"1", "dir/two": b"1", "A/x": base, "a/x": base, "late": base[:-1] + b"?", "mid": base[:1500] + b"?" + base[1501:], "twin": base[:1500] + b"?" + base[1501:]}
    many |= {f"s/{i}": rng.randbytes(i % 4) for i in range(40)} | {f"l/{i}": base[:1000] * (1 + i % 4) for i in range(12)}
    for name, data in many.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
    listing = corpus.list_files(ship(spark), str(tmp_path))
    want = plain(dedup.find_duplicates(files(spark, list(many.items()))).collect())
    for large in (1 << 20, 1000, 700):  # by whole digests, and by rounds of chunks
        assert plain(dedup.find_duplicates_on_disk(listing, str(tmp_path), large).collect()) == want
    os.remove(f"{tmp_path}/A/x")  # gone since it was listed
    known = spark.createDataFrame([(n, len(d)) for n, d in many.items()], "path_rel string, size long")
    got = {r.path_rel: r.original_path for r in dedup.find_duplicates_on_disk(known, str(tmp_path), 700).collect()}
    assert got["A/x"] is None and got["a/x"] is None and got["twin"] == "mid"
    assert dedup.find_duplicates_on_disk(known.limit(0), str(tmp_path)).count() == 0


def test_scan_tells_what_it_leaves_out(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in/deep")
    for n in ("a", "in/b", "in/deep/c"):
        with open(f"{tmp_path}/{n}", "w") as f:
            f.write("x")
    os.symlink(f"{tmp_path}/a", f"{tmp_path}/in/link")
    os.symlink(f"{tmp_path}/in/deep", f"{tmp_path}/in/folder")
    os.symlink(f"{tmp_path}/a", f"{tmp_path}/top")
    os.mkfifo(f"{tmp_path}/in/pipe")
    assert {r.path_rel for r in corpus.list_files(ship(spark), str(tmp_path)).collect()} == {"a", "in/b", "in/deep/c"}
    assert {r.reason: r.n for r in corpus.skipped(spark, str(tmp_path)).collect()} == {"symlink": 3, "special": 1}


def test_intermediate_tables_need_a_shared_folder():
    from types import SimpleNamespace as Named

    from cairn import staging

    cluster = Named(conf=Named(get=lambda *_: None), sparkContext=Named(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        staging.shared_dir(cluster)


def test_next_fit_and_oversize(spark):
    sizes = spark.createDataFrame([(i, s) for i, s in enumerate([40, 50, 30, 98, 1, 200, 5])], "frame_id long, size long")
    got = [(r.volume_no, r.volume_offset) for r in layout.next_fit(sizes, 98).orderBy("frame_id").collect()]
    assert got == [(1, 0), (1, 40), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0)]
    assert [(r.volume_no, r.volume_offset) for r in layout.next_fit(sizes.filter("frame_id < 2"), 98, 7, 60).orderBy("frame_id").collect()] == [(8, 0), (8, 40)]


def test_slices_tile_files_and_frames(spark):
    rng = random.Random(3)
    rows = [(f"f{i:03}", False, rng.choice([0, 1, 7, 64, 65, 200])) for i in range(60)]
    offsets = layout.file_offsets(spark.createDataFrame(rows, "path_rel string, is_duplicate boolean, size long"))
    got = layout.slices(offsets, 64)
    assert {r.path_rel: r.n for r in got.groupBy("path_rel").agg(F.sum("length").alias("n")).collect()} == {p: s for p, _, s in rows if s}
    per_frame = {r.frame_id: r.n for r in got.groupBy("frame_id").agg(F.sum("length").alias("n")).collect()}
    assert per_frame == {r.frame_id: r.original_size for r in layout.frames(offsets, 64).collect()}


def test_empty_archive(spark):
    none = files(spark, [])
    packed = archive.pack(none, 64, 128)
    assert packed.files.count() == packed.frames.count() == archive.restore(packed).count() == 0


def test_pack_write_restore_selection(spark, tmp_path):
    rows = [("a/one", b"x" * 300), ("b/two", b"x" * 300), ("c/empty", b""), ("d/three", bytes(range(256))), ("z/dup", b"x" * 300)]
    archive.write(archive.pack(files(spark, rows), 100, 150), f"{tmp_path}/a")
    back = archive.read(spark, f"{tmp_path}/a")
    assert {r.path_rel: bytes(r.content) for r in archive.restore(back).collect()} == dict(rows)
    chosen = spark.createDataFrame([("z/dup",), ("c/empty",)], "path_rel string")
    assert {r.path_rel: bytes(r.content) for r in archive.restore(back, chosen).collect()} == {"z/dup": b"x" * 300, "c/empty": b""}


TREE = [("a/one", b"x" * 300), ("b/two", b"x" * 300), ("c/empty", b""), ("d/three", bytes(range(256)) * 3), ("z/dup", b"x" * 300), ("é/ü.txt", "größer".encode())]


def on_disk(root):
    out = {}
    for where, _, names in os.walk(root):
        for n in names:
            with open(os.path.join(where, n), "rb") as f:
                out[os.path.relpath(os.path.join(where, n), root)] = f.read()
    return out


def test_restore_to_a_folder(spark, tmp_path):
    packed = archive.pack(files(spark, TREE), 100, 150)
    for link in (True, False):
        for _ in range(2):  # again over what is there
            how = {r.path_rel: r.how for r in archive.restore_to(packed, f"{tmp_path}/{link}", link=link).collect()}
            assert on_disk(f"{tmp_path}/{link}") == dict(TREE)
            assert how == {p: ("linked" if link else "copied") if p in ("b/two", "z/dup") else "written" for p, _ in TREE}
    assert os.path.samefile(f"{tmp_path}/True/a/one", f"{tmp_path}/True/z/dup") and not os.path.samefile(f"{tmp_path}/False/a/one", f"{tmp_path}/False/z/dup")
    chosen = spark.createDataFrame([("z/dup",), ("b/two",), ("c/empty",)], "path_rel string")
    report_ = archive.restore_to(packed, f"{tmp_path}/some", chosen)
    assert on_disk(f"{tmp_path}/some") == {p: c for p, c in TREE if p in ("z/dup", "b/two", "c/empty")}  # without the original
    row = report.run_summary(report_, 2.0).first()
    assert (row.written, row.linked, row.copied, row.failed, row.seconds) == (2, 1, 0, 0, 2.0) and abs(row.megabytes_a_second - 600 / 2**20 / 2) < 1e-12
    with pytest.raises(ValueError, match="leads out"):
        archive.restore_to(archive.pack(files(spark, [("../x", b"1")]), 100, 150), f"{tmp_path}/out")


def test_volume_files_come_back(spark, tmp_path):
    packed = archive.pack(files(spark, TREE), 100, 150)
    made = archive.write_volumes(packed, f"{tmp_path}/v/../x", 150, {"frame_size": 100})
    assert [os.path.basename(p) for p in made] == [f"x.{i + 1:03}" for i in range(len(made))] and len(made) >= 2
    assert sorted(os.listdir(tmp_path)) == sorted(os.path.basename(p) for p in made)  # nothing half-made is left
    back = archive.read_volumes(spark, f"{tmp_path}/x")
    assert {r.path_rel: bytes(r.content) for r in archive.restore(back).collect()} == dict(TREE)
    one = archive.restore(back, spark.createDataFrame([("z/dup",)], "path_rel string")).collect()
    assert [(r.path_rel, bytes(r.content)) for r in one] == [("z/dup", b"x" * 300)]
    # The index has a volume of its own where the last one is over 0.4 full.
    for size, alone in ((59, False), (61, True)):
        base = f"{tmp_path}/i{size}"
        got = archive.write_volumes(archive.pack(files(spark, [("f", random.Random(1).randbytes(size))]), 100, 150), base, 150, {"frame_size": 100})
        assert len(got) == 1 + alone


def test_volume_files_of_older_modes_come_back(spark, tmp_path):
    df, dictionary, patterns = files(spark, TREE), [120, 0], [b"xx", b"gr"]
    plain_ = archive.pack(df, 100, 150, "raw")
    bytes_ = ship(spark).createDataFrame([(r.frame_id, bytes(r.payload)) for r in plain_.frames.collect()], "frame_id long, data binary")
    for mode in ("rle1", "rle2", "pattern_rle", "delta_rle"):
        packed = codecs.encode_legacy(bytes_, mode, dictionary, patterns)
        placed = layout.next_fit(packed.select("frame_id", "size"), 150).drop("size")
        old = archive.Archive(plain_.files, plain_.slices, packed.join(placed, "frame_id"))
        params = {"frame_size": 100, "dictionary": {"top_bytes": dictionary}, "pattern_dictionary": {"patterns": [p.hex() for p in patterns]}}
        archive.write_volumes(old, f"{tmp_path}/{mode}", 150, params)
        back = archive.read_volumes(spark, f"{tmp_path}/{mode}")
        assert {r.path_rel: bytes(r.content) for r in archive.restore(back).collect()} == dict(TREE)


def test_spooled_bytes_are_the_stream(spark, tmp_path):
    class Pipe(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))

    data = random.Random(5).randbytes(1003)
    assert stream.spool(spark, Pipe(data), f"{tmp_path}/in", 64, at_once=5) == 1003 and stream.spool(spark, io.BytesIO(b""), f"{tmp_path}/none", 64) == 0
    q = stream.cut_chunks(stream.read_chunks(spark, f"{tmp_path}/in", 2), 100).writeStream.format("memory").queryName("spooled").trigger(availableNow=True).start()
    q.awaitTermination(60)
    whole = stream.join_frames(spark.table("spooled")).orderBy("frame_id").collect()
    assert b"".join(bytes(r.data) for r in whole) == data and len(whole) == 11


def test_indexes_as_json_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3, False, None), ("b", 3, True, "a")], "path_rel string, size long, is_duplicate boolean, original_path string")
    frames = spark.createDataFrame([(0, "x.001", 0, 2, 3)], index_io.FRAMES)
    index_io.write_line_index(f"{tmp_path}/x.001", rows, frames, {"frame_size": 64})
    got = index_io.read_index(spark, f"{tmp_path}/x.001")
    assert [(r.path_rel, r.is_duplicate, r.original_path) for r in got["files"].orderBy("id").collect()] == [("a", False, None), ("b", True, "a")] and got["params"] == {"frame_size": 64}

    class Odd:
        def __init__(self):
            self.top_bytes, self.own = [1, 2], {3: object}

    index_io.write_json_index(f"{tmp_path}/x.json", rows, frames, {"a": 1}, Odd())
    with open(f"{tmp_path}/x.json") as f:
        made = json.load(f)
    assert made["files"][1] == {"path_rel": "b", "size": 3, "is_duplicate": True, "original": "a"} and made["frames"][0]["compressed_size"] == 2
    assert made["dictionary"]["top_bytes"] == [1, 2]
    index_io.append_index(f"{tmp_path}/y.001", __import__("zlib").compress(json.dumps(made).encode()), 1)
    assert index_io.read_index(spark, f"{tmp_path}/y.001")["files"].count() == 2


def test_page_of_a_tree(spark):
    rows = [("a/b/c.txt", 5, False), ("a/<d>.txt", 7, False), ("top", 1, False), ("a/dup", 9, True)]
    page = report.html(report.tree_nodes(spark.createDataFrame(rows, "path_rel string, size long, is_duplicate boolean")), "All & more")
    assert "All &amp; more" in page and "&lt;d&gt;.txt" in page and "<d>" not in page and "dup" not in page
    assert page.count("<li>") == 5 and page.count("<details>") == page.count("</details>") == 2


@pytest.mark.parametrize(("data", "want"), [("30616263", b"abc"), ("1061010000", b"aaaaa"), ("f001" + "41" * 16, b"A" * 16), ("1f6101000000", b"a" * 20)])
def test_lz_vectors(data, want):
    assert codecs.lz_decode(bytes.fromhex(data), len(want)) == want


@pytest.mark.parametrize(("data", "size"), [("1061000000", 5), ("1061020000", 5), ("30616263", 4), ("f0", 3), ("306162", 3), ("106101", 5)])
def test_lz_errors(data, size):
    with pytest.raises(codecs.CodecError):
        codecs.lz_decode(bytes.fromhex(data), size)


def test_lz_round_trip():
    rng = random.Random(5)
    for n in [0, 1, 4, 12, 13, 255, 4000, 70_000]:
        for data in (bytes(n), bytes(rng.choices(b"ab", k=n)), rng.randbytes(n), (b"hello world " * n)[:n]):
            assert codecs.lz_decode(codecs.lz_encode(data), n) == data


def test_more_candidates_pack_better():
    rng = random.Random(7)
    words = [rng.randbytes(rng.randint(4, 30)) for _ in range(40)]
    data = b"".join(rng.choice(words) for _ in range(4000))
    sizes = [len(codecs.lz_encode(data, k)) for k in (1, 8)]
    assert sizes[1] < sizes[0] and codecs.lz_decode(codecs.lz_encode(data, 8, 12), len(data)) == data


def test_hashes_of_bytes(spark):
    data = random.Random(3).randbytes(60)
    want = [(int.from_bytes(data[i : i + 4], "little") * 2654435761 & 0xFFFFFFFF) >> 12 for i in range(57)]
    assert codecs.lz_hash(data).tolist() == want and len(codecs.lz_hash(b"abc")) == 0
    values = [b"", b"a", data, bytes(3000), *(random.Random(i).randbytes(i % 70) for i in range(200))]

    def plain_fnv(v):
        h = 0xCBF29CE484222325
        for b in v:
            h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
        return h

    assert codecs.fnv1a_many(values, rows=7).tolist() == codecs.fnv1a_many(values, room=100).tolist() == [plain_fnv(v) for v in values]

    def plain_blocks(v):
        out = 0xCBF29CE484222325
        for i in range(0, max(1, len(v)), codecs.FNV_BLOCK):
            part, h = v[i : i + codecs.FNV_BLOCK], 0xCBF29CE484222325
            n = -(-len(part) // 8) * 8 if len(v) <= codecs.FNV_BLOCK else codecs.FNV_BLOCK
            part = part.ljust(n, b"\0")
            for j in range(0, n, 8):
                h = (h ^ int.from_bytes(part[j : j + 8], "little")) * 0x100000001B3 & (1 << 64) - 1
            out = (out ^ h) * 0x100000001B3 & (1 << 64) - 1
        return out

    assert all(codecs.fnv_blocks(v) == plain_blocks(v) for v in (*values[:40], bytes(range(256)) * 1030))


def test_lz4_blocks_are_strict_and_standard():
    rng = random.Random(6)
    for data in (b"", b"a", b"ab" * 5000, rng.randbytes(3000), bytes(70_000)):
        packed = codecs.lz4_encode(data)
        assert codecs.lz4_decode(packed, len(data)) == codecs.lz_decode(packed, len(data), offset_bytes=2) == data
        for wrong in (len(data) - 1, len(data) + 1):
            if wrong >= 0:
                with pytest.raises(codecs.CodecError):
                    codecs.lz4_decode(packed, wrong)


@pytest.mark.parametrize("mode", sorted(codecs.ENCODERS))
def test_encoded_frames_come_back(spark, mode):
    rows = [(0, b"hello world " * 900), (1, random.Random(2).randbytes(500)), (2, b"x")]
    packed = codecs.encode_frames(ship(spark).createDataFrame(rows, "frame_id long, data binary"), mode)
    assert [r["mode"] for r in packed.orderBy("frame_id").collect()] == [mode, "raw", "raw"]
    assert [(r.frame_id, bytes(r.data)) for r in codecs.decode_frames(packed).orderBy("frame_id").collect()] == rows


def test_older_modes_come_back():
    rng, dictionary, patterns = random.Random(4), [101, 32], [b"the ", b"in"]
    for data in (b"", b"a", b"the inn in the sea" * 9, bytes(200_000), rng.randbytes(999), b"\xff\x00" * 40):
        assert codecs.rle_decode(codecs.rle_encode(data)) == data
        assert codecs.map_decode(codecs.map_encode(data, dictionary), dictionary) == data
        assert codecs.pattern_decode(codecs.pattern_encode(data, patterns), patterns) == data
        assert codecs.delta_decode(codecs.delta_encode(data)) == data


def test_originals_below_their_root(spark):
    rows = [("r/a", False, None), ("r/b", True, "a"), ("c", True, "r/a"), ("r/d", True, "gone")]
    got = catalog.resolve_originals(spark.createDataFrame(rows, "path_rel string, is_duplicate boolean, original_path string"))
    assert {r.path_rel: r.resolved for r in got.collect()} == {"r/b": "r/a", "c": "r/a", "r/d": None}


def test_other_codecs():
    assert codecs.simple_lz_decode(bytes.fromhex("00016101010003"), 4) == b"aaaa"
    with pytest.raises(codecs.CodecError):
        codecs.simple_lz_decode(b"\x02", 1)
    assert codecs.rle_decode(bytes.fromhex("030078020079")) == b"xxxyy"
    assert codecs.rle_decode(bytes.fromhex("000078")) == b""
    assert codecs.map_decode(b"\0\1\2", [0x62, 0x61]) == b"ba\0"
    assert codecs.pattern_decode(bytes.fromhex("00ff7a"), [b"abcd"]) == b"abcdz"
    assert codecs.delta_decode(b"\x01\xff\x02") == b"\x01\x00\x02"
    assert codecs.decode_frame("unknown", b"ab", 2) == b"ab"
    assert codecs.fnv1a(b"") == 0xCBF29CE484222325 and codecs.fnv1a(b"a") == 12638187200555641996


def test_formatting(spark):
    sizes = spark.createDataFrame([(None,), (0,), (1023,), (1024,), (5376,), (3 << 40,)], "n long")
    assert [r[0] for r in sizes.select(fmt.format_bytes(F.col("n"))).collect()] == ["0.0 B", "0.0 B", "1023.0 B", "1.0 KB", "5.2 KB", "3.0 TB"]


def test_paths_and_search(spark):
    df = spark.createDataFrame([("a/b/c.txt",), ("C:\\x\\y",), ("top",), ("50%/x_y",), ("back\\slash",)], "path_rel string")
    got = df.select(paths.parent_path(F.col("path_rel")).alias("p"), paths.strip_anchor(F.col("path_rel")).alias("s"), F.size(paths.ancestors(F.col("path_rel"))).alias("n")).collect()
    assert [r.p for r in got] == ["a/b", "", "", "50%", ""] and got[1].s == "x\\y" and [r.n for r in got] == [3, 1, 1, 2, 1]
    assert {r[0] for r in catalog.search(df, "B/C").collect()} == {"a/b/c.txt"}
    assert {r[0] for r in catalog.search(df, "K\\S").collect()} == {"back\\slash"}


def test_scan_directory(spark, tmp_path):
    for i in range(5):
        for j in ("", *(f"/sub_{k}" for k in range(4))):
            os.makedirs(f"{tmp_path}/root_{i}{j}", exist_ok=True)
            with open(f"{tmp_path}/root_{i}{j}/f.txt", "w") as f:
                f.write("ok")
    open(f"{tmp_path}/root_0/empty", "w").close()
    got = corpus.scan_directory(ship(spark), str(tmp_path))
    assert got.count() == 26 and {r.path_rel: r.size for r in got.collect()}["root_0/empty"] == 0
    found = dedup.find_duplicates(got)
    assert found.filter("is_duplicate").count() == 24 and found.filter("is_duplicate").select("original_path").distinct().collect()[0][0] == "root_0/f.txt"


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 3, False, None, "", 1), (2, "b", 3, True, "a", "", None)], "id long, path_rel string, size long, is_duplicate boolean, original_path string, parent_path string, sddl_id long")
    frames = spark.createDataFrame([(0, "x.001", 0, 2, 3)], index_io.FRAMES)
    path = f"{tmp_path}/x.001"
    with open(path, "wb") as f:
        f.write(b"payload")
    index_io.write_index(path, rows, frames, spark.createDataFrame([(1, "D:")], index_io.SDDLS), {"frame_size": 64, "frame_modes": {"0": "raw"}})
    got = index_io.read_index(spark, path)
    assert [(r.path_rel, r.is_duplicate, r.original_path, r.sddl_id, r.mtime) for r in got["files"].orderBy("id").collect()] == [("a", False, None, 1, None), ("b", True, "a", None, None)]
    assert got["params"]["frame_size"] == 64 and got["frames"].count() == 1 and index_io.volumes(f"{tmp_path}/x") == [path]
    lines = [{"params": {"a": 1}, "count_files": 1, "count_frames": 1}, {"path_rel": "p", "size": 1, "is_duplicate": False, "original": None}, {"frame_id": 0, "volume_name": "v", "offset": 0, "compressed_size": 1, "uncompressed_size": 1}]
    data = gzip.compress("\n".join(map(json.dumps, lines)).encode())
    with open(path, "wb") as f:
        f.write(data + index_io.FOOTER.pack(0, len(data), index_io.MAGIC[2]))
    assert index_io.read_index(spark, path)["files"].first().path_rel == "p"
    with open(path, "wb") as f:
        f.write(bytes(24))
    with pytest.raises(ValueError, match="no index"):
        index_io.read_index(spark, path)


def test_config():
    assert index_io.read_config("A = 1 # x\n# y\nB = on\nC = 2.5\nD = none\nE = 'q r'\nbad") == {"A": 1, "B": True, "C": 2.5, "D": None, "E": "q r"}


def test_streams_equal_batches(spark, tmp_path):
    ship(spark)
    data = random.Random(9).randbytes(1000)
    rows, at = [], 0
    while at < len(data):
        n = 37 + at % 11
        rows.append(("s", at, data[at : at + n]))
        at += n
    spark.createDataFrame(rows, "stream string, start long, data binary").repartition(3).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("stream string, start long, data binary").parquet(f"{tmp_path}/in")
    q = stream.cut_chunks(live, 64).writeStream.format("memory").queryName("cut").trigger(availableNow=True).start()
    q.awaitTermination(60)
    whole = stream.join_frames(spark.table("cut")).orderBy("frame_id").collect()
    assert b"".join(bytes(r.data) for r in whole) == data and [len(r.data) for r in whole] == [64] * 15 + [40]
    spark.createDataFrame([(r.stream, r.frame_id, bytes(r.data)) for r in whole], "stream string, frame_id long, data binary").coalesce(1).write.parquet(f"{tmp_path}/frames")
    frames = spark.readStream.schema("stream string, frame_id long, data binary").parquet(f"{tmp_path}/frames")
    q = stream.roll_volumes(frames.select("stream", "frame_id", F.octet_length("data").cast("long").alias("size")), 150).writeStream.format("memory").queryName("rolled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    sizes = spark.createDataFrame([(r.frame_id, len(r.data)) for r in whole], "frame_id long, size long")
    want = {(r.frame_id, r.volume_no, r.volume_offset) for r in layout.next_fit(sizes, 150).collect()}
    assert {(r.frame_id, r.volume_no, r.volume_offset) for r in spark.table("rolled").collect()} == want
    stream.pack_stream(frames.select("frame_id", "data"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    back = codecs.decode_frames(spark.read.parquet(f"{tmp_path}/out")).orderBy("frame_id").collect()
    assert b"".join(bytes(r.data) for r in back) == data
    # Volumes that go on from batch to batch, and the bytes in order.
    for i, part in enumerate((whole[:5], whole[5:])):
        spark.createDataFrame([(r.frame_id, bytes(r.data)) for r in part], "frame_id long, data binary").coalesce(1).write.parquet(f"{tmp_path}/more/{i}")
        live = spark.readStream.schema("frame_id long, data binary").parquet(f"{tmp_path}/more/*")
        stream.pack_stream(live, f"{tmp_path}/vols", f"{tmp_path}/check2", 150).awaitTermination(60)
    packed = spark.read.parquet(f"{tmp_path}/vols")
    once = layout.next_fit(packed.select("frame_id", "size"), 150)
    assert plain(packed.select("frame_id", "volume_no", "volume_offset").collect()) == plain(once.select("frame_id", "volume_no", "volume_offset").collect()) and packed.select("batch").distinct().count() == 2
    out = io.BytesIO()
    assert stream.write_ordered(packed, out, 1000) == 1000 and out.getvalue() == data
    with pytest.raises(ValueError, match="bytes"):
        stream.write_ordered(packed.filter("frame_id > 0"), io.BytesIO(), 1000)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200 and "Q1_find_duplicates" in e.queries() and set(e.oracle_sql()) <= set(e.queries())

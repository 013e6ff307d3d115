"""Walks, stored objects, byte ranges, listings and the stored catalog."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from catalog_engine import operators as op
from catalog_engine import sources as src
from catalog_engine.schemas import EVENTS, FILES
from catalog_engine.sources import inventory as walks

SHA = "a" * 64


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"abc")
    (root / "empty").write_bytes(b"")
    (root / ".hidden").write_bytes(b"h")
    (root / "_under").write_bytes(b"uu")
    (root / "sub" / "deep" / "x").write_bytes(b"x" * 10)
    (root / "sub" / "y é,z").write_bytes(b"y")
    os.utime(root / "a.txt", ns=(0, 1_700_000_000_999_999_999))
    os.utime(root / "empty", ns=(0, -1))
    (root / "link").symlink_to(root / "a.txt")
    (root / "linkdir").symlink_to(root / "sub")
    os.mkfifo(root / "pipe")
    return root


REGULAR = {"a.txt": 3, "empty": 0, ".hidden": 1, "_under": 2, "sub/deep/x": 10, "sub/y é,z": 1}


def found(df, root):
    return {os.path.relpath(r.path, root): r["size"] for r in df.collect()}


def test_walk(spark, tree):
    files, errors = src.scan_inventory(spark, [str(tree)])
    assert found(files, tree) == REGULAR
    times = {os.path.basename(r.path): r.last_modified_at for r in files.collect()}
    assert times["a.txt"] == 1_700_000_000 and times["empty"] == -1
    assert errors.count() == 0


def test_walk_splits_wide_and_deep_trees_alike(spark, tree, monkeypatch):
    for i in range(30):
        (tree / "sub" / f"n{i}").write_bytes(b"1")
    want = {**REGULAR, **{f"sub/n{i}": 1 for i in range(30)}}
    for entries, wide, pack in ((1, 10_000, 7), (5, 3, 2), (5, 8, 100), (10_000, 5, 1)):
        monkeypatch.setattr(walks, "WIDE_DIR", wide)
        monkeypatch.setattr(walks, "PACK", pack)
        open_, rows, turns = [(os.fsencode(tree), None)], [], 0
        while open_:
            found = list(walks.walk(iter(open_), entries))
            rows += [r for r in found if r[4] is None]
            open_, turns = [r[4:] for r in found if r[4] is not None], turns + 1
            assert all(len(names or []) <= pack for _, names in open_)
        assert len(rows) == len(want)
        assert {os.path.relpath(r[0], tree): r[1] for r in rows} == want
        assert turns > 1  # what was open was handed on


def test_walk_in_rounds(spark, tmp_path, monkeypatch):
    """A deep subtree and a wide directory spread over tasks; small directories share them."""
    monkeypatch.setattr(walks, "FIRST_ENTRIES", 10)
    monkeypatch.setattr(walks, "MOST_ENTRIES", 40)
    monkeypatch.setattr(walks, "WIDE_DIR", 50)
    monkeypatch.setattr(walks, "PACK", 20)
    tasks, round_ = [], walks._round
    monkeypatch.setattr(walks, "_round", lambda f, n, e: tasks.append(n) or round_(f, n, e))
    want = set()
    deep = tmp_path / "root" / "deep"
    for i in range(60):
        folder = deep / f"a{i % 7}" / f"b{i % 5}" / f"c{i}"
        folder.mkdir(parents=True)
        (folder / "f").write_bytes(b"1")
        want.add(f"deep/a{i % 7}/b{i % 5}/c{i}/f")
    wide = tmp_path / "root" / "wide"
    wide.mkdir()
    for i in range(120):
        (wide / f"n{i}").write_bytes(b"1")
        want.add(f"wide/n{i}")
    (wide / "inner").mkdir()
    (wide / "inner" / "x").write_bytes(b"1")
    want.add("wide/inner/x")
    for i in range(300):
        (tmp_path / "root" / "empty" / f"e{i}").mkdir(parents=True)
    files, errors = src.scan_inventory(spark, [str(tmp_path / "root")])
    got = [os.path.relpath(r.path, tmp_path / "root") for r in files.collect()]
    assert sorted(got) == sorted(want) and errors.count() == 0
    most = walks.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert 3 < len(tasks) < 20 and tasks[0] == 1 and 8 < max(tasks) <= most


def test_walk_without_a_directory(spark, tmp_path):
    files, errors = src.scan_inventory(spark, [])
    assert files.count() == 0 and errors.count() == 0
    files, errors = src.scan_inventory(spark, [str(tmp_path)])
    assert files.count() == 0 and errors.count() == 0


def test_roots(spark, tree):
    roots = [f"{tree}/sub/", f"{tree}/./sub/deep", f"{tree}/a.txt", f"{tree}/linkdir", f"{tree}/none"]
    files, errors = src.scan_inventory(spark, roots)
    assert sorted(found(files, tree)) == ["a.txt", "sub/deep/x", "sub/y é,z"]
    assert [r.path for r in errors.collect()] == [f"{tree}/none"]


def test_unreadable_directory_is_reported(tree, monkeypatch):
    scandir = os.scandir

    def refuse(path):
        if str(path).endswith("deep"):
            raise PermissionError(13, "Permission denied", path)
        return scandir(path)

    monkeypatch.setattr(os, "scandir", refuse)
    rows = list(walks.walk(iter([(os.fsencode(tree), None)]), 1_000))
    assert [r[:4] for r in rows if r[3]] == [(f"{tree}/sub/deep", None, None, "Permission denied")]
    assert len(rows) == len(REGULAR)


def test_name_that_is_not_text(spark, tree):
    with open(os.fsencode(tree) + b"/bad\xff", "wb"):
        pass
    os.mkdir(os.fsencode(tree) + b"/dir\xff")
    files, errors = src.scan_inventory(spark, [str(tree)])
    assert [r.error for r in errors.collect()] == ["name is not UTF-8"]
    assert files.count() == len(REGULAR)


def test_file_chunks_and_digests(spark, tree):
    content = os.urandom(1000)
    (tree / "big").write_bytes(content)
    files, _ = src.scan_inventory(spark, [str(tree)])
    located = files.withColumn("location", F.col("path"))
    chunks = src.read_file_chunks(located, 64)
    got = {}
    for r in chunks.orderBy("path", "chunk_index").collect():
        assert r.is_last == (r.chunk_index == r.n_chunks - 1)
        got[r.path] = got.get(r.path, b"") + bytes(r.plaintext)
    assert got[str(tree / "big")] == content and got[str(tree / "empty")] == b""
    assert {os.path.relpath(p, tree): len(c) for p, c in got.items()} == {**REGULAR, "big": 1000}
    digests = {r.path: r.sha256 for r in src.digest_files(located).collect()}
    assert digests[str(tree / "big")] == hashlib.sha256(content).hexdigest()


def test_unreadable_bytes_are_null(spark, rows, tree):
    ranges = rows(
        [(str(tree / "a.txt"), 1, 2), (str(tree / "a.txt"), 1, 3), (str(tree / "no"), 0, 1), (f"file://{tree}/a.txt", 0, 3)],
        "location string, offset long, length long",
    )
    got = sorted((r.location[-5:], r.piece and bytes(r.piece)) for r in src.read_ranges(ranges, "piece").collect() if r.piece)
    assert got == [("a.txt", b"abc"), ("a.txt", b"bc")]
    assert src.read_ranges(ranges, "piece").count() == 4
    gone = rows([(str(tree / "no"),)], "location string")
    assert src.digest_files(gone).first().sha256 is None


def test_stored_objects(spark, tmp_path):
    for name, content in {"data/a.txt/v1": b"1" * 60, "data/a.txt/v2": b"2", "b/v1": b""}.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    heads = src.read_heads(src.read_containers(spark, str(tmp_path)))
    got = {(r.path, r.version_id): (r.total_size, bytes(r.head)) for r in heads.collect()}
    assert got == {
        ("/data/a.txt", "v1"): (60, b"1" * 49),
        ("/data/a.txt", "v2"): (1, b"2"),
        ("/b", "v1"): (0, b""),
    }


def test_listing(spark, rows, tmp_path):
    lines = rows([("b",), ("a",)], "value string").orderBy("value")
    src.write_listing(lines, str(tmp_path / "some"), "none")
    assert [r.value for r in spark.read.text(str(tmp_path / "some")).collect()] == ["a", "b"]
    src.write_listing(lines.where("false"), str(tmp_path / "none"), "No files found")
    assert [r.value for r in spark.read.text(str(tmp_path / "none")).collect()] == ["No files found"]


def test_catalog_of_several_runs(spark, rows, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        src.read_catalog(spark, root, "p")
    assert src.read_catalog(spark, root, "p", absent_ok=True).count() == 0
    first = rows([(1, "/a", "v1", SHA, 1, 1, 1, None), (2, "/b", "v1", SHA, 1, 1, 1, None)], FILES)
    src.write_run(first, root, "versions", "p", 100)
    # A file of the first schema, without deletions.
    second = rows([(3, "/a", "v2", SHA, 1, 2, 1, None)], FILES).drop("deleted_at")
    src.write_run(second, root, "versions", "p", 200)
    src.write_run(first.limit(1), root, "versions", "q", 100)
    src.write_run(rows([(2, 150)], "row_seq long, deleted_at long"), root, "stamps", "p", 150)
    src.write_run(rows([(2, 250), (3, 250)], "row_seq long, deleted_at long"), root, "stamps", "p", 250)

    def state(**options):
        got = src.read_catalog(spark, root, **options)
        return sorted((r.row_seq, r.deleted_at) for r in got.collect())

    assert state(profile="p") == [(1, None), (2, 250), (3, 250)]
    assert state(profile="p", before_run=200) == [(1, None), (2, 150)]
    assert state(profile="q") == [(1, None)]
    assert state() == [(1, None), (1, None), (2, 250), (3, 250)]
    assert src.read_catalog(spark, root, "p").columns == FILES.names


def test_snapshot(spark, rows, tmp_path):
    hot = spark.range(2000).select(
        F.col("id").alias("row_seq"),
        F.when(F.col("id") < 700, "/hot").otherwise(F.concat(F.lit("/"), "id")).alias("path"),
        F.concat(F.lit("v"), "id").alias("version_id"),
        F.lit(SHA).alias("sha256"),
        F.lit(0).cast("long").alias("size"),
        (F.col("id") + 1).alias("last_modified_at"),
    )
    catalog = op.upgrade_catalog(hot)
    folder = src.publish_catalog(catalog, rows([], EVENTS), str(tmp_path), 5)
    assert folder.endswith("run=5")
    back = spark.read.parquet(f"{folder}/files")
    assert back.exceptAll(catalog).count() == 0 and back.count() == 2000
    assert spark.read.parquet(f"{folder}/events").count() == 0


def test_base_replaces_the_runs_it_holds(spark, rows, tmp_path):
    root = str(tmp_path / "store")
    first = rows([(1, "/a", "v1", SHA, 1, 1, 1, None), (2, "/b", "v1", SHA, 1, 1, 1, None)], FILES)
    src.write_run(first, root, "versions", "p", 100)
    src.write_run(rows([(2, 7)], "row_seq long, deleted_at long"), root, "stamps", "p", 200)
    src.write_run(rows([(3, "/a", "v2", SHA, 1, 2, 1, None)], FILES), root, "versions", "p", 300)
    src.write_run(rows([(1, 9)], "row_seq long, deleted_at long"), root, "stamps", "p", 300)
    whole = sorted(map(tuple, src.read_catalog(spark, root, "p").collect()))
    src.compact_catalog(spark, root, "p", 200)
    read = src.read_catalog(spark, root, "p")
    assert sorted(map(tuple, read.collect())) == whole and len(whole) == 3
    assert not any("versions/profile=p/run=100" in f for f in read.inputFiles()) or read.count() == 3
    # Before the base's run the base is of no use.
    assert {r.deleted_at for r in src.read_catalog(spark, root, "p", before_run=200).collect()} == {None}
    src.compact_catalog(spark, root, "p", 300)
    assert sorted(map(tuple, src.read_catalog(spark, root, "p").collect())) == whole

"""Versions, points in time, differences and stamps on hand-made tables."""

import random

import pytest

from catalog_engine import operators as op
from catalog_engine.functions import as_of_seconds, normalize_dir
from catalog_engine.schemas import FILES, INVENTORY

SHA = "a" * 64


def version(seq, path, mtime, size=1, deleted=None, version_id=None):
    return (seq, path, version_id or f"v{seq}", SHA, size, mtime, mtime, deleted)


@pytest.fixture
def catalog(rows):
    return lambda *data: rows(list(data), FILES)


@pytest.fixture
def walk(rows):
    return lambda *data: rows(list(data), INVENTORY)


def paths(df):
    return sorted(r.path for r in df.collect())


def test_tie_on_mtime_goes_to_the_later_row(catalog):
    df = catalog(version(1, "/a", 10), version(2, "/a", 10), version(3, "/a", 9))
    assert [r.row_seq for r in op.latest_versions(df).collect()] == [2]


def test_as_of_drops_later_rows_before_ranking(catalog):
    df = catalog(version(1, "/a", 10, deleted=20), version(2, "/a", 30))
    assert paths(op.files_as_of(df, 15)) == ["/a"]
    assert paths(op.files_as_of(df, 20)) == []
    assert paths(op.files_as_of(df, 30)) == ["/a"]


def test_deletion_of_an_older_row_does_not_matter(catalog):
    df = catalog(version(1, "/a", 10, deleted=12), version(2, "/a", 11))
    assert [r.version_id for r in op.files_as_of(df, 50).collect()] == ["v2"]


def test_path_back_with_an_older_mtime_stays_hidden(catalog):
    df = catalog(version(1, "/a", 10, deleted=12), version(2, "/a", 5))
    assert paths(op.files_as_of(df, 50)) == []


def test_like_prefix(catalog):
    df = catalog(
        version(1, "/Data/user_1", 1),
        version(2, "/data/userX1", 1),
        version(3, "/data/user", 1),
        version(4, "/other/data/user_1", 1),
        version(5, "/data/100%/x", 1),
        version(6, "/Éa/x", 1),
        version(7, "/éa/x", 1),
        version(8, "/data/a\nb", 1),
        version(9, "/data/[x].dat", 1),
    )

    def seqs(prefix, match="like"):
        return sorted(r.row_seq for r in op.filter_prefix(df, prefix, match).collect())

    assert seqs("/data/user_") == [1, 2]
    assert seqs("/data/user_", "literal") == []
    assert seqs("/Data/user_", "literal") == [1]
    assert seqs("%user_1") == [1, 2, 4]
    assert seqs("") == list(range(1, 10))
    assert seqs("/éA") == [7]
    assert seqs("/data/a\nB") == [8]
    assert seqs("/data/[X].") == [9]
    assert seqs("/DATA/100%/") == [5]
    with pytest.raises(ValueError):
        op.filter_prefix(df, "x", "glob")


def test_overlapping_prefixes_repeat_rows(catalog):
    df = catalog(version(1, "/a/b", 1), version(2, "/a/c", 1), version(3, "/d", 1))
    assert paths(op.list_files_multi(df, ["/a", "/a/b", "/A"], 5)) == ["/a/b"] * 3 + ["/a/c"] * 2
    assert paths(op.list_files_multi(df, ["/a", "/a/b"], 5, dedupe=True)) == ["/a/b", "/a/c"]
    assert paths(op.list_files_multi(df, [], 5)) == ["/a/b", "/a/c", "/d"]


def test_versions_include_deleted_ones_newest_first(catalog):
    df = catalog(version(1, "/a", 10, 1), version(2, "/a", 30, 2, 40), version(3, "/a", 10, 3))
    assert [r["size"] for r in op.list_versions(df, "/a").collect()] == [2, 3, 1]


def test_sample_is_of_live_files_and_repeatable(catalog):
    df = catalog(*[version(i, f"/f{i}", 1, deleted=2 if i % 2 else None) for i in range(40)])
    first = paths(op.sample_live(df, 5, seed=1))
    assert len(first) == 5 and first == paths(op.sample_live(df, 5, seed=1))
    assert all(int(p[2:]) % 2 == 0 for p in paths(op.sample_live(df, 100)))
    assert op.sample_live(df, 100).count() == 20


def test_times():
    assert as_of_seconds("2024-01-11T19:06:40Z") == 1705000000
    assert as_of_seconds("2024-01-11T20:06:40.999+01:00") == 1705000000
    assert as_of_seconds("1969-12-31T23:59:58.5Z") == -2
    assert as_of_seconds(7) == 7 and as_of_seconds() > 1_700_000_000
    for wrong in ("2024-01-11", "2024-01-11 19:06:40Z", "2024-01-11T19:06:40"):
        with pytest.raises(ValueError):
            as_of_seconds(wrong)


def test_changed_looks_at_every_undeleted_version(catalog, walk):
    known = catalog(
        version(1, "/a", 10, 5), version(2, "/a", 20, 6), version(3, "/b", 10, 5, deleted=11)
    )
    seen = walk(("/a", 5, 10), ("/b", 5, 10), ("/c", 1, 1), ("/c", 1, 1))
    assert paths(op.detect_changed(seen, known)) == ["/b", "/c"]


def test_exists_answers_each_key_once(catalog, walk):
    known = catalog(version(1, "/a", 10, 5), version(2, "/a", 10, 5))
    asked = walk(("/a", 5, 10), ("/a", 5, 10), ("/a", 6, 10))
    got = {(r["size"], r["exists"]) for r in op.file_exists(asked, known).collect()}
    assert got == {(5, True), (6, False)}


def test_deleted_paths(catalog, walk):
    known = catalog(
        version(1, "/a/x", 1),
        version(2, "/ab/x", 1),
        version(3, "/a/y", 1, deleted=2),
        version(4, "/a/z", 1),
        version(5, "/A/w", 1),
        version(6, "/a/s/q", 1),
    )
    seen = walk(("/a/z", 1, 1))
    assert paths(op.detect_deleted(known, seen, ["/a"])) == ["/A/w", "/a/s/q", "/a/x"]
    assert paths(op.detect_deleted(known, seen, ["/a", "./a/", "/a/s"], "literal")) == ["/a/s/q", "/a/x"]
    assert paths(op.detect_deleted(known, seen, ["/a"], exclude_roots=["/a/s"])) == ["/A/w", "/a/x"]


def test_stamp_goes_to_the_latest_row_even_if_stamped(catalog, rows):
    known = catalog(version(1, "/a", 10), version(2, "/a", 20, deleted=21), version(3, "/b", 1))
    marked = op.mark_deleted(known, rows([("/a",), ("/a",), ("/none",)], "path string"), 99)
    assert {r.row_seq: r.deleted_at for r in marked.collect()} == {1: None, 2: 99, 3: None}
    assert marked.columns == known.columns


def test_stamped_files_are_not_detected_again(catalog, walk):
    known = catalog(*[version(i, f"/a/{i % 7}", i) for i in range(1, 30)])
    seen = walk(("/a/1", 1, 1))
    marked = op.mark_deleted(known, op.detect_deleted(known, seen, ["/a"]), 99)
    assert op.detect_deleted(marked, seen, ["/a"]).count() == 0
    again = op.detect_deletion_stamps(known, seen, ["/a"], 99)
    assert sorted(op.apply_stamps(known, again).collect()) == sorted(marked.collect())


def test_one_path_with_a_third_of_all_rows(spark, walk):
    from pyspark.sql import functions as F

    n = 30_000
    df = spark.range(n, numPartitions=16).select(
        F.col("id").alias("row_seq"),
        F.when(F.col("id") % 3 == 0, "/hot").otherwise(F.concat(F.lit("/p"), "id")).alias("path"),
        F.concat(F.lit("v"), "id").alias("version_id"),
        F.lit(SHA).alias("sha256"),
        F.lit(1).cast("long").alias("size"),
        (F.col("id") % 1000 + 1).alias("last_modified_at"),
        F.lit(1).cast("long").alias("created_at"),
        F.lit(None).cast("long").alias("deleted_at"),
    )
    latest = op.latest_versions(df)
    hot = latest.where("path = '/hot'").collect()
    newest = max((i % 1000 + 1, i) for i in range(0, n, 3))
    assert [(r.last_modified_at, r.row_seq) for r in hot] == [newest]
    assert latest.count() == n - n // 3 + 1


def test_normalize_dir():
    assert [normalize_dir(d) for d in ("/a", "/a/", "./a", "/", "a//b", "//a")] == ["/a/", "/a/", "a/", "/", "a/b/", "/a/"]


def test_many_prefixes_as_few(spark, rows, monkeypatch):
    """A join of prefixes gives what conditions give: wildcards, case, repeats, overlaps, exclusions."""
    from catalog_engine.operators import catalog as module
    from catalog_engine.operators import diff

    draw = random.Random(6)
    paths = {"/" + "/".join(draw.choice(["a", "B", "a_b", "Ä", "c%"]) for _ in range(draw.randint(1, 4))) for _ in range(80)}
    known = [(i, p, "v", "a" * 64, 1, 5, 1, 9 if i % 9 == 0 else None) for i, p in enumerate(sorted(paths))]
    frame = rows(known, FILES)
    prefixes = ["/a/", "/A/b", "/a_b", "/a%b/", "%b", "_a", "/ä", "/Ä", "/a/", "", "/c%/", "/zz", "/a/b/a/b/a/b/a/b"]
    walk = rows([(p, 1, 5) for p in sorted(paths)[::3]], "path string, size long, last_modified_at long")

    def results():
        for match in ("like", "literal"):
            for dedupe in (False, True):
                yield sorted(map(tuple, op.files_as_of(frame, 7, prefixes, match, dedupe).collect()))
            gone = op.detect_deleted(frame, walk, ["/a", "/B/", "/a_b"], match, ["/a/B", "/a_b/a"])
            yield sorted(map(tuple, gone.collect()))

    want = list(results())
    for m in (module, diff):
        monkeypatch.setattr(m, "CONDITIONS", 1)
    assert list(results()) == want and all(want)


def test_ranges_of_like_prefixes(spark):
    from catalog_engine.functions.text import _after

    assert _after("ab") == "ac" and _after("a\U0010ffff") == "b" and _after("\U0010ffff") is None
    assert _after("\ud7ff") == "\ue000"
    frame = spark.createDataFrame([(p,) for p in ["Az", "aZ", "AZ", "a[", "aZ\U0010ffff", "azz", "b", "\u212ax", "kx"]], "path string")

    def got(prefix):
        return {r.path for r in op.filter_prefix(frame, prefix).collect()}

    assert got("aZ") == {"Az", "aZ", "AZ", "aZ\U0010ffff", "azz"} and got("k") == {"kx"} and got("A[") == {"a["}
    assert got("\u212a") == {"\u212ax"}

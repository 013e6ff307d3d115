"""The physical plans that the design rests on."""

import re

import pytest

from pyspark.sql import functions as F

from catalog_engine import operators as op
from catalog_engine import sources as src
from catalog_engine.sources import read_chunks
from checks import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plans")

    def store(name, df):
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    return {
        "files": store("files", fx.files(spark, SF)),
        "inventory": store("inventory", fx.inventory(spark, SF)),
        "content": store("content", op.plan_headers(fx.documents(spark, SF), fx.MAGIC)),
        "chunks": store("chunks", fx.chunks(spark, SF)),
        "headers": store("headers", fx.headers(spark, SF)),
        "keys": store("keys", fx.keys(spark, SF)),
    }


@pytest.fixture
def shuffled(spark):
    """Plans as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange (hash|range|Single|Round)", text))


def test_latest_versions_limits_before_its_shuffle(stored):
    text = plan(op.latest_versions(stored["files"]))
    assert exchanges(text) == 1
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", text)


def test_point_in_time_reads_what_it_needs(stored):
    text = plan(op.files_as_of(stored["files"], 1705000000, ["/data/view/", "/data/click/"], "literal"))
    assert exchanges(text) == 1 and text.count("FileScan") == 1
    assert "StringStartsWith(path,/data/view/)" in text and "LessThanOrEqual(last_modified_at" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "sha256" not in schema and "created_at" not in schema


def test_a_like_prefix_is_one_range_of_the_scan(stored):
    text = plan(op.filter_prefix(stored["files"], "/2024/viewer%/x"))
    assert "GreaterThanOrEqual(path,/2024/VIEWER)" in text and "LessThan(path,/2024/viewes)" in text
    assert "RLIKE" in text  # there is a wildcard
    for prefix in ("/2024/01", "/2024/viewer/long/way"):
        assert "RLIKE" not in plan(op.filter_prefix(stored["files"], prefix))


def test_many_prefixes_are_one_join(stored):
    dirs = [f"/data/{i % 7}/{i}/" for i in range(10_000)]
    text = plan(op.list_files_multi(stored["files"], dirs))
    assert text.count("FileScan") == 1 and len(text) < 20_000
    assert len(re.findall("BroadcastHashJoin|SortMergeJoin", text)) <= 2 and "CartesianProduct" not in text
    text = plan(op.detect_deleted(stored["files"], stored["inventory"], dirs))
    assert len(text) < 40_000 and "CartesianProduct" not in text and "NestedLoop" not in text


def test_differences_shuffle_each_side_once(stored, shuffled):
    text = plan(op.detect_changed(stored["inventory"], stored["files"]))
    assert "LeftAnti" in text
    # The walk's keys are wanted twice, by equal shuffles of which Spark runs one.
    shuffles = re.findall(r"Exchange hashpartitioning\(path#\d+, size#\d+L, last_modified_at", text)
    assert len(shuffles) == 3 == exchanges(text)
    text = plan(op.detect_deleted(stored["files"], stored["inventory"], ["/data"]))
    assert "LeftAnti" in text and exchanges(text) == 2
    assert text.count("HashAggregate(keys=[path") == 2


def test_a_short_walk_does_not_shuffle_the_catalog(spark, stored, tmp_path):
    stored["inventory"].limit(9).write.parquet(str(tmp_path / "walk"))
    walk = spark.read.parquet(str(tmp_path / "walk"))
    for df in (op.detect_changed(walk, stored["files"]), op.file_exists(walk, stored["files"])):
        text = plan(df)
        semi = text[text.index("LeftSemi, BuildRight") :]
        assert "Exchange" not in semi[: semi.index("FileScan")]


def test_a_few_stamps_do_not_shuffle_the_catalog(spark, stored, tmp_path):
    stamps = op.deletion_stamps(stored["files"], stored["inventory"].limit(3), 9)
    stamps.write.parquet(str(tmp_path / "stamps"))
    text = plan(op.apply_stamps(stored["files"], spark.read.parquet(str(tmp_path / "stamps"))))
    assert "BroadcastHashJoin" in text and exchanges(text) == 0


def test_a_small_append_only_scans_the_catalog(spark, stored, shuffled):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    text = plan(op.append_versions(stored["files"], stored["files"].limit(5), created_at=1).accepted)
    semi = text[text.index("LeftSemi, BuildRight") :]
    scan = semi[: semi.index("FileScan")]
    assert "Exchange" not in scan


def test_a_short_manifest_only_scans_the_catalog(spark, stored, tmp_path):
    items = stored["files"].selectExpr("path as key", "version_id").limit(5)
    items.write.parquet(str(tmp_path / "items"))
    text = plan(op.lookup_checksums(spark.read.parquet(str(tmp_path / "items")), stored["files"]))
    semi = text[text.index("LeftSemi, BuildRight") :]
    assert "Exchange" not in semi[: semi.index("FileScan")]


def test_a_long_manifest_leaves_splitting_of_hot_keys_to_spark(stored, shuffled):
    items = stored["files"].selectExpr("path as key", "version_id")
    text = plan(op.lookup_checksums(items, stored["files"]))
    outer = text[text.index("LeftOuter") :]
    sides = re.findall(r"Sort \[key[^\n]*\n[^\n]*Exchange hashpartitioning\(key", outer)
    assert len(sides) == 2 and exchanges(text) == 4


def test_sealing_and_opening_stay_in_the_jvm(stored, shuffled):
    sealed = op.seal_chunks(stored["chunks"], stored["headers"], stored["keys"])
    opened = op.open_chunks(sealed, stored["headers"], stored["keys"])
    for text in (plan(sealed), plan(opened)):
        assert "Python" not in text and "Arrow" not in text
        assert re.search(r"hashpartitioning\(path#\d+, version_id#\d+, _segment", text)


def test_content_with_its_parameters_is_one_stage(stored):
    params = ["path", "version_id", "content", "nonce_prefix", "header", "key"]
    text = plan(op.seal_chunks(read_chunks(stored["content"].select(*params), 1024)))
    assert "Join" not in text and exchanges(text) == 0
    # Splitting, cutting and sealing are one piece of generated code.
    assert re.search(r"\*\((\d+)\) Project[\s\S]*\*\(\1\) Generate explode", text)


def test_stamps_are_not_joined_where_they_do_not_matter(spark, stored, shuffled, tmp_path):
    from catalog_engine import sources as src

    src.write_run(stored["files"], str(tmp_path), "versions", "p", 1)
    src.write_run(stored["files"].select("row_seq", "deleted_at"), str(tmp_path), "stamps", "p", 2)
    catalog = src.read_catalog(spark, str(tmp_path), "p")
    assert "Join" in plan(catalog)
    assert "Join" not in plan(catalog.select("path", "version_id"))


def test_digests_of_single_chunks_are_not_shuffled_as_content(stored):
    text = plan(op.file_digests(stored["chunks"]))
    small = text[: text.index("MapInArrow")]
    for keys in re.findall(r"SortAggregate\(key=\[([^\]]*)\], functions=\[partial", small):
        assert "plaintext" not in keys
    assert "sha2(plaintext" in small[small.index("Exchange") :]


def test_keys_are_columns_never_literals(stored):
    key = stored["keys"].first().key
    text = plan(op.seal_chunks(stored["chunks"], stored["headers"], stored["keys"]))
    assert bytes(key).hex().upper() not in text.upper()


def test_a_prefix_prunes_versions_base_and_deletions(spark, stored, tmp_path):
    store = str(tmp_path)
    for run in (1, 3):
        src.write_run(stored["files"], store, "versions", "p", run)
        src.write_run(stored["files"].select("path", "row_seq", F.lit(9).cast("long").alias("deleted_at")), store, "deletions", "p", run)
    src.compact_catalog(spark, store, "p", 2)
    catalog = src.read_catalog(spark, store, "p")
    for prefix, pushed in (("/data/view/user1", "GreaterThanOrEqual(path,/DATA/VIEW/USER1)"), ("/1/", "StringStartsWith(path,/1/)")):
        text = plan(op.filter_prefix(catalog, prefix))
        scans = re.findall(r"PushedFilters: \[[^\]]*\]", text)
        assert len(scans) == 3 and all(pushed in scan for scan in scans)

"""Listings from table to text."""

import pytest

from catalog_engine import plans
from catalog_engine.schemas import EVENTS, FILES

SHA = "a" * 64


@pytest.fixture
def text(spark, tmp_path):
    def read(write, *arguments, **options):
        out = str(tmp_path / "out")
        write(arguments[0], out, *arguments[1:], **options)
        return [r.value for r in spark.read.text(out).collect()]

    return read


@pytest.fixture
def catalog(rows):
    return rows(
        [
            (1, "/a", "v1", SHA, 5, 1_700_000_000, 1, None),
            (2, "/a", "v2", SHA, 6, 1_700_000_060, 1, None),
            (3, "/b", "v3", SHA, 7, 1_700_000_000, 1, 1_700_000_100),
        ],
        FILES,
    )


def test_files(catalog, text):
    assert text(plans.list_files_to, catalog) == [
        "Path: /a, Size: 6 bytes, LastModified At: 2023-11-14 22:14:20 UTC"
    ]
    lines = text(plans.list_files_to, catalog, as_of=1_700_000_000, bucket="bkt", manifest=True)
    assert sorted(lines) == ["bkt,/a,v1", "bkt,/b,v3"]
    assert text(plans.list_files_to, catalog, dirs=["/c"]) == ["No files found"]
    with pytest.raises(ValueError, match="bucket"):
        text(plans.list_files_to, catalog, manifest=True)


def test_outputs(catalog):
    for out, why in (("s3://other/k", "does not match"), ("s3://bkt", "must contain")):
        with pytest.raises(ValueError, match=why):
            plans.list_files_to(catalog, out, bucket="bkt")


def test_versions(catalog, text):
    assert text(plans.list_versions_to, catalog, "/a") == [
        f"Size: 6 bytes, LastModified At: 2023-11-14 22:14:20 UTC, SHA256: {SHA}",
        f"Size: 5 bytes, LastModified At: 2023-11-14 22:13:20 UTC, SHA256: {SHA}",
    ]
    assert text(plans.list_versions_to, catalog, "/A") == ["No versions for file found"]


def test_events(rows, text):
    log = rows([(60, 120, "backup", "x", 1), (180, None, "backup", None, 1)], EVENTS)
    assert text(plans.list_events_to, log, "backup") == [
        "ID: 180, Started At: 1970-01-01 00:03:00 UTC, Ended At: N/A, Details: N/A",
        "ID: 60, Started At: 1970-01-01 00:01:00 UTC, Ended At: 1970-01-01 00:02:00 UTC, Details: x",
    ]
    assert text(plans.list_events_to, log, "restore") == ["No restores found"]
    assert text(plans.list_events_to, log.where("false"), "backup") == ["No backups found"]


def test_status(spark, rows, tmp_path):
    items = rows([("other", "k", "v")], "bucket string, key string, version_id string")
    heads = rows(
        [("k", "v", 'ongoing-request="false"', None)],
        "key string, version_id string, restore_header string, error string",
    )
    counts = plans.list_status_to(items, heads, str(tmp_path / "out"))
    assert tuple(counts.first()) == (1, 0, 0)
    assert spark.read.text(str(tmp_path / "out")).first().value == "k: Restored"


def test_sample(spark, catalog, tmp_path):
    from catalog_engine.plans import list_sample_to

    list_sample_to(catalog, str(tmp_path / "all"), 1000, seed=1, bucket="bkt", manifest=True)
    lines = {r.value for r in spark.read.text(str(tmp_path / "all")).collect()}
    assert lines and all(x.startswith("bkt,") for x in lines)
    list_sample_to(catalog.where("false"), str(tmp_path / "none"), 5)
    assert [r.value for r in spark.read.text(str(tmp_path / "none")).collect()] == ["No files found"]

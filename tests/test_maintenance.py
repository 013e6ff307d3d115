"""Constraints, appends, numbering, schema steps and the event log."""

from catalog_engine import operators as op
from catalog_engine.operators.maintenance import number_rows
from catalog_engine.schemas import EVENTS, FILES, NEW_FILES

from pyspark.sql import functions as F

SHA = "a" * 64


def test_each_constraint_has_its_reason(rows):
    good = [1, "/a", "v", SHA, 0, 1, 1, None]

    def changed(**values):
        row = list(good)
        for name, value in values.items():
            row[FILES.names.index(name)] = value
        return tuple(row)

    cases = [
        (changed(row_seq=1), None),
        (changed(row_seq=2, path=""), "path"),
        (changed(row_seq=3, sha256=SHA[1:]), "sha256"),
        (changed(row_seq=4, sha256="A" * 64), "sha256"),
        (changed(row_seq=5, sha256="a" + "z" * 63), "sha256"),
        (changed(row_seq=6, sha256=SHA + "\n"), "sha256"),
        (changed(row_seq=7, size=-1), "size"),
        (changed(row_seq=8, last_modified_at=0), "last_modified_at"),
        (changed(row_seq=9, deleted_at=0), "deleted_at"),
        (changed(row_seq=10), "duplicate key"),
        (changed(row_seq=11, version_id="w", deleted_at=5), None),
        (changed(row_seq=12, path="", size=-1), "path,size"),
    ]
    accepted, rejects = op.validate_files(rows([c for c, _ in cases], FILES))
    got = {r.row_seq: ",".join(r.reasons) for r in rejects.collect()}
    assert got == {c[0]: why for c, why in cases if why}
    assert sorted(r.row_seq for r in accepted.collect()) == [1, 11]


def test_an_invalid_row_does_not_take_the_key(rows):
    data = [(1, "/a", "v", "bad", 0, 1, 1, None), (2, "/a", "v", SHA, 0, 1, 1, None)]
    accepted, rejects = op.validate_files(rows(data, FILES))
    assert [r.row_seq for r in accepted.collect()] == [2]
    assert [r.reasons for r in rejects.collect()] == [["sha256"]]


def test_append(rows):
    catalog = rows([(7, "/a", "v1", SHA, 1, 1, 1, 5)], FILES)
    new = rows(
        [
            ("/a", "v1", SHA, 1, 1),
            ("/a", "v2", SHA, 1, 2),
            ("/a", "v2", SHA, 1, 2),
            ("/b", "v1", SHA, 1, 9),
            ("/b", "v1", SHA, 1, 3),
            ("/c", "v1", "", 1, 3),
        ],
        NEW_FILES,
    )
    result = op.append_versions(catalog, new, created_at=50)
    accepted = {(r.path, r.version_id, r.last_modified_at) for r in result.accepted.collect()}
    assert accepted == {("/a", "v2", 2), ("/b", "v1", 3)}
    assert all(r.row_seq > 7 and r.created_at == 50 and r.deleted_at is None for r in result.accepted.collect())
    rejects = sorted((r.path, r.version_id, r.copies, r.reasons) for r in result.rejects.collect())
    assert rejects == [
        ("/a", "v1", 1, ["duplicate key"]),
        ("/a", "v2", 1, ["duplicate key"]),
        ("/b", "v1", 1, ["duplicate key"]),
        ("/c", "v1", 1, ["sha256"]),
    ]
    assert result.catalog.columns == FILES.names and result.catalog.count() == 3
    again = op.append_versions(result.catalog, new.where("path <> '/c'"), created_at=60)
    assert again.accepted.count() == 0


def test_append_to_an_empty_catalog(rows):
    result = op.append_versions(rows([], FILES), rows([("/a", "v", SHA, 0, 1)], NEW_FILES))
    assert 0 < result.accepted.first().row_seq <= 65536


def test_numbers_are_unique_and_do_not_depend_on_partitions(spark):
    batch = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, "/hot").otherwise(F.concat(F.lit("/p"), "id")).alias("path"),
        F.concat(F.lit("v"), "id").alias("version_id"),
    )
    one = number_rows(batch.coalesce(1), F.lit(1000).cast("long"))
    many = number_rows(batch.repartition(13), F.lit(1000).cast("long"))
    assert one.exceptAll(many).count() == 0
    facts = one.agg(F.count_distinct("row_seq").alias("n"), F.min("row_seq").alias("low")).first()
    assert facts.n == 50_000 and facts.low > 1000


def test_schema_steps(spark, rows):
    old = rows([("/a", 1)], "path string, size long")
    assert op.upgrade_catalog(old, 1).columns == ["path", "size", "deleted_at"]
    assert op.upgrade_catalog(old).columns == ["path", "size", "created_at", "deleted_at"]
    assert op.upgrade_catalog(old, 2).columns == old.columns
    steps = op.applied_steps(spark, 0, 9)
    assert sorted(tuple(r) for r in steps.collect()) == [(1, 9), (2, 9)]
    assert op.current_schema_version(steps).first().version == 2
    assert op.current_schema_version(steps.where("version > 5")).first().version == 0


def test_event_log(rows):
    log = rows([(100, 110, "backup", None, 110)], EVENTS)
    log, rejects = op.append_event(log, "restore", 200, 210, "  spaced ", created_at=210)
    assert rejects.count() == 0
    assert [tuple(r) for r in op.list_events(log, "restore").collect()] == [(200, 210, "  spaced ")]
    log, _ = op.append_event(log, "backup", 300, None, " \n\t ", created_at=300)
    assert [tuple(r) for r in op.list_events(log, "backup").collect()] == [(300, None, None), (100, 110, None)]
    same, rejects = op.append_event(log, "backup", 100, 120, created_at=120)
    assert same.count() == 3 and rejects.first().reasons == ["duplicate key"]
    _, rejects = op.append_event(log, "copy", 0, 0, created_at=1)
    assert rejects.first().reasons == ["started_at", "ended_at", "type"]
    line = op.format_events(op.list_events(log, "backup")).collect()[0].value
    assert line == "ID: 300, Started At: 1970-01-01 00:05:00 UTC, Ended At: N/A, Details: N/A"


def test_events_in_bulk(rows):
    log = rows([(100, 110, "backup", None, 110)], EVENTS)
    new = rows(
        [
            (100, 1, "backup", "x", 1),
            (5, 9, "backup", "later", 1),
            (5, 8, "restore", "first", 1),
            (6, 7, "backup", " ", 1),
            (6, 7, "backup", " ", 1),
            (7, 7, "other", None, 1),
        ],
        EVENTS,
    )
    got, rejects = op.append_events(log, new)
    assert sorted((r.started_at, r.details) for r in got.where("started_at < 100").collect()) == [(5, "first"), (6, None)]
    assert sorted((r.started_at, r.copies, r.reasons[0]) for r in rejects.collect()) == [
        (5, 1, "duplicate key"),
        (6, 1, "duplicate key"),
        (7, 1, "type"),
        (100, 1, "duplicate key"),
    ]

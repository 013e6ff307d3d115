"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine import functions as fn
from catalog_engine import operators as op
from catalog_engine import plans
from catalog_engine import sources as src
from catalog_engine import streaming
from catalog_engine.session import work_dir
from checks import fixtures as fx

AS_OF = 1705000000
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Sources


@query
def read_catalog(spark, sf):
    """Stored by profile in two runs, the second with the deletion stamps only."""
    root = work_dir(spark, "catalog")
    rows = fx.files(spark, sf).withColumn("profile", F.split("path", "/")[2])
    bare = rows.withColumn("deleted_at", F.lit(None).cast("long"))
    bare.withColumn("run", F.lit(1)).write.partitionBy("profile", "run").parquet(f"{root}/versions")
    stamps = rows.where("deleted_at is not null").select("row_seq", "deleted_at", "profile")
    stamps.withColumn("run", F.lit(2)).write.partitionBy("profile", "run").parquet(f"{root}/stamps")
    return src.read_catalog(spark, root, profile="view")


@query
def compact_catalog(spark, sf):
    """The first of two runs made a base of each profile; all profiles are read as the base and the
    stamps of the second run."""
    root = work_dir(spark, "catalog")
    rows = fx.files(spark, sf).withColumn("profile", F.split("path", "/")[2])
    bare = rows.withColumn("deleted_at", F.lit(None).cast("long"))
    bare.withColumn("run", F.lit(1)).write.partitionBy("profile", "run").parquet(f"{root}/versions")
    stamps = rows.where("deleted_at is not null").select("row_seq", "deleted_at", "profile")
    stamps.withColumn("run", F.lit(2)).write.partitionBy("profile", "run").parquet(f"{root}/stamps")
    whole = None
    for row in rows.select("profile").distinct().orderBy("profile").collect():
        src.compact_catalog(spark, root, row.profile, 1)
        part = src.read_catalog(spark, root, profile=row.profile)
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query
def read_manifest(spark, sf):
    path = work_dir(spark, "manifest")
    fx.manifest_lines(spark, sf).write.option("lineSep", "\n").text(path)
    return src.read_manifest(spark, path, on_error="reject")[0]


@query
def read_manifest_rejects(spark, sf):
    path = work_dir(spark, "manifest")
    fx.manifest_lines(spark, sf).write.option("lineSep", "\n").text(path)
    rejects = src.read_manifest(spark, path, on_error="reject")[1]
    return rejects.select("line", "reason")


@query
def read_chunks(spark, sf):
    return fx.chunks(spark, sf).groupBy("path").agg(
        F.count("*").alias("n_chunks"),
        F.sum(F.length("plaintext")).cast("long").alias("n_bytes"),
        F.count_if("is_last").alias("n_last"),
    )


# Sinks


def _new_versions(spark, sf):
    """Rows to append: stored keys, repeated keys and broken values among them."""
    rows = fx.files(spark, sf).selectExpr(
        "path",
        "case when row_seq % 5 = 0 then version_id else concat('n', row_seq) end as version_id",
        "case when row_seq % 11 = 0 then upper(sha256) else sha256 end as sha256",
        "case when row_seq % 13 = 0 then -1 else size end as size",
        "last_modified_at + row_seq % 2 as last_modified_at",
        "row_seq % 3 as turn",
    )
    later = rows.where("turn = 0").withColumn("last_modified_at", F.col("last_modified_at") + 5)
    return rows.unionAll(later).unionAll(rows.where("turn = 1")).drop("turn")


def _append(spark, sf):
    return op.append_versions(fx.files(spark, sf), _new_versions(spark, sf), created_at=fx.NOW)


@query
def append_versions(spark, sf):
    return _append(spark, sf).catalog


@query
def append_versions_rejects(spark, sf):
    rejects = _append(spark, sf).rejects
    return rejects.withColumn("reasons", F.array_join("reasons", ","))


@query
def append_event(spark, sf):
    events, _ = op.append_event(fx.run_events(spark, sf), "backup", 2, 9, " \t", created_at=9)
    return events


@query
def append_events(spark, sf):
    """Runs with blank and padded details, recorded in bulk on top of a third of the log."""
    runs = fx.run_events(spark, sf)
    stored = runs.where("created_at % 300 = 0")
    new = runs.withColumn(
        "details", F.expr("case when created_at % 400 = 0 then ' \\n ' else concat(' ', details) end")
    )
    return op.append_events(stored, new)[0]


@query
def to_manifest(spark, sf):
    return op.to_manifest(op.files_as_of(fx.files(spark, sf), AS_OF), "bkt")


@query
def format_files(spark, sf):
    return op.format_files(op.files_as_of(fx.files(spark, sf), AS_OF))


@query
def format_versions(spark, sf):
    return op.format_versions(fx.files(spark, sf))


@query
def format_events(spark, sf):
    return op.format_events(op.list_events(fx.run_events(spark, sf), "backup"))


@query
def write_listing(spark, sf):
    path = work_dir(spark, "listing")
    lines = op.format_events(op.list_events(fx.run_events(spark, sf), "restore"))
    src.write_listing(lines, path, "No restores found")
    return spark.read.text(path)


@query
def write_listing_empty(spark, sf):
    path = work_dir(spark, "listing")
    none = op.list_events(fx.run_events(spark, sf), "backup").where("started_at < 0")
    src.write_listing(op.format_events(none), path, "No backups found")
    return spark.read.text(path)


@query
def publish_catalog(spark, sf):
    folder = src.publish_catalog(
        fx.files(spark, sf), fx.run_events(spark, sf), work_dir(spark, "publish"), fx.NOW
    )
    return spark.read.parquet(f"{folder}/files")


@query
def adopt_snapshot(spark, sf):
    """A published catalog, read again from a new store that adopted the snapshot."""
    folder = src.publish_catalog(
        fx.files(spark, sf), fx.run_events(spark, sf), work_dir(spark, "publish"), fx.NOW
    )
    store = work_dir(spark, "store")
    src.adopt_snapshot(spark, folder, store)
    events = src.read_events(spark, store, "default").agg(F.count("*").alias("n_events"))
    return src.read_catalog(spark, store, "default").join(events)


@query
def restore_layout(spark, sf):
    keyed = fx.manifest(spark, sf).withColumn(
        "key",
        F.expr(
            """case cast(conv(substr(computed_sha256, 1, 2), 16, 10) as int) % 6
                 when 0 then key
                 when 1 then concat('/', key)
                 when 2 then concat(key, '/../z')
                 when 3 then concat('../..', key)
                 when 4 then replace(key, '/user', '/./user/')
                 else '/data/..' end"""
        ),
    )
    return op.restore_layout(keyed, "/restore/./to/").select("key", "version_id", "out_path", "reason")


# Filters and predicates


@query
def filter_prefix(spark, sf):
    return op.filter_prefix(fx.files(spark, sf), "/DATA/view/user_1")


@query
def filter_prefix_literal(spark, sf):
    return op.filter_prefix(fx.files(spark, sf), "/data/view/user_1", match="literal")


@query
def live_only(spark, sf):
    return op.live_only(op.latest_versions(fx.files(spark, sf)))


@query
def live_only_as_of(spark, sf):
    return op.live_only(fx.files(spark, sf), AS_OF)


@query
def filter_events(spark, sf):
    return op.filter_events(fx.run_events(spark, sf), "restore")


def _addresses(spark, sf):
    return op.parse_object_uri(
        fx.files(spark, sf).selectExpr(
            "row_seq",
            """case row_seq % 6
                 when 0 then concat('s3://bkt', path)
                 when 1 then concat('s3://other', path)
                 when 2 then concat('http://bkt', path)
                 when 3 then 's3://bkt'
                 when 4 then concat('s3://bkt/', path)
                 else concat('s3://bkt', path, '/') end as uri""",
        )
    )


@query
def parse_object_uri(spark, sf):
    return _addresses(spark, sf)


@query
def check_bucket(spark, sf):
    return op.check_bucket(_addresses(spark, sf), "bkt")


# Joins


@query
def detect_changed(spark, sf):
    return op.detect_changed(fx.inventory(spark, sf), fx.files(spark, sf))


@query
def detect_deleted(spark, sf):
    return op.detect_deleted(fx.files(spark, sf), fx.inventory(spark, sf), ["/data", "/data/view/"])


@query
def lookup_checksums(spark, sf):
    return op.lookup_checksums(
        fx.manifest(spark, sf).drop("computed_sha256"), fx.files(spark, sf)
    )


@query
def verify_checksums(spark, sf):
    return op.verify_checksums(fx.manifest(spark, sf), fx.files(spark, sf))


@query
def mark_deleted(spark, sf):
    catalog = fx.files(spark, sf)
    gone = op.detect_deleted(catalog, fx.inventory(spark, sf), ["/data"])
    return op.mark_deleted(catalog, gone, fx.NOW)


@query
def restore_status(spark, sf):
    return op.restore_status(fx.status_manifest(spark, sf), fx.heads(spark, sf))


# Aggregations


@query
def file_exists(spark, sf):
    return op.file_exists(fx.inventory(spark, sf), fx.files(spark, sf))


@query
def status_summary(spark, sf):
    return op.status_summary(restore_status(spark, sf))


@query
def run_summary(spark, sf):
    catalog, walk = fx.files(spark, sf), fx.inventory(spark, sf)
    changed = op.detect_changed(walk, catalog)
    failed = changed.where("size % 5 = 0")
    stored = changed.where("size % 5 <> 0")
    deleted = op.detect_deleted(catalog, walk, ["/data"])
    return op.run_summary(changed, stored, deleted, failed, 100, 160)


def _migrations(spark, sf):
    return fx.table(spark, sf, "orders").groupBy(F.expr("o_orderkey % 2 + 1").alias("version")).agg(
        F.min("o_orderkey").alias("applied_at")
    )


@query
def current_schema_version(spark, sf):
    return op.current_schema_version(_migrations(spark, sf))


@query
def file_digests(spark, sf):
    return op.file_digests(fx.chunks(spark, sf)).select("path", "size", "sha256")


# Windows


@query
def latest_versions(spark, sf):
    return op.latest_versions(fx.files(spark, sf))


@query
def files_as_of(spark, sf):
    return op.files_as_of(fx.files(spark, sf), AS_OF)


@query
def files_as_of_prefix(spark, sf):
    return op.files_as_of(fx.files(spark, sf), "2024-01-11T19:06:40Z", ["/DATA/view/user_1"])


# Sorts, limits, sets


@query
def list_events(spark, sf):
    return op.list_events(fx.run_events(spark, sf), "backup")


@query
def list_versions(spark, sf):
    return op.list_versions(fx.files(spark, sf), "/data/view/user_10.dat")


@query
def sample_live(spark, sf):
    return op.sample_live(fx.files(spark, sf), 100, seed=7)


@query
def sample_live_count(spark, sf):
    return op.sample_live(fx.files(spark, sf), 100).agg(F.count("*").alias("n"))


@query
def list_files_multi(spark, sf):
    return op.list_files_multi(
        fx.files(spark, sf), ["/data/view", "/data/view/user_1", "/data/click"], AS_OF
    )


@query
def walked_paths(spark, sf):
    walk = fx.inventory(spark, sf)
    return op.walked_paths(walk.unionAll(walk))


# Scalar functions


@query
def parse_restore_header(spark, sf):
    parsed = fn.parse_restore_header(F.col("restore_header")).alias("head")
    return fx.heads(spark, sf).select("key", parsed).select("key", "head.*")


@query
def status_text(spark, sf):
    return op.format_status(restore_status(spark, sf))


@query
def upload_parts(spark, sf):
    sizes = fx.object_sizes(spark, sf).withColumn("stored", fn.sealed_size(F.col("size")))
    return sizes.select("l_orderkey", "stored", fn.upload_parts(F.col("stored")).alias("p")).select(
        "l_orderkey", "stored", "p.part_size", "p.part_count"
    )


@query
def n_chunks(spark, sf):
    size = F.col("size")
    return fx.documents(spark, sf).select("path", fn.n_chunks(size, fx.CHUNK).alias("n_chunks"))


@query
def sealed_size(spark, sf):
    size = F.col("size")
    return fx.object_sizes(spark, sf).select("l_orderkey", fn.sealed_size(size).alias("sealed_size"))


@query
def epoch_text(spark, sf):
    return fx.files(spark, sf).select(
        "row_seq", fn.epoch_text(F.col("last_modified_at")).alias("modified")
    )


@query
def hex_digest(spark, sf):
    return fx.documents(spark, sf).select("path", fn.hex_digest(F.col("content")).alias("sha256"))


# Content


@query
def plan_headers(spark, sf):
    return fx.headers(spark, sf).select("path", "n_chunks", F.hex("header").alias("header"))


@query
def plan_headers_random(spark, sf):
    """Drawn salts, prefixes and version ids: stored once, all different, all well formed."""
    root = work_dir(spark, "headers")
    walk = fx.documents(spark, sf).select("path", "size")
    stored = src.write_run(op.plan_headers(walk, fx.MAGIC), root, "headers", "test", 1)
    return stored.agg(
        F.count("*").alias("n"),
        F.count_distinct("salt").alias("salts"),
        F.count_distinct("nonce_prefix").alias("prefixes"),
        F.count_distinct("version_id").alias("versions"),
        F.count_if((F.length("header") == 49) & (F.length("salt") == 16)).alias("whole"),
    )


@query
def chunk_nonces(spark, sf):
    nonces = op.chunk_nonces(fx.chunks(spark, sf), fx.headers(spark, sf))
    return nonces.select("path", "chunk_index", F.hex("nonce").alias("nonce"))


def _sealed(spark, sf):
    return op.seal_chunks(fx.chunks(spark, sf), fx.headers(spark, sf), fx.keys(spark, sf))


@query
def seal_chunks(spark, sf):
    return _sealed(spark, sf).select(
        "path",
        "chunk_index",
        "is_last",
        F.length("payload").cast("long").alias("n_bytes"),
        "chunk_sha256",
    )


@query
def open_chunks(spark, sf):
    opened = op.open_chunks(_sealed(spark, sf), fx.headers(spark, sf), fx.keys(spark, sf))
    return op.file_digests(opened).select("path", "size", "sha256")


@query
def verify_sealed(spark, sf):
    digests = fx.documents(spark, sf).select("path", "version_id", F.sha2("content", 256).alias("sha256"))
    verified = op.verify_sealed(_sealed(spark, sf), fx.headers(spark, sf), fx.keys(spark, sf), digests)
    return verified.select("path", "status")


@query
def verify_sealed_chunks(spark, sf):
    """The check chunk by chunk, with every seventh document's first chunk altered."""
    spoilt = F.expr("cast(substr(version_id, 2) as bigint) % 7 = 0")
    altered = F.when(spoilt & (F.col("chunk_index") == 0), F.concat(F.col("payload"), F.lit(b"x")))
    sealed = _sealed(spark, sf).withColumn("payload", F.coalesce(altered, F.col("payload")))
    verified = op.verify_sealed(sealed, fx.headers(spark, sf), fx.keys(spark, sf))
    return verified.groupBy(spoilt.alias("spoilt"), "status").agg(F.count("*").alias("n"))


@query
def parse_headers(spark, sf):
    return op.parse_headers(fx.damaged_headers(spark, sf), fx.MAGIC).select(
        "path", "reason", "n_chunks", "size"
    )


@query
def detect_format(spark, sf):
    return op.detect_format(fx.damaged_headers(spark, sf), fx.MAGIC).select("path", "format")


@query
def split_container(spark, sf):
    chunks, _ = op.split_container(fx.damaged_headers(spark, sf), fx.MAGIC)
    return chunks.groupBy("path").agg(
        F.count("*").alias("n_chunks"),
        F.sum(F.length("payload")).cast("long").alias("n_bytes"),
        F.count_if("is_last").alias("n_last"),
    )


@query
def split_container_rejects(spark, sf):
    return op.split_container(fx.damaged_headers(spark, sf), fx.MAGIC)[1].select("path", "reason")


@query
def split_container_forged(spark, sf):
    """Chunks of containers, of which every fifth claims to have chunks of one byte: sizes that no such
    container can have, else its first chunk, tell them apart, and only the others are expanded."""
    rows = fx.forged_headers(spark, sf).join(fx.keys(spark, sf), ["path", "version_id"])
    forged = op.forged_containers(rows, fx.MAGIC, probe=0)
    chunks, unusable = op.split_container(rows.join(forged, ["path", "version_id"], "left_anti"), fx.MAGIC)
    found = chunks.groupBy("path").agg(F.count("*").alias("n_chunks"), F.sum(F.length("payload")).alias("n_bytes"))
    refused = forged.select("path").union(unusable.select("path"))
    return found.unionByName(refused, allowMissingColumns=True)


@query
def split_legacy(spark, sf):
    frames = op.split_legacy(fx.legacy_containers(spark, sf).drop("doc_id"))
    return frames.groupBy("path").agg(
        F.count_if(F.col("reason").isNull()).alias("n_frames"),
        F.max("reason").alias("reason"),
    )


@query
def open_legacy(spark, sf):
    frames = op.split_legacy(fx.legacy_containers(spark, sf).drop("doc_id"))
    opened = op.open_legacy(frames, fx.keys(spark, sf))
    digests = op.file_digests(opened)
    return digests.select("path", "sha256")


@query
def audit_containers(spark, sf):
    damaged = fx.damaged_chunks(_sealed(spark, sf))
    audit = op.audit_containers(damaged, fx.headers(spark, sf), fx.keys(spark, sf))
    return audit.drop("version_id")


# Jobs


def _document_walk(spark, sf):
    return fx.documents(spark, sf).selectExpr(
        "doc_id", "path", "size", "1700000000 + doc_id as last_modified_at"
    )


def _document_catalog(spark, sf):
    """A catalog that knows a third of the documents, an older version of another third, and
    files that are no longer there."""
    return fx.documents(spark, sf).selectExpr(
        "doc_id as row_seq",
        "case when doc_id % 5 = 4 then concat('/docs/gone/', doc_id) else path end as path",
        "version_id",
        "sha2(content, 256) as sha256",
        "size",
        "1700000000 + doc_id - case when doc_id % 3 = 1 then 10 else 0 end as last_modified_at",
        "1700000100 as created_at",
        "cast(null as bigint) as deleted_at",
    ).where("row_seq % 3 <> 2")


def _backup(spark, sf):
    docs = fx.documents(spark, sf)
    content = docs.where("doc_id % 7 <> 0").select("path", "content")
    return plans.backup_run(
        _document_walk(spark, sf).drop("doc_id"),
        content,
        _document_catalog(spark, sf),
        fx.run_events(spark, sf),
        docs.select("path", "key"),
        ["/docs"],
        now=fx.NOW,
        store=work_dir(spark, "backup"),
        magic=fx.MAGIC,
        details="nightly",
        ended_at=fx.NOW + 60,
        chunk_size=fx.CHUNK,
    )


@query
def backup_run(spark, sf):
    return _backup(spark, sf).summary


@query
def backup_run_catalog(spark, sf):
    """Every version after the run, without the drawn ids."""
    return _backup(spark, sf).catalog.select(
        "path", "sha256", "size", "last_modified_at", "created_at", "deleted_at"
    )


@query
def backup_run_repeated(spark, sf):
    """The stored catalog after one run was made twice, with objects and a snapshot."""
    docs, store = fx.documents(spark, sf), work_dir(spark, "backup")
    objects = work_dir(spark, "objects").removeprefix("file://").removeprefix("file:")
    published = work_dir(spark, "publish")
    content = docs.where("doc_id % 7 <> 0").select("path", "content")
    for _ in range(2):
        plans.backup_run(
            _document_walk(spark, sf).drop("doc_id"),
            content,
            None,
            None,
            docs.select("path", "key"),
            ["/docs"],
            now=fx.NOW,
            store=store,
            magic=fx.MAGIC,
            ended_at=fx.NOW + 60,
            chunk_size=fx.CHUNK,
            objects=objects,
            publish_to=published,
        )
    made = src.read_containers(spark, objects).agg(F.count("*").alias("n_objects"))
    events = src.read_events(spark, store, "default").agg(F.count("*").alias("n_events"))
    return src.read_catalog(spark, store, "default").join(events).join(made).select(
        "path", "sha256", "size", "last_modified_at", "created_at", "deleted_at", "n_events", "n_objects"
    )


def _below(root):
    """A path of a tree without the folder the tree is in."""
    return F.expr(f"substring(path, {len(root) + 1})").alias("path")


@query
def scan_inventory(spark, sf):
    root = fx.document_tree(spark, sf)
    walk, _ = src.scan_inventory(spark, [root])
    return walk.select(_below(root), "size", "last_modified_at")


def _tree_backup(spark, sf):
    """A backup of a tree from disk, with containers as files: root, folder, keys, result."""
    root, store = fx.document_tree(spark, sf), work_dir(spark, "store")
    objects = work_dir(spark, "objects").removeprefix("file://").removeprefix("file:")
    walk, _ = src.scan_inventory(spark, [root])

    def keys(headers):
        return headers.select("path", "version_id", F.unhex(F.sha2("salt", 256)).alias("key"))

    result = plans.backup_run(
        walk, None, None, None, keys, [root], fx.NOW, store, fx.MAGIC,
        ended_at=fx.NOW + 60, chunk_size=fx.CHUNK, objects=objects,
    )
    headers = spark.read.parquet(f"{store}/headers/profile=default/run={fx.NOW}")
    return root, store, objects, keys(headers), result


@query
def backup_run_from_files(spark, sf):
    root, *_, result = _tree_backup(spark, sf)
    return result.catalog.select(_below(root), "sha256", "size", "last_modified_at", "created_at")


@query
def read_containers(spark, sf):
    root, _, objects, _, _ = _tree_backup(spark, sf)
    return src.read_containers(spark, objects).select(_below(root), "total_size")


@query
def restore_run_to_files(spark, sf):
    """Every document restored from containers in storage and written back to files; the containers
    of every second one are of the older framing."""
    root, store, objects, keys, result = _tree_backup(spark, sf)
    # The containers are in their folder: the sealed chunks they were written from go.
    src.discard_run(spark, f"{store}/sealed/profile=default/run={fx.NOW}")
    legacy = fx.documents(spark, sf).where("doc_id % 2 = 0").drop("version_id", "key", "content")
    legacy = legacy.withColumn("path", F.expr(f"concat('{root}', substring(path, 6))"))
    # Keys meet names; the contents are read from the tree where they are framed, and are not shuffled.
    named = legacy.join(keys, "path").withColumns(
        {"location": F.col("path"), "offset": F.lit(0).cast("long"), "length": F.col("size")}
    )
    legacy = fx.legacy_content(src.read_ranges(named, "content"))
    fx.write_files(legacy.select(F.concat(F.lit(objects), "path", F.lit("/"), "version_id").alias("path"), "content"))
    # What is restored comes from the containers alone.
    fx.remove_files(result.catalog)
    out = work_dir(spark, "out").removeprefix("file://").removeprefix("file:")
    items = result.catalog.selectExpr("'bkt' as bucket", "path as key", "version_id")
    restored = plans.restore_run(
        items, src.read_containers(spark, objects), None, keys, out, fx.MAGIC, None,
        now=fx.NOW + 100, store=store, ended_at=fx.NOW + 105, write=True,
    )
    written, _ = src.scan_inventory(spark, [out])
    bytes_out = written.select(F.expr(f"substring(path, {len(out) + 1})").alias("path"), "size")
    status = restored.status.select(F.col("key").alias("path"), "status")
    return status.join(bytes_out, "path").select(_below(root), "status", "size")


def _restore(spark, sf):
    whole = fx.damaged_headers(spark, sf)
    legacy = fx.legacy_containers(spark, sf)
    stored = whole.where("doc_id % 24 < 12").unionByName(legacy.where("doc_id % 24 >= 14")).drop("doc_id")
    catalog = fx.documents(spark, sf).where("doc_id % 17 <> 0").selectExpr(
        "path",
        "version_id",
        "case when doc_id % 13 = 0 then repeat('0', 64) else sha2(content, 256) end as sha256",
    )
    items = fx.documents(spark, sf).selectExpr("'bkt' as bucket", "path as key", "version_id")
    return plans.restore_run(
        items,
        stored,
        catalog,
        fx.keys(spark, sf),
        "/restore",
        fx.MAGIC,
        fx.run_events(spark, sf),
        now=fx.NOW,
        store=work_dir(spark, "restore"),
        ended_at=fx.NOW + 5,
    )


@query
def restore_run(spark, sf):
    return _restore(spark, sf).status.select("key", "status")


@query
def restore_run_summary(spark, sf):
    return _restore(spark, sf).summary


# Maintenance


def _unchecked_files(spark, sf):
    rows = fx.files(spark, sf).selectExpr(
        "row_seq",
        "case when row_seq % 29 = 0 then '' else path end as path",
        "concat('v', row_seq % 997) as version_id",
        "case row_seq % 31 when 0 then upper(sha256) when 1 then substr(sha256, 2) else sha256 end as sha256",
        "case when row_seq % 37 = 0 then null when row_seq % 41 = 0 then -size - 1 else size end as size",
        "case when row_seq % 43 = 0 then 0 else last_modified_at end as last_modified_at",
        "created_at",
        "case when row_seq % 47 = 0 then -1 else deleted_at end as deleted_at",
    )
    return rows.withColumn("path", F.expr("regexp_replace(path, 'user_[0-9]+', 'user_1')"))


@query
def validate_files(spark, sf):
    return op.validate_files(_unchecked_files(spark, sf))[0]


@query
def validate_files_rejects(spark, sf):
    rejects = op.validate_files(_unchecked_files(spark, sf))[1]
    return rejects.select("row_seq", F.array_join("reasons", ",").alias("reasons"))


@query
def validate_events(spark, sf):
    return op.validate_events(fx.colliding_events(spark, sf))[0]


@query
def validate_events_rejects(spark, sf):
    rejects = op.validate_events(fx.colliding_events(spark, sf))[1]
    return rejects.select("created_at", "copies", F.array_join("reasons", ",").alias("reasons"))


@query
def upgrade_catalog(spark, sf):
    old = fx.files(spark, sf).drop("deleted_at")
    return op.upgrade_catalog(old, from_version=1)


# Streaming


def _ingest(spark, sf):
    """The backup's walk as a stream of files, over a stored catalog."""
    root, feed = work_dir(spark, "ingest"), work_dir(spark, "feed")
    known = F.col("doc_id") % 3 == 0
    version = F.when(~known, F.concat(F.lit("s"), "doc_id"))
    digest = F.when(~known, F.sha2("path", 256))
    rows = _document_walk(spark, sf).select(
        "path", version.alias("version_id"), digest.alias("sha256"), "size", "last_modified_at"
    )
    rows.repartition(4, "path").write.parquet(feed)
    src.write_run(_document_catalog(spark, sf), root, "versions", "default", 1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(feed)
    return streaming.ingest_stream(stream, root, ["/docs"], fx.NOW, ended_at=fx.NOW + 60)


@query
def ingest_stream(spark, sf):
    return _ingest(spark, sf).catalog.select(
        "path", "version_id", "sha256", "size", "last_modified_at", "deleted_at"
    )


@query
def ingest_stream_summary(spark, sf):
    return _ingest(spark, sf).summary

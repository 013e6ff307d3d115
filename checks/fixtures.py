"""Catalog tables derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine.operators import latest_versions, plan_headers
from catalog_engine.session import work_dir
from catalog_engine.sources import read_chunks

MAGIC = "CATALOG-TEST"
CHUNK = 1024
NOW = 1_800_000_000

SECONDS = "unix_micros(cast(ts as timestamp)) div 1000000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as read from storage, where containers come from."""
    folder = work_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as row_seq",
        "concat('/data/', event_type, '/user_', user_id, '.dat') as path",
        "concat('v', event_id) as version_id",
        "sha2(props, 256) as sha256",
        "cast(floor(value * 100) as bigint) as size",
        f"{SECONDS} as last_modified_at",
        f"{SECONDS} + 60 as created_at",
        f"case when event_id % 7 = 0 then {SECONDS} + 86400 end as deleted_at",
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "events").selectExpr("event_id as row_seq", "user_id")
    return (
        latest_versions(files(spark, sf_dir))
        .join(owners, "row_seq")
        .where("user_id % 4 <> 0")
        .selectExpr(
            "path",
            "size + case when row_seq % 3 = 0 then 1 else 0 end as size",
            "last_modified_at + case when row_seq % 3 = 0 then 10 else 0 end as last_modified_at",
        )
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "1000000000 + o_orderkey * 100 as started_at",
        "1000000000 + o_orderkey * 100 + cast(floor(o_totalprice) as bigint) % 97 as ended_at",
        "case when o_orderstatus = 'F' then 'restore' else 'backup' end as type",
        "nullif(trim(case when o_orderpriority = '5-LOW' then '  ' else o_orderpriority end), '') as details",
        "1000000000 + o_orderkey * 100 as created_at",
    )


def colliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of which several start in one second, some twice over, some of a wrong type."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "1000000000 + o_orderkey % 5003 as started_at",
        "case when o_orderkey % 19 = 0 then 0 else 1000000000 + o_orderkey % 5003 + cast(floor(o_totalprice) as bigint) % 97 end as ended_at",
        "case o_orderstatus when 'F' then 'restore' when 'O' then 'backup' else 'other' end as type",
        "concat(o_orderpriority, ' ', o_orderkey) as details",
        "o_orderkey as created_at",
    )
    return rows.unionAll(rows.where("created_at % 4 = 0"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).selectExpr(
        "'bkt' as bucket",
        "path as key",
        "case when row_seq % 11 = 0 then 'missing' else version_id end as version_id",
        "case when row_seq % 13 = 0 then repeat('0', 64) else sha256 end as computed_sha256",
    )


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest text with blank, padded, short and long lines among the good ones."""
    return files(spark, sf_dir).selectExpr(
        """case row_seq % 9
             when 1 then '   '
             when 2 then concat(' bkt , ', path, ' ,', version_id, ' \\r')
             when 3 then concat('bkt,', path)
             when 4 then concat('bkt,', path, ',', version_id, ',x')
             else concat_ws(',', 'bkt', path, version_id) end as value"""
    )


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restore headers, their dates in each of the three forms."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('/orders/', o_orderkey) as key",
        "concat('v', o_orderkey) as version_id",
        """case o_orderstatus
             when 'O' then 'ongoing-request="true"'
             when 'F' then concat('ongoing-request="false", expiry-date="', case o_orderkey % 4
               when 0 then date_format(o_orderdate, 'EEEE, dd-MMM-yy HH:mm:ss') || ' GMT'
               when 1 then date_format(o_orderdate, 'EEE MMM dd HH:mm:ss yyyy')
               when 2 then 'soon'
               else date_format(o_orderdate, 'EEE, dd MMM yyyy HH:mm:ss') || ' GMT' end, '"')
           end as restore_header""",
        "case when o_orderkey % 17 = 0 then 'access denied' end as error",
    )


def status_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "'bkt' as bucket",
        "concat('/orders/', o_orderkey) as key",
        "case when o_orderkey % 23 = 0 then 'gone' else concat('v', o_orderkey) end as version_id",
    )


def object_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.expr("sum(cast(floor(l_extendedprice * 300) as bigint)) as size"))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with the header and key material of tests: digests of the document id."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "concat('/docs/', source, '/', lang, '/', doc_id, '.txt') as path",
        "concat('d', doc_id) as version_id",
        "cast(text as binary) as content",
        "cast(octet_length(text) as bigint) as size",
        "unhex(md5(concat('salt', doc_id))) as salt",
        "unhex(substr(md5(concat('nonce', doc_id)), 1, 14)) as nonce_prefix",
        "unhex(sha2(concat('key', doc_id), 256)) as key",
    )


def document_tree(spark: SparkSession, sf_dir: str) -> str:
    """All documents as files ``<root>/<source>/<lang>/<doc_id>.txt``; the root is returned.

    The folder is the one that executors share, which must be mounted on all of them.
    """
    root = work_dir(spark, "tree").removeprefix("file://").removeprefix("file:")
    if "://" in root:
        raise ValueError("files need a mounted folder as spark.checkpoint.dir")
    rows = documents(spark, sf_dir).select(
        F.concat(F.lit(root), F.substring("path", F.lit(6), F.length("path"))).alias("path"), "content"
    )
    write_files(rows)
    return root


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = documents(spark, sf_dir).select("path", "version_id", "content")
    return read_chunks(content, CHUNK)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = documents(spark, sf_dir).select("path", "version_id", "size", "salt", "nonce_prefix")
    return plan_headers(known, MAGIC, CHUNK)


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("path", "version_id", "key")


def _joined(frame: str) -> str:
    """A container's chunks in order, each given by the expression ``frame`` of index ``i``."""
    return f"aggregate(sequence(0, n_chunks - 1), cast('' as binary), (acc, i) -> concat(acc, {frame}))"


def _piece(nonce: str, *aad: str) -> str:
    arguments = ", ".join(["'GCM'", "'DEFAULT'", nonce, *aad])
    return f"aes_encrypt(substring(content, cast(i * {CHUNK} + 1 as int), {CHUNK}), key, {arguments})"


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole containers, built row by row."""
    own = documents(spark, sf_dir)
    planned = plan_headers(own, MAGIC, CHUNK)
    nonce = "concat(nonce_prefix, unhex(lpad(hex(i), 8, '0')), unhex(if(i = n_chunks - 1, '01', '00')))"
    sealed = _joined(f"substring({_piece(nonce, 'header')}, 13)")
    return planned.select(
        "doc_id", "path", "version_id", F.expr(f"concat(header, {sealed})").alias("content")
    )


def damaged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers whose header is broken in one of eight ways, by document id."""
    swap = {
        1: "concat(unhex('00'), substring(content, 2))",
        2: "concat(substring(content, 1, 12), unhex('02'), substring(content, 14))",
        3: "concat(substring(content, 1, 29), unhex('00000000'), substring(content, 34))",
        4: "concat(substring(content, 1, 33), unhex('00400001'), substring(content, 38))",
        5: "concat(substring(content, 1, 37), unhex('41'), substring(content, 39))",
        6: "concat(substring(content, 1, 45), unhex('00000000'), substring(content, 50))",
        7: "substring(content, 1, 30)",
        8: "substring(content, 1, 49)",
        9: "substring(content, 1, 49 + 1040 * ((octet_length(content) - 50) div 1040) + 15)",
        10: "substring(content, 1, 5)",
    }
    cases = " ".join(f"when {n} then {text}" for n, text in swap.items())
    broken = F.expr(f"case doc_id % 12 {cases} else content end")
    return _stored(containers(spark, sf_dir).withColumn("content", broken), "containers")


def legacy_content(docs: DataFrame) -> DataFrame:
    """``content`` (with ``size``, ``salt`` and ``key``) in the older framing."""
    own = docs.withColumn("n_chunks", F.expr(f"greatest(1, (size + {CHUNK} - 1) div {CHUNK})"))
    nonce = "unhex(substr(md5(concat('frame', doc_id, '-', i)), 1, 24))"
    sealed = _piece(nonce)
    # The built-in puts the nonce first, where the frame wants it; the length goes between.
    little = "unhex(concat(substr(h, 15, 2), substr(h, 13, 2), substr(h, 11, 2), substr(h, 9, 2), '00000000'))"
    length = (
        f"transform(array(lpad(hex(octet_length({sealed}) - 12), 16, '0')), h -> {little})[0]"
    )
    frame = f"concat(substring({sealed}, 1, 12), {length}, substring({sealed}, 13))"
    return own.select(
        "doc_id", "path", "version_id", F.expr(f"concat(salt, {_joined(frame)})").alias("content")
    )


def legacy_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of the older framing, cut short for every tenth document."""
    whole = legacy_content(documents(spark, sf_dir))
    cut = "case when doc_id % 10 = 0 then substring(content, 1, octet_length(content) - 1) else content end"
    return _stored(whole.withColumn("content", F.expr(cut)), "legacy")


def forged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, every fifth with a header that says that its chunks have one byte."""
    forged = "concat(substring(content, 1, 45), unhex('00000001'), substring(content, 50))"
    cases = f"case when doc_id % 5 = 0 then {forged} else content end"
    return _stored(containers(spark, sf_dir).withColumn("content", F.expr(cases)), "containers")


def write_files(rows: DataFrame) -> None:
    """Writes ``content`` to the file ``path`` of each row."""

    def write(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as file:
                    file.write(content)
                os.utime(path, (NOW - 1000, NOW - 1000))
            yield batch.select(["path"])

    rows.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def remove_files(paths: DataFrame) -> None:
    """Removes the files ``path`` that nothing reads any more; by many tasks, as they were written."""

    def remove(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if os.path.exists(path):
                    os.remove(path)
            yield batch

    paths.select("path").mapInArrow(remove, "path string").write.format("noop").mode("overwrite").save()


def damaged_chunks(sealed: DataFrame) -> DataFrame:
    """Sealed chunks with a fault by document: dropped, swapped, altered, repeated, spliced."""
    kind = F.substring("version_id", F.lit(2), F.length("version_id")).cast("long") % 6
    first, last = F.col("chunk_index") == 0, F.col("is_last")
    swapped = F.when(
        (kind == 2) & (F.col("n_chunks") > 1) & (F.col("chunk_index") < 2), 1 - F.col("chunk_index")
    ).otherwise(F.col("chunk_index"))
    flipped = F.concat(
        F.substring("payload", F.lit(1), F.length("payload") - 1),
        F.when(F.substring("payload", -1, 1) == F.lit(b"\x00"), F.lit(b"\x01")).otherwise(F.lit(b"\x00")),
    )
    payload = F.when((kind == 3) & first, flipped).otherwise(F.col("payload"))
    kept = sealed.where(~((kind == 1) & last))
    copies = kept.where((kind == 4) & first)
    alien = kept.where((kind == 5) & first & (F.col("n_chunks") > 1)).withColumn(
        "chunk_index", F.col("n_chunks")
    )
    changed = kept.withColumn("payload", payload).withColumn("chunk_index", swapped)
    return reduce(DataFrame.unionByName, [changed, copies, alien])

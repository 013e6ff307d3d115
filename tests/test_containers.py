"""Container headers, framing, legacy frames and audits."""

import hashlib
import random
import struct

from pyspark.sql import functions as F

from catalog_engine import operators as op
from catalog_engine.sources import read_chunks
from tests.test_content import CHUNK, CONTENT, MAGIC, material, table_of


def joined(sealed, headers):
    """Container bytes by path, put together outside Spark."""
    whole = {r.path: bytes(r.header) for r in headers.collect()}
    for r in sealed.orderBy("path", "chunk_index").collect():
        whole[r.path] += bytes(r.payload)
    return whole


def header(**fields):
    values = dict(magic=MAGIC.encode(), version=1, time=3, memory=65536, threads=4, chunk=CHUNK)
    values.update(fields)
    return (
        values["magic"]
        + bytes([values["version"]])
        + bytes(16)
        + struct.pack(">IIB", values["time"], values["memory"], values["threads"])
        + bytes(7)
        + struct.pack(">I", values["chunk"])
    )


def test_header_limits(rows):
    body = bytes(CHUNK + 16)
    cases = [
        (header() + body, None),
        (header(magic=b"CATALOG-TESU") + body, "bad magic"),
        (header(version=2) + body, "unsupported version"),
        (header(version=0) + body, "unsupported version"),
        (header(time=0) + body, "invalid time cost"),
        (header(time=20) + body, None),
        (header(time=21) + body, "invalid time cost"),
        (header(time=0xFFFFFFFF) + body, "invalid time cost"),
        (header(memory=0) + body, "invalid memory cost"),
        (header(memory=4 << 20) + body, None),
        (header(memory=(4 << 20) + 1) + body, "invalid memory cost"),
        (header(threads=0) + body, "invalid parallelism"),
        (header(threads=64) + body, None),
        (header(threads=65) + body, "invalid parallelism"),
        (header(chunk=0) + body, "invalid chunk size"),
        (header(chunk=1 << 30) + body, None),
        (header(chunk=(1 << 30) + 1) + body, "invalid chunk size"),
        (header(), "no chunk data"),
        (header()[:48], "short header"),
        (b"", "short header"),
        (header() + body + bytes(15), "truncated"),
        (header() + body + bytes(16), None),
        (header() + bytes(15), "truncated"),
    ]
    df = rows([(f"/{i:02}", "v", c) for i, (c, _) in enumerate(cases)], CONTENT)
    parsed = op.parse_headers(df, MAGIC).orderBy("path").collect()
    assert [r.reason for r in parsed] == [why for _, why in cases]
    assert [(r.n_chunks, r["size"]) for r in parsed if r.path == "/21"] == [(2, CHUNK)]
    stored = df.select("path", "version_id", F.substring("content", 1, 49).alias("head"), F.length("content").cast("long").alias("total_size"))
    assert [r.reason for r in op.parse_headers(stored, MAGIC).orderBy("path").collect()] == [why for _, why in cases]
    chunks, rejects = op.split_container(df, MAGIC)
    assert rejects.count() == sum(why is not None for _, why in cases)
    assert {r.path for r in chunks.collect()} == {f"/{i:02}" for i, (_, why) in enumerate(cases) if why is None}


def test_formats(rows):
    cases = {b"CATALOG-TEST": "v1", b"CATALOG-TESTx": "v1", b"CATALOG-TES": None, bytes(12): "legacy", b"": None}
    df = rows([("/a", "v", c) for c in cases], CONTENT)
    assert {bytes(r.content): r.format for r in op.detect_format(df, MAGIC).collect()} == cases


def test_split_and_open(rows):
    contents = [random.Random(n).randbytes(n) for n in (0, 1, 64, 65, 500)]
    df = table_of(rows, contents)
    headers, keys = material(df)
    whole = joined(op.seal_chunks(read_chunks(df, CHUNK), headers, keys), headers)
    containers = rows([(p, "v", c) for p, c in whole.items()], CONTENT)
    chunks, rejects = op.split_container(containers.join(keys, ["path", "version_id"]), MAGIC)
    assert rejects.count() == 0
    digests = op.file_digests(op.open_chunks(chunks))
    assert {r.path: r.sha256 for r in digests.collect()} == {f"/f{i}": hashlib.sha256(c).hexdigest() for i, c in enumerate(contents)}
    # A container cut at a chunk's end keeps its framing, and fails at its last chunk.
    cut = rows([("/f4", "v", whole["/f4"][: 49 + 3 * (CHUNK + 16)])], CONTENT)
    chunks, rejects = op.split_container(cut.join(keys, ["path", "version_id"]), MAGIC)
    opened = op.open_chunks(chunks).orderBy("chunk_index").collect()
    assert rejects.count() == 0 and [r.plaintext is None for r in opened] == [False, False, True]


def legacy(rows, contents, chunk=CHUNK):
    """Legacy containers sealed by Spark and framed outside it."""
    df = table_of(rows, contents)
    _, keys = material(df)
    nonce = F.unhex(F.substring(F.md5(F.concat("path", "chunk_index")), 1, 24))
    sealed = read_chunks(df, chunk).join(keys, ["path", "version_id"]).withColumn(
        "sealed", F.aes_encrypt("plaintext", "key", F.lit("GCM"), F.lit("DEFAULT"), nonce)
    )
    whole = {f"/f{i}": bytes(16) for i in range(len(contents))}
    for r in sealed.orderBy("path", "chunk_index").collect():
        piece = bytes(r.sealed)
        whole[r.path] += piece[:12] + struct.pack("<Q", len(piece) - 12) + piece[12:]
    return whole, keys


def test_legacy(rows):
    contents = [b"", b"x", random.Random(2).randbytes(200)]
    whole, keys = legacy(rows, contents)
    frame = 12 + 8 + CHUNK + 16
    start = 16 + 2 * frame
    cases = {
        "/f0": whole["/f0"],
        "/f1": whole["/f1"],
        "/f2": whole["/f2"],
        "/none": bytes(16),
        "/salt": bytes(15),
        "/nonce": whole["/f2"][: start + 11],
        "/length": whole["/f2"][: start + 19],
        "/short": whole["/f2"][: start + 25],
        "/huge": bytes(28) + b"\xff" * 8 + bytes(10),
    }
    df = rows([(p, "v", c) for p, c in cases.items()], CONTENT)
    frames = op.split_legacy(df)
    reasons = {r.path: r.reason for r in frames.where("reason is not null").collect()}
    assert reasons == {
        "/salt": "short salt",
        "/nonce": "truncated nonce",
        "/length": "truncated length",
        "/short": "truncated",
        "/huge": "truncated",
    }
    opened = op.open_legacy(frames, keys)
    digests = {r.path: r.sha256 for r in op.file_digests(opened).collect()}
    assert {p for p, d in digests.items() if d} == {"/f0", "/f1", "/f2", "/none"}
    assert digests["/f2"] == hashlib.sha256(contents[2]).hexdigest()
    assert digests["/none"] == hashlib.sha256(b"").hexdigest()
    positions = [(r.chunk_index, r.position) for r in frames.where("path = '/f2'").orderBy("chunk_index").collect()]
    assert positions == [(0, 0), (1, 64), (2, 128), (3, 192)]


def test_audit(rows):
    contents = [random.Random(n).randbytes(CHUNK * 4) for n in range(8)]
    df = table_of(rows, contents)
    headers, keys = material(df)
    sealed = op.seal_chunks(read_chunks(df, CHUNK), headers, keys)
    index, path = F.col("chunk_index"), F.col("path")
    swapped = F.when((path == "/f2") & index.isin(1, 2), 3 - index).otherwise(index)
    damaged = (
        sealed.where("not (path = '/f1' and is_last)")
        .withColumn("chunk_index", swapped)
        .unionByName(sealed.where("path = '/f3' and chunk_index = 0"))
        .withColumn("path", F.when((path == "/f4") & (index == 2), "/f5").otherwise(path))
        .where("path <> '/f6'")
        .withColumn("payload", F.when((path == "/f7") & (index == 0), F.lit(b"")).otherwise(F.col("payload")))
        .unionByName(sealed.where("path = '/f0' and chunk_index = 0").withColumn("path", F.lit("/alien")))
    )
    audit = {r.path: r for r in op.audit_containers(damaged, headers, keys).collect()}
    facts = {
        p: (r.chunks_expected, r.chunks_seen, r.chunks_failed, r.chunks_missing, r.chunks_repeated, r.intact)
        for p, r in audit.items()
    }
    assert facts == {
        "/f0": (4, 4, 0, 0, 0, True),
        "/f1": (4, 3, 0, 1, 0, False),
        "/f2": (4, 4, 2, 0, 0, False),
        "/f3": (4, 5, 0, 0, 1, False),
        "/f4": (4, 3, 0, 1, 0, False),
        "/f5": (4, 5, 1, 0, 1, False),
        "/f6": (4, 0, 0, 4, 0, False),
        "/f7": (4, 4, 1, 0, 0, False),
        "/alien": (0, 1, 1, 0, 0, False),
    }


def test_containers_in_storage(spark, rows, tmp_path):
    """Both formats as files: the same digests, and damage is told apart."""
    from catalog_engine import sources as src
    from catalog_engine.plans import restore_run
    from catalog_engine.schemas import EVENTS

    contents = [b"", b"x", random.Random(2).randbytes(CHUNK * 5 + 3)]
    old, keys = legacy(rows, contents)
    df = table_of(rows, contents)
    headers, _ = material(df)
    new = joined(op.seal_chunks(read_chunks(df, CHUNK), headers, keys), headers)
    files = {f"{p}/v": c for p, c in new.items()}
    files |= {f"/old{p}/v": c for p, c in old.items()}
    files |= {"/old/none/v": bytes(16), "/old/cut/v": old["/f2"][:-1], "/tiny/v": b"abc"}
    for name, content in files.items():
        file = tmp_path / "objects" / name[1:]
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    known = {f"/f{i}": c for i, c in enumerate(contents)} | {f"/old/f{i}": c for i, c in enumerate(contents)}
    known["/old/none"] = b""
    catalog = rows([(p, "v", hashlib.sha256(c).hexdigest()) for p, c in known.items()], "path string, version_id string, sha256 string")
    old_keys = keys.unionByName(keys.withColumn("path", F.concat(F.lit("/old"), "path")))
    items = rows([("b", n[:-2], "v") for n in files], "bucket string, key string, version_id string")
    result = restore_run(
        items, src.read_containers(spark, str(tmp_path / "objects")), catalog, old_keys, str(tmp_path / "out"),
        MAGIC, rows([], EVENTS), 5, str(tmp_path / "store"), ended_at=6, write=True,
    )
    got = {r.key: r.status for r in result.status.collect()}
    assert got == {**dict.fromkeys(known, "ok"), "/old/cut": "undecryptable", "/tiny": "too short"}
    for path, content in known.items():
        assert (tmp_path / "out" / path[1:]).read_bytes() == content
    left = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert len(left) == len(known)


def test_chunk_numbers_come_in_segments(spark):
    from catalog_engine.sources.chunks import SEGMENT, number_chunks

    counts = [1, 2, SEGMENT, SEGMENT + 1, 3 * SEGMENT - 1]
    files = spark.createDataFrame([(n,) for n in counts], "n_chunks bigint")
    got = number_chunks(files).groupBy("n_chunks").agg({"chunk_index": "max", "*": "count"}).collect()
    assert {r.n_chunks: (r["max(chunk_index)"], r["count(1)"]) for r in got} == {n: (n - 1, n) for n in counts}
    # A forged header may ask for billions of chunks: its plan starts, no array holds them all.
    forged = spark.createDataFrame([(3_000_000_000,)], "n_chunks bigint")
    assert number_chunks(forged).limit(5).count() == 5


def test_legacy_frames_have_no_limit_of_their_own():
    import io

    from catalog_engine.operators.containers import (
        LEGACY_LENGTH_SIZE,
        MAX_CELL,
        NONCE_SIZE,
        SALT_SIZE,
        _legacy_frames,
    )

    class Long(io.BytesIO):
        """Only the beginning of a very long container."""

    def frames(length):
        head = bytes(SALT_SIZE + NONCE_SIZE) + length.to_bytes(LEGACY_LENGTH_SIZE, "little")
        return _legacy_frames(Long(head), len(head) + length)

    two_gib = (1 << 30) + 17
    assert frames(two_gib)[1] is None and frames(two_gib)[0][0][1] == two_gib
    assert frames(MAX_CELL + 1)[1] == "frame larger than a cell"


def test_forged_header_costs_one_row(spark, rows):
    """A container of 60 KB that says its chunks have one byte, among a true one and a short one."""
    size = 3600 * 17
    content = rows([("/true", "v", b"x" * 5000), ("/one", "v", b"y")], "path string, version_id string, content binary")
    files = content.withColumn("size", F.length("content").cast("long")).drop("content")
    drawn = files.withColumns({"salt": F.lit(bytes(16)), "nonce_prefix": F.lit(bytes(7))})
    headers = op.plan_headers(drawn, MAGIC, 16).cache()
    keys = content.select("path", "version_id", F.lit(bytes(32)).alias("key"))
    sealed = op.seal_chunks(read_chunks(content, 16), headers, keys)
    body = sealed.groupBy("path").agg(
        F.expr("aggregate(array_sort(collect_list(struct(chunk_index, payload))), cast('' as binary), (a, x) -> concat(a, x.payload))").alias("body")
    )
    whole = headers.join(body, "path").select("path", "version_id", F.concat("header", "body").alias("content"))
    forged = whole.where("path = '/true'").select(
        F.lit("/forged").alias("path"),
        "version_id",
        F.concat(F.substring("content", 1, 45), F.lit(b"\x00\x00\x00\x01"), F.lit(b"z" * size)).alias("content"),
    )
    known = whole.unionByName(forged).withColumn("key", F.lit(bytes(32)))
    chunks, unusable = op.split_container(known, MAGIC)
    assert unusable.count() == 0 and chunks.where("path = '/forged'").count() == 3600
    assert [r.path for r in op.forged_containers(known, MAGIC).collect()] == ["/forged"]
    # Containers of few chunks are not probed: their expansion is as small.
    wrong = known.withColumn("key", F.lit(b"1" * 32))
    assert {r.path for r in op.forged_containers(wrong, MAGIC).collect()} == {"/true", "/forged"}
    assert {r.path for r in op.forged_containers(wrong, MAGIC, probe=0).collect()} == {"/true", "/one", "/forged"}

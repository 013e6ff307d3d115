"""Headers, sealing, opening and digests."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from catalog_engine import operators as op
from catalog_engine.functions import n_chunks, sealed_size
from catalog_engine.operators import content as content_ops
from catalog_engine.sources import read_chunks

MAGIC = "CATALOG-TEST"
CHUNK = 64
CONTENT = "path string, version_id string, content binary"


def table_of(rows, contents):
    return rows([(f"/f{i}", "v", bytes(c)) for i, c in enumerate(contents)], CONTENT)


def material(contents, chunk=CHUNK):
    """Headers and keys with fixed salts for a content table."""
    files = contents.select(
        "path",
        "version_id",
        F.length("content").cast("long").alias("size"),
        F.unhex(F.md5(F.concat(F.lit("s"), "path"))).alias("salt"),
        F.unhex(F.substring(F.md5(F.concat(F.lit("n"), "path")), 1, 14)).alias("nonce_prefix"),
    )
    keys = contents.select("path", "version_id", F.unhex(F.sha2(F.concat(F.lit("k"), "path"), 256)).alias("key"))
    return op.plan_headers(files, MAGIC, chunk), keys


@pytest.fixture
def samples(rows):
    draw = random.Random(5)
    sizes = [0, 1, 63, 64, 65, 127, 128, 129, 640, 1000]
    contents = [draw.randbytes(n) for n in sizes]
    return contents, table_of(rows, contents)


def test_header_bytes(rows):
    """A header put together by hand from the byte table."""
    salt, prefix = bytes(range(16)), b"\xf0\xf1\xf2\xf3\xf4\xf5\xf6"
    files = rows([("/a", "v", 10, salt, prefix)], "path string, version_id string, size long, salt binary, nonce_prefix binary")
    row = op.plan_headers(files, MAGIC).first()
    want = b"CATALOG-TEST" + b"\x01" + salt + b"\0\0\0\x03" + b"\0\x01\0\0" + b"\x04" + prefix + b"\x01\0\0\0"
    assert bytes(row.header) == want and len(want) == 49
    parsed = op.parse_headers(rows([("/a", "v", want, 49 + 26)], "path string, version_id string, head binary, total_size long"), MAGIC).first()
    assert (parsed.argon_time, parsed.argon_memory_kib, parsed.argon_threads, parsed.chunk_size) == (3, 65536, 4, 16 << 20)
    assert bytes(parsed.salt) == salt and bytes(parsed.nonce_prefix) == prefix
    assert (parsed.reason, parsed.n_chunks, parsed.size) == (None, 1, 10)
    with pytest.raises(ValueError):
        op.plan_headers(files, "short")


def test_nonces(rows):
    chunks = rows([("/a", "v", 0x01020304, False), ("/a", "v", 5, True)], "path string, version_id string, chunk_index long, is_last boolean")
    chunks = chunks.withColumn("nonce_prefix", F.lit(b"prefix7"))
    got = {bytes(r.nonce) for r in op.chunk_nonces(chunks).collect()}
    assert got == {b"prefix7\x01\x02\x03\x04\x00", b"prefix7\x00\x00\x00\x05\x01"}


def test_sizes(rows):
    df = rows([(s,) for s in (-1, 0, 1, 64, 65, (1 << 62) + 1)], "s long")
    got = [r.n for r in df.select(n_chunks(df.s, 64).alias("n")).collect()]
    assert got == [1, 1, 1, 1, 2, (1 << 56) + 1]
    assert df.where("s = 65").select(sealed_size(df.s, 64).alias("n")).first().n == 49 + 65 + 32


def test_chunks(samples):
    contents, df = samples
    got = {}
    for r in read_chunks(df, CHUNK).orderBy("path", "chunk_index").collect():
        got.setdefault(r.path, []).append(r)
    for i, content in enumerate(contents):
        pieces = got[f"/f{i}"]
        assert b"".join(bytes(p.plaintext) for p in pieces) == content
        assert [p.is_last for p in pieces] == [False] * (len(pieces) - 1) + [True]
        assert {p.n_chunks for p in pieces} == {max(1, -(-len(content) // CHUNK))}


def test_open_of_seal_is_the_content(samples):
    contents, df = samples
    headers, keys = material(df)
    sealed = op.seal_chunks(read_chunks(df, CHUNK), headers, keys)
    lengths = {(r.path, r.chunk_index): len(r.payload) for r in sealed.collect()}
    assert lengths["/f0", 0] == 16 and lengths["/f2", 0] == 63 + 16
    opened = op.open_chunks(sealed, headers, keys)
    got = {r.path: (r["size"], r.sha256) for r in op.file_digests(opened).collect()}
    assert got == {f"/f{i}": (len(c), hashlib.sha256(c).hexdigest()) for i, c in enumerate(contents)}


def test_known_cipher_text(rows):
    """AES-256-GCM test case with additional data, from the published GCM vectors."""
    key = bytes.fromhex("feffe9928665731c6d6a8f9467308308" * 2)
    plain = bytes.fromhex(
        "d9313225f88406e5a55909c5aff5269a86a7a9531534f7da2e4c303d8a318a72"
        "1c3c0c95956809532fcf0e2449a6b525b16aedf5aa0de657ba637b39"
    )
    aad = bytes.fromhex("feedfacedeadbeeffeedfacedeadbeefabaddad2")
    nonce = bytes.fromhex("cafebabefacedbaddecaf888")
    want = bytes.fromhex(
        "522dc1f099567d07f47f37a32a84427d643a8cdcbfe5c0c97598a2bd2555d1aa"
        "8cb08e48590dbb3da7b08b1056828838c5f61e6393ba7a0abcc9f662"
        "76fc6ece0f4e1768cddf8853bb2d551b"
    )
    df = rows([(plain, key, aad)], "plaintext binary, key binary, header binary").select(
        "*",
        F.lit(nonce[:7]).alias("nonce_prefix"),
        F.lit(int.from_bytes(nonce[7:11], "big")).alias("chunk_index"),
    )
    sealed = F.aes_encrypt("plaintext", "key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(nonce), "header")
    got = df.select(F.substring(sealed, F.lit(13), F.length(sealed)).alias("p")).first().p
    assert bytes(got) == want


def test_any_change_fails(samples):
    """Flipped bits, cut tags, another index, flag, header or key: never a plaintext."""
    _, df = samples
    headers, keys = material(df)
    sealed = op.seal_chunks(read_chunks(df, CHUNK), headers, keys)

    def failures(chunks, headers=headers, keys=keys):
        opened = op.open_chunks(chunks, headers, keys)
        return opened.agg(F.count("*").alias("n"), F.count("plaintext").alias("ok")).first()

    def flipped(position):
        """Payload with one bit flipped at a byte position, counted from either end."""
        size = F.length("payload")
        at = F.lit(position) if position > 0 else size + position + 1
        byte = F.conv(F.hex(F.substring(F.col("payload"), at, F.lit(1))), 16, 10).cast("int")
        changed = F.unhex(F.lpad(F.hex(byte.bitwiseXOR(F.lit(1)).cast("long")), 2, "0"))
        return F.concat(
            F.substring(F.col("payload"), F.lit(1), at - 1),
            changed,
            F.substring(F.col("payload"), at + 1, size),
        )

    total = sealed.count()
    assert tuple(failures(sealed)) == (total, total)
    for position in (1, 16, -1, -16):
        assert tuple(failures(sealed.withColumn("payload", flipped(position)))) == (total, 0)
    cut = F.substring(F.col("payload"), F.lit(1), F.length("payload") - 1)
    assert failures(sealed.withColumn("payload", cut)).ok == 0
    assert failures(sealed.withColumn("payload", F.lit(b""))).ok == 0
    assert failures(sealed.withColumn("chunk_index", F.col("chunk_index") + 1)).ok == 0
    assert failures(sealed.withColumn("is_last", ~F.col("is_last"))).ok == 0
    other, _ = material(df, CHUNK * 2)
    assert failures(sealed, headers=other).ok == 0
    wrong = keys.withColumn("key", F.unhex(F.sha2("key", 256)))
    assert failures(sealed, keys=wrong).ok == 0
    assert failures(sealed, keys=keys.where("false")).ok == 0


def test_files_longer_than_a_join_segment(rows, monkeypatch):
    """Parameters reach every chunk when a file spans several join segments."""
    monkeypatch.setattr(content_ops, "SEGMENT", 4)
    content = random.Random(1).randbytes(CHUNK * 30 + 7)
    df = table_of(rows, [content, b"x"])
    headers, keys = material(df)
    sealed = op.seal_chunks(read_chunks(df, CHUNK), headers, keys)
    opened = op.open_chunks(sealed.drop("n_chunks"), headers, keys)
    assert {r.sha256 for r in op.file_digests(opened).collect()} == {
        hashlib.sha256(c).hexdigest() for c in (content, b"x")
    }
    carried = sealed.join(headers.select("path", "header", "nonce_prefix"), "path")
    assert op.open_chunks(carried, keys=keys).where("plaintext is null").count() == 0


def test_digest_needs_every_chunk_once(rows):
    chunks = rows(
        [
            ("/gap", "v", 0, 3, b"a"),
            ("/gap", "v", 2, 3, b"c"),
            ("/twice", "v", 0, 2, b"a"),
            ("/twice", "v", 0, 2, b"a"),
            ("/twice", "v", 1, 2, b"b"),
            ("/null", "v", 0, 2, b"a"),
            ("/null", "v", 1, 2, None),
            ("/single", "v", 0, 1, None),
            ("/pair", "v", 0, 1, b"a"),
            ("/pair", "v", 0, 1, b"a"),
            ("/good", "v", 1, 2, b"b"),
            ("/good", "v", 0, 2, b"a"),
            ("/good", "w", 0, 1, b""),
            ("/lost", "v", 1, 1, b"a"),
        ],
        "path string, version_id string, chunk_index long, n_chunks long, plaintext binary",
    )
    got = {(r.path, r.version_id): r.sha256 for r in op.file_digests(chunks).collect()}
    assert {k for k, v in got.items() if v} == {("/good", "v"), ("/good", "w")}
    assert got["/good", "v"] == hashlib.sha256(b"ab").hexdigest()
    assert len(got) == 8


def test_verify(samples):
    contents, df = samples
    headers, keys = material(df)
    sealed = op.seal_chunks(read_chunks(df, CHUNK), headers, keys)
    digests = df.select("path", "version_id", F.sha2("content", 256).alias("sha256"))
    whole = op.verify_sealed(sealed, headers, keys, digests)
    assert {r.status for r in whole.collect()} == {"ok"} and whole.count() == len(contents)
    assert op.verify_sealed(sealed, headers, keys).where("status <> 'ok'").count() == 0
    lacking = sealed.where("not (path = '/f8' and chunk_index = 3)")
    assert [r.path for r in op.verify_sealed(lacking, headers, keys).where("status <> 'ok'").collect()] == ["/f8"]
    assert [r.path for r in op.verify_sealed(lacking, headers, keys, digests).where("status <> 'ok'").collect()] == ["/f8"]
    unknown = op.verify_sealed(sealed, headers, keys, digests.where("path <> '/f1'"))
    assert [r.path for r in unknown.where("status = 'missing'").collect()] == ["/f1"]

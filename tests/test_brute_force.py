"""Random catalogs against plain Python over all rows."""

import random

import pytest

from catalog_engine import operators as op
from catalog_engine.schemas import FILES, INVENTORY

SHA = "a" * 64


@pytest.fixture(params=[1, 2, 3])
def data(request):
    draw = random.Random(request.param)
    paths = ["/hot"] * 12 + [f"/{a}/{b}" for a in ("a", "A", "b_", "bc") for b in ("x", "x1", "y%", "Z")]
    files = [
        (
            seq,
            draw.choice(paths),
            f"v{seq}",
            SHA,
            draw.randrange(3),
            draw.randrange(1, 12),
            1,
            draw.choice([None, None, draw.randrange(1, 15)]),
        )
        for seq in range(1, 200)
    ]
    walk = [(p, draw.randrange(3), draw.randrange(1, 12)) for p in set(paths) if draw.random() < 0.6]
    return files, walk + walk[:3]


def like(path, pattern):
    """Does the pattern match a beginning of the path?"""
    if pattern == "":
        return True
    if pattern[0] == "%":
        return any(like(path[i:], pattern[1:]) for i in range(len(path) + 1))
    return path != "" and pattern[0] in ("_", path[0].lower(), path[0].upper()) and like(path[1:], pattern[1:])


def newest(files, keep=lambda f: True):
    latest = {}
    for f in sorted(files, key=lambda f: (f[5], f[0])):
        if keep(f):
            latest[f[1]] = f
    return latest.values()


def test_points_in_time(spark, data):
    files, _ = data
    catalog = spark.createDataFrame(files, FILES).cache()
    for prefix in ("", "/a", "/B_", "/%/x", "/hot", "/b_/y%", "/none"):
        for moment in (0, 5, 11, 20):
            got = sorted(r.version_id for r in op.files_as_of(catalog, moment, [prefix]).collect())
            known = newest(files, lambda f: like(f[1], prefix) and f[5] <= moment)
            want = sorted(f[2] for f in known if f[7] is None or f[7] > moment)
            assert got == want, (prefix, moment)


def test_differences(spark, data):
    files, seen = data
    catalog = spark.createDataFrame(files, FILES).cache()
    walk = spark.createDataFrame(seen, INVENTORY)
    stored = {(f[1], f[4], f[5]) for f in files if f[7] is None}
    changed = [tuple(r) for r in op.detect_changed(walk, catalog).collect()]
    assert sorted(changed) == sorted(set(seen) - stored)
    walked = {w[0] for w in seen}
    for root in ("/", "/a", "/b_", "/hot"):
        under = root.rstrip("/") + "/"
        gone = [f for f in newest(files) if like(f[1], under) and f[7] is None and f[1] not in walked]
        deleted = op.detect_deleted(catalog, walk, [root])
        assert sorted(r.path for r in deleted.collect()) == sorted(f[1] for f in gone)
        marked = op.mark_deleted(catalog, deleted, 99).where("deleted_at = 99")
        assert sorted(r.row_seq for r in marked.collect()) == sorted(f[0] for f in gone)

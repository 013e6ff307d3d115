"""MinHash near-duplicates by DartMinHash (operator 10).

A text is the set of its five-word shingles, each with a weight. Hashed darts fall on the plane of
weight and rank over each shingle, as a Poisson process does; a text sees the darts below its
weights. For each coordinate the dart of lowest rank is kept, so two signatures agree in a
coordinate with the probability of the weighted Jaccard similarity. Bands of coordinates are the
join keys, and similarity is then computed on the shingles themselves.

Texts with equal shingle sets are one class from the start and stand for each other through the
smallest id. Pairs that share a band are compared until every one is compared or connected.

Null texts and texts without a word are near-duplicates of nothing. Rows with equal ids count as
one document; rows without an id are kept. An empty table gives an empty one; texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import discard, map_rows, stage
from catalog_engine.llm.buckets import classes, shared
from catalog_engine.llm.shingles import SIZE, mix, shingles

BANDS, ROWS = 20, 5
SIMILARITY = 0.8
#: Shingles that a comparison of two blocks has in its tables at a time.
COLUMNS = 4_096

_COUNTS = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(20)])
_UNIT = 2.0**-64


def darts(elements: np.ndarray, weights: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """Hash, rank and element of the darts with low <= rank < high below the elements' weights.

    A cell of the plane, one unit of weight wide and one of rank high, holds a Poisson number of
    darts with mean 1; all of it follows from the element's hash and the place of the cell.
    """
    widths = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), widths)
    first = np.repeat(np.cumsum(widths) - widths, widths)
    column = np.arange(len(owner)) - first
    ranks = np.arange(low, high)
    cell = mix(elements[owner] + np.uint64(0x632BE59BD9B4E019) * (column + 1).astype(np.uint64))
    cell = mix(cell[:, None] + np.uint64(0xD1342543DE82EF95) * (ranks + 1).astype(np.uint64)).ravel()
    base = np.tile(ranks, len(owner))
    owner, column = np.repeat(owner, len(ranks)), np.repeat(column, len(ranks))
    number = np.searchsorted(_COUNTS, cell * _UNIT)
    place = np.repeat(np.arange(len(cell)), number)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(number) - number, number)
    dart = mix(cell[place] + np.uint64(0xA0761D6478BD642F) * (nth + 1).astype(np.uint64))
    rank = base[place] + mix(dart + np.uint64(1)) * _UNIT
    weight = column[place] + mix(dart + np.uint64(2)) * _UNIT
    seen = weight < weights[owner[place]]
    return dart[seen], rank[seen], owner[place][seen]


def signature(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The dart of lowest rank for each coordinate; ranks are raised until each has one."""
    out = np.zeros(size, np.uint64)
    open_, low = np.ones(size, bool), 0
    # About size * log(size) darts fill all coordinates.
    step = max(1, round(size * math.log(size) / max(1.0, float(weights.sum()))))
    while open_.any():
        dart, rank, _ = darts(elements, weights, low, low + step)
        order = np.lexsort((dart, rank))
        coordinate = (mix(dart[order] + np.uint64(3)) % np.uint64(size)).astype(np.int64)
        found, first = np.unique(coordinate, return_index=True)
        new = open_[found]
        out[found[new]] = dart[order][first[new]]
        open_[found] = False
        low, step = low + step, step
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1).astype(np.uint64)
    for column in values.reshape(bands, rows).T:
        h = mix(h * np.uint64(31) + column)
    return h.view(np.int64)


def sketch(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    bands: int = BANDS,
    rows: int = ROWS,
    size: int = SIZE,
) -> DataFrame:
    """``doc_id``, ``set_key`` (digest of the shingle set, null without words), ``bands`` and
    ``shingles`` (sorted 32-bit hashes, one after the other)."""
    import hashlib

    def make():
        def run(keys, texts):
            made = {"doc_id": keys, "set_key": [], "bands": [], "shingles": []}
            for value in texts:
                found = shingles(value, size)
                if not len(found):
                    made["set_key"].append(None)
                    made["bands"].append([])
                    made["shingles"].append(b"")
                    continue
                values = signature(found, np.ones(len(found)), bands * rows)
                made["set_key"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                made["bands"].append(band_keys(values, bands, rows))
                short = np.unique((found >> np.uint64(32)).astype(np.uint32))
                made["shingles"].append(short.tobytes())
            return made

        return run

    schema = "doc_id bigint, set_key binary, bands array<bigint>, shingles binary"
    return map_rows(
        docs.select(F.col(key).cast("long").alias(key), text), [key, text], make, schema
    )


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is at least ``similarity``."""
    one = sets.select(F.col("rep").alias("a"), F.col("data").alias("x"))
    two = sets.select(F.col("rep").alias("b"), F.col("data").alias("y"))
    size = F.length("x"), F.length("y")
    joined = (
        pairs.join(one, "a")
        .join(two, "b")
        .where(F.least(*size) >= similarity * F.greatest(*size) - 1e-6)
        .select("a", "b", "x", "y")
    )

    def make():
        def run(a, b, x, y):
            keep = []
            for i, (p, q) in enumerate(zip(x, y)):
                p, q = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= similarity * (len(p) + len(q) - both) - 1e-9:
                    keep.append(i)
            return {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

        return run

    return map_rows(joined, ["a", "b", "x", "y"], make, "a bigint, b bigint")


def _compared(blocks: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all similar members of pairs of blocks (one, two)."""

    def entries(block):
        """Values of all sets in order, the place of their set, and sizes, ids, components."""
        sets = [np.frombuffer(m["data"], np.uint32) for m in block]
        sizes = np.array([len(x) for x in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(block)), sizes)
        order = values.argsort(kind="stable")
        ids = np.array([(m["rep"], m["comp"]) for m in block], np.int64).T
        return values[order], owner[order], sizes, *ids

    def common(x, x_owner, n, y, y_owner, m):
        """Sizes of all intersections, from 0-1 tables of some thousand values at a time."""
        both = np.zeros((n, m), np.float32)
        every = np.intersect1d(x, y)
        for at in range(0, len(every), COLUMNS):
            part = every[at : at + COLUMNS]
            tables = []
            for values, owner, rows in ((x, x_owner, n), (y, y_owner, m)):
                low, high = np.searchsorted(values, part[0]), np.searchsorted(values, part[-1], "right")
                places = np.searchsorted(part, values[low:high])
                held = part[places] == values[low:high]
                made = np.zeros((rows, len(part)), np.float32)
                made[owner[low:high][held], places[held]] = 1
                tables.append(made)
            both += tables[0] @ tables[1].T
        return both

    def make():
        def run(ones, twos):
            out = {"a": [], "b": []}
            for one, two in zip(ones, twos):
                x, x_owner, n, rep, comp = entries(one)
                y, y_owner, m, other, other_comp = entries(two)
                both = common(x, x_owner, len(n), y, y_owner, len(m))
                close = both >= similarity * (n[:, None] + m - both) - 1e-6
                close &= comp[:, None] != other_comp
                # Of the links of a member into one component, one is enough.
                for i in np.flatnonzero(close.any(axis=1)):
                    for c in np.unique(other_comp[close[i]]):
                        out["a"].append(int(rep[i]))
                        out["b"].append(int(other[close[i] & (other_comp == c)].min()))
            return out

        return run

    return map_rows(blocks, ["one", "two"], make, "a bigint, b bigint", step=8)


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id``, ``class_id`` (smallest id of its class) and ``kept``, a row for each row of
    ``docs``."""
    return _found(docs, text, key, similarity, bands, rows)[0]


def _found(
    docs: DataFrame, text: str, key: str, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> tuple[DataFrame, list[DataFrame]]:
    """What ``near_duplicates`` gives, and the staged tables that it reads."""
    made = stage(sketch(docs, text, key, bands, rows), "sketch")
    # One row for each shingle set; bands of copies never meet.
    sets = made.where("set_key is not null and doc_id is not null")
    reps = stage(
        sets.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")),
        "reps",
    )
    exploded = reps.select(F.explode("bands").alias("bucket"), "rep")
    members = stage(shared(exploded), "members")
    met = members.select("rep").distinct()
    near = stage(
        made.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("data")).join(met, "rep").dropDuplicates(["rep"]), "sets"
    )
    labels = classes(
        members,
        near,
        lambda pairs: _similar(pairs, near, similarity),
        lambda blocks: _compared(blocks, similarity),
    )
    discard(members, near)
    copies = (
        reps.select("set_key", "rep")
        .join(labels, reps["rep"] == labels["node"], "left")
        .select("set_key", F.coalesce("component", "rep").alias("class_id"))
    )
    found = (
        made.select("doc_id", "set_key")
        .join(copies, "set_key", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
    )
    return found, [made, reps, labels]


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents that are the first of their class; those that go are joined by id."""
    made, used = _found(docs, text, key, **options)
    gone = stage(made.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    discard(*used)
    return docs.join(gone, F.col(key).cast("long") == F.col("__gone"), "left_anti")

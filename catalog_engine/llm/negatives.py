"""Hard-negative mining by tiles of exact integer products (operator 11).

Anchors and candidates are packed into tiles of bounded size. The scores of a pair of tiles are one
matrix product in 64-bit numbers, by Strassen's recursion: both sides are padded with zeros until
they halve evenly, seven products of half the size take the place of eight, and all additions are
exact, so the scores are those of plain multiplication. From each product every anchor keeps a heap
of its best rows, and heaps merge: of a task's tiles where they follow each other, of all tasks in
a ranked window, whose limit is taken before the shuffle.

First the positives: rows meet by buckets of labels. Then the negatives: every anchor has a window of
scores for each of its positives, and meets all rows. Both are joins of tiles by their numbers, so a
hot label, or any other group, is many tiles, and each pair of tiles is a row of its own.

Rows whose label, id or vector is null, or that hold a null or non-finite component, take no part.
Rows of equal ids count as one, that of the smallest label and vector. Vectors of different lengths
do not meet. Other columns are not looked at; without rows or anchors the result is empty. Vectors so
large that a hundredfold score could leave 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine.llm.common import map_rows, show_library, stage
from catalog_engine.llm.vectors import whole_rows

POSITIVES = 5
NEGATIVES = 3
SCALE = 256
#: Whole components lie below this, as they are packed into 32 bits.
MOST = 1 << 31
#: Window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows of a tile, on average; a tile is packed into bytes.
TILE = 2_048
#: Side below which a product is not split further.
LEAF = 32
#: Columns whose scores a task holds at a time.
STRIP = 1_024

_NONE = np.iinfo(np.int64).min


def _even(m: np.ndarray) -> np.ndarray:
    rows, columns = m.shape
    return np.pad(m, ((0, rows % 2), (0, columns % 2))) if rows % 2 or columns % 2 else m


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of 64-bit numbers; exact where the result fits, as sums wrap alike."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        # Both sides are walked along rows: numpy has no library product for whole numbers.
        return a @ np.ascontiguousarray(b.T).T
    a, b = _even(a), _even(b)
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:n, :m]


@dataclass
class Heaps:
    """For each row the best (score, id), by score downwards, then by id; the rest is ``_NONE``."""

    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def empty(cls, rows: int, k: int) -> Heaps:
        return cls(np.full((rows, k), _NONE), np.zeros((rows, k), np.int64))

    def merge(self, scores: np.ndarray, ids: np.ndarray) -> Heaps:
        k = self.scores.shape[1]
        scores, ids = np.hstack([self.scores, scores]), np.hstack([self.ids, ids])
        # Negated bits turn the order of all 64-bit numbers, the smallest included.
        best = np.lexsort((ids, ~scores), axis=1)[:, :k]
        return Heaps(np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> Heaps:
        """Merges with a matrix of scores of the columns ``ids``; ``_NONE`` takes no part."""
        n, k = self.scores.shape
        # What does not reach the k-th of the matrix or of the heap is not sorted; ties are.
        least = self.scores[:, -1:]
        if scores.shape[1] > k:
            cut = scores.shape[1] - k
            least = np.maximum(least, np.partition(scores, cut, axis=1)[:, cut : cut + 1])
        row, column = np.nonzero((scores >= least) & (scores != _NONE))
        if not len(row):
            return self
        value, id_ = scores[row, column], ids[column]
        order = np.lexsort((id_, ~value, row))
        row, value, id_ = row[order], value[order], id_[order]
        at = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
        top = at < k
        more = Heaps.empty(n, k)
        more.scores[row[top], at[top]] = value[top]
        more.ids[row[top], at[top]] = id_[top]
        return self.merge(more.scores, more.ids)


def quantised(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: Column | str = "label"
) -> DataFrame:
    """``vec_id``, ``label``, ``size`` and ``data`` (whole components as bytes) of the rows that take
    part, one for each id."""
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"),
        (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        F.col(embedding).alias("embedding"),
    ).where("vec_id is not null and label is not null and embedding is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in whole_rows(batch.column(2), SCALE, MOST):
                largest = int(np.abs(found).max(initial=0))
                if 100 * found.shape[1] * largest**2 >= 1 << 63:
                    raise ValueError(f"scores of components of {largest} leave 64 bits")
                at, found = pa.array(rows), found.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(np.full(len(rows), found.shape[1], np.int32)),
                        pa.array([x.tobytes() for x in found], pa.binary()),
                    ],
                    names=["vec_id", "label", "size", "data"],
                )

    show_library(vectors.sparkSession)
    made = rows.mapInArrow(run, "vec_id long, label long, size int, data binary")
    return made.groupBy("vec_id").agg(F.min(F.struct("label", "size", "data")).alias("r")).select("vec_id", "r.*")


def _tiles(rows: DataFrame, extra: list[str] = []) -> DataFrame:
    """Tiles (bucket, part, parts) of rows (bucket, vec_id, label, size, data, ...): bytes of ids,
    labels and components, and lists of the ``extra`` columns, in the order of ids."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts")).cast("int")
    packed = (
        rows.join(sizes, "bucket")
        .groupBy("bucket", part.alias("part"), "parts")
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", "label", "size", "data", *extra))).alias("rows"))
    )

    def make():
        def run(buckets, parts, counts, lists):
            return {
                "bucket": buckets,
                "part": parts,
                "parts": counts,
                "size": [rows[0]["size"] for rows in lists],
                "ids": [np.array([r["vec_id"] for r in rows], "<i8").tobytes() for rows in lists],
                "labels": [np.array([r["label"] for r in rows], "<i8").tobytes() for rows in lists],
                "data": [b"".join(r["data"] for r in rows) for rows in lists],
                **{name: [[r[name] for r in rows] for rows in lists] for name in extra},
            }

        return run

    kinds = "".join(f", {n} array<{rows.schema[n].dataType.simpleString()}>" for n in extra)
    schema = "bucket long, part int, parts int, size int, ids binary, labels binary, data binary" + kinds
    return stage(map_rows(packed, ["bucket", "part", "parts", "rows"], make, schema, step=4), "tiles")


def _met(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each pair of tiles of a bucket, keyed by the pair: many tiles of a bucket are many
    keys. Sorted by the anchors' tile, so that its heaps merge within a task."""
    counts = anchors.groupBy("bucket").agg(F.max("parts").alias("their_parts"))
    theirs = candidates.groupBy("bucket").agg(F.max("parts").alias("their_parts"))

    def dealt(tiles: DataFrame, others: DataFrame, own: str, other: str, names: list[str]) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col("their_parts") - 1))
        return tiles.join(others, "bucket").select(
            "bucket", F.col("part").alias(own), every.alias(other), *names
        )

    left = dealt(anchors, theirs, "a_part", "c_part", [c for c in anchors.columns if c not in ("bucket", "part", "parts")])
    right = dealt(candidates, counts, "c_part", "a_part", ["ids", "labels", "data"]).withColumnsRenamed(
        {n: f"c_{n}" for n in ("ids", "labels", "data")}
    )
    return left.join(right.hint("merge"), ["bucket", "a_part", "c_part"])


def _mine(
    pairs: DataFrame,
    extra: list[str],
    k: int,
    masks: Callable[..., list[tuple[int, Callable[[np.ndarray, np.ndarray], np.ndarray]]]],
) -> DataFrame:
    """``anchor_id``, ``slot``, ``score``, ``id`` of the heaps of each task.

    ``masks(ids, labels, *extra)`` gives for the anchors of a tile, slot by slot, a function from
    their scores with some candidates, and those ids and labels, to what each slot's heaps are
    offered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held) -> pa.RecordBatch:
            ids, heaps = held[1], held[3]
            parts = []
            for slot, heap in enumerate(heaps):
                row, at = np.nonzero(heap.scores != _NONE)
                parts.append((ids[row], np.full(len(row), slot, np.int32), heap.scores[row, at], heap.ids[row, at]))
            columns = [np.concatenate(c) for c in zip(*parts)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["anchor_id", "slot", "score", "id"]
            )

        held = None  # of the tile of anchors at hand: key, ids, slots, heaps, matrix
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i] for n, c in zip(batch.schema.names, batch.columns)}
                tile = row["bucket"].as_py(), row["a_part"].as_py()
                size = row["size"].as_py()

                def numbers(name: str, kind: str = "<i8") -> np.ndarray:
                    return np.frombuffer(row[name].as_buffer(), kind).astype(np.int64)

                if held is None or held[0] != tile:
                    if held is not None:
                        yield out(held)
                    ids = numbers("ids")
                    slots = masks(ids, numbers("labels"), *(row[n].as_py() for n in extra))
                    heaps = [Heaps.empty(len(ids), k) for _ in slots]
                    held = tile, ids, slots, heaps, numbers("data", "<i4").reshape(len(ids), size)
                c_ids, c_labels = numbers("c_ids"), numbers("c_labels")
                others = numbers("c_data", "<i4").reshape(len(c_ids), size)
                for at in range(0, len(c_ids), STRIP):
                    strip = slice(at, at + STRIP)
                    scores = strassen(held[4], others[strip].T)
                    for s, mask in enumerate(held[2]):
                        held[3][s] = held[3][s].offer(mask(scores, c_ids[strip], c_labels[strip]), c_ids[strip])
        if held is not None:
            yield out(held)

    show_library(pairs.sparkSession)
    names = ["bucket", "a_part", "size", "ids", "labels", "data", *extra, "c_ids", "c_labels", "c_data"]
    return pairs.select(*names).mapInArrow(run, "anchor_id long, slot int, score long, id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and slot; heaps of all tasks merge under a rank limit."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _same_label(ids: np.ndarray, labels: np.ndarray) -> list:
    def mask(scores, other_ids, other_labels):
        good = (labels[:, None] == other_labels) & (ids[:, None] != other_ids)
        return np.where(good, scores, _NONE)

    return [mask]


def _in_windows(ids: np.ndarray, labels: np.ndarray, positives: list) -> list:
    """A slot for each positive: candidates of another label with low <= 100 score <= high."""
    slots = []
    for at in range(max(map(len, positives), default=0)):
        has = np.array([len(p) > at for p in positives])
        score = np.array([p[at]["score"] if len(p) > at else 0 for p in positives], np.int64)

        def mask(scores, other_ids, other_labels, has=has, score=score):
            # In whole numbers: 100 s >= LOW p, 100 s <= HIGH p.
            low, high = -(-(LOW * score) // 100), (HIGH * score) // 100
            good = (scores >= low[:, None]) & (scores <= high[:, None]) & has[:, None]
            return np.where(good & (labels[:, None] != other_labels), scores, _NONE)

        slots.append(mask)
    return slots


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of
    ``quantised`` that ``anchors`` holds for."""
    rows = stage(rows, "whole")
    total = rows.count()
    # As many buckets of labels as there are tiles: rare labels share one, a hot one is many tiles.
    buckets = max(1, -(-total // TILE))
    by_label = rows.withColumn("bucket", F.col("size") * F.lit(buckets).cast("long") + F.pmod(F.xxhash64("label"), F.lit(buckets)))
    is_anchor = anchors.alias("is_anchor")
    met = _met(_tiles(by_label.where(is_anchor)), _tiles(by_label))
    first = _ranked(_mine(met, [], positives, _same_label), positives)
    best = stage(
        first.groupBy("anchor_id").agg(
            F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("positives")
        ),
        "positives",
    )
    by_size = rows.withColumn("bucket", F.col("size").cast("long"))
    wanted = by_size.where(is_anchor).join(best.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    met = _met(_tiles(wanted, ["positives"]), _tiles(by_size))
    found = _ranked(_mine(met, ["positives"], negatives, _in_windows), negatives)
    return found.join(best, "anchor_id").select(
        "anchor_id",
        F.get("positives", F.col("slot"))["id"].alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.get("positives", F.col("slot"))["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )

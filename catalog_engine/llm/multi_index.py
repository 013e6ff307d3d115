"""Near-duplicate embeddings by an inverted multi-index (operator 6).

A codebook for each half of the unit vectors forms a grid of cells. Every vector lies in one cell
and looks into the nearest cells, in the order of the sum of distances, which the multi-sequence
walk gives from the two sorted lists. How many cells it visits is set on a sample, so that the
target recall is reached there for its links by brute force and for vectors moved to the threshold:
the rank of a cell in a walk is the number of smaller sums, so nothing is walked for it. What a vector
meets is verified by cosine in double precision. Cells are handled in blocks of bounded size, so no
task holds a large cell. Equal vectors stand for each other from the start, as one with a weight.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
different lengths do not link, and each length has a grid of its own. Rows with equal ids count as one
vector (the smallest one). A row without an id links with nothing. An empty table gives an empty one;
other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import map_rows, stage
from catalog_engine.llm.components import components

COSINE = 0.9
RECALL = 0.95
#: Vectors that codebooks and the number of visited cells are fitted on at least, chosen by hash, of
#: one length; and for each centre.
SAMPLE = 4_096
FOR_CENTRE = 4
#: Vectors a cell holds on average, and vectors that are compared at a time.
CELL = 64
BLOCK = 256
#: Centres of a half grow with the root of the vectors, up to here (four billion vectors).
MAX_CENTRES = 8_192
ROUNDS = 12


def _centres(points: np.ndarray, k: int) -> np.ndarray:
    """k-means from points spread over the sample; empty centres stay where they are."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = _distances(points, centres).argmin(axis=1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)


def walk(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The n cells of smallest a[i] + b[j], nearest first (multi-sequence algorithm)."""
    left, right = a.argsort(kind="stable"), b.argsort(kind="stable")
    heap, out = [(a[left[0]] + b[right[0]], 0, 0)], []
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append((int(left[i]), int(right[j])))
        # (i + 1, j) waits until (i + 1, j - 1) has been visited, which is so only at j = 0 or
        # when that cell was popped; pushing along one axis first visits each cell once.
        if j + 1 < len(right):
            heapq.heappush(heap, (a[left[i]] + b[right[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(left):
            heapq.heappush(heap, (a[left[i + 1]] + b[right[0]], i + 1, 0))
    return out


@dataclass
class Grid:
    """Codebooks of the halves of vectors of one length, and how many cells are visited."""

    halves: tuple[np.ndarray, np.ndarray]
    visits: int = 1

    def walks(self, units: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
        cut = units.shape[1] // 2
        a, b = _distances(units[:, :cut], self.halves[0]), _distances(units[:, cut:], self.halves[1])
        return [walk(x, y, n) for x, y in zip(a, b)]


def _valid(vector) -> bool:
    return bool(vector) and all(x is not None for x in vector) and bool(
        np.isfinite(vector).all() and np.any(vector)
    )


def units_of(vectors: list) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square leaves the range."""
    made = np.array(vectors, np.float64)
    made /= np.abs(made).max(axis=1, keepdims=True)
    return made / np.sqrt((made**2).sum(axis=1, keepdims=True))


def ranks(a: np.ndarray, b: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many cells come before each of ``cells`` (pairs of numbers) in the order of a[i] + b[j]."""
    # As the walk adds them up, so that a cell is not before itself by rounding.
    sums = a[cells[:, 0]] + b[cells[:, 1]]
    left = np.sort(b)
    # Sums that are equal but for rounding count as not smaller.
    low = sums[:, None] - a[None, :]
    return np.searchsorted(left, low - 1e-12, "left").sum(axis=1)


def _visits(grid: Grid, units: np.ndarray, cosine: float, recall: float) -> int:
    """Cells to visit, so that ``recall`` of links meet from either side: links of the sample by
    brute force, and pairs of a sampled vector and one moved from it to the threshold."""
    cut = units.shape[1] // 2

    def to_centres(points):
        return _distances(points[:, :cut], grid.halves[0]), _distances(points[:, cut:], grid.halves[1])

    def nearest(points):
        return np.stack([d.argmin(axis=1) for d in to_centres(points)], axis=1)

    home = nearest(units)
    noise = np.random.Generator(np.random.Philox(key=[11, 5])).normal(size=units.shape)
    noise -= (noise * units).sum(1, keepdims=True) * units
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    moved = cosine * units + (1 - cosine**2) ** 0.5 * noise
    moved_home = nearest(moved)
    # By rank the number of links that meet there: bounded by the cells, however many links.
    met: Counter = Counter()
    turned: Counter = Counter()
    for at in range(0, len(units), 256):
        some = slice(at, at + 256)
        a, b = to_centres(units[some])
        c, d = to_centres(moved[some])
        close = units[some] @ units.T >= cosine
        for i in range(len(a)):
            place = at + i
            one = ranks(a[i], b[i], moved_home[place : place + 1])[0]
            two = ranks(c[i], d[i], home[place : place + 1])[0]
            turned[int(min(one, two))] += 1
            linked = np.flatnonzero(close[i])
            linked = linked[linked != place]
            if len(linked):
                # Each pair of cells once; from here a link is met at this rank, from there at its own.
                cells, n = np.unique(home[linked], axis=0, return_counts=True)
                for rank, times in zip(ranks(a[i], b[i], cells).tolist(), n.tolist()):
                    met[rank] += times
    need = 0
    for counts in (met, turned):
        left = recall * sum(counts.values())
        for rank in sorted(counts):
            if left <= 0:
                break
            left -= counts[rank]
            need = max(need, rank)
    return 1 + need


def fit(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE) -> dict[int, Grid]:
    """A grid for each length of the vectors (vec_id, embedding), on a bounded sample of each."""
    sized = vectors.where("embedding is not null").withColumn("size", F.size("embedding"))
    counts = {r["size"]: r["count"] for r in sized.groupBy("size").count().collect() if r["size"] > 1}
    # The sample is for all lengths together, but a rare length has its part.
    per_length = max(256, sample * 4 // max(4, len(counts)))
    centres = {n: int(min(MAX_CENTRES, max(1, round((c / CELL) ** 0.5)))) for n, c in counts.items()}
    grids: dict[int, Grid] = {}
    for length, k in centres.items():
        rows = (
            sized.where(F.col("size") == length)
            .orderBy(F.xxhash64("vec_id"), "vec_id")
            .limit(max(per_length, FOR_CENTRE * k))
            .select("embedding")
            .collect()
        )
        found = [r["embedding"] for r in rows if _valid(r["embedding"])]
        if not found:
            continue
        units, cut = units_of(found), length // 2
        k = min(k, len(units))
        grid = Grid((_centres(units[:, :cut], k), _centres(units[:, cut:], k)))
        grid.visits = _visits(grid, units[:sample], cosine, recall)
        grids[length] = grid
    return grids


def _placed(vectors: DataFrame, grids: dict[int, Grid], kind: str) -> DataFrame:
    """``vec_id``, ``weight``, ``cell``, ``visits`` (cells to look into) and ``vector`` of valid
    vectors."""

    def make():
        def run(ids, weights, vectors):
            out = {"vec_id": [], "weight": [], "cell": [], "visits": [], "vector": []}
            groups: dict[int, list[int]] = {}
            for i, vector in enumerate(vectors):
                if _valid(vector):
                    groups.setdefault(len(vector), []).append(i)
            for length, places in groups.items():
                grid = grids.get(length)
                if grid is None:  # of one component: its sign is the cell
                    walks = [[(int(vectors[i][0] > 0), 0)] for i in places]
                else:
                    walks = grid.walks(units_of([vectors[i] for i in places]), grid.visits)
                for i, cells in zip(places, walks):
                    codes = [length << 40 | a << 20 | b for a, b in cells]
                    out["vec_id"].append(ids[i])
                    out["weight"].append(weights[i])
                    out["cell"].append(codes[0])
                    out["visits"].append(codes)
                    out["vector"].append(np.array(vectors[i], kind).tobytes())
            return out

        return run

    schema = "vec_id bigint, weight bigint, cell bigint, visits array<bigint>, vector binary"
    return map_rows(vectors, ["vec_id", "weight", "embedding"], make, schema)


def _local(close: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and column reaches through the links of one comparison."""
    most = np.iinfo(np.int64).max
    a, b = rows.copy(), columns.copy()
    while True:
        b2 = np.minimum(b, np.where(close, a[:, None], most).min(axis=0))
        a2 = np.minimum(a, np.where(close, b2[None, :], most).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def _compare(pairs: DataFrame, cosine: float, kind: str) -> DataFrame:
    """``vec_id``, ``n`` (links met here and counted here) and ``reach`` from pairs of blocks."""

    def make():
        def unit(block):
            data = [np.frombuffer(r["vector"], kind).astype(np.float64) for r in block]
            ids, weights = (np.array([r[n] for r in block], np.int64) for n in ("vec_id", "weight"))
            return units_of(data), ids, weights

        def run(seekers, held):
            out = {"vec_id": [], "n": [], "reach": []}
            for one, two in zip(seekers, held):
                (p, pid, weight), (e, eid, other_weight) = unit(one), unit(two)
                close = (p @ e.T >= cosine) & (pid[:, None] != eid)
                if not close.any():
                    continue
                i, j = np.nonzero(close)
                home = np.array([r["cell"] for r in one], np.int64)[i]
                visits = np.array([r["visits"] for r in two], np.int64)[j]
                # A pair that meets from both sides counts where the smaller id looks.
                count = (pid[i] < eid[j]) | ~(visits == home[:, None]).any(axis=1)
                i, j = i[count], j[count]
                sums = np.zeros(len(pid), np.int64), np.zeros(len(eid), np.int64)
                np.add.at(sums[0], i, other_weight[j])
                np.add.at(sums[1], j, weight[i])
                for ids, n, reach in zip((pid, eid), sums, _local(close, pid, eid)):
                    some = (n > 0) | (reach != ids)
                    out["vec_id"] += ids[some].tolist()
                    out["n"] += n[some].tolist()
                    out["reach"] += reach[some].tolist()
            return out

        return run

    return map_rows(pairs, ["seekers", "held"], make, "vec_id bigint, n bigint, reach bigint")


def link(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = COSINE,
    recall: float = RECALL,
    sample: int = SAMPLE,
) -> DataFrame:
    """For each row of ``vectors``: ``vec_id``, ``n_links``, ``component_id`` (smallest id that
    links reach) and ``kept``."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    single = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # Two hashes of 64 bits tell vectors apart.
    same = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")]
    single = stage(single.select("*", *same), "vectors")
    lowest = F.min(F.struct("vec_id", "embedding")).alias("r")
    reps = stage(
        single.where("embedding is not null")
        .groupBy("k1", "k2")
        .agg(lowest, F.count("*").alias("weight"))
        .select("k1", "k2", "weight", "r.*"),
        "distinct",
    )
    # Vectors travel as they are given and become double precision where they are compared.
    kind = "<f4" if single.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    placed = stage(_placed(reps, fit(reps, cosine, recall, sample), kind), "placed")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    held = (
        placed.join(blocks, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "weight", "vector", "visits")).alias("held"))
    )
    looks = placed.select(F.explode("visits").alias("target"), "vec_id", "weight", "cell", "vector")
    parts = (
        placed.select(F.explode("visits").alias("target"))
        .groupBy("target")
        .agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
        .join(blocks.withColumnRenamed("cell", "target"), "target")
    )
    seekers = (
        looks.join(parts, "target")
        .groupBy(
            F.col("target").alias("cell"),
            "blocks",
            F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).alias("part"),
        )
        .agg(F.collect_list(F.struct("vec_id", "weight", "vector", "cell")).alias("seekers"))
        .select("cell", "seekers", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    )
    met = stage(_compare(seekers.join(held, ["cell", "block"]), cosine, kind), "met")
    labels = components(met.select(F.col("vec_id").alias("a"), F.col("reach").alias("b")))
    counts = met.groupBy("vec_id").agg(F.sum("n").alias("n"))
    # Of valid vectors only: a copy links with all other copies, and with what its kind links with.
    known = (
        placed.select("vec_id", "weight")
        .join(reps.select("k1", "k2", "vec_id"), "vec_id")
        .join(counts, "vec_id", "left")
        .join(labels, F.col("vec_id") == labels["node"], "left")
        .select(
            "k1",
            "k2",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component"),
        )
    )
    found = single.select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).drop("k1", "k2")
    return (
        rows.select("vec_id")
        .join(found, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )

"""Language identification by hyperdimensional profiles (operator 5).

Every letter has a random vector of +1 and -1. The vector of three letters in a row is the product
of theirs, rotated by place; a document is the sum over its n-grams, a language the sum over
documents of unit length. The language whose vector has the largest cosine with the document wins.

Texts that are null or hold no letter get ``und`` and score 0. Equal cosines go to the language
that sorts first. Without known languages every document is ``und``. Repeated rows are predicted each,
and learned from each; an empty table gives an empty one. Long texts are read whole, in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import map_rows

DIMENSIONS = 1024
#: Documents of a language that its profile is learned from (expected number, chosen by hash).
SAMPLE = 2_000
#: Languages that profiles may be sent to every task for; more is an error, not a cut.
MAX_LANGUAGES = 4_096
SEED = 20_240_501
GROUP = 128
#: Letters, and n-grams, whose vectors are kept; n-grams counted, and n-grams added up, at a time.
_STORED = 1 << 15
PART = 1 << 20
SLICE = 2_048


@dataclass
class Vectors:
    """Vectors of letters and of n-grams, made when first met; both follow from the seed only.

    Memory is bounded whatever the texts: letters and n-grams are kept up to a number each, and
    n-grams are counted and added up in slices."""

    dimensions: int = DIMENSIONS
    letters: dict[int, np.ndarray] = field(default_factory=dict)
    places: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.store = np.zeros((_STORED, self.dimensions), np.int8)
        #: 1 for code points that are letters; the rest separates words.
        self.is_letter = np.zeros(0x110000, bool)
        for start in range(0, 0x110000, 0x10000):
            plane = range(start, start + 0x10000)
            self.is_letter[start : start + 0x10000] = [chr(c).isalpha() for c in plane]

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= _STORED:
                self.letters.clear()
            draw = np.random.Generator(np.random.Philox(key=[SEED, code]))
            self.letters[code] = draw.integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.letters[code]

    def _bound(self, keys: np.ndarray) -> np.ndarray:
        """The product of the letters' vectors, rotated by place, for n-grams."""
        made = None
        for turn, codes in ((2, keys >> 42), (1, keys >> 21 & 0x1FFFFF), (0, keys & 0x1FFFFF)):
            of, where = np.unique(codes, return_inverse=True)
            found = np.roll(np.stack([self.letter(c) for c in of.tolist()]), turn, axis=1)[where]
            made = found if made is None else np.multiply(made, found, out=made)
        return made

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of at most SLICE n-grams, given as three code points of 21 bits."""
        places = np.array([self.places.get(k, -1) for k in keys.tolist()])
        fresh = keys[places < 0]
        if len(fresh):
            if len(self.places) + len(fresh) > len(self.store):
                self.places.clear()
                fresh, places = keys, np.full(len(keys), -1)
            first = len(self.places)
            self.store[first : first + len(fresh)] = self._bound(fresh)
            self.places.update(zip(fresh.tolist(), range(first, first + len(fresh))))
            places[places < 0] = np.arange(first, first + len(fresh))
        return self.store[places]

    def grams(self, text: str) -> Iterator[np.ndarray]:
        """Keys of the n-grams of a text, a part at a time; runs of other characters count as one
        blank."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.is_letter[codes]
        if not letter.any():
            return
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = np.concatenate([[0], np.where(letter, codes, 0)[keep], [0]]).astype(np.uint32)
        for at in range(0, len(codes) - 2, PART):
            part = codes[at : at + PART + 2].astype(np.int64)
            yield part[:-2] << 42 | part[1:-1] << 21 | part[2:]

    def _add(self, out: np.ndarray, owners: list[int], grams: list[np.ndarray]) -> None:
        """Adds the vectors of n-grams to the rows of their texts."""
        keys, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        owner = np.repeat(np.array(owners), [len(g) for g in grams])
        pairs, counts = np.unique(inverse * len(out) + owner, return_counts=True)
        for at in range(0, len(keys), SLICE):
            some = slice(*np.searchsorted(pairs, [at * len(out), (at + SLICE) * len(out)]))
            part = keys[at : at + SLICE]
            dense = np.zeros((len(part), len(out)), np.float32)
            dense.ravel()[pairs[some] - at * len(out)] = counts[some]
            out += dense.T @ self.rows(part).astype(np.float32)

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors of texts; zero where there is no letter."""
        out = np.zeros((len(texts), self.dimensions))
        owners, held, size = [], [], 0
        for owner, text in enumerate(texts):
            for part in self.grams(text) if text else ():
                owners.append(owner)
                held.append(part)
                size += len(part)
                if size >= PART:
                    self._add(out, owners, held)
                    owners, held, size = [], [], 0
        if size:
            self._add(out, owners, held)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


@lru_cache(maxsize=2)
def vectors(dimensions: int) -> Vectors:
    """One store a process, kept from task to task."""
    return Vectors(dimensions)


@dataclass
class Profiles:
    languages: list[str]
    matrix: np.ndarray  # a unit row for each language

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        store, names, scores = vectors(self.matrix.shape[1]), [], []
        for at in range(0, len(texts), GROUP):
            made = store.bundles(texts[at : at + GROUP])
            if not self.languages:
                names += ["und"] * len(made)
                scores += [0.0] * len(made)
                continue
            cosines = np.round(made @ self.matrix.T, 9)
            best = cosines.argmax(axis=1)
            some = made.any(axis=1)
            names += [self.languages[b] if s else "und" for b, s in zip(best, some)]
            top = np.clip(cosines[np.arange(len(made)), best], 0, 1)
            scores += np.where(some, top, 0.0).tolist()
        return names, scores


def fit(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    key: str = "doc_id",
    sample: int = SAMPLE,
    dimensions: int = DIMENSIONS,
) -> Profiles:
    """Profiles of the languages of ``docs``, from about ``sample`` documents of each.

    The sample is a threshold on the hash of the id, set by how many documents a language has.
    """
    known = docs.where(F.col(lang).isNotNull()).select(
        F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: profiles would not fit a task")
    if not sizes:
        return Profiles([], np.zeros((0, dimensions)))
    share = F.create_map(
        *(F.lit(x) for n, c in sizes.items() for x in (n, int(min(1.0, sample / c) * (1 << 30))))
    )
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")])

    def make():
        def run(langs, texts):
            store, sums = vectors(dimensions), {}
            for at in range(0, len(texts), GROUP):
                made = np.rint(store.bundles(texts[at : at + GROUP]) * 10_000).astype(np.int64)
                for name, row in zip(langs[at : at + GROUP], made):
                    sums[name] = sums.get(name, 0) + row  # whole numbers: in any order the same
            return {
                "lang": [n for n in sums for _ in range(dimensions)],
                "place": [*range(dimensions)] * len(sums),
                "value": [int(x) for row in sums.values() for x in row],
            }

        return run

    parts = map_rows(chosen, ["lang", "text"], make, "lang string, place int, value bigint")
    rows = (
        parts.groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .groupBy("lang")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("v"))
        .collect()
    )
    found = {r["lang"]: np.array(r["v"], np.float64) for r in rows}
    names = sorted(n for n, v in found.items() if v.any())
    matrix = np.array([found[n] / np.linalg.norm(found[n]) for n in names])
    return Profiles(names, matrix.reshape(len(names), dimensions))


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score``; columns of these names are replaced."""
    names = [text, *(c for c in docs.columns if c not in (text, "lang_pred", "score"))]

    def make():
        def run(texts, *rest):
            langs, scores = profiles.predict(texts)
            return dict(zip(names, [texts, *rest])) | {"lang_pred": langs, "score": scores}

        return run

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_rows(docs, names, make, schema + ", lang_pred string, score double")

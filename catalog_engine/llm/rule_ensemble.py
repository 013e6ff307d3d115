"""Quality classifier by a sparse rule ensemble (operator 12).

Statistics of a text are Spark columns. Shallow trees are grown on them; every path from a root is a
conjunctive rule (bounds of some statistics), and a logistic regression with a lasso penalty gives
most rules the weight 0. What is left is compiled into one Spark column: scoring needs no Python and
no model at the executors.

Trees and weights are fitted by Spark ML on a bounded sample of labelled rows (``MAX_EXAMPLES``, by
hash of their ids); scoring looks at every whole text. The sample lies in one partition, ordered, so
that a repeated fit gives the same rules.

Null and empty texts have the statistic 0 everywhere and get a score like any other. Labels that are
null, or of no document, are not learned from; of repeated labels of one id the larger counts;
repeated rows of a document are examples each. Without labels every score is 0, with labels of one
kind it is their rate. A very long text is as any other. Input columns named like those added are
replaced, other columns are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import stage

#: Labelled rows that are learned from at most.
MAX_EXAMPLES = 20_000
TREES = 24
DEPTH = 3
#: Examples that a node of a tree holds at least.
LEAST = 8
#: Weight of the lasso penalty, and weights below which a rule is dropped.
LASSO = 0.001
ZERO = 1e-6
THRESHOLD = 0.7
SEED = 12

#: Names of the columns that hold counts and statistics while a text is scored.
_MARK = "__stat_"

_SYMBOLS = "#*$%&|<>{}[]=+@^~_\\/"
_STOPS = ".,;:!?"
_DIGITS = "0123456789"


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _counts(text: Column) -> dict[str, Column]:
    lower = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    lines = F.split(text, "\n")
    return {
        "chars": F.length(text).cast("double"),
        "words": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("double"),
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double"),
        "symbols": _without(text, _SYMBOLS).cast("double"),
        "stops": _without(text, _STOPS).cast("double"),
        "bangs": _without(text, "!").cast("double"),
        "digits": _without(text, _DIGITS).cast("double"),
        "lines": F.size(lines).cast("double"),
        "new_lines": F.size(F.array_distinct(lines)).cast("double"),
        "new_words": F.size(F.array_distinct(lower)).cast("double"),
        "short": F.regexp_count(text, F.lit(r"(?<!\S)\S{1,3}(?!\S)")).cast("double"),
    }


def _statistics() -> dict[str, Column]:
    count = {name: F.col(_MARK + "n_" + name) for name in _counts(F.lit(""))}
    words, chars = count["words"], count["chars"]
    return {
        "words": words,
        "word_length": _share(chars, words),
        "upper": _share(count["upper"], chars),
        "symbols": _share(count["symbols"], words),
        "stops": _share(count["stops"], words),
        "bangs": _share(count["bangs"], words),
        "digits": _share(count["digits"], chars),
        "line_words": _share(words, count["lines"]),
        "repeated_lines": _share(count["lines"] - count["new_lines"], count["lines"]),
        # Long texts repeat words by nature: the square root takes most of that out.
        "new_words": _share(count["new_words"], F.sqrt(words)),
        "repeated_words": _share(words - F.least(count["new_words"], words), words),
        "short_words": _share(count["short"], words),
    }


#: The statistics in the order in which trees number them.
NAMES = (
    "words",
    "word_length",
    "upper",
    "symbols",
    "stops",
    "bangs",
    "digits",
    "line_words",
    "repeated_lines",
    "new_words",
    "repeated_words",
    "short_words",
)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with a column ``__stat_<name>`` for each statistic."""
    value = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumns({_MARK + "n_" + n: c for n, c in _counts(value).items()})
    made = counted.withColumns({_MARK + n: c for n, c in _statistics().items()})
    return made.drop(*(_MARK + "n_" + n for n in _counts(value)))


@dataclass(frozen=True)
class Rule:
    """Bounds of statistics, as (name, low, high): low < statistic <= high, either may be missing."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for name, low, high in self.bounds:
            if low is not None:
                held = held & (F.col(_MARK + name) > low)
            if high is not None:
                held = held & (F.col(_MARK + name) <= high)
        return held

    def __str__(self) -> str:
        parts = []
        for name, low, high in self.bounds:
            parts += [f"{name} > {low:.6g}"] if low is not None else []
            parts += [f"{name} <= {high:.6g}"] if high is not None else []
        return " and ".join(parts)


@dataclass
class Model:
    """Rules with their weights; ``base`` is the log-odds where no rule holds."""

    base: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    #: The score of every text where there was nothing to tell apart.
    constant: float | None = None

    def margin(self) -> Column:
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return total

    def column(self) -> Column:
        """The score, of the columns of ``with_statistics``."""
        if self.constant is not None:
            return F.lit(self.constant)
        return 1 / (1 + F.exp(-self.margin()))


_SPLIT = re.compile(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEeINFinf]+)\)")


def rules_of(tree: str, names: tuple[str, ...] = NAMES) -> list[Rule]:
    """The path to every node but the root, from the text form of a tree."""
    path: list[tuple[str, str, float]] = []
    found, root = [], None
    for line in tree.splitlines():
        if match := _SPLIT.match(line):
            blanks, feature, sign, value = match.groups()
            # The text form is indented by one blank more for each level below the root.
            root = len(blanks) if root is None else root
            path = path[: len(blanks) - root] + [(names[int(feature)], sign, float(value))]
            found.append(_merged(path))
    return found


def _merged(path: list[tuple[str, str, float]]) -> Rule:
    bounds: dict[str, list[float | None]] = {}
    for name, sign, value in path:
        low, high = bounds.setdefault(name, [None, None])
        if sign == ">":
            bounds[name][0] = value if low is None else max(low, value)
        else:
            bounds[name][1] = value if high is None else min(high, value)
    return Rule(tuple((n, *bounds[n]) for n in sorted(bounds)))


def _examples(docs: DataFrame, labels: DataFrame, label: str, max_examples: int) -> DataFrame:
    """Statistics and label of the bounded sample, in one ordered partition."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_examples)
    )
    # At most max_examples ids and labels are sent to every task.
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    columns = [_MARK + n for n in NAMES]
    sample = with_statistics(known).select("doc_id", F.col("label").cast("double"), *columns)
    return stage(stage(sample, "sample").repartition(1).sortWithinPartitions("doc_id", *columns), "examples")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    max_examples: int = MAX_EXAMPLES,
    trees: int = TREES,
    depth: int = DEPTH,
    lasso: float = LASSO,
) -> Model:
    """Learns rules and weights from ``labels`` (doc_id, ``label``) and the texts of ``docs``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    examples = _examples(docs, labels, label, max_examples)
    total, good = examples.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < good < total:
        return Model(0.0, constant=good / total if total else 0.0)
    columns = [_MARK + n for n in NAMES]
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(examples)
    forest = RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=LEAST,
        featureSubsetStrategy="onethird",
        seed=SEED,
    ).fit(data.select("features", "label"))
    rules = list(dict.fromkeys(r for t in forest.trees for r in rules_of(t.toDebugString)))
    if not rules:
        return Model(0.0, constant=good / total)
    held = [r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    assembler = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features")
    # A row of 0 and 1 for each example; of the bounded sample only.
    fired = stage(examples.select("label", *held), "fired")
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=100, tol=1e-7).fit(
        assembler.transform(fired).select("features", "label")
    )
    weights = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray()) if abs(w) > ZERO]
    return Model(float(fitted.intercept), weights)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", prefix: str = "") -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 where it reaches the threshold)."""
    added = [prefix + "score", prefix + "predicted"]
    kept = [f"`{c}`" for c in docs.columns if c not in added]
    scored = with_statistics(docs, text).withColumn(_MARK + "score", model.column())
    return scored.select(
        *kept,
        F.col(_MARK + "score").alias(added[0]),
        (F.col(_MARK + "score") >= threshold).cast("int").alias(added[1]),
    )

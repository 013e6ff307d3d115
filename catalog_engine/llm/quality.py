"""Quality rules as a bitmask ledger (operator 1, DataFrame functions only).

Every rule is evaluated once a document. The ledger keeps the measurements and one bit for each
failed rule; policies are masks over those bits, so a new policy or an ablation never reads the
texts again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import SPACE, let

WINDOW = 5

#: Rules by name, as SQL over the measurements. The place in this mapping is the bit.
RULES: Mapping[str, str] = {
    "few_words": "n_words < 10",
    "repetition": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "2 * n_upper > word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a document under it."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Mapping[str, str] = RULES) -> int:
        bits = {name: 1 << i for i, name in enumerate(rules)}
        return sum(bits[name] for name in dict.fromkeys(self.rules))


BASE = Policy("base-1", ("few_words", "repetition"))
STRICT = Policy("strict-1", tuple(RULES))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of five words that the text holds twice or more."""

    def at(i: Column) -> Column:
        return F.concat_ws(" ", *(F.get(words, i + k) for k in range(WINDOW)))

    def exact(starts: Column) -> Column:
        def covered(places: Column) -> Column:
            gaps = F.transform(
                places,
                lambda x, k: F.coalesce(F.least(F.get(places, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)),
            )
            return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

        def twice(ordered: Column) -> Column:
            return F.filter(
                ordered,
                lambda x, k: F.coalesce(F.get(ordered, k - 1)["w"] == x["w"], F.lit(False))
                | F.coalesce(F.get(ordered, k + 1)["w"] == x["w"], F.lit(False)),
            )

        windows = F.sort_array(F.transform(starts, lambda i: F.struct(at(i).alias("w"), i.alias("i"))))
        places = let(windows, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        return let(places, covered)

    def hashed(codes: Column) -> Column:
        # Pairs, then fours, then fives: three cheap passes over the hashes of the words.
        pairs = F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: F.xxhash64(a, b))
        fours = let(
            pairs,
            lambda p: F.zip_with(p, F.slice(p, 3, F.size(p)), lambda a, b: F.xxhash64(a, b)),
        )
        fives = F.zip_with(fours, F.slice(codes, 5, F.size(codes)), lambda a, b: F.xxhash64(a, b))
        windows = F.slice(fives, 1, F.size(words) - WINDOW + 1)
        starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
        # Different hashes mean different windows, so most texts need no comparison of words.
        return let(
            windows,
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(exact(starts)),
        )

    some = F.size(words) > WINDOW
    return F.when(some, let(F.transform(words, lambda w: F.xxhash64(w)), hashed)).otherwise(0)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements of the rules as columns; a null text counts as empty.

    Columns: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_lines``, ``n_upper`` (all long). Input columns of these names are replaced.
    """
    whole, words = F.col("__text"), F.col("__words")
    length = F.length

    def removed(pattern: str) -> Column:
        return length(whole) - length(F.regexp_replace(whole, pattern, ""))

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    shaped = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumns(
        {
            "__words": F.array_remove(F.split("__text", SPACE), ""),
            "__lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))),
        }
    )
    return shaped.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + length(w)),
            "n_symbols": removed(r"[#*$%&|<>]+").cast("long"),
            "n_dup_lines": (F.col("__lines")["n"] - F.col("__lines")["d"]).cast("long"),
            "n_repeat_words": _repeat_words(words).cast("long"),
            "n_lines": F.col("__lines")["n"].cast("long"),
            "n_upper": removed(r"\p{Lu}+").cast("long"),
        }
    ).drop("__text", "__words", "__lines")


def build_ledger(
    docs: DataFrame, text: str = "text", rules: Mapping[str, str] = RULES, key: str = "doc_id"
) -> DataFrame:
    """The ledger: ``key``, the measurements and ``failed_bits`` (bit i: rule i failed).

    Null texts count as empty; repeated rows give repeated rows; an empty table an empty ledger.
    """
    measured = measure(docs.select(F.col(key), F.col(text).alias("text")))
    bits = [
        F.when(F.expr(sql), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        for i, sql in enumerate(rules.values())
    ]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.drop("text").withColumn("failed_bits", failed)


def rejects(bits: Column, policy: Policy, rules: Mapping[str, str] = RULES) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def apply_policy(
    ledger: DataFrame, policy: Policy, rules: Mapping[str, str] = RULES
) -> DataFrame:
    """Adds ``kept`` and ``policy_version``; reads the ledger only."""
    return ledger.withColumns(
        {
            "kept": ~rejects(F.col("failed_bits"), policy, rules),
            "policy_version": F.lit(policy.version),
        }
    )


def ablate(ledger: DataFrame, policy: Policy, rules: Mapping[str, str] = RULES) -> DataFrame:
    """One row for each rule of the policy: documents it fails, and those only it rejects.

    ``rule``, ``bit``, ``n_failed``, ``n_only`` (kept if this rule were left out), ``n_docs``. One
    pass: equal bit patterns are counted first, so the shuffle holds patterns and no documents.
    """
    mask = policy.mask(rules)
    patterns = (
        ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits"))
        .agg(F.count("*").alias("n"))
    )
    sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs")]
    for i, name in enumerate(rules):
        if name in policy.rules:
            bit = F.lit(1 << i).cast("long")
            for what, test in (
                ("f", F.col("bits").bitwiseAND(bit) != 0),
                ("o", F.col("bits") == bit),
            ):
                sums.append(F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(f"{what}{i}"))
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.lit(i).alias("bit"),
            F.col(f"f{i}").alias("n_failed"),
            F.col(f"o{i}").alias("n_only"),
        )
        for i, name in enumerate(rules)
        if name in policy.rules
    ]
    return (
        patterns.agg(*sums)
        .select("n_docs", F.explode(F.array(*rows)).alias("r"))
        .select("r.rule", "r.bit", "r.n_failed", "r.n_only", "n_docs")
    )

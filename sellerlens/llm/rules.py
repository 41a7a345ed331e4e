"""Quality rules as a bitmask ledger (built-in expressions only).

Every measurement and every rule is evaluated once per document; the ledger
keeps the measurements and one failure bit per rule. Policies are versioned
sets of rules: applying one is a bitwise AND, and the effect of leaving a
rule out is counted from the masks alone, without looking at texts again.

Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n``.

Defined cases: a null or empty text has no words, all measurements are 0 and
the ``few_words`` bit is set; repeated rows are judged one by one; a null
doc_id is kept as it is; an empty table gives an empty ledger; extra input
columns are ignored. No step moves rows between tasks except the grouping by
mask in ``ablation``, which combines before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurement columns."""
    name: str
    fails: str


# Bit i of a mask belongs to RULES[i]; new rules are appended, never moved.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
)

# Versioned policies: names of the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": tuple(r.name for r in RULES),
}


def bits(names, rules: tuple[Rule, ...] = RULES) -> int:
    index = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << index[n] for n in names)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words lying in a 3-word window that occurs twice or more.

    Windows are compared through sorted (hash, position) pairs, so the work is
    n log n in the length of the text whatever repeats. The cheap test first:
    most texts have as many distinct windows as windows.
    """
    n = F.size(words)
    at = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def again(p, k, s):
        before = F.get(s, k - 1)["h"].eqNullSafe(p["h"]) & (k > 0)
        return before | F.get(s, k + 1)["h"].eqNullSafe(p["h"])

    def covered(s):
        starts = F.array_sort(F.transform(F.filter(s, lambda p, k: again(p, k, s)), lambda p: p["i"]))
        return F.get(F.transform(F.array(starts), lambda q: F.aggregate(
            F.transform(q, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(q, k - 1)))),
            F.lit(0), lambda a, b: a + b)), 0)

    return F.when(n < 4, 0).otherwise(F.get(F.transform(F.array(hashes), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), 0)
        .otherwise(F.get(F.transform(F.array(
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))), covered), 0))), 0))


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and one measurement per column, all from one pass."""
    t = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.select(
        "doc_id", "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda l: F.btrim(l, F.lit(SPACE_CHARS)) != "").alias("lines"))
    long = "long"
    return t.select(
        "doc_id",
        F.size("words").cast(long).alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast(long).alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast(long).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast(long).alias("n_dup_lines"),
        repeated_words(F.col("words")).cast(long).alias("n_repeat_words"),
        F.size("lines").cast(long).alias("n_lines"),
        _count(F.col("text"), UPPER).cast(long).alias("n_capitals"))


def ledger(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``failed``, the bitmask of the rules a document fails."""
    mask = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        mask = mask.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(documents).withColumn("failed", mask)


def apply_policy(led: DataFrame, policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the policy (a name or rule names) fails."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return led["failed"].bitwiseAND(F.lit(bits(names, rules)).cast("long")) == 0


def ablation(led: DataFrame, policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents it fails, and documents that only it
    rejects (those that come back when the rule is left out)."""
    names = POLICIES[policy] if isinstance(policy, str) else tuple(policy)
    within = F.lit(bits(names, rules)).cast("long")
    masks = (led.select(F.col("failed").bitwiseAND(within).alias("mask"))
             .groupBy("mask").agg(F.count("*").alias("n")))
    one = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bits([n], rules)).cast("long").alias("bit")) for n in names])
    return (masks.select("mask", "n", F.inline(one))
            .groupBy("rule").agg(
                F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("failed"),
                F.coalesce(F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only")))

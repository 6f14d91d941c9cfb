"""Quality rules as a bitmask ledger, in DataFrame functions only.

``measure`` takes each text's measurements once. ``ledger`` evaluates every rule once on them and stores one
bit a failed rule. Policies are versions of a choice of rules (a mask) over a ledger: ``apply_policy`` needs a
bitwise AND, and ``ablations`` groups the ledger by its bits (at most 2**rules rows, whatever the corpus) and
reads from them what each rule rejects, rejects alone, and would let through if it were dropped.

Nothing is shuffled before the ablation counts. Windows of words are compared by 64-bit hashes first; only texts
in which two agree are sorted by the windows' words themselves, so the counts are exact.

Defined results: a null text has no words and fails the word-count rule; null or repeated doc_ids are passed
through, one row out for each row in; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL predicate over the measurements."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of what counts: the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 50 * n_text_lines"),
    Rule(4, "shouting", "100 * n_shouted > 50 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "short_words", "word_chars < 2 * n_words"),
    Rule(7, "word_runs", "100 * n_run_words > 30 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("2024-1", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "long_words", "short_words", "word_runs"))
POLICIES = (BASE, STRICT)


def _covered(starts: Column) -> Column:
    """Words under windows that start at the given positions (ascending)."""
    each = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1), p + WINDOW) - p))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements, all long."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").alias("doc_id"), text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    index = F.sequence(F.lit(1), F.size("w") - (WINDOW - 1))
    hashes = F.when(F.size("w") > WINDOW, F.transform(index, lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    out = out.select("doc_id", "t", "w", hashes.alias("h"), lines.alias("lines"))
    out = out.select("doc_id", "t", "w", "lines", F.coalesce(F.size(F.array_distinct("h")) < F.size("h"), F.lit(False)).alias("again"))
    windows = F.transform(index, lambda i: F.struct(F.array_join(F.slice("w", i, WINDOW), " ").alias("s"), i.alias("i")))
    out = out.select("*", F.when(F.col("again"), F.sort_array(windows)).alias("s"))
    same = lambda x, k: (x["s"] == F.get("s", k - 1)["s"]) | (x["s"] == F.get("s", k + 1)["s"])
    twice = F.filter("s", lambda x, k: F.coalesce(same(x, k), x["s"] == F.get("s", k + 1)["s"], x["s"] == F.get("s", k - 1)["s"], F.lit(False)))
    out = out.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("starts"))
    shouted = F.regexp_count("t", F.lit(r"(?<![^\x20\x09-\x0D])" + 2 * r"[^\x20\x09-\x0D\p{Ll}\p{Lu}]*+\p{Lu}" + r"[^\x20\x09-\x0D\p{Ll}]*+(?![^\x20\x09-\x0D])"))
    runs = F.regexp_count("t", F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?=[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D]))"))
    long = {
        "n_words": F.size("w"),
        "word_chars": F.char_length(F.array_join("w", "")),
        "n_symbols": F.regexp_count("t", F.lit(r"[#*$%&|<>]")),
        "n_text_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(_covered(F.col("starts")), F.lit(0)),
        "n_shouted": shouted,
        "n_run_words": runs,
    }
    return out.select("doc_id", *[c.cast("long").alias(n) for n, c in long.items()])


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements with ``fail_bits``: bit k is set where rule k fails."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules))
    return measured.withColumn("fail_bits", bits)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    by = {r.name: r.bit for r in rules}
    return sum(1 << by[n] for n in {*policy.rules})


def apply_policy(entries: DataFrame, policy: Policy, name: str = "kept", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``name``: true where no rule of the policy failed."""
    return entries.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """version, rule, n_docs, n_failed (the rule), n_rejected (by the policy), n_only (rejected by this rule alone:
    what dropping it would keep), n_added (kept by the policy, but rejected if the rule joined it)."""
    counts = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    plan = [(p.version, r.name, mask(p, rules), 1 << r.bit) for p in policies for r in rules]
    total = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).cast("long")
    exploded = counts.select("*", F.explode(F.array(*[F.struct(*(F.lit(v).alias(k) for k, v in zip(("version", "rule", "m", "bit"), row, strict=True))) for row in plan])).alias("p")).select("n", "fail_bits", "p.*")
    failed, rejected = F.col("fail_bits").bitwiseAND(F.col("bit").cast("long")) != 0, F.col("fail_bits").bitwiseAND(F.col("m").cast("long"))
    return exploded.groupBy("version", "rule").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_docs"),
        total(failed).alias("n_failed"),
        total(rejected != 0).alias("n_rejected"),
        total(rejected == F.col("bit").cast("long")).alias("n_only"),
        total((rejected == 0) & failed).alias("n_added"),
    )


def judge(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """Measurements, fail_bits, base_failed and kept (false if the base fails, else by the policy)."""
    out = apply_policy(apply_policy(ledger(measure(docs)), policy, "kept"), BASE, "base_kept")
    return out.withColumn("base_failed", ~F.col("base_kept")).withColumn("kept", F.col("kept") & F.col("base_kept")).drop("base_kept")

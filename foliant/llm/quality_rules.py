"""Quality rules as a ledger: each rule is evaluated once and sets one bit; policies are masks over the bits."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import pinned

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
#: Rules in the order of their bits. Percentages are compared in whole numbers.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "capitals": "100 * n_upper > 40 * word_chars",
    "exclamations": "100 * n_exclaims > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "ellipses": "100 * n_ellipsis_lines > 30 * n_lines",
    "bullets": "100 * n_bullet_lines > 90 * n_lines",
    "stutters": "100 * n_stutters > 20 * n_words",
}
#: Rules of each version of the policy.
POLICIES: dict[str, tuple[str, ...]] = {"base": ("few_words", "repeated_windows"), "v1": tuple(RULES)}
#: Changes with the rules: their names, order and bounds.
VERSION = f"{zlib.crc32(repr(list(RULES.items())).encode()):08x}"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims", "n_ellipsis_lines", "n_bullet_lines", "n_stutters")


def mask(policy: str | tuple[str, ...]) -> int:
    """Bits of a policy's rules."""
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << list(RULES).index(r) for r in rules)


def _pairwise(h: Column, by: int) -> Column:
    """Hash of each element with the one ``by`` places on."""
    n = F.greatest(F.size(h) - by, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements of ``MEASURES`` (long), without a shuffle.

    Windows of eight words are hashed by doubling. Only documents with an equal pair of hashes sort them, with
    their positions, and add up what the equal ones cover: never quadratic, however long a text is.
    """
    own = [c for c in docs.columns if c not in MEASURES]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(*own, text.alias("__t"))
    out = out.withColumn("__w", F.filter(F.split("__t", SPACE, -1), lambda w: w != ""))
    out = out.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    out = out.withColumn("__h1", F.transform("__w", lambda w: F.xxhash64(w)))
    out = out.withColumn("__h2", _pairwise(F.col("__h1"), 1))
    out = out.withColumn("__h4", _pairwise(F.col("__h2"), 2))
    out = out.withColumn("__h8", _pairwise(F.col("__h4"), 4))
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__h8")) < F.size("__h8"), F.sort_array(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, k: F.get("__s", k - 1)["h"].eqNullSafe(e["h"]) | F.get("__s", k + 1)["h"].eqNullSafe(e["h"])
    out = out.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.transform(F.filter("__s", same), lambda e: e["i"]))))
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    measured = {
        "n_words": pinned(F.size("__w")),
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": F.regexp_count("__t", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.when(F.col("__p").isNull(), 0).otherwise(covered),
        "n_lines": F.size("__l"),
        "n_upper": F.regexp_count("__t", F.lit("\\p{Lu}")),
        "n_exclaims": F.regexp_count("__t", F.lit("!")),
        "n_ellipsis_lines": F.size(F.filter("__l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        "n_stutters": F.size(F.filter(F.zip_with(F.slice("__h1", 1, F.greatest(F.size("__h1") - 1, F.lit(0))), F.slice("__h1", 2, F.greatest(F.size("__h1") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)),
        "n_bullet_lines": F.size(F.filter("__l", lambda x: x.rlike("^\\s*[-*•‣]\\s"))),
    }
    return out.select(*own, *[v.cast("long").alias(k) for k, v in measured.items()])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its measurements, ``failed_bits`` (long) and ``rules_version``: bit k is set if rule k of ``RULES`` fails.

    Null text counts as empty, and so fails ``few_words``. Columns of ``docs`` named as what is added are replaced. Each row is measured by itself, rows that repeat
    alike; an empty table gives no rows. Texts of any length are read whole, in time that grows with n log n of their words at most.
    """
    bits = " + ".join(f"(case when {rule} then {1 << k} else 0 end)" for k, rule in enumerate(RULES.values()))
    return measure(docs.drop("failed_bits", "rules_version"), text_col).withColumn("failed_bits", F.expr(bits).cast("long")).withColumn("rules_version", F.lit(VERSION))


def store(entries: DataFrame, path: str) -> DataFrame:
    """Write a ledger, measured once, as a table that policies are applied to; the table."""
    entries.write.parquet(path)
    return entries.sparkSession.read.schema(entries.schema).parquet(path)


def _bits() -> Column:
    """A row's failed bits; those of other rules are an error."""
    return F.when(F.col("rules_version") == VERSION, F.col("failed_bits")).otherwise(F.raise_error(F.lit("the ledger was measured by other rules")).cast("long"))


def judge(entries: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` under a policy, to which the base rules always belong; no rule is evaluated again.

    Null texts, repeated rows and empty tables are as ``ledger`` says. Raises if the ledger is of another version of the rules.
    """
    base, wanted = mask("base"), mask(policy) | mask("base")
    return entries.withColumn("base_failed", _bits().bitwiseAND(F.lit(base)) != 0).withColumn("kept", _bits().bitwiseAND(F.lit(wanted)) == 0)


def ablation(entries: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """For each rule of a policy and the base: ``rule, n_failed, n_failed_alone, n_kept_without``, rows that fail it, that fail it alone, and that are kept without it.

    One aggregation over the bits. An empty ledger gives zeros.
    """
    wanted = mask(policy) | mask("base")
    failed = F.col("__failed")
    counts = []
    names = [r for r in RULES if mask((r,)) & wanted]
    for r in names:
        bit = mask((r,))
        counts += [F.count_if(failed.bitwiseAND(F.lit(bit)) != 0).alias(f"{r}_f"), F.count_if(failed == bit).alias(f"{r}_a"), F.count_if(failed.bitwiseAND(F.lit(wanted & ~bit)) == 0).alias(f"{r}_k")]
    row = entries.select(_bits().bitwiseAND(F.lit(wanted)).alias("__failed")).agg(*counts)
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_f").alias("n_failed"), F.col(f"{r}_a").alias("n_failed_alone"), F.col(f"{r}_k").alias("n_kept_without")) for r in names])).alias("x")).select("x.*")

"""Quality rules kept as a ledger of failure bits and measurements.

``ledger`` evaluates every rule once and stores one bit a failed rule beside
the measurements.  A policy is a named version: a set of rules, as a mask.
Applying one is ``bits & mask = 0``; comparing policies and leaving rules out
need no text any more, only the counts of the different bit patterns.

Everything is DataFrame expressions.  Words are runs of bytes other than space
and 0x09-0x0D.  Equal 8-word windows are found by 64-bit hashes of 8 words:
only a text whose hashes are not all different sorts them with their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\v\f\r"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")
#: Rule by bit: name and failure, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("upper_case", "100 * n_upper > 40 * word_chars"),
    ("exclamations", "100 * n_exclaims > 30 * n_words"),
)
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "repeated_lines"),
    "v2": tuple(name for name, _ in RULES),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _pairs(hashes: Column) -> Column:
    """Hashes of neighbouring elements; one element fewer."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _skip(hashes: Column, by: int) -> Column:
    """Hashes of elements ``by`` apart; ``by`` elements fewer."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame, text: Column) -> DataFrame:
    """The table with a struct ``__ow`` of the measurements of ``text``.

    Lower-case names with two underscores before them are free for the steps.
    """
    t = F.col("__ow_text")
    out = docs.withColumn("__ow_text", F.coalesce(text.cast("string"), F.lit("")))
    trimmed = F.btrim(t, F.lit(SPACES))
    out = out.withColumn("__ow_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    words = F.col("__ow_words")
    out = out.withColumn("__ow_pairs", _pairs(F.transform(words, lambda w: F.xxhash64(w))))
    out = out.withColumn("__ow_fours", _skip(F.col("__ow_pairs"), 2))
    out = out.withColumn("__ow_eights", _skip(F.col("__ow_fours"), 4))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumn("__ow_lines", lines)
    eights = F.col("__ow_eights")
    twice = F.size(F.array_distinct(eights)) < F.size(eights)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("__ow_sorted", F.when(twice, F.sort_array(F.transform(eights, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    s = F.col("__ow_sorted")
    less = F.greatest(F.size(s) - 1, F.lit(0))
    same = F.zip_with(F.slice(s, F.lit(1), less), F.slice(s, F.lit(2), less), lambda a, b: a["h"] == b["h"])
    out = out.withColumn("__ow_same", same)
    no = F.array(F.lit(False))
    before, after = F.concat(no, F.col("__ow_same")), F.concat(F.col("__ow_same"), no)
    hit = F.zip_with(s, F.zip_with(before, after, lambda a, b: a | b), lambda x, y: F.when(y, x["i"]))
    out = out.withColumn("__ow_hit", F.when(F.size(s) > 0, F.sort_array(F.array_compact(hit))).otherwise(F.array().cast("array<int>")))
    hits = F.col("__ow_hit")
    fewer = F.greatest(F.size(hits) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(hits, F.lit(1), fewer), F.slice(hits, F.lit(2), fewer), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    repeats = F.when(F.size(hits) > 0, F.aggregate(gaps, _long(WINDOW), lambda a, b: a + b)).otherwise(_long(0))
    long = lambda c: c.cast("long")
    gone = lambda chars: long(F.length(t) - F.length(F.translate(t, chars, "")))
    values = {
        "n_words": long(F.size(words)),
        "word_chars": long(F.length(F.translate(t, SPACES, ""))),
        "n_symbols": gone("#*$%&|<>"),
        "n_dup_lines": long(F.size("__ow_lines") - F.size(F.array_distinct("__ow_lines"))),
        "n_repeat_words": repeats,
        "n_lines": long(F.size("__ow_lines")),
        "n_upper": gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_exclaims": gone("!"),
    }
    # a later filter would be pushed through all these projections, and repeat each in the one above;
    # it stops at a projection that holds something not deterministic
    out = out.withColumns({"__ow": F.struct(*(values[m].alias(m) for m in MEASURES)), "__ow_at": F.monotonically_increasing_id()})
    out = out.withColumn("__ow", F.when(F.col("__ow_at") >= 0, F.col("__ow")))
    return out.drop("__ow_at", "__ow_text", "__ow_words", "__ow_pairs", "__ow_fours", "__ow_eights", "__ow_lines", "__ow_sorted", "__ow_same", "__ow_hit")


def _bits(measures: str) -> Column:
    import re

    names = re.compile(r"\b(" + "|".join(MEASURES) + r")\b")
    failed = (F.when(F.expr(names.sub(rf"{measures}.\1", rule)), _long(1 << k)).otherwise(_long(0)) for k, (_, rule) in enumerate(RULES))
    return sum(failed, _long(0))


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, the measurements, bits), one a document.

    A null text has no words.  Rows with equal or null ids are kept apart; other
    columns are ignored; an empty table stays empty.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return measured(rows, F.col("text")).select("doc_id", "__ow.*", _bits("__ow").alias("bits"))


def with_policy(table: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and, by the policy, ``kept``."""
    base = F.col("bits").bitwiseAND(_long(mask("base"))) != 0
    return table.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("bits").bitwiseAND(_long(mask(policy))) == 0))


def ablations(table: DataFrame) -> DataFrame:
    """What each policy rejects, and what it would keep without one rule.

    Rows (policy, rule, failed, rejected, only_by_rule): documents failing the
    rule, documents the policy rejects, and those that only this rule rejects.
    The ledger is counted by bit pattern first; there are at most 2 ** rules.
    """
    patterns = table.groupBy("bits").agg(F.count("*").alias("n"))
    names = [name for name, _ in RULES]
    plan = [(p, r, mask(p), 1 << names.index(r)) for p in POLICIES for r in POLICIES[p]]
    plan = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), _long(m).alias("m"), _long(b).alias("b")) for p, r, m, b in plan)))
    rows = patterns.select("bits", "n", plan.alias("x")).select("bits", "n", "x.*")
    hit, only = F.col("bits").bitwiseAND(F.col("m")), F.col("b")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(_long(0)))
    return rows.groupBy("policy", "rule").agg(count(F.col("bits").bitwiseAND(only) != 0).alias("failed"), count(hit != 0).alias("rejected"), count(hit == only).alias("only_by_rule"))


def accepted(docs: DataFrame, policy: str = CURRENT, text_column: str = "text") -> DataFrame:
    """The rows, all their columns as they are, that the policy keeps."""
    columns = docs.columns
    kept = measured(docs, F.col(f"`{text_column}`")).where(_bits("__ow").bitwiseAND(_long(mask(policy) | mask("base"))) == 0)
    return kept.select(*(F.col(f"`{c}`") for c in columns))

"""Operator 9: quality rules in a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once for each document; the ledger stores the
measurements and a long with a bit for each rule that fails. A policy
is a named mask of rules, so a new version of a policy, or its ablations, read the ledger
and not the texts.

Defined results: null or word-less text has zero of everything and fails by its
word count; repeated rows give a row each; an empty table gives none. Windows
of words are compared by XXH64, within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfuse.llm import common

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits: name -> the condition on the measurements under which a document fails.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "symbols": "100 * n_symbols > 15 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "shouting": "100 * n_marks > 50 * n_words",
}
#: Versions of the policy: the rules that reject a document.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "long_words", "short_words", "symbols"],
    "v2": list(RULES),
}


def mask(rules: list[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""

    def covered(places: Column) -> Column:
        widths = F.transform(places, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1), x + 3) - x))
        return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

    def places(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, i: F.coalesce(x.k == F.get(pairs, i - 1).k, F.lit(False)) | F.coalesce(x.k == F.get(pairs, i + 1).k, F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x.i))

    def count(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(let(pairs, places), covered))

    keys = F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(keys, count)


def measure(documents: DataFrame) -> DataFrame:
    """(doc_id, m): m has every measurement of the whole text."""
    text = F.coalesce("text", F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeat_words(words, n).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return common.as_table(documents, "doc_id", "text").select(
        "doc_id",
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_marks"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_marks")


def ledger(documents: DataFrame) -> DataFrame:
    """Measurements and fail_bits of each document."""
    bits = " | ".join(f"CASE WHEN {rule} THEN {1 << i}L ELSE 0L END" for i, rule in enumerate(RULES.values()))
    return measure(documents).withColumn("fail_bits", F.expr(bits))


def apply_policy(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept under a version of the policy."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[p]))) != 0
    return entries.withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(policy))


def ablations(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that fail nothing else, which the policy would keep without it.

    One pass over the ledger groups by its bits (at most 2**rules rows); the rest is on those.
    """
    bits = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[policy]])
    return bits.select("bits", "n", F.inline(rules)).groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, n_failed, n_only) of the latest policy over all documents."""
    return ablations(ledger(common.read(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_policy(ledger(common.read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: [words[i], words[i + 1], words[i + 2]])) AS k FROM w),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(text) - length(replace(text, '!', '')) AS n_marks
      FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars > 15 * n_words)::BIGINT
             + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (100 * n_symbols > 15 * n_words)::BIGINT
             + 32 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 64 * (100 * n_marks > 50 * n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

ABLATIONS_SQL = f"""
WITH r(rule, bit) AS (VALUES {", ".join(f"('{name}', {1 << i}::BIGINT)" for i, name in enumerate(RULES))})
SELECT rule, sum((fail_bits & bit <> 0)::INT)::BIGINT AS n_failed, sum((fail_bits = bit)::INT)::BIGINT AS n_only FROM ({OP9_SQL}) CROSS JOIN r GROUP BY rule
"""

"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected per stratum.

For every stratum (language) and rule, the labelled good documents are a holdout. A cutoff is
admissible if an exact binomial test shows that it rejects at most ``max_loss / rules`` of the good
documents; the level is divided by the number of tests (strata x rules x cutoffs, Bonferroni), so
with confidence 1 - ``error`` all chosen cutoffs hold at once, and by the union bound a stratum
loses at most ``max_loss``. The strictest admissible cutoff is used; without one the rule is off.

Everything is a DataFrame expression. Texts are read once: their counts are stored, and both the
holdout and the verdict are made from the counts.

Defined results: a null or empty text has no words and fails the base rule. A document without
label takes no part in the holdout; several labels for an id count as the lowest one. All labelled good
documents are the holdout, every language is a stratum, and null languages form one of their own. Without
labels no cutoff is admissible and the base rule alone decides. Repeated rows are judged each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pedalgrid.llm.common import BLANKS, keyed_rows
from pedalgrid.session import cut_lineage

#: Share of good documents that a stratum may lose, and the chance that this fails.
MAX_LOSS, ERROR = 0.02, 0.05
#: The stratum of null languages.
POOLED = "*"

#: Candidate cutoffs, strictest first; a document above the cutoff is rejected.
RULES = {
    "symbols_per_word": [0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8, 1.2],
    "chars_per_word": [7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0, 30.0],
    "dup_line_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7],
    "repeat_word_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
}


def _repeated_windows(words: str, n: str) -> Column:
    """Sorted array of (hash, position) in one long each: high bits hash, low bits position."""
    return F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.col(n) - 3),
            lambda i: F.xxhash64(F.col(words)[i], F.col(words)[i + 1], F.col(words)[i + 2])
            .bitwiseAND(F.col("_high"))
            .bitwiseOR(i.cast("long")),
        )
    )


def text_counts(docs: DataFrame) -> DataFrame:
    """Rows of (k1, k2, row) with the counts of the base rule as further columns.

    The windows of a text are hashed and sorted inside its row; positions take as many low bits as
    the text needs, the hash keeps the rest.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    trimmed = F.btrim("_text", F.lit(BLANKS))
    same = lambda a, b: a.bitwiseXOR(b).bitwiseAND(F.col("_high")) == 0
    found = lambda x, i: (
        ((i > 0) & same(x, F.get("_windows", i - 1)))
        | ((i < F.size("_windows") - 1) & same(x, F.get("_windows", i + 1)))
    )
    at = lambda x: x.bitwiseAND(F.bitwise_not("_high"))
    return (
        keyed_rows(docs)
        .withColumn("_text", text)
        .withColumn("_words", F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
        .withColumn("_blank", trimmed == "")
        .withColumn("_n", F.when(F.col("_blank"), 0).otherwise(F.size("_words")))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
        .withColumn("_high", F.lit(-1).cast("long") * F.pow(F.lit(2), F.ceil(F.log2(F.col("_n") + 2))).cast("long"))
        .withColumn("_windows", F.when(F.col("_n") >= 4, _repeated_windows("_words", "_n")))
        .withColumn("_again", F.when(F.col("_n") >= 4, F.filter("_windows", found)))
        .select(
            "k1",
            "k2",
            "row",
            F.col("_n").cast("long").alias("n_words"),
            F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
            (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.coalesce(F.size("_again"), F.lit(0)) <= 0, 0)
            .otherwise(
                F.size(
                    F.array_distinct(
                        F.flatten(F.transform("_again", lambda x: F.array(at(x), at(x) + 1, at(x) + 2)))
                    )
                )
            )
            .cast("long")
            .alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("_n_lines"),
        )
    )


def with_values(counts: DataFrame) -> DataFrame:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns(
        {
            "symbols_per_word": per_word("n_symbols"),
            "chars_per_word": per_word("word_chars"),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
            "repeat_word_share": per_word("n_repeat_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) for success rate ``p`` and k up to n * p, term by term: the logarithm of a term, and the
    sum so far as a multiple of it, so that nothing underflows however large n is."""
    odds = lambda i: (n - i + 1) / i * F.lit(p / (1 - p))
    step = lambda acc, i: F.struct(
        (acc["log"] + F.log(odds(i))).alias("log"),
        (acc["sum"] / odds(i) + 1).alias("sum"),
    )
    none = F.struct((n * F.lit(math.log1p(-p))).alias("log"), F.lit(1.0).alias("sum"))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, none, step, lambda acc: F.exp(acc["log"]) * acc["sum"])


def cutoffs(values: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS, error: float = ERROR) -> DataFrame:
    """One row per stratum: ``stratum`` and, per rule, the chosen cutoff (null: the rule is off).

    At most a row per language and one more, whatever the number of documents.
    """
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q")).filter("_q = 1")
    held = (
        values.select("doc_id", "lang", "base_failed", *RULES)
        .filter(~F.col("base_failed"))
        .join(good, F.col("doc_id") == F.col("_id"))
    )
    named = held.withColumn("stratum", F.coalesce("lang", F.lit(POOLED)))
    bins = [
        F.struct(
            F.lit(rule).alias("rule"),
            sum((F.col(rule) > F.lit(float(c))).cast("int") for c in grid).alias("passed"),
        )
        for rule, grid in RULES.items()
    ]
    histogram = (
        named.select("stratum", F.explode(F.array(*bins)).alias("b"))
        .groupBy("stratum", "b.rule", "b.passed")
        .agg(F.count("*").alias("n"))
    )
    grid = F.explode(
        F.array(
            *(
                F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.lit(j).alias("j"))
                for rule, cs in RULES.items()
                for j, c in enumerate(cs)
            )
        )
    )
    per = histogram.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("passed", "n")).alias("bins")
    )
    tests = (
        per.select("stratum", "rule", "n", "bins", grid.alias("g"))
        .filter(F.col("rule") == F.col("g.rule"))
        .withColumn(
            "k",
            F.aggregate(
                F.filter("bins", lambda b: b["passed"] > F.col("g.j")),
                F.lit(0).cast("long"),
                lambda acc, b: acc + b["n"],
            ),
        )
    )
    loss = max_loss / len(RULES)
    count = sum(len(c) for c in RULES.values())
    strata = F.count("*").over(W.partitionBy("rule", "g.j"))  # one row per stratum there
    tested = tests.withColumn("_level", F.lit(error / count) / strata).withColumn(
        "_risk", F.when(F.col("k") < F.col("n") * loss, binomial_tail(F.col("k"), F.col("n"), loss))
    )
    return (
        tested.filter(F.col("_risk") <= F.col("_level"))
        .groupBy("stratum")
        .agg(*(F.min(F.when(F.col("rule") == r, F.col("g.cutoff"))).alias(f"cut_{r}") for r in RULES))
    )


def judged(values: DataFrame, chosen: DataFrame) -> DataFrame:
    """``values`` with ``kept``. ``chosen`` comes from :func:`cutoffs`; a stratum that is not in it has all rules off."""
    known = values.join(chosen, F.coalesce("lang", F.lit(POOLED)) == F.col("stratum"), "left")
    fails = F.lit(False)
    for r in RULES:
        fails = fails | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return known.withColumn("kept", ~F.col("base_failed") & ~fails)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """k1, k2, doc_id, the counts, base_failed and kept, one row per row of ``docs``."""
    counts = with_values(text_counts(docs)).select(
        "k1", "k2", F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), *COUNTS, *RULES
    )
    values = cut_lineage(counts, "quality")
    chosen = cut_lineage(cutoffs(values, labels), "cutoffs")
    return judged(values, chosen).select("k1", "k2", "doc_id", *COUNTS, "kept")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, with its own columns."""
    kept = quality_verdicts(docs, labels).filter("kept").select("k1", "k2").dropDuplicates()
    return keyed_rows(docs).join(kept, ["k1", "k2"], "left_semi").select("row.*")


def quality_digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_verdicts(docs, labels).select("doc_id", *COUNTS, "kept")


def _sql() -> str:
    """The same in SQL, the binomial sums by logarithms of factorials."""
    grid = ", ".join(f"('{r}', CAST('{c}' AS DOUBLE))" for r, cs in RULES.items() for c in cs)
    loss = f"CAST('{MAX_LOSS / len(RULES)}' AS DOUBLE)"
    tests = sum(map(len, RULES.values()))
    return f"""
WITH texts AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, i, w[i:i + 2] AS g FROM texts, LATERAL unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)),
again AS (SELECT doc_id, g FROM places GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
  FROM places SEMI JOIN again USING (doc_id, g), unnest([0, 1, 2]) AS v(j) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM texts LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
measured AS (
  SELECT doc_id, coalesce(lang, '{POOLED}') AS stratum, base_failed, rule, value
  FROM (SELECT *, unnest([
      {{'rule': 'symbols_per_word', 'value': n_symbols / greatest(n_words, 1)}},
      {{'rule': 'chars_per_word', 'value': word_chars / greatest(n_words, 1)}},
      {{'rule': 'dup_line_share', 'value': n_dup_lines / greatest(len(lines), 1)}},
      {{'rule': 'repeat_word_share', 'value': n_repeat_words / greatest(n_words, 1)}}], recursive := true) FROM judged)),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
tests AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
  FROM measured SEMI JOIN good USING (doc_id) JOIN (VALUES {grid}) AS c(rule, cutoff) USING (rule)
  WHERE NOT base_failed GROUP BY ALL),
risks AS (
  SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln({loss}) + (n - i) * ln(1 - {loss})))) AS risk,
    {ERROR} / {tests} / (SELECT count(DISTINCT stratum) FROM tests) AS level
  FROM tests WHERE k < n * {loss}),
chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM risks WHERE risk <= level GROUP BY ALL),
failed AS (
  SELECT DISTINCT doc_id FROM measured m JOIN chosen c ON c.rule = m.rule AND c.stratum = m.stratum
  WHERE value > cutoff)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (FROM failed) AS kept
FROM judged
"""


SQL = _sql()

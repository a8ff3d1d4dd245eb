"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that rejects a document. Its cost (time) and selectivity (share rejected) are estimated on a
bounded sample, and the rules are put into one CASE expression in descending order of rejection per cost, so that a
document meets costly rules only if the cheap and selective ones let it pass. The order never changes a verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import BLANKS, SPACE, WORD, let, total, words

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated, and one in how many rows may belong to it.
SAMPLE = 400
SEED = 7
#: Times that a condition is evaluated on each row of the sample; seconds below which costs can't be told apart.
REPEATS = 8
LEAST_COST = 1e-3


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text. Windows are told apart by 64-bit hashes.

    Where no hash occurs twice, which one pass shows, nothing is sorted; otherwise (hash, position) pairs are sorted
    once and equal neighbours looked up, so repetitive and very long texts cost n log n.
    """

    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))).cast("long")))

    def repeated(s: Column) -> Column:
        own = lambda i: F.get(s, i)["h"]
        same = F.filter(s, lambda x, i: F.coalesce(x["h"] == own(i + 1), F.lit(False)) | F.when(i > 0, x["h"] == own(i - 1)).otherwise(False))
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(pairs, repeated), covered))

    def hashes(w: Column) -> Column:
        n = F.size(w)
        return F.transform(F.arrays_zip(w.alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))

    def windows(w: Column) -> Column:
        n = F.size(w)
        return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(F.slice(hashes(w), 1, n - 2), count))

    return let(words(text), windows)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def default_rules(text: Column) -> list[Rule]:
    """The rules over a text column. Thresholds are lenient: prose in any language passes."""
    n = n_words(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return [
        Rule("too_few_words", n < 50),
        Rule("repeated_windows", 100 * n_repeat_words(text) > 50 * n),
        Rule("symbols", 10 * n_symbols(text) > n),
        Rule("word_length", (word_chars(text) < 2 * n) | (word_chars(text) > 20 * n)),
        Rule("repeated_lines", 2 * n_dup_lines(text) > F.size(lines(text))),
        Rule("few_letters", 2 * letters < word_chars(text)),
        Rule("bullets", let(lines(text), lambda x: 10 * F.size(F.filter(x, lambda y: y.rlike(rf"^{SPACE}*[-•‣◦●*]"))) > 9 * F.size(x))),
    ]


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About `sample` rows (give or take its root), each of docs' rows with the same odds; all of a smaller table."""
    return docs.sample(min(1.0, sample / max(docs.count(), 1)), seed=SEED)


def measure(rows: DataFrame, rules: list[Rule], repeats: int = REPEATS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) over the rows of a sample, of the conditions as they are.

    Each condition is evaluated `repeats` times on every row, so that its own work shows, once to have it compiled and once
    timed; what a job without a condition takes on the same rows is subtracted. An empty sample gives costs and shares of 0.
    """
    many = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def timed(condition: Column) -> tuple[float, float]:
        job = many.agg(F.avg(F.when(condition, 1.0).otherwise(0.0)))
        job.first()
        began = time.perf_counter()
        share = job.first()[0] or 0.0
        return time.perf_counter() - began, share

    empty = timed(F.col("_copy") < 0)[0]
    return [(rule, max(seconds - empty, 0.0), share) for rule in rules for seconds, share in [timed(rule.rejects)]]


def ordered(rules: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules in descending order of rejection per cost. Costs below LEAST_COST can't be told from none and count as that much."""
    return [r for r, *_ in sorted(rules, key=lambda x: (-x[2] / max(x[1], LEAST_COST), x[1], x[0].name))]


def cascade(rules: list[tuple[Rule, float, float]]) -> Column:
    """The name of the first rule in order that rejects the row, null if none does."""
    out = None
    for rule in ordered(rules):
        out = F.when(rule.rejects, rule.name) if out is None else out.when(rule.rejects, rule.name)
    return out


def rejected_by(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Column:
    """The cascade over docs' text column (null texts count as empty and are rejected), ordered by a sample of docs."""
    rows = sampled(docs.select(text_col), sample).persist()
    try:
        return cascade(measure(rows, default_rules(F.coalesce(F.col(text_col), F.lit("")))))
    finally:
        rows.unpersist()


def keep_good(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects. Repeated rows stay; an empty table stays empty."""
    return docs.filter(rejected_by(docs, text_col, sample).isNull())


def _counted(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "text", n_words(text).alias("n_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(text).alias("n_repeat_words"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts, base_failed and the cascade's verdict for every document.

    The counts are returned anyway, so rules over them are measured, and run, on the counted columns. Null and empty texts have
    no words and fail; repeated rows give rows of their own; an empty table gives none; other columns aren't read.
    """
    from .common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _counted(sampled(docs)).persist()
    try:
        verdict = cascade(measure(rows, [Rule(r.name, _on_counts(r, text)) for r in default_rules(text)]))
    finally:
        rows.unpersist()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return _counted(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict.isNull()).alias("kept"))


def _on_counts(rule: Rule, text: Column) -> Column:
    """A default rule over the counts that the query returns anyway."""
    n = F.col("n_words")
    return {
        "too_few_words": n < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    }.get(rule.name, rule.rejects)


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w),
gram AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM g),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM gram) WHERE c > 1),
spot AS (SELECT DISTINCT r, i + k AS p FROM twice, (SELECT unnest([0, 1, 2]) AS k)),
rep AS (SELECT r, count(*) AS n FROM spot GROUP BY r),
c AS (SELECT doc_id, text, lines, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > len(lines)
  OR 2 * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) < word_chars
  OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-•‣◦●*]'))) > 9 * len(lines)) AS kept
FROM f
"""

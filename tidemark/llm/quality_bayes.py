"""Document quality by hierarchical empirical Bayes.

Evidence. A text classifier, multinomial naive Bayes over hashed words, is fitted on one half of the labelled rows. Its mean
log-likelihood ratio over a document's words, binned, is one of the properties of a text from which a second
naive Bayes, fitted on the other half (the properties that need no fit, on both), gives every document the log of its
likelihood ratio: words of a document aren't independent, so their sum would claim far too much. Posteriors. The share of good documents of a host is drawn from a Beta prior around the
global share, that of a path from one around its host's; the strengths of both priors come from the data by the method
of moments, so sparse sites shrink towards what is above them. A document's probability combines its own evidence with
its path's share, computed without the document itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .native import let, words
from .quality_rules import lines, n_dup_lines, n_repeat_words, n_symbols, n_words, word_chars

#: At most so many labelled rows are used for fitting; those with the smallest hashes of their ids.
LABELLED = 20_000
SMOOTHING = 1.0
#: Bounds of the priors' strengths, in documents.
STRENGTH = (1.0, 10_000.0)
BINS = 12
#: Buckets of hashed words; width of a bin of the words' mean log ratio.
BUCKETS = 1 << 12
TOKEN_BIN = 0.05


def _share_bin(part: Column, whole: Column) -> Column:
    """0 for none, then one bin for each halving of the share."""
    share = part / F.greatest(whole, F.lit(1))
    return F.when(part <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(BINS - 1), F.lit(9) + F.floor(F.log2(share)).cast("int"))))


def _doubled(w: Column) -> Column:
    """Words equal to the one before."""
    return F.size(F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: a == b), lambda same: same)).cast("long")


def _counts(text: Column) -> dict[str, Column]:
    """What the properties are made of, each computed once as a column of its own."""
    return {
        "_n": n_words(text), "_chars": word_chars(text), "_sym": n_symbols(text), "_dup": n_dup_lines(text), "_lines": F.size(lines(text)), "_rep": n_repeat_words(text), "_dbl": let(words(text), _doubled),
        "_up": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), "_let": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")),
    }


def _buckets(text: Column) -> Column:
    """The bucket of each word of a text, in lower case."""
    return F.transform(words(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _token_mean(text: Column, ratios: list[float]) -> Column:
    """Mean log ratio of a text's words; null without words or without a fitted classifier."""
    if not ratios:
        return F.lit(None).cast("double")
    table = F.array(*map(F.lit, ratios))
    return let(_buckets(text), lambda b: F.aggregate(b, F.lit(0.0), lambda a, k: a + F.get(table, k)) / F.nullif(F.size(b), F.lit(0)))


def token_ratios(rows: DataFrame, text: Column, label: Column) -> list[float]:
    """Log-likelihood ratio of each bucket of words, good over bad, from labelled rows; empty if a class is missing."""
    seen = rows.select(label.alias("y"), F.explode(_buckets(text)).alias("b")).groupBy("y", "b").count().collect()
    n = {y: {r.b: r["count"] for r in seen if r.y == y} for y in (0, 1)}
    total = {y: sum(n[y].values()) + SMOOTHING * BUCKETS for y in (0, 1)}
    if not n[0] or not n[1]:
        return []
    return [math.log((n[1].get(b, 0) + SMOOTHING) / total[1]) - math.log((n[0].get(b, 0) + SMOOTHING) / total[0]) for b in range(BUCKETS)]


def properties() -> dict[str, Column]:
    """Bins over the columns of _counts()."""
    n, chars, letters = F.col("_n"), F.col("_chars"), F.col("_let")
    return {
        "symbols": _share_bin(F.col("_sym"), n),
        "dup_lines": F.when(F.col("_dup") * 2 > F.col("_lines"), 2).when(F.col("_dup") * 4 > F.col("_lines"), 1).otherwise(0),
        "repeats": _share_bin(F.col("_rep"), n),
        "doubled": _share_bin(F.col("_dbl"), n),
        "upper": F.when(2 * F.col("_up") > letters, 1).otherwise(0),
        "letters": F.when(2 * letters < chars, 1).otherwise(0),
        "word_length": F.when(chars < 2 * n, 1).when(chars > 20 * n, 2).otherwise(0),
        "words": F.coalesce(F.greatest(F.lit(1), F.least(F.lit(BINS - 1), F.floor(F.col("_tok") / TOKEN_BIN).cast("int") + BINS // 2)), F.lit(0)),
    }


def _binned(docs: DataFrame, text_col: str, keep: list[Column], ratios: list[float]) -> tuple[DataFrame, list[str]]:
    """The columns `keep` and one column for each property, under its name and an underscore."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(*(c.alias(f"_k{i}") for i, c in enumerate(keep)), *(c.alias(name) for name, c in (_counts(text) | {"_tok": _token_mean(text, ratios)}).items()))
    names = docs.select(*keep).columns
    bins = properties()
    return counted.select(*(F.col(f"_k{i}").alias(n) for i, n in enumerate(names)), *(c.cast("int").alias(f"_{name}") for name, c in bins.items())), list(bins)


@dataclass(frozen=True)
class Evidence:
    #: Log ratio of each bucket of words; log-likelihood ratio by property and bin; share of good rows.
    tokens: list[float]
    ratio: dict[str, list[float]]
    share: float


def fit_evidence(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED) -> Evidence:
    """What labelled documents teach, at most `most` of them; null labels are left out. The halves are told apart by a hash of the id."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_words"))
    half = F.pmod(F.xxhash64("_id"), F.lit(2)).cast("int")
    rows = materialize(texts.join(known, F.col("_doc") == F.col("_id")).select("_words", "_y", half.alias("_half")), "labelled")
    tokens = token_ratios(rows.filter("_half = 0"), F.coalesce("_words", F.lit("")), F.col("_y"))
    binned, names = _binned(rows, "_words", [F.col("_y"), F.col("_half")], tokens)
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"_{n}").alias("bin")) for n in names))).alias("cell")
    found = binned.select("_y", "_half", cells).filter("cell.name <> 'words' or _half = 1")
    counts = {(r[0], r[1], r[2]): r[3] for r in found.groupBy("cell.name", "cell.bin", "_y").count().collect()}
    total = {(n, y): sum(c for (m, _, k), c in counts.items() if k == y and m == n) for n in names for y in (0, 1)}

    def log_share(n: str, b: int, y: int) -> float:
        return math.log((counts.get((n, b, y), 0) + SMOOTHING) / (total[n, y] + SMOOTHING * BINS))

    good, bad = total[names[0], 1], total[names[0], 0]
    discard(rows)
    return Evidence(tokens, {n: [log_share(n, b, 1) - log_share(n, b, 0) for b in range(BINS)] for n in names}, (good + 1) / (good + bad + 2))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(between: float, freedom: float, spread: float, mean: float) -> float:
    """Strength of a Beta prior by moments: from the weighted squares of groups about their centres."""
    unit = mean * (1 - mean)
    rho = (between - freedom * unit) / (unit * (spread - freedom)) if unit > 0 and spread > freedom else 0.0
    low, high = STRENGTH
    return high if rho <= 1 / (high + 1) else max(low, 1 / rho - 1)


def posterior_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, evidence, host_share, path_share, quality) for every row of docs; quality is the posterior probability.

    Null hosts and paths are sites of their own; null texts are empty texts; repeated rows count each. Without labels all
    evidence is 0 and the shares are one half. Groups are summed before they are shuffled, and what is joined back is one row for each path.
    """
    learned = fit_evidence(docs, labels, id_col, text_col, label_col)
    ratio, share = learned.ratio, learned.share
    keep = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("\0")).alias("host"), F.coalesce(path.cast("string"), F.lit("\0")).alias("path")]
    rows, names = _binned(docs, text_col, keep, learned.tokens)
    evidence = sum((F.get(F.array(*map(F.lit, ratio[n])), F.col(f"_{n}")) for n in names), F.lit(0.0))
    rows = materialize(rows.select("doc_id", "host", "path", evidence.alias("evidence")), "evidence")
    rows = rows.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + math.log(share / (1 - share))))))

    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("n") * F.col("n")).alias("hnn"), F.count("*").alias("hp"))
    t = hosts.agg(F.sum("hn"), F.sum("hs"), F.sum(F.col("hn").cast("double") * F.col("hn")), F.count("*"), F.sum(F.col("hnn") / F.col("hn")), F.sum("hp"), F.sum(F.col("hs") * F.col("hs") / F.col("hn"))).first()
    n, s = float(t[0] or 0), float(t[1] or 0)
    mean = s / n if n else share
    host_strength = _strength((t[6] or 0.0) - n * mean * mean, t[3] - 1, n - (t[2] or 0.0) / max(n, 1), mean)
    squares = paths.agg(F.sum(F.col("s") * F.col("s") / F.col("n"))).first()[0] or 0.0
    path_strength = _strength(squares - (t[6] or 0.0), (t[5] or 0) - t[3], n - (t[4] or 0.0), mean)

    shares = hosts.select("host", "hn", "hs", ((F.col("hs") + host_strength * mean) / (F.col("hn") + host_strength)).alias("host_share"))
    sites = paths.join(shares, "host").select("host", "path", "n", "s", "hn", "hs", "host_share", ((F.col("s") + path_strength * F.col("host_share")) / (F.col("n") + path_strength)).alias("path_share"))
    joined = rows.join(sites, ["host", "path"])
    rest_host = (F.col("hs") - F.col("p") + host_strength * mean) / (F.col("hn") - 1 + host_strength)
    rest = (F.col("s") - F.col("p") + path_strength * rest_host) / (F.col("n") - 1 + path_strength)
    rest = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rest))
    return joined.select("doc_id", "evidence", "host_share", "path_share", (1 / (1 + F.exp(-(F.col("evidence") + _logit(rest))))).alias("quality"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    """The first part of a URL's path."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/", 1)


def op2_quality_bayes(spark, sf_dir: str) -> DataFrame:
    """Every document's quality: its source is the host, its language the path below it.

    Null sources and languages are sites of their own, null texts are empty; repeated rows, repeated and null ids count each and
    give rows of their own; an empty table gives none; other columns aren't read. Texts are read whole.
    """
    from .common import documents

    docs = documents(spark, sf_dir)
    found = posterior_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"))
    return found.select("*", (F.col("quality") >= 0.5).alias("kept"))

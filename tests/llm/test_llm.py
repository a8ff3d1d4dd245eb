"""The text operators against brute force, exact round trips, held-out accuracy and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import catalog, langid, near_copies, packing, pii, quality_bayes, quality_rules, sentencepieces, simhash, spotsigs, substrings, suffix, tokens
from tidemark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = ["", None, "a", "the", "   \n\t ", "é😀", "!!! ??? %%%", "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Edge cases, repeated rows and ids, a null id, and columns whose names clash with those of the operators."""
    data = [(i, t) for i, t in enumerate(EDGES)] + [(3, "the"), (None, "a null id"), (20, "same text twice " * 20), (21, "same text twice " * 20), (21, "same text twice " * 20)]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in data], SCHEMA)
    for c in ("fp", "part", "kind", "data", "key", "root", "rep", "spans", "ids", "p", "host", "_text", "_row", "o", "copy", "component_id"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# --- 1


def test_spotsigs_query(spark, sf, rows):
    got = {r.doc_id: r for r in catalog.queries()["op1_spotsigs"](spark, sf).collect()}
    rows = sorted(rows)
    after = [t for _, t in rows[1:]] + [rows[0][1]]
    assert len(got) == len(rows)
    for (i, t), f in zip(rows, after, strict=True):
        edited = t[: len(t) - len(t) // 4] + f[: len(t) // 4]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(x.tolist()) for x in spotsigs.signatures([t, edited, f]))
        assert set(spotsigs.unpack(r.fingerprint).tolist()) == a and r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)


def test_spotsigs_pairs(docs, spark):
    base = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    more = base + [(1000 + i, t.replace(" the ", " a ", 1)) for i, t in base[:30]] + [(2000, base[0][1])]
    prints = spotsigs.fingerprints(spark.createDataFrame(more, "doc_id long, text string")).persist()
    sets = {}
    for r in prints.orderBy("doc_id").collect():
        sets.setdefault(r.fingerprint, (r.doc_id, set(spotsigs.unpack(r.fingerprint).tolist())))
    reps = [v for k, v in sets.items() if k]
    want = {(min(a, b), max(a, b)) for x, (a, s) in enumerate(reps) for b, t in reps[:x] if len(s & t) >= 0.8 * len(s | t)}
    assert {(r.rep_a, r.rep_b) for r in spotsigs.near_pairs(prints).collect()} == want and want


def test_spotsigs_pairs_with_repeated_and_null_ids(spark):
    words = np.random.default_rng(7).integers(0, 5000, (3, 200))
    a, b, c = (" ".join(f"w{x}" for x in w) for w in words)
    data = [(5, a), (5, a + " more"), (5, b), (None, b + " more"), (None, c), (None, c + " more")]
    got = spotsigs.near_pairs(spotsigs.fingerprints(spark.createDataFrame(data, "doc_id long, text string"))).collect()
    assert collections.Counter((r.rep_a, r.rep_b) for r in got) == collections.Counter([(5, 5), (5, None), (None, None)])


def plain_signatures(text):
    """Chains that follow anchors, each as (words of the chain, how often it was met before), by plain Python."""
    common = set(spotsigs.COMMON)
    words = re.findall("(?:[a-z0-9]|[^\\x00-\\x7f])+", text.lower())
    out, seen = set(), collections.Counter()
    for i in range(len(words)):
        if words[i] in common or not any(w in common for w in words[max(0, i - spotsigs.GAP) : i]):
            chain = (words[i], *[w for w in words[i + 1 :] if w not in common][: spotsigs.CHAIN])
            out.add((chain, seen[chain]))
            seen[chain] += 1
    return out


def test_spotsigs_chains_against_plain_python(rows):
    texts = [t for _, t in rows[:60]] + [t.replace(" the ", " a ") for _, t in rows[:20]] + ["", "the", "the the the", "one two three four five six seven eight nine ten", "Über die Brücke, the 3 élans!", "a b a b a b a b"]
    ours, plain = spotsigs.signatures(texts), [plain_signatures(t) for t in texts]
    assert [len(x) for x in ours] == [len(x) for x in plain]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            a, b = set(ours[i].tolist()), set(ours[j].tolist())
            assert len(a & b) == len(plain[i] & plain[j])


def test_next_documents_of_odd_tables(spark, odd, empty):
    import pyarrow as pa

    def told(ids, texts, after):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts), pa.array(after)], names=["doc_id", "text", "after"])

    schema = "doc_id long, text string, after string"
    got = [tuple(r) for r in spotsigs.with_next(odd, told, schema).collect()]
    order = sorted(((-(10**9) if r.doc_id is None else r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()))
    want = [(None if i == -(10**9) else i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    assert collections.Counter(got) == collections.Counter(want)
    assert spotsigs.with_next(empty, told, schema).count() == 0
    assert [tuple(r) for r in spotsigs.with_next(odd.filter("doc_id = 2"), told, schema).collect()] == [(2, "a", "a")]


def test_spotsigs_edges(odd, empty):
    assert spotsigs.fingerprints(odd).count() == odd.count() and spotsigs.fingerprints(empty).count() == 0


# --- 2


def test_quality_bayes(spark, docs, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality_bayes.posterior_quality(big, labels.filter("doc_id % 2 = 0"), F.col("source"), F.col("lang")).join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("good")), "doc_id")
    rate = out.agg(F.avg(((F.col("quality") >= 0.5).cast("int") == F.col("good")).cast("int"))).first()[0]
    assert rate > 0.93
    found = quality_bayes.posterior_quality(odd, labels, F.col("source"), F.col("lang")).collect()
    assert len(found) == odd.count() and all(0 <= r.quality <= 1 for r in found)
    assert quality_bayes.posterior_quality(empty, labels, F.col("source"), F.col("lang")).count() == 0
    assert quality_bayes.posterior_quality(docs, labels.limit(0), F.col("source"), F.col("lang")).count() == docs.count()
    url = spark.createDataFrame([("HTTPS://u:p@Ex.Com:8080/a/b?c",), (None,), ("nothing",)], "url string")
    assert [tuple(r) for r in url.select(quality_bayes.host_of(F.col("url")), quality_bayes.path_of(F.col("url"))).collect()] == [("ex.com", "a"), (None, None), ("", "")]


def plain_properties(text, tokens_):
    """The bins of a text's properties, by plain Python."""
    w = [x for x in re.split("[ \t-\r]+", text) if x]
    n, k = len(w), quality_bayes.BINS
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeated = len({i + j for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)})
    upper, letters, chars = sum(c.isupper() and c.isalpha() for c in text), sum(c.isalpha() for c in text), sum(map(len, w))

    def share(part):
        return 0 if part <= 0 else max(1, min(k - 1, 9 + int(np.floor(np.log2(part / max(n, 1))))))

    dup = len(lines) - len(set(lines))
    low = [x for x in re.split("[ \t-\r]+", text.lower()) if x]
    mean = np.mean([tokens_[np.int64(np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).view(np.int64)) % quality_bayes.BUCKETS] for x in low]) if low else None
    return {
        "symbols": share(sum(c in quality_rules.SYMBOLS for c in text)), "dup_lines": 2 if dup * 2 > len(lines) else 1 if dup * 4 > len(lines) else 0, "repeats": share(repeated),
        "doubled": share(sum(a == b for a, b in zip(w, w[1:], strict=False))), "upper": int(2 * upper > letters), "letters": int(2 * letters < chars), "word_length": 1 if chars < 2 * n else 2 if chars > 20 * n else 0,
        "words": 0 if mean is None else max(1, min(k - 1, int(np.floor(mean / quality_bayes.TOKEN_BIN)) + k // 2)),
    }


def test_posterior_against_plain_python(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    text, good = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    half = {i: np.int64(np.uint64(xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)).view(np.int64)) % 2 for i in good}
    seen = {0: collections.Counter(), 1: collections.Counter()}
    for i, y in good.items():
        if half[i] == 0 and i in text:
            seen[y].update(int(np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).view(np.int64) % quality_bayes.BUCKETS) for x in re.split("[ \t-\r]+", (text[i].text or "").lower()) if x)
    size = {y: sum(seen[y].values()) + quality_bayes.BUCKETS for y in (0, 1)}
    tokens_ = [np.log((seen[1][b] + 1) / size[1]) - np.log((seen[0][b] + 1) / size[0]) for b in range(quality_bayes.BUCKETS)]
    bins = {i: plain_properties(r.text or "", tokens_) for i, r in text.items()}
    names, count = list(next(iter(bins.values()))), collections.Counter()
    for i, y in good.items():
        if i in text:
            count.update((n, bins[i][n], y) for n in names if n != "words" or half[i] == 1)
    total = {(n, y): sum(c for (m, _, k), c in count.items() if (m, k) == (n, y)) for n in names for y in (0, 1)}
    share = (total["symbols", 1] + 1) / (total["symbols", 0] + total["symbols", 1] + 2)
    evidence = {i: sum(np.log((count[n, b[n], 1] + 1) / (total[n, 1] + 12)) - np.log((count[n, b[n], 0] + 1) / (total[n, 0] + 12)) for n in names) for i, b in bins.items()}
    p = {i: 1 / (1 + np.exp(-(e + np.log(share / (1 - share))))) for i, e in evidence.items()}
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for i, r in text.items():
        hosts[r.source].append(p[i])
        paths[r.source, r.lang].append(p[i])
    every, mean = len(p), np.mean(list(p.values()))

    def strength(groups, centre, outer):
        squares = sum(len(g) * np.mean(g) ** 2 for g in groups.values()) - sum(len(g) * np.mean(g) ** 2 for g in outer.values())
        spread, freedom = every - sum(len(g) ** 2 / len(centre(k)) for k, g in groups.items()), len(groups) - len(outer)
        rho = (squares - freedom * mean * (1 - mean)) / (mean * (1 - mean) * (spread - freedom))
        low, high = quality_bayes.STRENGTH
        return high if rho <= 1 / (high + 1) else max(low, 1 / rho - 1)

    sh, sp = strength(hosts, lambda k: range(every), {0: list(p.values())}), strength(paths, lambda k: hosts[k[0]], hosts)
    for r in quality_bayes.posterior_quality(docs, labels, F.col("source"), F.col("lang")).collect():
        h, q, own = hosts[text[r.doc_id].source], paths[text[r.doc_id].source, text[r.doc_id].lang], p[r.doc_id]
        host_rest = (sum(h) - own + sh * mean) / (len(h) - 1 + sh)
        rest = min(max((sum(q) - own + sp * host_rest) / (len(q) - 1 + sp), 1e-6), 1 - 1e-6)
        want = 1 / (1 + np.exp(-(evidence[r.doc_id] + np.log(rest / (1 - rest)))))
        assert (r.evidence, r.quality) == (pytest.approx(evidence[r.doc_id], abs=1e-9), pytest.approx(want, abs=1e-6))


def test_shrinkage(spark):
    texts = [(i, "plain words in a line " * 12, "big", "a") for i in range(200)] + [(900, "plain words in a line " * 12, "tiny", "b")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    r = {x.doc_id: x for x in quality_bayes.posterior_quality(df, labels, F.col("source"), F.col("lang")).collect()}
    assert abs(r[900].host_share - r[0].host_share) < 0.05


# --- 3

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


HARD = ["a@b.com_x@c.de y@z@w.org 1.2.3.4.5.6 999.1.1.1 4111 1111 1111 1111 call +1 (555) 123-4567, +49-30-1234567. iban DE89 3704 0044 0532 0130 00 ok. ssn 123-45-6789 é😀 q@r.st", "9" * 20000 + " " + "a" * 20000 + "@" + "b." * 5000 + "c", "x@y.zz +12 345678901 " * 300]


def test_pii(spark, docs, odd, empty):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    for r in pii.find(df, ["doc_id", "text"]).select("text", pii.listed(F.col("base_spans")).alias("b"), pii.listed(F.col("spans")).alias("s")).collect():
        assert r.b == base_spans(r.text)
        assert set(r.b.split(",")) <= set(r.s.split(","))
    hard = pii.find(df.filter("doc_id = 10000"), ["doc_id"]).select(pii.listed(F.col("spans"))).first()[0]
    assert "iban:112:139" in hard and "national:148:159" in hard
    assert "national" not in (pii.find(spark.createDataFrame([(1, "code 123-45-6789 here")], "doc_id long, text string"), []).select(pii.listed(F.col("spans"))).first()[0])
    out = {r.doc_id: r.text for r in pii.redact(df.filter("doc_id >= 10000")).collect()}
    assert out[10000].startswith("<EMAIL><EMAIL> y@<EMAIL> <IP>.5.6 999.1.1.1 4111") and out[10002] == "<EMAIL> <PHONE> " * 300
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count() and pii.redact(empty).count() == 0
    assert clean.filter("doc_id = 1").first().text is None


def test_iban_before_capitals_and_digits(spark):
    a, b, c = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947"
    cases = [(f"{a} Please pay", [a]), (f"{b} The account", [b]), (f"{b} AND more", [b]), (f"{a} 2024", [a]), (f"{b} 2024", [b]), (f"AB12 {b} X", [b]), (f"to {c} BE68539007547034 {a} GB29 NWBK 6016 1331 9268 19 A", [c, "BE68539007547034", a, "GB29 NWBK 6016 1331 9268 19"]), (f"{a}x", []), (f"{b}A", []), (f"x{a} A", []), ("DE89 3704 0044 0532 0130 01 A", []), (f"{b}.", [b]), (a, [a])]
    got = pii.find(spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string"), ["doc_id", "text"]).select("doc_id", "text", "spans").collect()
    for r in got:
        assert [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] == cases[r.doc_id][1], r.text
    assert pii.redact(spark.createDataFrame([(1, f"pay {b} The end")], "doc_id long, text string")).first().text == "pay <IBAN> The end"


def test_account_numbers_in_all_spellings(spark):
    """Lower case, hyphens and no-break blanks, with words of either case after them; random words are no number."""
    plain = ["DE89370400440532013000", "GB29NWBK60161331926819", "NO9386011117947"]
    cases = []
    for gap in ("", " ", "-", "\u00a0", "\u202f"):
        for n in plain:
            spelled = gap.join(n[i : i + 4] for i in range(0, len(n), 4))
            cases += [(f"x {form} {after}", form) for form in (spelled, spelled.lower()) for after in ("please pay", "Now", "2024", "")]
    cases += [("ab12 some words here and there that go on", None), ("de89 3704 0044 0532 0130 01 no", None)]
    got = pii.find(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string"), ["doc_id", "text"]).collect()
    for r in got:
        assert [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] == ([cases[r.doc_id][1]] if cases[r.doc_id][1] else []), r.text


# --- 4


def test_quality_rules(spark, sf, docs, odd, empty):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    ours = sorted(map(tuple, catalog.queries()["op4_quality_rules"](spark, sf).collect()))
    assert ours == sorted(c.execute(quality_rules.OP4_SQL).fetchall())
    assert quality_rules.keep_good(empty).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null or doc_id < 20").count() == 0
    rules = quality_rules.measure(quality_rules.sampled(docs.select("text"), 50), quality_rules.default_rules(F.coalesce(F.col("text"), F.lit(""))))
    assert docs.filter(quality_rules.cascade(rules).isNull()).count() == docs.filter(quality_rules.cascade([(r, c, -s) for r, c, s in rules]).isNull()).count()


def test_rules_are_ordered_by_rejection_per_cost(docs):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = quality_rules.sampled(docs.select("text"), 100).persist()
    assert 0 < rows.count() < docs.count()
    costly = quality_rules.Rule("costly", quality_rules.n_repeat_words(F.concat(text, F.lit(" "), F.reverse(text))) >= 0)
    cheap, idle = quality_rules.Rule("cheap", F.length(text) >= 0), quality_rules.Rule("idle", F.length(text) < 0)
    found = quality_rules.measure(rows, [costly, idle, cheap])
    assert [r.name for r in quality_rules.ordered(found)] == ["cheap", "costly", "idle"] and found[0][1] > 3 * found[2][1]
    assert {r.name: s for r, _, s in found} == {"costly": 1.0, "idle": 0.0, "cheap": 1.0}
    assert quality_rules.measure(rows.limit(0), [cheap])[0][2] == 0


# --- 5


def test_packing(spark, sf, docs, odd, empty):
    encode = tokens.encoder()
    ids = {r.doc_id: np.append(encode(r.text), 0).astype("<u4") for r in docs.collect()}
    out = catalog.queries()["op5_packing"](spark, sf).toPandas()
    for doc, g in out.sort_values("start").groupby("doc_id"):
        assert (g.length.cumsum() - g.length).tolist() == g.start.tolist() and g.length.sum() == len(ids[doc]) == g.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[doc][s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))
    g = out.sort_values("offset").groupby("sequence_id")
    assert all((x.length.cumsum() - x.length).tolist() == x.offset.tolist() for _, x in g)
    size = g.length.sum()
    assert size.max() <= 1024 and sum(0 if n & (n - 1) == 0 else 1024 - n for n in size) < 0.01 * size.sum()
    assert packing.pack(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count() and packing.pack(empty).count() == 0


def test_packing_limits(spark):
    df = spark.createDataFrame([(i, "prompt words and then an answer that bears loss " * (1 + i % 7), 12) for i in range(300)], "doc_id long, text string, prompt long")
    out = packing.pack(df, loss_col="prompt", limits=packing.Limits(tokens=256, segments=3, loss=200)).toPandas()
    g = out.groupby("sequence_id")
    assert g.length.sum().max() <= 256 and g.size().max() <= 3 and g.loss_tokens.sum().max() <= 200
    assert out.groupby("doc_id").length.sum().eq(out.groupby("doc_id").doc_tokens.first()).all()


def test_dialogues_fill_all_limits(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    text = {(r.conv_id, r.turn): r.text or "" for r in rows}
    encode = tokens.encoder()
    want = {}
    for r in rows:
        if r.role == "assistant":
            asked = text[r.conv_id, r.turn - 1] + "\n" if (r.conv_id, r.turn - 1) in text else ""
            ids = np.append(encode(asked + (r.text or "")), 0)
            want[r.conv_id, r.turn] = (len(ids), max(len(ids) - len(encode(asked)), 0))
    out = catalog.queries()["pack_dialogues"](spark, sf).toPandas()
    per = out.groupby(["conv_id", "turn"])
    assert {i: (int(n), int(loss)) for i, n, loss in zip(per.size().index, per.length.sum(), per.loss_tokens.sum(), strict=True)} == want
    g, lim = out.groupby("sequence_id"), packing.DIALOGUES
    n, k, loss = g.length.sum(), g.size(), g.loss_tokens.sum()
    assert n.max() <= lim.tokens and k.max() <= lim.segments and loss.max() <= lim.loss
    assert (n >= lim.tokens - lim.gap).any() and (k == lim.segments).any() and (loss >= lim.loss - lim.gap).any()


def test_answers_of_odd_conversations(spark):
    """Numbers of a thousand and more, repeated turns, null ids, turns, roles and texts."""
    rows = [(1, 999, "user", "q"), (1, 1000, "assistant", "late"), (2, 0, "assistant", "first"), (3, 0, "user", "a"), (3, 0, "user", "b"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (None, 1, "assistant", "no id"), (4, None, "assistant", None), (5, 1, None, "no role")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(7)).withColumn("x", F.lit(1))
    got = sorted(map(tuple, packing.answers(df).collect()), key=repr)
    assert got == sorted([(1, 1000, "q\nlate", 2), (2, 0, "first", 0), (3, 1, "b\nx", 2), (None, 1, "no id", 0), (4, None, "", 0)], key=repr)
    assert packing.answers(df.limit(0)).count() == 0


def test_dot_product_choice():
    """Each placed piece is the fitting one whose demand has the largest dot product with what is left."""
    rng, lim, placed = np.random.default_rng(3), packing.Limits(tokens=100, segments=5, loss=60, gap=101, window=64), []
    packer = packing.Packer(lim, lambda sequence, offset, piece: placed.append((sequence, piece)))
    items = []
    for i in range(40):
        n = int(rng.integers(5, 60))
        loss = np.concatenate([[0], np.cumsum(rng.integers(0, 2, n))])
        items.append((i, 0, n, loss))
        packer.add(i, loss)
    packer.pack(0)
    cap, left = np.array([100, 5, 60], float), {i: np.array([n, 1, loss[n]], float) for i, _, n, loss in items}
    for sequence in range(packer.sequence):
        free = cap.copy()
        for _, (i, *_) in [x for x in placed if x[0] == sequence]:
            fits = {k: d / cap @ (free / cap) for k, d in left.items() if (d <= free).all()}
            assert fits[i] == pytest.approx(max(fits.values()))
            free -= left.pop(i)
    assert len(left) < len(items)


def test_special_token_strings():
    text = "one <|endoftext|> two"
    assert 50256 in tokens.encoder()(text).tolist()


# --- 6


def test_simhash_fingerprints(rows):
    for _, t in rows[:40] + [(0, ""), (0, "One"), (0, "one TWO"), (0, "É a b c d e")]:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), t.encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] if len(w) > 2 else [w] if w else [])]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(t) == want


def test_golay_keys_miss_nothing():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    for weight in range(4):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.choice(64, weight, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        shared = set(zip(*map(np.ndarray.tolist, simhash.keys(base)), strict=True)) & set(zip(*map(np.ndarray.tolist, simhash.keys(other)), strict=True))
        assert len({i for _, i in shared}) == len(base)


def test_near_duplicate_components(spark, odd, empty):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = []
    for c in centres:
        x = c
        for _ in range(25):
            fps.append(x)
            x = x ^ np.uint64(1 << int(rng.integers(0, 62))) ^ np.uint64(1 << int(rng.integers(0, 62)))
    fps = np.unique(np.array(fps, np.uint64))
    u, v = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3)
    root = {int(f): int(f) for f in fps.view(np.int64)}
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(fps.view(np.int64)[u], fps.view(np.int64)[v], strict=True)], "u long, v long")
    want = {r.node: r.root for r in connected_components(edges).collect()}
    distinct = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.near_links(distinct)).collect()}
    assert got == want and len(want) > 500
    assert {r.node: r.root for r in connected_components(simhash.near_links(distinct, most=3)).collect()} == want
    groups = collections.defaultdict(set)
    for f in root:
        groups[want.get(f, f)].add(f)
    assert all(min(g) == k for k, g in groups.items())
    assert len(simhash.links(np.unique(rng.integers(0, 1 << 20, 6000, dtype=np.uint64)))[0]) > 0
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert found[21] == 20 and found[1] == 0 and simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(empty).count() == 0


# --- 7


def full_viterbi(v, text):
    best, back = [0.0], [0]
    for n in range(1, len(text) + 1):
        options = [(best[n - k] + (v.scores[text[n - k : n]][0] if text[n - k : n] in v.scores else v.unknown), k) for k in range(min(v.longest, n), 0, -1) if k == 1 or text[n - k : n] in v.scores]
        top = max(o[0] for o in options)
        best.append(top)
        back.append(next(k for s, k in options if s == top))
    out, p = [], len(text)
    while p:
        out.append(text[p - back[p] : p])
        p -= back[p]
    return [i for piece in reversed(out) for i in v.ids_of(piece)]


def test_sentencepieces(spark, docs, odd, empty, rows):
    c = sentencepieces.codec()
    random.seed(0)
    for text in [t for _, t in rows[:25]] + ["", "  two   blanks ", "\n\tx", "中文 тест é😀", "a" * 400]:
        n, stream, got, i = c.v.normalized(text), sentencepieces.StreamingViterbi(c.v), [], 0
        while i < len(n):
            k = random.randint(1, 60)
            got += stream.feed(n[i : i + k])
            i += k
        got += stream.finish()
        assert got == full_viterbi(c.v, n) == c.encode(text) and c.decode(got) == text
    back = sentencepieces.decode(sentencepieces.encode(docs.limit(30))).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert back.filter("text <> t").count() == 0 and back.count() == 30
    texts = {r.doc_id: r.text or "" for r in odd.filter("doc_id < 9").dropDuplicates(["doc_id"]).collect()}
    for r in sentencepieces.decode(sentencepieces.encode(odd)).filter("doc_id < 9").collect():
        assert r.text == texts[r.doc_id]
    assert sentencepieces.encode(odd).count() == odd.count() and sentencepieces.encode(empty).count() == 0


# --- 8


def test_token_counts(spark, sf, docs, odd, empty):
    n = np.array([len(tokens.encoder()(r.text)) for r in docs.collect()])
    hist = tokens.length_histogram(tokens.token_lengths(docs)).persist()
    for r in hist.collect():
        assert (r.n_docs, r.docs_over, r.tokens_over, r.total_tokens, r.kept_tokens) == ((n == r.limit_tokens).sum(), (n > r.limit_tokens).sum(), n[n > r.limit_tokens].sum(), n.sum(), np.minimum(n, r.limit_tokens).sum())
    limits = {r.limit_tokens: r for r in tokens.at_limits(hist, [0, 100, 1024, 10**6]).collect()}
    assert all(r.kept_tokens == np.minimum(n, k).sum() and r.docs_over == (n > k).sum() for k, r in limits.items())
    assert tokens.quantile(hist, 0.5).first()[0] == np.sort(n)[int(np.ceil(0.5 * len(n))) - 1]
    assert tokens.length_histogram(tokens.token_lengths(empty)).count() == 0
    lengths = tokens.token_lengths(odd).collect()
    assert len(lengths) == odd.count() and sorted(r.n_tokens for r in lengths)[:2] == [0, 0] and tokens.length_histogram(tokens.token_lengths(odd)).agg(F.sum("n_docs")).first()[0] == odd.count()


# --- 9


def test_language_id(spark, docs, odd, empty):
    big = "/root/testdata/sf0.01"
    out = langid.op9_langid(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id] == out.held_out.tolist()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()
    model = langid.LanguageModel.fit(docs)
    found = langid.predict(odd, model, ["doc_id", "text"]).collect()
    assert len(found) == odd.count() and all(r.lang_pred == "und" and r.score == 0 for r in found if not r.text or not re.search(r"[^\W\d_]", r.text))
    assert langid.predict(docs, langid.LanguageModel.fit(empty), ["doc_id"]).filter("lang_pred <> 'und'").count() == 0


def plain_grams(text):
    """The n-grams of a text by hash, one by one."""
    c = re.sub("[^a-z\x80-\U0010ffff]+", " ", f" {text.lower()} ")
    for n in langid.ORDERS:
        for i in range(len(c) - n + 1):
            h = 0
            for k, x in enumerate(c[i : i + n]):
                h = (h * 0x9E3779B97F4A7C15 + ord(x) + k + 1) % 2**64
            yield int(langid.mix(np.array([h], np.uint64))[0]) % langid.BUCKETS


def test_language_model_against_plain_python(spark, docs):
    some = [r for r in docs.select("doc_id", "text", "lang").orderBy("doc_id").limit(40).collect()]
    table, prior = collections.defaultdict(collections.Counter), collections.Counter()
    for r in some[:30]:
        if r.lang is not None and r.text is not None:
            prior[r.lang] += 1
            table[r.lang].update(plain_grams(r.text[:3000]))
    cut = spark.createDataFrame([(r.doc_id, (r.text or "")[:3000] if r.text is not None else None, r.lang) for r in some], "doc_id long, text string, lang string")
    ids = [r.doc_id for r in some[:30]]
    model = langid.LanguageModel.fit(cut.filter(F.col("doc_id").isin(ids)))
    assert model.langs == sorted(prior)
    for r in langid.predict(cut, model, ["doc_id", "text"]).collect():
        if r.lang_pred != "und":
            grams = list(plain_grams(r.text))
            score = {x: np.log(prior[x] / sum(prior.values())) + sum(np.log((table[x][g] + 0.5) / (sum(table[x].values()) + 0.5 * langid.BUCKETS)) for g in grams) for x in prior}
            best = max(score.values())
            p = {x: np.exp(v - best) for x, v in score.items()}
            assert r.lang_pred == max(score, key=score.get) and r.score == pytest.approx(1 / sum(p.values()), abs=1e-3)


def test_long_texts_have_whole_counts(spark):
    long = "The quick-brown fox; ünd dér 123 Hund! " * 20000
    assert len(long) > 2 * langid.PIECE
    whole = collections.Counter()
    c = re.sub("[^a-z\x80-\U0010ffff]+", " ", f" {long.lower()} ")
    for n in langid.ORDERS:
        whole.update(c[i : i + n] for i in range(len(c) - n + 1))
    got = {r.feature: r.n for r in langid.counts(spark.createDataFrame([(long, "x")], "text string, lang string"), "text", "lang").collect()}
    assert got.pop(-1) == 1 and sum(got.values()) == sum(whole.values())
    want = collections.Counter()
    for g, n in whole.items():
        h = 0
        for k, x in enumerate(g):
            h = (h * 0x9E3779B97F4A7C15 + ord(x) + k + 1) % 2**64
        want[int(langid.mix(np.array([h], np.uint64))[0]) % langid.BUCKETS] += n
    assert got == dict(want)


def test_many_languages_are_as_one_model(spark):
    """Three languages to a matrix, ten of them, and one matrix of all: the same predictions and posteriors."""
    words = [f"{chr(97 + i)}{chr(98 + i)}{chr(110 + i)}" for i in range(10)]
    many = spark.createDataFrame([(f"{w} {w}{i} text {w * (1 + i % 3)}", f"l{k}") for k, w in enumerate(words) for i in range(4)] + [("", None)], "text string, lang string")
    blocks = langid.LanguageModel.blocks(many, languages=3)
    assert [m.langs for m in blocks] == [["l0", "l1", "l2"], ["l3", "l4", "l5"], ["l6", "l7", "l8"], ["l9"]]
    whole = langid.LanguageModel.fit(many)
    got, want = ({(r.text, r.lang): (r.lang_pred, round(r.score, 9)) for r in langid.predict(many, m, ["text", "lang"]).collect()} for m in (blocks, whole))
    assert got == want and got["", None] == ("und", 0.0) and all(p == lang for (_, lang), (p, _) in got.items() if lang)
    assert sum(np.exp(m.prior).sum() for m in blocks) == pytest.approx(1)


# --- 10


def repeats(rows):
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in rows:
        b, m = t.encode(), np.zeros(len(t.encode()), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                m[p : p + 50] = True
        edge = np.flatnonzero(np.diff(np.r_[False, m, False].astype(int)))
        out.append((i, len(b), int(m.sum()), len(edge) // 2, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 50)))
        assert suffix.suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: tuple(a[i:]))
    big = rng.integers(0, 1 << 40, 500)
    assert suffix.suffix_array(big).tolist() == sorted(range(500), key=lambda i: tuple(big[i:]))


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
def test_remove_repeats(docs, rows, hot):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = substrings.remove_repeats(docs, hot=hot)
    assert sorted(map(tuple, got.select(*columns).collect())) == repeats(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and r.n_removed == sum(s.end - s.start for s in r.spans) for r in got.limit(50).collect())


def test_remove_repeats_edges(spark, rows, odd, empty):
    a, b = rows[0][1], rows[1][1]
    data = [(5, a), (5, b + a), (5, a), (None, b[:120]), (7, None), (8, a[:49]), (9, "a" * 3000), (10, "b" + "a" * 70), (11, "a" * 49)]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect())
    n = len(b[:120].encode())
    assert got[(5, len(a.encode()), 0)] == 2 and got[(5, len((b + a).encode()), n)] == 1 and got[(10, 71, 70)] == 1 and got[(9, 3000, 0)] == 1 and got[(7, 0, 0)] == 1
    assert substrings.remove_repeats(odd).count() == odd.count() and substrings.remove_repeats(empty).count() == 0


# --- pipeline


def test_pipeline(spark, sf, docs, empty):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "repeated_strings", "personal_data", "packing"]
    good = corpus_pipeline.quality(spark, docs, sf).persist()
    sets = [(r.doc_id, near_copies.shingles(r.text)) for r in good.collect()]
    kept = corpus_pipeline.near_dedup(spark, good, sf).persist()
    assert {r.doc_id for r in kept.collect()} == grouped(sets, lambda a, b: near_copies.similarity(a, b) >= 0.8) and kept.count() < good.count()
    cut = corpus_pipeline.repeated_strings(spark, kept, sf).persist()
    want = {i: (n - r) for i, n, r, _, _ in repeats([(r.doc_id, r.text) for r in kept.collect()])}
    assert all(len(r.text.encode()) <= want[r.doc_id] <= len(r.text.encode()) + 8 and r.n_chars == len(r.text) for r in cut.collect())
    safe = corpus_pipeline.personal_data(spark, cut, sf).persist()
    assert safe.columns == corpus_pipeline.COLUMNS and not any(base_spans(r.text) for r in safe.collect())
    packed = corpus_pipeline.packing(spark, safe, sf)
    assert packed.select("doc_id").distinct().count() == safe.count()
    # which pieces share a sequence depends on the partitions; what is packed of each document doesn't
    packed_tokens = lambda df: {(r.doc_id, r.n, r.all) for r in df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()}
    assert packed_tokens(corpus_pipeline.run(spark, sf)) == packed_tokens(packed) == {(r.doc_id, n, n) for r in safe.collect() for n in [len(tokens.encoder()(r.text)) + 1]}
    twice = docs.limit(20).unionByName(docs.limit(20))
    assert corpus_pipeline.near_dedup(spark, twice, sf).groupBy("doc_id").count().filter("count > 1").count() == 0
    x = empty
    for _, stage in corpus_pipeline.STAGES:
        x = stage(spark, x, sf)
    assert x.count() == 0


def test_pipeline_on_odd_rows(spark, sf, odd, rows):
    """The stages one after the other, on edge cases and good texts with null, repeated and clashing values; without lang and source too."""
    good = spark.createDataFrame([(100 + i, t, None, None, None) for i, t in rows[:12]] + [(None, rows[0][1], "en", "s", 1), (100, rows[0][1], None, None, None)], SCHEMA)
    for x in (odd.unionByName(good, allowMissingColumns=True), good.drop("lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            x = stage(spark, x, sf).persist()
            assert x.columns == corpus_pipeline.COLUMNS
        packed = corpus_pipeline.packing(spark, x, sf)
        assert 0 < x.count() <= 12 and packed.select("doc_id").distinct().count() == x.select("doc_id").distinct().count()


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def planted(rng):
    """(id, text): unrelated texts, each with a copy of one changed word and one of more, near a similarity of 0.8."""
    out = []
    for k in range(120):
        n = int(rng.choice([60, 100, 200, 600]))
        w = [f"w{x}" for x in rng.integers(0, 5000, n)]
        out.append((10 * k, " ".join(w)))
        for j, edits in ((1, 1), (2, max(1, round(n * rng.uniform(0.01, 0.05))))):
            c = list(w)
            for at in rng.choice(n, edits, replace=False):
                c[at] = f"x{rng.integers(0, 5000)}"
            out.append((10 * k + j, " ".join(c)))
    return out


def test_near_dedup_planted_edits(spark, sf):
    data = planted(np.random.default_rng(5))
    sets = {i: grams(t) for i, t in data}
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = set()
    for k in range(0, 1200, 10):
        left = {k, k + 1, k + 2}
        while left:
            group, more = set(), {min(left)}
            while more:
                group |= more
                more = {j for j in left - group for i in group if alike(i, j)}
            want.add(min(group))
            left -= group
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], SCHEMA).repartition(5)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf).collect()} == want and 120 < len(want) < 240
    many = [(i, " ".join(f"y{x if x != i % 90 else 1000 + i}" for x in range(90)), "en", "s", 1) for i in range(300)]
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(many, SCHEMA), sf).collect()] == [0]


def grouped(data, alike):
    """The smallest id of each group that links between the texts connect."""
    want, left = set(), dict(data)
    while left:
        group, more = {}, {min(left): left[min(left)]}
        while more:
            group |= more
            left = {i: x for i, x in left.items() if i not in more}
            more = {i: x for i, x in left.items() if any(alike(x, y) for y in more.values())}
        want.add(min(group))
    return want


@pytest.mark.parametrize("most", [near_copies.ALL, 3])
def test_hot_bands_lose_no_link(spark, monkeypatch, most):
    """Chains of copies whose ends are unlike, and texts that share a passage but aren't copies: most bands are hot if 3 texts are many."""
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng = np.random.default_rng(11)
    data, i = [], 0
    shared = [f"s{x}" for x in rng.integers(0, 5000, 60)]
    for _ in range(4):
        w = shared + [f"w{x}" for x in rng.integers(0, 5000, 60)]
        for _ in range(25):
            data.append((i, " ".join(w)))
            i += 1
            w = list(w)
            for at in rng.choice(60, 2, replace=False):
                w[60 + at] = f"x{rng.integers(0, 5000)}"
    data += [(i + k, " ".join(shared + [f"z{x}" for x in rng.integers(0, 5000, 40)])) for k in range(40)]
    sets = [(k, near_copies.shingles(t)) for k, t in data]
    want = grouped(sets, lambda a, b: near_copies.similarity(a, b) >= 0.8)
    df = spark.createDataFrame([(k, t) for k, t in data], "doc_id long, text string").repartition(3)
    rows, kept = near_copies.near_copies(df, most=most)
    assert {r.doc_id for r in kept.collect()} == want and 44 <= len(want) < 100 and rows.count() == len(data)


def test_near_copies_edges(odd, empty):
    rows, kept = near_copies.near_copies(odd)
    assert rows.count() == odd.count() and kept.count() == len({r.text or "" for r in odd.select("text").collect() if (r.text or "").split()}) + 1
    assert near_copies.near_copies(empty)[1].count() == 0


def test_near_copies_by_golay_keys(spark, monkeypatch):
    """Without bands, what is left is the first step: groups of fingerprints of 5-word shingles at most 3 bits apart, nothing more."""
    rng, data = np.random.default_rng(12), []
    for k in range(40):
        w = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        data.append((10 * k, " ".join(w)))
        for j in (1, 2):
            c = list(w)
            c[int(rng.integers(400))] = f"x{j}"
            data.append((10 * k + j, " ".join(c)))

    def bits(text):
        h = near_copies.shingles(text).tolist()
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = grouped([(i, bits(t)) for i, t in data], lambda a, b: (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_copies, "_spread", lambda batches: iter(()))
    assert {r.doc_id for r in near_copies.near_copies(df)[1].collect()} == want and 40 <= len(want) < 100


def test_documents_are_rows_not_ids(spark, sf):
    rng = np.random.default_rng(6)
    a, b, c, d, e = (" ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) for _ in range(5))
    data = [(None, a), (None, b), (None, c), (7, d), (7, e), (7, e), (3, d), (9, d), (None, a)]
    df = spark.createDataFrame([(i, t, "en", f"s{k % 4}", len(t)) for k, (i, t) in enumerate(data)], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, df, sf)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter([(None, a), (None, b), (None, c), (3, d), (7, e)])
    cut = corpus_pipeline.repeated_strings(spark, kept, sf)
    assert cut.columns == corpus_pipeline.COLUMNS
    assert collections.Counter((r.doc_id, r.text, r.n_chars) for r in cut.collect()) == collections.Counter((i, t, len(t)) for i, t in [(None, a), (None, b), (None, c), (3, d), (7, e)])
    source = {r.text: r.source for r in kept.collect()}
    assert all(r.source == source[r.text] for r in cut.collect())
    assert corpus_pipeline.repeated_strings(spark, df, sf).count() <= len(data)

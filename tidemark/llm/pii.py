"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score. DataFrame functions only.

Positions come from splitting a text at the matches: the lengths of the pieces and of the matches add up to them. The
patterns are written so that Java's matcher takes linear time: a run of characters is entered at its beginning (or where
the last match ended) and taken possessively, which finds the same matches as starting anywhere within it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, lets, prefix_sums, total


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits has a valid Luhn check digit."""

    def value(i: Column) -> Column:
        d = F.substring(digits, -(i + 1), F.lit(1)).cast("long")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return total(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an account number without blanks has valid ISO 13616 check digits."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, a * 10 + code - 48).otherwise(a * 100 + code - 55) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


#: Lengths of account numbers by country (fixed values).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"
#: What may stand between blocks of a number: blank, hyphen, no-break blank and hyphen, narrow no-break blank.
_GAP = r"[\x20\-\u00A0\u2011\u202F]"


def iban_end(candidate: Column) -> Column:
    """Length of the account number that a candidate begins with, null if none.

    Numbers end where a block does. One of its country's length is preferred, whatever its letters' case; then the longest
    in capitals.
    """
    country = F.upper(F.substring(candidate, 1, 2))
    own = F.concat(*(F.when(country.isin(c.split()), F.lit(str(n))).otherwise(F.lit("")) for n, c in IBAN_LENGTHS.items()))

    def prefix(blocks: Column, k: Column) -> Column:
        plain = F.array_join(F.slice(blocks, F.lit(1), k), "")
        return F.struct((F.length(plain).cast("string") == own).alias("fits"), (F.length(plain) + k - 1).alias("end"), plain.alias("plain"))

    def best(blocks: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(blocks)), lambda k: prefix(blocks, k))
        real = lambda x: F.when(x["fits"], F.upper(x["plain"])).otherwise(x["plain"])
        return F.array_max(F.filter(every, lambda x: real(x).rlike(_IBAN) & mod97(real(x))))["end"]

    return let(F.split(candidate, _GAP), best)


@dataclass(frozen=True)
class Kind:
    name: str
    #: Present in every text with a match; cheap to look for.
    hint: str
    pattern: str
    valid: Callable[[Column], Column]
    #: Score of a confirmed match; words near it that raise or lower the score by a half.
    score: float
    near: str
    against: str = r"\b(?:version|isbn|build|chapter|section|order|invoice no|serial)\b"
    #: The group of the pattern that is the candidate, and how many characters the pattern takes if that is ahead of it.
    group: int = 0
    taken: int | None = None
    #: Length of the match that a candidate begins with, null if none; the whole candidate if not given.
    end: Callable[[Column], Column] | None = None


_RUN = r"[A-Za-z0-9._%+-]"
#: The base kinds, in the order in which spans of one start are listed. Their matches are kept whatever the score.
BASE = (
    Kind("email", r"@", rf"(?:\G|(?<!{_RUN})){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 1.0, r"\b(?:e-?mail|contact|write|address|correo|courriel)\b"),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"), 0.8, r"\b(?:ip|host|server|address|login)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++", lambda m: let(_digits(m), lambda d: F.length(d).between(12, 19) & luhn(d)), 0.8, r"\b(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\b"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.8, r"\b(?:phone|tel|call|mobile|fax|telefon|móvil|téléphone)\b"),
)
#: Kinds that the method adds. National numbers have no checksum and need a word near them.
MORE = (
    # each word that can begin a number is a candidate, with what may follow ahead of it: a number ends no other's search
    Kind("iban", rf"[A-Za-z]{{2}}[0-9]{{2}}{_GAP}?[A-Za-z0-9]", rf"(?<![A-Za-z0-9])(?=([A-Za-z]{{2}}[0-9]{{2}}(?:{_GAP}?[A-Za-z0-9]){{11,30}}+[A-Za-z0-9]?))[A-Za-z]{{2}}[0-9]{{2}}", lambda m: F.lit(True), 1.0, r"\b(?:iban|account|konto|cuenta|compte)\b", group=1, taken=4, end=iban_end),
    Kind("national", rf"[0-9]{{3}}{_GAP}[0-9]{{2}}{_GAP}[0-9]{{4}}", rf"(?<![0-9-])[0-9]{{3}}{_GAP}[0-9]{{2}}{_GAP}[0-9]{{4}}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|^.{4}00|0000$"), 0.3,
         r"\b(?:ssn|social security|national id|tax id|passport|sozialversicherung|steuernummer|reisepass|seguridad social|pasaporte|sécurité sociale|passeport)"),
)
KINDS = BASE + MORE
#: Added spans need this score. Characters before and after a span in which words are looked for.
THRESHOLD = 0.5
NEAR = 40

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"


def _found(text: Column, rank: int, kind: Kind) -> Column:
    """The confirmed matches of a kind with their scores."""

    def located(matches: Column) -> Column:
        size = F.transform(matches, lambda m: F.length(m).cast("long") if kind.taken is None else F.lit(kind.taken).cast("long"))
        gap = F.transform(F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches)), lambda p: F.length(p).cast("long"))

        def spans(size: Column, gap: Column) -> Column:
            before = prefix_sums(F.zip_with(gap, size, lambda a, b: a + b))
            rows = F.zip_with(F.zip_with(before, gap, lambda a, b: a + b), matches, lambda s, m: F.struct(s.alias("start"), m.alias("m")))
            if kind.end:
                return let(ended(rows), lambda r: F.transform(apart(r), scored))
            return F.transform(F.filter(rows, lambda x: kind.valid(x["m"])), scored)

        return lets([size, gap], spans)

    def ended(rows: Column) -> Column:
        cut = F.transform(rows, lambda x: let(kind.end(x["m"]), lambda n: F.struct(x["start"].alias("start"), F.substring(x["m"], F.lit(1), n).alias("m"))))
        return F.filter(cut, lambda x: x["m"].isNotNull())

    def apart(rows: Column) -> Column:
        """rows without those that begin within the one kept before them."""
        until = lambda x: x["start"] + F.length(x["m"])
        overlap = F.exists(F.zip_with(rows, F.slice(rows, F.lit(2), F.size(rows)), lambda a, b: b["start"] < until(a)), lambda x: F.coalesce(x, F.lit(False)))
        add = lambda a, x: F.when((F.size(a) > 0) & (x["start"] < until(F.element_at(a, -1))), a).otherwise(F.concat(a, F.array(x)))
        return F.when(overlap, F.aggregate(rows, F.array().cast("array<struct<start:bigint,m:string>>"), add)).otherwise(rows)

    def scored(x: Column) -> Column:
        end = x["start"] + F.length(x["m"])
        first = F.greatest(x["start"] - NEAR, F.lit(0))
        around = F.lower(F.concat(F.substring(text, first.cast("int") + 1, (x["start"] - first).cast("int")), F.lit(" "), F.substring(text, end.cast("int") + 1, F.lit(NEAR))))
        score = F.lit(kind.score) + let(around, lambda a: F.when(a.rlike(kind.near), 0.5).otherwise(0.0) - F.when(a.rlike(kind.against), 0.5).otherwise(0.0))
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), F.lit(kind.name).alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    return F.when(text.rlike(kind.hint), let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)), located)).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, base_spans and spans: arrays of (start, rank, end, kind, score) in order of start, then kind.

    Positions are code points, ends exclusive. base_spans holds every confirmed match of the base kinds, spans those
    and the added kinds whose score reaches THRESHOLD. Null and empty texts have none. A text with many matches costs no
    more than its length times a small factor.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = [_found(text, rank, kind).alias(f"_{kind.name}") for rank, kind in enumerate(KINDS)]
    per = docs.select(*keep, *cols)
    base = F.sort_array(F.concat(*(F.col(f"_{k.name}") for k in BASE)))
    more = F.concat(*(F.filter(F.col(f"_{k.name}"), lambda x: x["score"] >= THRESHOLD) for k in MORE))
    return per.select(*keep, base.alias("base_spans"), F.sort_array(F.concat(base, more)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are one, named by the first."""

    def add(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
        kind = "array<struct<start:bigint,end:bigint,kind:string>>"
        return F.when((F.size(a) > 0) & (x["start"] < last["end"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(own))).cast(kind)

    def plain(s: Column) -> Column:
        return F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))

    def merged(s: Column) -> Column:
        overlap = F.exists(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: b["start"] < a["end"]), lambda x: F.coalesce(x, F.lit(False)))
        return F.when(overlap, F.aggregate(s, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), add)).otherwise(plain(s))

    def rebuilt(s: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0)
            return F.concat(F.substring(text, before.cast("int") + 1, (x["start"] - before).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))

        return F.concat(F.array_join(F.transform(s, part), ""), F.substring(text, F.element_at(s, -1)["end"].cast("int") + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(let(spans, merged), rebuilt))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, but for the text, in which personal data is replaced. Null texts stay null."""
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    own = f"_row.`{text_col}`"
    found = find(wrapped, ["_row"], own)
    text = F.when(F.col(own).isNotNull(), redacted(F.col(own), F.col("spans")))
    return found.select(*((text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.when(x["kind"] == kind, True)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Counts of every document's base spans, their digest, and all spans.

    Null and empty texts have none. Repeated rows, repeated and null ids give rows of their own; an empty table gives none; other
    columns aren't read. Spans of one start are in order of their kinds; texts are read whole, however long.
    """
    from .common import documents

    found = find(documents(spark, sf_dir), ["doc_id"])
    counts = [F.size(F.array_compact(F.transform("base_spans", _is(k.name)))).cast("long").alias(f"n_{k.name}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

"""Model lifecycle, monitoring, audit replay, evidence and its text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import simplex as S

STATES = ["EXPERIMENTAL", "VALIDATED", "CHALLENGER", "CHAMPION", "RETIRED"]


def promote(cards: DataFrame, model: str, version: str, at: str, reason: str) -> DataFrame:
    """The registry after a promotion: the newest card of each model and version, the promoted one champion, the old champion challenger."""
    newest = cards.groupBy("model", "version").agg(F.max_by("state", "updated_at").alias("state"), F.max("updated_at").alias("updated_at"))
    chosen = (F.col("model") == model) & (F.col("version") == version)
    state = F.when(chosen, "CHAMPION").when(F.col("state") == "CHAMPION", "CHALLENGER").otherwise(F.col("state"))
    moved = state != F.col("state")
    note = F.when(chosen, f"Promoted to CHAMPION: {reason}").when(moved, "Demoted").otherwise("")
    return newest.select("model", "version", state.alias("new_state"), F.when(moved | chosen, F.lit(at).cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at"), note.alias("note")).withColumnRenamed("new_state", "state")


def conformal_health(efficiency: DataFrame, nominal: float = 0.90, warning: float = 0.80) -> DataFrame:
    c = F.col("empirical_coverage")
    return efficiency.select("panel", "model", c.alias("realized_coverage"), (c - nominal).alias("coverage_gap"), (c >= warning).alias("is_healthy"), F.when(c >= warning, "NONE").otherwise("RECALIBRATE_CONFORMAL_LAYER").alias("action_required"))


def regime_state(predictions: DataFrame, probes: DataFrame, nearest: bool = False) -> DataFrame:
    """(panel, as_of, date, regime, probability, entropy, set, status) of the probabilities in force at each probe date.

    Looks back by default; nearest takes the nearest row, future ones included, and says so.
    """
    from .pit import asof_backward, asof_nearest

    facts = predictions.select("panel", "date", "p")
    found = (asof_nearest if nearest else asof_backward)(probes, facts, "panel", "as_of", "date", ["p"])
    p = F.col("p")
    future = F.col("is_future") if nearest else F.lit(False)
    return found.select("panel", "as_of", "date", F.when(p.isNotNull(), S.label(S.argmax(p))).alias("regime"), F.array_max(p).alias("probability"), F.when(p.isNotNull(), S.entropy(p)).alias("entropy"), F.size(S.prediction_set(p, F.lit(0.90))).alias("set_size"), F.coalesce(future, F.lit(False)).alias("is_future"), F.when(p.isNull(), "UNAVAILABLE").otherwise("VERIFIED").alias("status")).withColumn("set_size", F.when(F.col("status") == "VERIFIED", F.col("set_size")))


def entropy_band(entropy: Column) -> Column:
    """How certain an entropy (in nats) is, in words."""
    return F.when(entropy < 0.0005, "near-certain").when(entropy < 0.05, "very low").when(entropy < 0.20, "low").when(entropy < 0.60, "moderate").otherwise("high")


def changepoint_alert(p: Column) -> Column:
    return F.when(p.isNull(), "UNAVAILABLE").when(p >= 0.30, "HIGH").when(p >= 0.15, "ELEVATED").otherwise("NORMAL")


def commentary(regime: Column, probability: Column, epistemic: Column, cvar: Column, changepoint: Column) -> Column:
    """The committee's stance for a day, in one sentence. Models that disagree come before any regime."""
    pct = lambda c, digits: F.concat(F.format_string(f"%.{digits}f", c * 100), F.lit(" %"))
    return (
        F.when(epistemic > 0.4, F.concat(F.lit("Stay cautious: the models part ways (epistemic uncertainty "), F.format_string("%.2f", epistemic), F.lit(").")))
        .when(regime == "Risk-Off", F.concat(F.lit("Protect capital: Risk-Off holds "), pct(probability, 1), F.lit(" of the probability and the worst twentieth of months loses "), pct(cvar, 2), F.lit(" on average.")))
        .when(regime == "Risk-On", F.concat(F.lit("Lean in: Risk-On holds "), pct(probability, 1), F.lit(" of the probability.")))
        .otherwise(F.concat(F.lit("Keep hedges: no side prevails, a break is "), pct(changepoint, 1), F.lit(" likely.")))
    )


def top_drivers(attributions: DataFrame, positive: int = 3, negative: int = 2) -> DataFrame:
    """(panel, date, side, place, feature, attribution): the largest positive and the most negative attributions of each day."""
    def ranked(side: str, keep: Column, order: Column, most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("panel", "date").orderBy(order, "feature"))
        return attributions.filter(keep).select("panel", "date", F.lit(side).alias("side"), place.alias("place"), "feature", "attribution").filter(F.col("place") <= most)

    a = F.col("attribution")
    return ranked("up", a > 0, a.desc(), positive).unionByName(ranked("down", a < 0, a.asc(), negative))


#: Features that a narrative may name: words for a high and a low value, and the value that parts them (fixed values).
DRIVERS = {
    "vix_level": ("a tense volatility index", "a calm volatility index", 20.0), "breadth_midcap_ret_21d": ("midcaps in the lead", "midcaps falling behind", 0.0),
    "nifty_dist_sma50": ("prices above their 50-day mean", "prices below their 50-day mean", 0.0), "nifty_vol_ewma_21d": ("high realized volatility", "low realized volatility", 0.2),
    "nifty_ret_1d": ("a rising index", "a falling index", 0.0),
}


def narrative(regime: Column, probability: Column, features: dict[str, Column], attributions: dict[str, Column], agreeing: Column, dissenting: Column, changepoint: Column, least: float = 0.05) -> Column:
    """One paragraph from the day's numbers: up to three drivers for and two against, by the size of attributions beyond `least`;
    how many models agree; a break if its probability exceeds 0.3."""
    pct = lambda c: F.concat(F.format_string("%.1f", c * 100), F.lit(" %"))
    parts = F.array(*(F.struct(attributions[f].alias("a"), F.lit(f).alias("f"), F.when(features[f] > mid, high).otherwise(low).alias("words")) for f, (high, low, mid) in DRIVERS.items() if f in features))
    words = lambda x: F.array_join(F.transform(x, lambda d: d["words"]), ", ")
    up = F.slice(F.reverse(F.array_sort(F.filter(parts, lambda d: d["a"] > least))), 1, 3)
    down = F.slice(F.array_sort(F.filter(parts, lambda d: d["a"] < -least)), 1, 2)
    why = F.when(F.size(up) > 0, F.concat(F.lit(" It rests on "), words(up), F.lit("."))).otherwise(" No single feature carries it.")
    why_not = F.when(F.size(down) > 0, F.concat(F.lit(" Against it: "), words(down), F.lit("."))).otherwise("")
    n = F.size(agreeing) + F.size(dissenting)
    others = F.when(F.size(dissenting) > 0, F.concat(F.lit("; not "), F.array_join(F.slice(dissenting, 1, 2), ", "))).otherwise("")
    who = F.concat(F.lit(" "), F.size(agreeing).cast("string"), F.lit(" of "), n.cast("string"), F.lit(" models agree"), others, F.lit("."))
    notice = F.when(changepoint > 0.30, F.concat(F.lit(" A break is "), pct(changepoint), F.lit(" likely."))).otherwise("")
    return F.concat(regime, F.lit(" at "), pct(probability), F.lit("."), why, why_not, who, notice)


def ablation(rows: DataFrame, score, features: list[str], baseline: dict[str, float]) -> DataFrame:
    """(panel, date, feature, attribution): change of score(columns) when a feature takes its baseline value, shares of their absolute sum."""
    full = score({f: F.col(f) for f in features})
    parts = F.array(*(F.struct(F.lit(f).alias("feature"), (full - score({g: F.lit(baseline[g]) if g == f else F.col(g) for g in features})).alias("d")) for f in features))
    total = S.fold(F.col("parts"), lambda x: F.abs(x["d"]))
    out = rows.select("panel", "date", parts.alias("parts")).select("panel", "date", total.alias("total"), F.explode("parts").alias("x"))
    return out.select("panel", "date", "x.feature", F.when(F.col("total") > 0, F.col("x.d") / F.col("total")).otherwise(0.0).alias("attribution"))


#: Figures of earlier reports that must not be quoted any more (fixed values).
SUPERSEDED = ("0.0003", "0.0014", "0.0011")
#: Characters around a percentage in which what it is about is looked for.
NEAR = 50
_NAMES = "|".join(S.REGIMES)
#: The word regime and, within the sentence, the name that is claimed for it; the size of a prediction set.
_CLAIM = rf"(?i)\bregime\b(?:[^.%\n]{{0,24}}?)\b({_NAMES})\b"
_SET = r"(?i)\b(?:conformal|prediction)\b[^.\n]{0,20}?\bset\b[^.\n0-9]{0,24}([0-9]+)"
_PERCENT = r"[0-9]+(?:\.[0-9]+)?\s*%"


def percentages(text: Column) -> Column:
    """Every percentage of a text, in order: (value, before, after), with the NEAR characters on either side of it."""
    pieces, matches = F.split(text, _PERCENT, -1), F.regexp_extract_all(text, F.lit(_PERCENT), F.lit(0))

    def located(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["pieces"], F.lit(1), F.size(x["matches"])), x["matches"], lambda a, b: F.length(a) + F.length(b))
        ends = F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, v: a + v))

        def one(end: Column, i: Column) -> Column:
            m = F.get(x["matches"], i)
            start = end - F.length(m)
            first = F.greatest(start - NEAR, F.lit(0))
            return F.struct(F.regexp_extract(m, "[0-9.]+", 0).cast("double").alias("value"), F.substring(text, first + 1, start - first).alias("before"), F.substring(text, end + 1, F.lit(NEAR)).alias("after"))

        return F.transform(ends, one)

    return S.let(F.struct(pieces.alias("pieces"), matches.alias("matches")), located)


def subject(x: Column) -> Column:
    """What a percentage is about: the name or `changepoint` right after it, else the last one before it, else the first after it."""
    word = f"(?:{_NAMES}|change-?points?|bocpd|transition prob)"
    known = lambda c: F.when(F.lower(c).rlike("^(?:change|bocpd|transition)"), "changepoint").otherwise(F.lower(c))
    at_once = F.regexp_extract(x["after"], rf"(?i)^\s*(?:(?:for|in|of|on|to|probability of|chance of)\s+)?({word})", 1)
    last = F.regexp_extract(x["before"], rf"(?is)^.*({word})", 1)
    first = F.regexp_extract(x["after"], rf"(?i)({word})", 1)
    return known(F.coalesce(*(F.nullif(c, F.lit("")) for c in (at_once, last, first))))


def validate_responses(responses: DataFrame, tolerance_pp: float = 2.5, superseded: tuple[str, ...] = SUPERSEDED) -> DataFrame:
    """(id, violations, is_trusted) of texts against their evidence: (id, text, regime, p, set_size, changepoint), nulls for what isn't known.

    Checked are superseded figures, every claim of a regime, every percentage against the probability of what it is about
    (see subject(); percentages about nothing known aren't claims), and the size of a prediction set. Each kind of violation counts once a text.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = responses.withColumn("_said", F.transform(percentages(t), lambda x: F.struct(x["value"].alias("value"), subject(x).alias("of"))))
    claimed = F.transform(F.regexp_extract_all(t, F.lit(_CLAIM), F.lit(1)), F.lower)
    off = lambda name, known: F.exists("_said", lambda x: (x["of"] == name) & (known.isNull() | (F.abs(x["value"] - 100 * known) > tolerance_pp)))
    wrong = []
    for k, name in enumerate(S.REGIMES):
        said = F.array_contains(claimed, name.lower())
        wrong.append(F.when(said & F.col("regime").isNull(), f"claims regime {name} without evidence").when(said & (F.col("regime") != name), f"claims regime {name} against the evidence"))
        wrong.append(F.when(off(name.lower(), F.get("p", F.lit(k))), f"probability of {name} differs from the evidence"))
    size = F.regexp_extract(t, _SET, 1)
    old = "|".join(f.replace(".", r"\.") for f in superseded)
    wrong += [
        F.when(t.rlike(rf"(?<![0-9.])(?:{old})(?![0-9])"), "uses a superseded figure") if superseded else F.lit(None).cast("string"),
        F.when((size != "") & F.col("set_size").isNull(), "claims a prediction set without evidence").when((size != "") & (F.nullif(size, F.lit("")).cast("int") != F.col("set_size")), "claims another set size than the evidence"),
        F.when(off("changepoint", F.col("changepoint")), "changepoint probability differs from the evidence"),
    ]
    return rows.select("id", F.array_compact(F.array(*wrong)).alias("violations")).withColumn("is_trusted", F.size("violations") == 0)


def evidence_bundle(state: DataFrame, features: DataFrame, changepoints: DataFrame) -> DataFrame:
    """(panel, as_of, bundle, bundle_hash): everything known of a date as JSON, each part with its status."""
    f = features.select(F.col("panel").alias("_fp"), F.col("date").alias("_fd"), F.struct(*(c for c in features.columns if c not in ("panel", "date"))).alias("_f"))
    c = changepoints.select(F.col("panel").alias("_cp"), F.col("date").alias("_cd"), F.col("changepoint").alias("_c"))
    rows = state.join(f, (F.col("panel") == F.col("_fp")) & (F.col("date") == F.col("_fd")), "left").join(c, (F.col("panel") == F.col("_cp")) & (F.col("date") == F.col("_cd")), "left")
    status = lambda x: F.when(x.isNull(), "UNAVAILABLE").otherwise("VERIFIED")
    bundle = F.to_json(F.struct(
        F.struct("regime", "probability", "entropy", "set_size", "status").alias("regime_state"), F.struct(F.col("_f").alias("values"), status(F.col("_f")).alias("status")).alias("feature_snapshot"),
        F.struct(F.col("_c").alias("probability"), changepoint_alert(F.col("_c")).alias("alert"), status(F.col("_c")).alias("status")).alias("changepoint_signal"),
    ))
    return rows.select("panel", "as_of", bundle.alias("bundle")).withColumn("bundle_hash", F.substring(F.sha2("bundle", 256), 1, 16))


def audit_records(state: DataFrame, text: Column) -> DataFrame:
    """state (of regime_state) with a narrative and record_id, a hash of all that the record says."""
    parts = ("panel", "as_of", "date", "regime", "status")
    whole = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts), F.when(F.col("probability").isNotNull(), F.format_string("%.6f", "probability")).otherwise(""), F.coalesce(F.col("set_size").cast("string"), F.lit("")), F.col("narrative"))
    return state.withColumn("narrative", text).withColumn("record_id", F.substring(F.sha2(whole.cast("binary"), 256), 1, 16))


def analogs(predictions: DataFrame, forward: DataFrame, most: int = 5) -> DataFrame:
    """(panel, regime, place, date, probability, fwd_ret): of each regime the days that it was most probable on, and what came after."""
    top = S.argmax(F.col("p"))
    rows = predictions.select("panel", "date", S.label(top).alias("regime"), F.array_max("p").alias("probability"))
    place = F.row_number().over(Window.partitionBy("panel", "regime").orderBy(F.col("probability").desc(), "date"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).join(forward.select("panel", "date", "fwd_ret"), ["panel", "date"], "left").select("panel", "regime", "place", "date", "probability", "fwd_ret")


def exact_lookup(probes: DataFrame, facts: DataFrame, values: list[str], at: str = "as_of") -> DataFrame:
    """probes (panel, as_of) with the values of the very date; status UNAVAILABLE and nulls if there are none. No date stands in for another."""
    known = facts.select(F.col("panel").alias("_p"), F.col("date").alias("_d"), *values)
    rows = probes.join(known, (F.col("panel") == F.col("_p")) & (F.col(at) == F.col("_d")), "left")
    return rows.select(*probes.columns, *values, F.when(F.col("_d").isNull(), "UNAVAILABLE").otherwise("VERIFIED").alias("status"))


def record_lookup(asked: DataFrame, records: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """asked (columns key) with the values of the artifact's record of that key, a status and a reason.

    VERIFIED: one record, all its values known. QUARANTINED: records that contradict each other, or a value that is missing or
    isn't finite; values are then null. UNAVAILABLE: no record. Repeated equal records count once, repeated questions are answered
    each, a null key finds nothing, and no other record stands in.
    """
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in values if dict(records.dtypes)[c] in ("double", "float")]
    sound = F.lit(True)
    for ok in (*(F.col(c).isNotNull() for c in values), *finite):
        sound = sound & ok
    known = records.select(*(F.col(c).alias(f"_k_{c}") for c in key), F.struct(*values).alias("_v"), F.coalesce(sound, F.lit(False)).alias("_ok"))
    known = known.groupBy(*(f"_k_{c}" for c in key)).agg(F.min("_v").alias("_v"), (F.min("_v") == F.max("_v")).alias("_one"), F.min("_ok").alias("_ok"))
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"_k_{c}"))
    rows = asked.select(*key).join(known, same, "left")
    reason = F.when(F.col("_v").isNull(), "no record").when(~F.col("_one"), "records contradict each other").when(~F.col("_ok"), "a value is missing or not finite").otherwise("")
    status = F.when(F.col("_v").isNull(), "UNAVAILABLE").when(F.col("_one") & F.col("_ok"), "VERIFIED").otherwise("QUARANTINED")
    rows = rows.select(*key, "_v", status.alias("status"), reason.alias("reason"))
    return rows.select(*key, *(F.when(F.col("status") == "VERIFIED", F.col(f"_v.{c}")).alias(c) for c in values), "status", "reason")


#: Tilts that the committee's memo gives for each regime (fixed values).
TILTS = {"Risk-On": "cyclicals and midcaps", "Late-Cycle": "quality and energy", "Transitional": "balanced sectors", "Post-Shock": "beaten-down leaders", "Risk-Off": "staples, health care and cash"}


def committee_memo(state: DataFrame, tail: DataFrame) -> DataFrame:
    """(panel, as_of, memo): a page in Markdown for each state: regime, probability, tilt, and the tail risk of the month ahead (one row)."""
    tilt = F.element_at(F.create_map(*(F.lit(x) for pair in TILTS.items() for x in pair)), F.col("regime"))
    pct = lambda c: F.format_string("%.1f %%", 100 * F.col(c))
    lines = [F.concat(F.lit("# Regime memo, "), F.date_format("as_of", "yyyy-MM-dd")), F.lit(""), F.concat(F.lit("- Regime: **"), F.col("regime"), F.lit("** ("), pct("probability"), F.lit(")")), F.concat(F.lit("- Tilt: "), tilt),
             F.concat(F.lit("- Month ahead: VaR "), pct("var_95"), F.lit(", CVaR "), pct("cvar_95"))]
    return state.filter("regime is not null").join(F.broadcast(tail)).select("panel", "as_of", F.array_join(F.array(*lines), "\n").alias("memo"))


def template_answer(question: Column, state: dict[str, Column]) -> Column:
    """An answer without a language model: what the question asks of the state, by the words it uses; all of it if none fits."""
    asks = lambda words: F.lower(question).rlike(words)
    pct = lambda c: F.format_string("%.1f %%", 100 * c)
    regime = F.concat(F.lit("The regime is "), state["regime"], F.lit(" at "), pct(state["probability"]), F.lit("."))
    sets = F.concat(F.lit("The prediction set has "), state["set_size"].cast("string"), F.lit(" members."))
    risk = F.concat(F.lit("The month's CVaR is "), pct(state["cvar"]), F.lit("."))
    return F.when(asks("cvar|tail|risk of loss|drawdown"), risk).when(asks("set|uncertain|conformal"), sets).when(asks("regime|state|outlook"), regime).otherwise(F.concat_ws(" ", regime, sets, risk))

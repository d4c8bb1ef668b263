"""The number fence: prose may name figures only as tokens of computed claims, and fails closed."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import band, dollars, finite, fixed

#: Fixed value: the shape of a token.
TOKEN = r"\{\{\s*([A-Za-z][A-Za-z0-9_]*)\s*\}\}"


# The words for a figure's size, by token or by the token's beginning (cuts, words, of the magnitude or not).
_RATIO = ([0.0, 1.0, 2.0], ["negative", "weak", "solid", "strong"], False)
_RETURN = ([0.0, 0.10, 0.20], ["negative", "modest", "healthy", "strong"], False)
_ULCER = ([0.02, 0.05, 0.10], ["mild", "moderate", "significant", "severe"], False)
_DEPTH = ([0.05, 0.15, 0.30], ["mild", "moderate", "significant", "severe"], True)
BANDS = {
    "max_drawdown": _DEPTH, "cdar": _DEPTH, "ulcer": _ULCER, "sharpe": _RATIO, "sortino": _RATIO, "calmar": _RATIO,
    "twr_annual": _RETURN, "mwr_annual": _RETURN, "dietz_annual": _RETURN,
}
PREFIX_BANDS = {"gap_": ([0.005, 0.03, 0.10], ["none", "very little", "some", "a fair amount"], False), "bench_dd_": _DEPTH, "bench_ulcer_": _ULCER}
# What a check's status says of a fund.
FIT_WORDS = {
    "cost": {"pass": "cheap", "warn": "a bit pricey", "fail": "expensive"},
    "liquidity": {"pass": "liquid", "warn": "thinly traded", "fail": "illiquid"},
    "overlap": {"pass": "little overlap with what you hold", "warn": "some overlap with what you hold", "fail": "heavy overlap with what you hold"},
    "diversifier": {"pass": "diversified your past drawdowns", "warn": "a weak diversifier for your book", "fail": "moved with your book"},
}


def band_of(token: Column, value: Column) -> Column:
    """The word for a figure's size that its token has, by name or else by its beginning; NULL without one or a figure."""
    x = finite(value)
    out = F.lit(None).cast("string")
    for prefix, (cuts, words, magnitude) in reversed(PREFIX_BANDS.items()):
        out = F.when(token.startswith(prefix), band(x, cuts, words, magnitude)).otherwise(out)
    for name, (cuts, words, magnitude) in BANDS.items():
        out = F.when(token == name, band(x, cuts, words, magnitude)).otherwise(out)
    return out


def slug(text: Column) -> Column:
    """A name as part of a token: lower case, all else than letters and digits as low lines."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")


def fit_phrases(checks: DataFrame) -> DataFrame:
    """ticker, fit: what the headline checks (ticker, check, status) say of a fund in words, without figures; empty without any."""
    places = {(c, s): k for k, (c, s) in enumerate((c, s) for c, words in FIT_WORDS.items() for s in words)}
    word = F.lit(None).cast("struct<place:int,word:string>")
    for (c, s), k in places.items():
        word = F.when((F.col("check") == c) & (F.col("status") == s), F.struct(F.lit(k).alias("place"), F.lit(FIT_WORDS[c][s]).alias("word"))).otherwise(word)
    return checks.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["word"]), ", ").alias("fit"))


def claim_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, token, value, rendered, label, band of rows (key, token, value, rendered, label) whose figure is finite or is none."""
    kept = rows.where(F.col("value").isNull() | finite(F.col("value")).isNotNull())
    return kept.select(key, "token", "value", "rendered", "label", band_of(F.col("token"), F.col("value")).alias("band"))


def brief_claims(totals: DataFrame, returns: DataFrame, risk: DataFrame, given_back: DataFrame, key: str = "book") -> DataFrame:
    """The figures that prose on a book may name: its holdings, returns and risk, as claim_rows.

    totals: as report.totals, with n_priced, the holdings that have a price; returns: as returns.summary; risk: key, depth,
    peak_date, trough_date, recovery_date, duration_days, underwater, ulcer, cdar, sharpe, sortino, calmar; given_back: key,
    depth of the fall of the profit in dollars. A figure that is missing or not finite makes no claim, nor does one that
    says nothing: values without a priced holding, a cost of nothing, a period of no days. Books may lack in any input.
    """
    v = F.col
    percent = lambda c: F.concat(fixed(v(c) * 100, 2, plus=True), F.lit("%"))
    size = lambda c: F.concat(fixed(v(c) * 100, 2), F.lit("%"))
    money = lambda c: F.when(v(c).isNotNull(), dollars(v(c)))
    day = lambda c: v(c).cast("string")
    days = F.datediff("asof_date", "period_start")
    # fixed values: the names of the tokens, and how each figure is shown
    made = {
        "totals": (totals, [
            ("total_market_value", "value", money("value"), v("n_priced") > 0, "market value of the holdings that have a price"), ("unrealized_pnl", "unrealized", money("unrealized"), v("n_priced") > 0, "profit not yet realised"),
            ("net_pnl", "net", money("net"), v("n_priced") > 0, "profit in all"), ("n_holdings", "n_priced", v("n_priced").cast("string"), v("n_priced") > 0, "holdings that have a price"),
            ("total_cost_basis", "cost_basis", money("cost_basis"), v("cost_basis") > 0, "cost of what is held"), ("realized_pnl", "realized", money("realized"), F.lit(True), "profit realised by sales and income"),
        ]),
        "returns": (returns.withColumns({"days_": days, "years_": days / 365.25}), [
            ("twr_annual", "twr", percent("twr"), F.lit(True), "time-weighted return of a year"), ("mwr_annual", "money_weighted", percent("money_weighted"), F.lit(True), "money-weighted return of a year"), ("dietz_annual", "modified_dietz", percent("modified_dietz"), F.lit(True), "Modified Dietz return of a year"),
            ("period_start", None, day("period_start"), v("days_") > 0, "first day of the period"), ("period_end", None, day("asof_date"), v("days_") > 0, "last day of the period"), ("period_years", "years_", F.concat(fixed(v("years_"), 2), F.lit("y")), v("days_") > 0, "years of the period"),
        ]),
        "risk": (risk, [
            ("max_drawdown", "depth", percent("depth"), F.lit(True), "deepest fall from a peak"), ("drawdown_peak_date", None, day("peak_date"), F.lit(True), "day of the peak before the deepest fall"), ("drawdown_trough_date", None, day("trough_date"), F.lit(True), "day of the deepest fall"),
            ("drawdown_recovery_date", None, day("recovery_date"), F.lit(True), "day on which the peak was reached again"), ("drawdown_duration_days", "duration_days", F.concat(v("duration_days").cast("string"), F.lit(" days")), F.lit(True), "days from the peak to the recovery"),
            ("time_underwater_pct", "underwater", F.concat(fixed(v("underwater") * 100, 0), F.lit("%")), F.lit(True), "share of days below an earlier peak"), ("ulcer", "ulcer", size("ulcer"), F.lit(True), "Ulcer index"), ("cdar", "cdar", size("cdar"), F.lit(True), "mean of the deepest twentieth of falls"),
            ("sharpe", "sharpe", fixed(v("sharpe"), 2, plus=True), F.lit(True), "Sharpe ratio"), ("sortino", "sortino", fixed(v("sortino"), 2, plus=True), F.lit(True), "Sortino ratio"), ("calmar", "calmar", fixed(v("calmar"), 2, plus=True), F.lit(True), "Calmar ratio"),
        ]),
        "given_back": (given_back, [("gains_given_back", "depth", money("depth"), F.lit(True), "largest fall of the profit in dollars")]),
    }
    out = None
    for rows, claims in made.values():
        each = [F.struct(F.lit(t).alias("token"), (F.lit(None) if c is None else v(c)).cast("double").alias("value"), F.when(when, shown).alias("rendered"), F.lit(label).alias("label")) for t, c, shown, when, label in claims]
        named = rows.select(key, F.explode(F.array(*each)).alias("c")).select(key, "c.*")
        # a date has no value, but it is missing where it has no text
        named = named.where("rendered is not null")
        out = named if out is None else out.unionByName(named)
    return claim_rows(out, key)


def discovery_claims(gaps: DataFrame, menu: DataFrame, verdicts: DataFrame, checks: DataFrame, key: str = "book") -> DataFrame:
    """The figures that prose on gaps may name: the exposure to each gap role, and each candidate on a menu that was screened.

    gaps: key, role, exposure; menu: key, role, ticker, name; verdicts: ticker, verdict; checks as in fit_phrases.
    """
    none = F.lit(None).cast("double")
    roles = gaps.select(key, F.concat(F.lit("gap_"), slug(F.col("role"))).alias("token"), F.col("exposure").alias("value"), F.concat(fixed(F.col("exposure") * 100, 0), F.lit("%")).alias("rendered"), F.concat(F.lit("the book's exposure to "), "role").alias("label"))
    judged = menu.join(verdicts, "ticker").join(fit_phrases(checks), "ticker", "left")
    name = F.array_join(F.filter(F.split(F.col("name"), r"\s+"), lambda w: w != ""), " ")
    said = F.concat(name, F.lit(", "), F.col("role"), F.lit(": the screen says "), F.upper("verdict"), F.when(F.coalesce("fit", F.lit("")) != "", F.concat(F.lit(" ("), "fit", F.lit(")"))).otherwise(""))
    funds = judged.select(key, F.concat(F.lit("cand_"), slug(F.col("ticker"))).alias("token"), none.alias("value"), F.col("ticker").alias("rendered"), said.alias("label"))
    return claim_rows(roles.unionByName(funds), key)


def benchmark_claims(stats: DataFrame, reference: str, key: str = "pair") -> DataFrame:
    """The figures that prose on a benchmark may name: both held-out Ulcer indices (stats: key, leg, ulcer) and the reference's name."""
    ulcers = stats.select(key, F.when(F.col("leg") == "with", "bench_ulcer_preset").otherwise("bench_ulcer_reference").alias("token"), F.col("ulcer").alias("value"), F.concat(fixed(F.col("ulcer") * 100, 2), F.lit("%")).alias("rendered"), F.when(F.col("leg") == "with", "the posture's Ulcer index, held out").otherwise("the reference's Ulcer index, held out").alias("label"))
    names = stats.select(key).distinct().select(key, F.lit("bench_reference").alias("token"), F.lit(None).cast("double").alias("value"), F.lit(reference).alias("rendered"), F.lit("the reference's name").alias("label"))
    return claim_rows(ulcers.unionByName(names), key)


def prompt_listing(claims: DataFrame, key: str, exact: bool) -> DataFrame:
    """key, listing: a line for each claim in the order of tokens; with its exact text, or only with the word for its size."""
    hint = F.coalesce(F.col("rendered") if exact else F.col("band"), F.lit(""))
    line = F.concat(F.lit("{{"), "token", F.lit("}}  — "), "label", F.when(hint != "", F.concat(F.lit(" ("), hint, F.lit(")"))).otherwise(""))
    return claims.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token", line.alias("line")))), lambda x: x["line"]), "\n").alias("listing"))


@lru_cache(maxsize=1)
def letter_numerals() -> str:
    """All letters that stand for numbers, as the ideographs of ten or ten thousand: number categories do not cover them."""
    return "".join(c for c in map(chr, range(0x110000)) if not unicodedata.category(c).startswith("N") and unicodedata.numeric(c, None) is not None)


def numeral_class() -> str:
    return r"[\p{N}" + letter_numerals() + "]"


def has_bare_numeral(prose: Column) -> Column:
    """Whether a numeral of any script stands outside the tokens."""
    return F.regexp_replace(prose, TOKEN, "").rlike(numeral_class())


def render(prose: Column, claims: Column) -> Column:
    """The prose with its tokens replaced from claims (a map of lower-case names to texts); NULL if it is blank, has a bare numeral, an unknown token or left-over braces.

    The prose is cut at its tokens once, each token is looked up, and the parts are put together again: what a claim says
    is not read again, and claims that the prose does not name cost nothing.
    """
    named = F.transform(F.regexp_extract_all(prose, F.lit(TOKEN), F.lit(1)), lambda t: F.try_element_at(claims, F.lower(t)))
    parts = F.split(prose, TOKEN, -1)
    out = F.array_join(F.transform(parts, lambda p, k: F.concat(F.when(k == 0, "").otherwise(F.get(named, k - 1)), p)), "")
    bad = (F.trim(prose) == "") | has_bare_numeral(prose) | F.exists(named, lambda v: v.isNull())
    return F.when(~bad & ~out.contains("{{") & ~out.contains("}}"), out)


def claims_of(rows: DataFrame, key: str) -> DataFrame:
    """key and claims, a map, of rows (key, token, value, rendered); figures that are missing or not finite make no claim."""
    usable = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return usable.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(slug(F.col("token")).alias("t"), F.col("rendered"))))).alias("claims"))

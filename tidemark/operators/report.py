"""Report panels as small result sets, and their rendering."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import dollars, fixed, human, ratio, signed_percent
from tidemark.operators.screen import age_years

LAG_FLAG_DAYS, LAG_ALARM_DAYS = 4, 10


def holdings(positions: DataFrame, latest: DataFrame) -> DataFrame:
    """book, ticker, shares, avg_cost, value, unrealized, realized and priced of all that is held; latest: ticker, close."""
    value = F.col("shares") * F.col("close")
    return positions.where("shares > 1e-9").join(latest.select("ticker", "close"), "ticker", "left").select("book", "ticker", "shares", ratio(F.col("cost_basis"), F.col("shares")).alias("avg_cost"), "cost_basis", value.alias("value"), (value - F.col("cost_basis")).alias("unrealized"), "realized", "fees", F.col("close").isNotNull().alias("priced"))


def totals(panel: DataFrame, key: str = "book") -> DataFrame:
    """key, value and cost of what is priced, cost of all, unrealized, realized, net (both together), fees (told, never taken off again) and unpriced."""
    priced = lambda c: F.sum(F.when(F.col("priced"), F.col(c)).otherwise(0.0))
    out = panel.groupBy(key).agg(priced("value").alias("value"), priced("cost_basis").alias("priced_cost"), F.sum("cost_basis").alias("cost_basis"), priced("unrealized").alias("unrealized"), F.sum("realized").alias("realized"), F.sum("fees").alias("fees"), F.count_if(~F.col("priced")).alias("unpriced"))
    return out.withColumn("net", F.col("unrealized") + F.col("realized"))


def leg_table(legs: DataFrame, names: list[str]) -> DataFrame:
    """metric and a column of text for each leg (columns: leg and figures as shares)."""
    figures = [c for c in legs.columns if c != "leg"]
    long = legs.select("leg", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), signed_percent(F.col(c).cast("double")).alias("v")) for c in figures])).alias("e")).select("leg", "e.metric", "e.v")
    return long.groupBy("metric").pivot("leg", names).agg(F.first("v"))


def securities(facts: DataFrame, today: Column) -> DataFrame:
    """ticker, expense, aum, volume, age, kind: fund facts as texts, n/a where a fact is not published."""
    text = lambda shown, c: F.when(F.col(c).isNull(), "n/a").otherwise(shown)
    parts = F.array(*[F.nullif(F.trim(F.col(c) if c in facts.columns else F.lit(None).cast("string")), F.lit("")) for c in ("quote_type", "category", "family")])
    kind = F.array_join(F.array_compact(parts), " — ")
    return facts.select(
        "ticker", text(F.concat(fixed(F.col("expense_ratio") * 100, 2), F.lit("%")), "expense_ratio").alias("expense"), text(F.concat(F.lit("$"), human(F.col("aum"))), "aum").alias("aum"),
        text(human(F.col("avg_volume")), "avg_volume").alias("volume"), text(F.concat(fixed(age_years(F.col("inception"), today), 1), F.lit("y")), "inception").alias("age"), F.when(kind == "", "n/a").otherwise(kind).alias("kind"),
    )


def candidates(checks: DataFrame, only_found: bool = False) -> DataFrame:
    """ticker, verdict, counts, lines: the screen's result as texts, the checks in the order of their names, with their reasons if they have any.

    only_found: just what a check found, warnings, failures, and a held-out role that passed.
    """
    from tidemark.operators.screen import roll_up

    found = F.col("status").isin("warn", "fail") | ((F.col("check") == "role") & (F.col("status") == "pass"))
    told = F.coalesce(F.concat(F.lit(": "), F.col("reason")), F.lit("")) if "reason" in checks.columns else F.lit("")
    line = F.when(found | F.lit(not only_found), F.concat(F.lit("["), "status", F.lit("] "), "check", told))
    lines = checks.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("check", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    n = lambda c, word: F.concat(F.col(c).cast("string"), F.lit(f" {word}"))
    counts = F.concat_ws(" / ", n("n_fail", "fail"), n("n_warn", "warn"), n("n_pass", "pass"), n("n_na", "n-a"))
    return roll_up(checks).join(lines, "ticker").select("ticker", F.upper("verdict").alias("verdict"), counts.alias("counts"), F.array_join(F.array_compact("lines"), "\n").alias("lines"))


def discoveries(gaps: DataFrame, menu: DataFrame, shelves: DataFrame, screened: DataFrame) -> DataFrame:
    """book, role, held, shown, also: a line for each gap role, with its funds and their verdicts, and the shelves not shown.

    gaps: book, role, exposure; menu: book, role, place, ticker, flavor; shelves: book, role, flavor, n; screened: ticker, verdict.
    Roles with neither funds nor shelves are left out.
    """
    fund = F.struct("place", F.concat_ws(" ", "ticker", F.coalesce("verdict", F.lit("N/A"))).alias("text"))
    listed = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["text"]), " · ")
    shown = menu.join(screened.select("ticker", "verdict"), "ticker", "left").groupBy("book", "role").agg(listed(fund).alias("shown"))
    shelf = F.struct(F.col("flavor").alias("place"), F.concat(F.when(F.col("flavor") == "", "(unnamed)").otherwise(F.col("flavor")), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("text"))
    also = shelves.groupBy("book", "role").agg(listed(shelf).alias("also"))
    out = gaps.join(shown, ["book", "role"], "left").join(also, ["book", "role"], "left").where("shown is not null or also is not null")
    return out.select("book", "role", F.concat(fixed(F.col("exposure") * 100, 0), F.lit("%")).alias("held"), F.coalesce("shown", F.lit("")).alias("shown"), F.coalesce("also", F.lit("")).alias("also"))


def returns_lines(summary: DataFrame, left_out: DataFrame, key: str = "book") -> DataFrame:
    """key, place, metric, v: a book's returns as texts, of returns.summary and of the tickers that are left out (key, ticker).

    Where the period is too short for a year's time-weighted return, what it came to so far is told, and only there. The
    last row names the tickers that time-weighted returns and risk leave out, if there are any.
    """
    n_a = lambda c: signed_percent(F.col(c))
    days = F.datediff("asof_date", "period_start")
    period = F.concat(F.col("period_start").cast("string"), F.lit(" to "), F.col("asof_date").cast("string"), F.lit(" ("), days.cast("string"), F.lit(" days, "), fixed(days / 365.25, 2), F.lit(" years)"))
    names = left_out.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("ticker")), ", ").alias("left_out"))
    short = F.col("twr").isNull() & F.col("twr_cumulative").isNotNull()
    rows = [("Period", period), ("Time-weighted", n_a("twr")), ("Time-weighted so far, not for a year", F.when(short, n_a("twr_cumulative"))), ("Money-weighted", n_a("money_weighted")), ("Modified Dietz", n_a("modified_dietz")), ("Left out of time-weighted returns and risk", F.col("left_out"))]
    texts = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("metric"), v.alias("v")) for k, (name, v) in enumerate(rows)])
    return summary.join(names, key, "left").select(key, F.explode(texts).alias("e")).select(key, "e.*").where("v is not null")


def leg_panel(panels: DataFrame, finals: DataFrame) -> DataFrame:
    """leg, place, metric, v: the rows that describe a leg, as texts: each risk metric and its interval, the year's return and the final value.

    panels: drawdown.panel with key leg; finals: leg, annualized, final_value.
    """
    pct = lambda c, digits, plus=False: F.concat(fixed(F.col(c) * 100, digits, plus), F.lit("%"))
    both = lambda a, shown, b: F.concat(shown(a), F.lit(" .. "), shown(b))
    number = lambda c: fixed(F.col(c), 2, plus=True)
    rows = []
    for name, m in (("Max drawdown", "max_drawdown"), ("Ulcer index", "ulcer"), ("CDaR (worst 5%)", "cdar")):
        rows += [(name, m, pct(m, 2, m == "max_drawdown")), (f"{name} 95% CI", m, both(f"{m}_low", lambda c: pct(c, 1), f"{m}_high"))]
    for name, m in (("Sharpe", "sharpe"), ("Sortino", "sortino"), ("Calmar", "calmar")):
        rows += [(name, m, number(m)), (f"{name} 95% CI", m, both(f"{m}_low", number, f"{m}_high"))]
    rows += [("Annualized return", "annualized", pct("annualized", 2, True)), ("Final value", "final_value", dollars(F.col("final_value")))]
    texts = [F.struct(F.lit(k).alias("place"), F.lit(name).alias("metric"), F.when(F.col(c).isNull(), "n/a").otherwise(v).alias("v")) for k, (name, c, v) in enumerate(rows)]
    return panels.join(finals, "leg").select("leg", F.explode(F.array(*texts)).alias("e")).select("leg", "e.*")


def provenance(latest: DataFrame, today: Column) -> DataFrame:
    """One row: prices by source, first and last close day, oldest fetch, and whether the newest close lags."""
    by = F.count_if
    out = latest.agg(F.count(F.lit(1)).alias("n"), by(F.col("source") == "cache").alias("n_cache"), F.sort_array(F.collect_set("source")).alias("sources"), F.min("asof_date").alias("first_close"), F.max("asof_date").alias("last_close"), F.min("fetched_at").alias("oldest_fetch"))
    lag = F.datediff(today, F.col("last_close"))
    return out.withColumns({"lag_days": lag, "flagged": lag > LAG_FLAG_DAYS, "alarm": lag > LAG_ALARM_DAYS})


def proposal(target: DataFrame, held_weights: DataFrame, key: str = "book") -> DataFrame:
    """key, ticker, w, cur_w, delta of a proposed target (key, ticker, w), and holdings that it leaves out with w 0."""
    both = target.join(held_weights.withColumnRenamed("w", "cur_w"), [key, "ticker"], "full")
    return both.select(key, "ticker", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("cur_w", F.lit(0.0)).alias("cur_w"), (F.coalesce("w", F.lit(0.0)) - F.coalesce("cur_w", F.lit(0.0))).alias("delta"), F.col("w").isNull().alias("omitted"))


def render(title: str, rows: list[dict], kind: str = "text") -> str:
    """A panel's collected rows as text, markdown or HTML. Panels have a few rows for each holding of one book."""
    cells = [[str(v) if v is not None else "n/a" for v in r.values()] for r in rows]
    head = list(rows[0]) if rows else []
    if kind == "html":
        row = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in xs) + "</tr>"
        return f"<h2>{html.escape(title)}</h2><table>{row('th', head)}{''.join(row('td', x) for x in cells)}</table>"
    if kind == "markdown":
        line = lambda xs: "| " + " | ".join(x.replace("|", "\\|") for x in xs) + " |"
        return "\n".join([f"## {title}", "", line(head), line(["-"] * len(head)), *map(line, cells)])
    wide = [max(len(x[k]) for x in [head, *cells]) for k in range(len(head))]
    return "\n".join([title, *("  ".join(v.ljust(n) for v, n in zip(x, wide, strict=True)).rstrip() for x in [head, *cells])])

"""Rule tables over fund facts and series: candidate checks and their verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite, fixed, ratio
from tidemark.operators import drawdown
from tidemark.operators.scan import running
from tidemark.sources.shared import keep

# Thresholds of the checks.
COST = (0.0020, 0.0050)
LEAST_AUM, LEAST_VOLUME = 1e8, 1e5
AGE_YEARS = (1.0, 3.0)
MOST_TOP = 0.50
RHO = (0.60, 0.85)
RHO_RISE = 0.15
OVERLAP = (0.40, 0.70)
#: Digits to which falls and overlaps are compared: sums of equal figures in other orders are ties, which go by name or day.
DIGITS = 12
LEAST_COMMON, LEAST_RED = 60, 20
OWN_DEPTH, OWN_YEARS = -0.30, 2.0
STATUS_ORDER = ("n/a", "pass", "warn", "fail")


def structure(category: Column, legal: Column) -> Column:
    """Leveraged, inverse and trading funds and notes fail; n/a without facts."""
    c, text = F.lower(category), F.lower(legal)
    bad = F.coalesce(c.contains("trading--") | c.contains("leveraged") | c.contains("inverse"), F.lit(False)) | F.coalesce(text.contains("note"), F.lit(False))
    return F.when(category.isNull() & legal.isNull(), "n/a").when(bad, "fail").otherwise("pass")


def cost(expense: Column) -> Column:
    return F.when(expense.isNull(), "n/a").when(expense <= COST[0], "pass").when(expense <= COST[1], "warn").otherwise("fail")


def liquidity(aum: Column, volume: Column) -> Column:
    """Small in both fails, in one warns; n/a if neither is known."""
    small, thin = F.coalesce(aum < LEAST_AUM, F.lit(False)), F.coalesce(volume < LEAST_VOLUME, F.lit(False))
    return F.when(aum.isNull() & volume.isNull(), "n/a").when(small & thin, "fail").when(small | thin, "warn").otherwise("pass")


def age_years(inception: Column, today: Column) -> Column:
    return F.greatest(F.datediff(today, inception), F.lit(0)) / 365.25


def age(inception: Column, today: Column) -> Column:
    y = age_years(inception, today)
    return F.when(inception.isNull(), "n/a").when(y < AGE_YEARS[0], "fail").when(y < AGE_YEARS[1], "warn").otherwise("pass")


def concentration(top: Column) -> Column:
    return F.when(top.isNull(), "n/a").when(top > MOST_TOP, "warn").otherwise("pass")


def _percent(x: Column, digits: int, plus: bool = False) -> Column:
    return F.concat(fixed(x * 100, digits, plus), F.lit("%"))


def fact_rows(facts: DataFrame, today: Column) -> DataFrame:
    """ticker, check, status, reason of the checks that facts alone decide (one row for each)."""
    c, legal, expense, aum, volume, inception, top = (F.col(x) for x in ("category", "legal_type", "expense_ratio", "aum", "avg_volume", "inception", "top_share"))
    said = lambda x, *parts: F.when(x.isNull(), "not published").otherwise(F.concat(*parts))
    odd = structure(c, F.lit(None).cast("string")) == "fail"
    size = F.coalesce(F.concat(F.lit("$"), fixed(aum / 1e6, 0, commas=True), F.lit("M")), F.lit("size unknown"))
    traded = F.coalesce(F.concat(fixed(volume, 0, commas=True), F.lit(" shares a day")), F.lit("volume unknown"))
    liquid = liquidity(aum, volume)
    years = age_years(inception, today)
    made = {
        "structure": (structure(c, legal), F.when(c.isNull() & legal.isNull(), "not published").when(F.coalesce(odd, F.lit(False)), F.concat(c, F.lit(": leveraged, inverse or trading"))).when(structure(c, legal) == "fail", F.concat(legal, F.lit(": a note, not a fund"))).otherwise(F.coalesce(legal, c))),
        "cost": (cost(expense), said(expense, _percent(expense, 2), F.when(expense <= COST[0], " a year").when(expense <= COST[1], " a year, not cheap").otherwise(" a year, expensive"))),
        "liquidity": (liquid, F.when(liquid == "n/a", "not published").otherwise(F.concat(size, F.lit(", "), traded, F.when(liquid == "fail", ": both too small").when(liquid == "warn", ": one too small").otherwise("")))),
        "age": (age(inception, today), said(inception, fixed(years, 1), F.when(years < AGE_YEARS[0], " years, too young").when(years < AGE_YEARS[1], " years, young").otherwise(" years"))),
        "concentration": (concentration(top), said(top, F.lit("largest holdings "), _percent(top, 0), F.when(top > MOST_TOP, ", concentrated").otherwise(""))),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status"), r.alias("reason")) for k, (v, r) in made.items()])).alias("c")
    return facts.select("ticker", rows).select("ticker", "c.check", "c.status", "c.reason")


def fact_checks(facts: DataFrame, today: Column) -> DataFrame:
    """ticker, check, status of fact_rows."""
    return fact_rows(facts, today).drop("reason")


def roll_up(checks: DataFrame) -> DataFrame:
    """ticker, verdict (the worst status: fail, warn, pass, n/a) and the number of each."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    count = lambda s: F.count_if(F.col("status") == s)
    out = checks.groupBy("ticker").agg(F.max(rank).alias("worst"), count("fail").alias("n_fail"), count("warn").alias("n_warn"), count("pass").alias("n_pass"), count("n/a").alias("n_na"))
    return out.select("ticker", F.get(F.array(*[F.lit(s) for s in STATUS_ORDER]), (F.col("worst") - 1).cast("int")).alias("verdict"), "n_fail", "n_warn", "n_pass", "n_na")


def correlation(pairs: DataFrame, key: str) -> DataFrame:
    """key, n, rho of pairs (key, c, p) by centred moments; NULL where either does not vary."""
    mean = Window.partitionBy(key)
    dc, dp = F.col("c") - F.avg("c").over(mean), F.col("p") - F.avg("p").over(mean)
    sums = pairs.select(key, dc.alias("dc"), dp.alias("dp")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dc") * F.col("dp")).alias("cp"), F.sum(F.col("dc") ** 2).alias("cc"), F.sum(F.col("dp") ** 2).alias("pp"))
    return sums.select(key, "n", F.when((F.col("cc") > 0) & (F.col("pp") > 0), ratio(F.col("cp"), F.sqrt(F.col("cc") * F.col("pp")))).alias("rho"))


FAR = "9999-12-31"


def _as_of_cuts(cuts: DataFrame, context: DataFrame, value: str) -> DataFrame:
    """cut and the last value at or before it, of distinct cuts and of a context (d, value) of one row a day."""
    both = context.select(F.lit(0).alias("one"), "d", value, F.lit(0).alias("is_cut")).unionByName(cuts.select("cut").distinct().select(F.lit(0).alias("one"), F.col("cut").alias("d"), F.lit(None).cast(context.schema[value].dataType).alias(value), F.lit(1).alias("is_cut")))
    found = running(both, ("one",), {"last_": ("last", F.col(value))}, ties=("is_cut",)).where("is_cut = 1")
    return found.select(F.col("d").alias("cut"), F.col("last_").alias(value))


def book_falls(book: DataFrame) -> DataFrame:
    """d, fall (depth, trough, peak): the book's deepest fall up to each day, of its returns (d, r): one run for any number of cut-offs."""
    levels = drawdown.with_base(book.select(F.lit(0).alias("one"), "d", "r"), "one")
    topped = running(levels, ("one",), {"top": ("max", F.struct("x", (-F.unix_date("d")).alias("back")))})
    drop = F.struct((ratio(F.col("x"), F.col("top.x")) - 1).alias("depth"), F.col("d").alias("trough"), F.date_from_unix_date(-F.col("top.back")).alias("peak"))
    return running(topped.select("one", "d", drop.alias("drop")), ("one",), {"fall": ("min", F.col("drop"))}).select("d", "fall")


def held_falls(series: DataFrame, held: DataFrame) -> DataFrame:
    """d, worst (level, peer, depth): the deepest fall of any held fund up to each day (series: ticker, d, dd; held: ticker); of equal ones the first ticker's."""
    by_day = series.join(held.select("ticker").distinct(), "ticker", "left_semi").groupBy("d").agg(F.min(F.struct(F.round("dd", DIGITS).alias("level"), F.col("ticker").alias("peer"), F.col("dd").alias("depth"))).alias("day"))
    return running(by_day.withColumn("one", F.lit(0)), ("one",), {"worst": ("min", F.col("day"))}).select("d", "worst")


def with_falls(closes: DataFrame) -> DataFrame:
    """ticker, d, close, r, dd of closes: the change to the close before, and how far a close lies below the highest so far."""
    line = Window.partitionBy("ticker").orderBy("d")
    own = running(closes.select("ticker", "d", "close"), ("ticker",), {"top_": ("max", F.col("close"))})
    return own.select("ticker", "d", "close", (ratio(F.col("close"), F.lag("close").over(line)) - 1).alias("r"), (ratio(F.col("close"), F.col("top_")) - 1).alias("dd"))


def series_figures(series: DataFrame, cuts: DataFrame, book: DataFrame) -> DataFrame:
    """ticker, cut, fall, n, rho, n_red, red_rho, dd_return, years, depth, trough of every candidate, from its days up to its cut.

    series: as with_falls, of candidates; cuts: ticker, cut; book: d, r. Every figure is an aggregate of one pass over the
    candidates' days beside the book's of the same day; what the book had fallen by then is looked up for each cut.
    """
    falls = _as_of_cuts(cuts, book_falls(book), "fall")
    asked = cuts.join(falls, "cut", "left")
    days = series.join(asked, "ticker").where("d <= cut").join(book.select("d", F.col("r").alias("p")), "d", "left")
    both = F.col("r").isNotNull() & F.col("p").isNotNull()
    c, p = F.when(both, F.col("r")), F.when(both, F.col("p"))
    red = p < 0
    through = both & F.col("d").between(F.col("fall.peak"), F.col("fall.trough"))
    sums = days.groupBy("ticker").agg(
        F.max("cut").alias("cut"), F.first("fall", ignorenulls=True).alias("fall"), F.count_if(both).alias("n"), F.corr(c, p).alias("rho"), F.count_if(red).alias("n_red"), F.corr(F.when(red, c), F.when(red, p)).alias("red_rho"),
        F.product(F.when(through, 1 + c)).alias("through"), F.min("d").alias("from"), F.max("d").alias("to"), F.min(F.struct(F.round("dd", DIGITS).alias("level"), "d", "dd")).alias("deep"),
    )
    return sums.select("ticker", "cut", "fall", "n", finite(F.col("rho")).alias("rho"), "n_red", F.when(F.col("n_red") >= LEAST_RED, finite(F.col("red_rho"))).alias("red_rho"), (F.col("through") - 1).alias("dd_return"), (F.datediff("to", "from") / 365.25).alias("years"), F.col("deep.dd").alias("depth"), F.col("deep.d").alias("trough"))


def diversifier_status(n: Column, rho: Column, red_rho: Column) -> Column:
    return F.when((n < LEAST_COMMON) | rho.isNull(), "n/a").when(rho > RHO[1], "fail").when((rho > RHO[0]) | F.coalesce(red_rho - rho > RHO_RISE, F.lit(False)), "warn").otherwise("pass")


def diversifier(candidates: DataFrame, book: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """ticker, n, rho, red_rho, dd_return and status: do candidates' returns (ticker, d, r) move unlike the book's (d, r)?

    dd_return is the return through the book's deepest fall. The correlation on the book's red days needs LEAST_RED of
    them, and turns a pass into a warning if it lies far above the other. cuts (ticker, cut): the last day that is looked
    at for a candidate, in its own returns and in the book's; candidates without one see everything. Candidates without
    a day in common have no row.
    """
    far = F.lit(FAR).cast("date")
    asked = candidates.select("ticker").distinct()
    own = asked.withColumn("cut", far) if cuts is None else asked.join(cuts, "ticker", "left").withColumn("cut", F.coalesce("cut", far))
    found = series_figures(candidates.withColumn("dd", F.lit(0.0)), own, book).where("n > 0")
    return found.select("ticker", "n", "rho", "red_rho", "dd_return", diversifier_status(F.col("n"), F.col("rho"), F.col("red_rho")).alias("status"))


def _deeper(depth: Column, held_worst: Column) -> Column:
    return (held_worst < 0) & (F.round(depth, DIGITS) < F.round(held_worst, DIGITS))


def own_drawdown_status(years: Column, depth: Column, held_worst: Column) -> Column:
    return F.when(years < OWN_YEARS, "n/a").when(depth >= 0, "pass").when(_deeper(depth, held_worst), "warn").when(depth <= OWN_DEPTH, "warn").otherwise("pass")


def own_drawdown(levels: DataFrame, held_worst: Column) -> DataFrame:
    """ticker, years, depth and status: the candidates' own worst falls (levels: ticker, d, x) against the worst of what is held."""
    deep = drawdown.curve(levels, "ticker").groupBy("ticker").agg((F.datediff(F.max("d"), F.min("d")) / 365.25).alias("years"), F.min("dd").alias("depth"))
    return deep.withColumn("status", own_drawdown_status(F.col("years"), F.col("depth"), held_worst))


def overlaps(candidates: DataFrame, held: DataFrame, look_through: DataFrame) -> DataFrame:
    """ticker, held_ticker, overlap and status: the most that a candidate's holdings share with those of a held fund.

    candidates and held: ticker, category; look_through: ticker, symbol, w. The shared weight is the sum of the smaller
    weights of common symbols, 0 if both sides are known and share nothing; of equal ones the first ticker counts. Where
    a side has no look-through holdings overlap is NULL: then a held fund of the same category is a warning, and without
    one nothing can be said.
    """
    own = candidates.select("ticker").distinct().join(look_through, "ticker").select("ticker", "symbol", F.col("w").alias("a"))
    theirs = held.select("ticker").distinct().join(look_through, "ticker").select(F.col("ticker").alias("held_ticker"), "symbol", F.col("w").alias("b"))
    sums = own.join(theirs, "symbol").groupBy("ticker", "held_ticker").agg(F.sum(F.least("a", "b")).alias("overlap"))
    best = sums.groupBy("ticker").agg(F.max(F.round("overlap", DIGITS)).alias("overlap"), F.min_by("held_ticker", F.struct(-F.round("overlap", DIGITS), F.col("held_ticker"))).alias("best_ticker"))
    known = own.select("ticker").distinct().withColumn("known", F.lit(True))
    comparable = theirs.agg((F.count(F.lit(1)) > 0).alias("comparable"))
    same = held.where("trim(category) <> ''").groupBy("category").agg(F.min("ticker").alias("same_ticker"))
    out = candidates.groupBy("ticker").agg(F.min("category").alias("category")).join(known, "ticker", "left").join(best, "ticker", "left").join(same, "category", "left").crossJoin(F.broadcast(comparable))  # one row
    out = out.withColumn("overlap", F.when(F.col("known") & F.col("comparable"), F.coalesce("overlap", F.lit(0.0))))
    shared = F.when(F.col("overlap") >= OVERLAP[1], "fail").when(F.col("overlap") >= OVERLAP[0], "warn").otherwise("pass")
    status = F.when(F.col("overlap").isNotNull(), shared).when(F.col("same_ticker").isNotNull(), "warn").otherwise("n/a")
    return out.select("ticker", F.when(F.col("overlap").isNotNull(), F.col("best_ticker")).otherwise(F.col("same_ticker")).alias("held_ticker"), "overlap", status.alias("status"))


def novelty(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """ticker, check, status: a failure for every candidate that is held already, nothing for the others."""
    return candidates.select("ticker").distinct().join(held.select("ticker").distinct(), "ticker", "left_semi").select("ticker", F.lit("novelty").alias("check"), F.lit("fail").alias("status"))


def cutoffs(candidates: DataFrame, book_end: DataFrame, judged: DataFrame) -> DataFrame:
    """ticker, cut: the last day that may be looked at when candidates are chosen, so that choosing never sees held-out days.

    The earlier of the book's own in-sample end (book_end: one row, in_sample_end) and that of the candidate's role check
    (judged: ticker, in_sample_end); NULL where there is neither.
    """
    return candidates.select("ticker").distinct().join(judged.select("ticker", F.col("in_sample_end").alias("own_end")), "ticker", "left").crossJoin(F.broadcast(book_end.select("in_sample_end"))).select("ticker", F.least("own_end", "in_sample_end").alias("cut"))  # one row


def screen(candidates: DataFrame, facts: DataFrame, held: DataFrame, look_through: DataFrame, closes: DataFrame, book: DataFrame, today: Column, role: DataFrame | None = None, book_end: DataFrame | None = None) -> DataFrame:
    """ticker, check, status, reason of every check of every candidate.

    candidates: ticker; held: ticker; facts: as in fact_rows, and look_through: of candidates and held funds, in one table
    each; closes: ticker, d, close, of both; book: d, r. A fall is held against the deepest one that any held fund had
    had by then. With role (ticker, verdict, in_sample_end, and reason if there is one) the screen stands before a
    held-out verdict: checks of returns then end at the cut-off of cutoffs(), which their reasons name, and the verdict is
    a check itself. Without, everything is looked at. A candidate without facts or prices gets n/a where they are needed.
    Closes are read once and run through once; all figures of a candidate come from one aggregation.
    """
    asked = candidates.select("ticker").distinct()
    known = asked.join(facts, "ticker", "left")
    far = F.lit(FAR).cast("date")
    cuts = asked.withColumn("cut", far) if role is None else cutoffs(asked, book_end, role).withColumn("cut", F.coalesce("cut", far))
    series = keep(with_falls(closes.join(asked.unionByName(held.select("ticker")).distinct(), "ticker", "left_semi")), "series")
    cuts = keep(cuts, "cuts")
    figures = series_figures(series, cuts, book).join(_as_of_cuts(cuts, held_falls(series, held), "worst"), "cut", "left")
    note = F.when(F.col("cut") < far, F.concat(F.lit(" [in-sample through "), F.col("cut").cast("string"), F.lit("]"))).otherwise("")
    none = F.lit("no usable price history")
    n, rho, red, depth, peer = F.col("n"), F.col("rho"), F.col("red_rho"), F.col("depth"), F.col("worst.depth")
    moves = F.concat(
        F.lit("correlation "), fixed(rho, 2, plus=True), F.lit(" over "), n.cast("string"), F.lit(" days"), F.coalesce(F.concat(F.lit(", "), fixed(red, 2, plus=True), F.lit(" on red ones")), F.lit("")),
        F.coalesce(F.concat(F.lit("; "), _percent(F.col("dd_return"), 1, True), F.lit(" while the book fell "), _percent(F.col("fall.depth"), 1), F.lit(" from "), F.col("fall.peak").cast("string"), F.lit(" to "), F.col("fall.trough").cast("string")), F.lit("")),
    )
    moves = F.when(n.isNull(), None).when(n < LEAST_COMMON, F.concat(F.lit("only "), n.cast("string"), F.lit(" common days"))).when(rho.isNull(), "nothing varies").otherwise(moves)
    status = own_drawdown_status(F.col("years"), depth, peer)
    fell = F.concat(F.lit("fell "), _percent(depth, 1), F.lit(" by "), F.col("trough").cast("string"), F.lit(" in "), fixed(F.col("years"), 1), F.lit(" years"))
    against = F.when(_deeper(depth, peer), F.concat(F.lit(", deeper than all that is held, "), F.col("worst.peer"), F.lit(" with "), _percent(peer, 1))).when(peer < 0, F.concat(F.lit("; "), F.col("worst.peer"), F.lit(" of what is held fell "), _percent(peer, 1)))
    falls = F.when(F.col("years") < OWN_YEARS, F.concat(F.lit("only "), fixed(F.col("years"), 1), F.lit(" years of history"))).when(depth >= 0, "no fall").otherwise(F.concat(fell, F.coalesce(against, F.lit(""))))
    rows = F.explode(F.array(
        F.struct(F.lit("diversifier").alias("check"), F.coalesce(diversifier_status(n, rho, red), F.lit("n/a")).alias("status"), F.coalesce(F.concat(moves, note), none).alias("reason")),
        F.struct(F.lit("own_drawdown").alias("check"), F.coalesce(status, F.lit("n/a")).alias("status"), F.coalesce(F.concat(falls, note), none).alias("reason")),
    )).alias("c")
    priced = asked.join(figures, "ticker", "left").select("ticker", rows).select("ticker", "c.*")
    priced = priced.withColumn("status", F.when(F.col("reason") == none, "n/a").otherwise(F.col("status")))
    lap = overlaps(known.select("ticker", "category"), held.join(facts, "ticker", "left").select("ticker", "category"), look_through)
    share = F.when(F.col("overlap") == 0, "nothing in common with what is held").otherwise(F.concat(_percent(F.col("overlap"), 0), F.lit(" in common with "), F.col("held_ticker")))
    shared = F.when(F.col("overlap").isNotNull(), share).when(F.col("held_ticker").isNotNull(), F.concat(F.lit("of the same category as "), F.col("held_ticker"))).otherwise("no holdings to compare")
    out = fact_rows(known, today).unionByName(novelty(asked, held).withColumn("reason", F.lit("held already"))).unionByName(priced)
    out = out.unionByName(lap.select("ticker", F.lit("overlap").alias("check"), "status", shared.alias("reason")))
    if role is None:
        return out
    word = F.col("reason") if "reason" in role.columns else F.col("verdict")
    judged = asked.join(role.select("ticker", role_row(F.col("verdict")).alias("status"), word.alias("reason")), "ticker", "left")
    return out.unionByName(judged.select("ticker", F.lit("role").alias("check"), F.coalesce("status", F.lit("n/a")).alias("status"), F.coalesce("reason", F.lit("no role check")).alias("reason")))


def role_row(verdict: Column) -> Column:
    """The check that a held-out role verdict becomes."""
    return F.when(verdict == "improved", "pass").when(verdict == "worsened", "fail").otherwise("n/a")

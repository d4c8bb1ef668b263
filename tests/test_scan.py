"""Blocked scans, and the operators that run over long series in blocks, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import align, drawdown, ledger, returns, scan, screen

D = dt.date(2020, 1, 1)


def series(seed, kind):
    r = random.Random(seed)
    at = {"date": lambda n: D + dt.timedelta(days=n), "timestamp": lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=97 * n), "long": lambda n: 5 * n - 300}[kind]
    rows = [(k, at(n), r.choice([None, 0.5 + r.random(), 1.0, 1.0])) for k in ("a", "b", None) for n in sorted(r.sample(range(400), 150))]
    return [*rows, ("c", at(7), None), ("d", at(3), 2.0)]


def plain(rows, kind, backward, before_only):
    out = {}
    for k in {r[0] for r in rows}:
        so_far = None
        for row in sorted((r for r in rows if r[0] == k), key=lambda r: r[1], reverse=backward):
            new = so_far
            if row[2] is not None:
                joined = {"product": lambda a, b: a * b, "sum": lambda a, b: a + b, "max": max, "min": min, "last": lambda a, b: b}[kind]
                new = row[2] if so_far is None else joined(so_far, row[2])
            out[row[:2]] = so_far if before_only else new
            so_far = new
    return out


@pytest.mark.parametrize("order", ["date", "timestamp", "long"])
@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("before_only", [False, True])
def test_running(spark, order, backward, before_only):
    rows = series(1, order)
    df = spark.createDataFrame(rows, f"k string, d {order}, x double").repartition(5)
    kinds = ("product", "sum", "max", "min", "last")
    got = scan.running(df, ("k",), {f"r_{k}": (k, F.col("x")) for k in kinds}, backward=backward, before_only=before_only, width=37 if order == "date" else None if order == "long" else 600)
    assert got.columns == ["k", "d", "x", *[f"r_{k}" for k in kinds]]
    expected = {k: plain(rows, k, backward, before_only) for k in kinds}
    found = got.collect()
    assert len(found) == len(rows)
    for row in found:
        for k in kinds:
            want = expected[k][row["k"], row["d"]]
            assert row[f"r_{k}"] == (want if want is None else pytest.approx(want, rel=1e-12))


def test_one_long_series_is_spread_over_tasks(spark):
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.col("id").alias("d"), (1 + (F.xxhash64("id") % 1000) / 1e7).alias("x"))
    out = scan.running(df, ("k",), {"p": ("product", F.col("x")), "m": ("max", F.col("x"))}, width=1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 200_000 and len(sizes) == 4 and max(sizes) < 100_000
    whole = scan.running(df, ("k",), {"p": ("product", F.col("x")), "m": ("max", F.col("x"))}, width=10**9)
    a, b = (t.where("d % 9973 = 0").orderBy("d").collect() for t in (out, whole))
    assert [(x["d"], x["m"]) for x in a] == [(x["d"], x["m"]) for x in b]
    assert all(x["p"] == pytest.approx(y["p"], rel=1e-12) for x, y in zip(a, b, strict=True))


def test_operators_in_blocks_of_days(spark):
    r = random.Random(4)
    prices = spark.createDataFrame([(t, D + dt.timedelta(days=n), 50 + 10 * r.random()) for t in "AB" for n in sorted(r.sample(range(300), 120))], "ticker string, d date, close double")
    grid = spark.createDataFrame([(t, D + dt.timedelta(days=n)) for t in "ABC" for n in range(-5, 310, 3)], "ticker string, d date")
    rounded = lambda df: sorted(map(str, (tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in df.collect())))
    splits = spark.createDataFrame([("A", D + dt.timedelta(days=60), 2.0), ("A", D + dt.timedelta(days=200), 1.5), ("A", D, 0.0), ("B", D + dt.timedelta(days=10), 3.0)], "ticker string, d date, ratio double")
    levels = prices.withColumnRenamed("close", "x")
    pairs = [
        lambda w: align.asof_fill(prices, grid, width=w),
        lambda w: align.snap_forward(grid, prices.select("ticker", "d"), ("ticker",), width=w),
        lambda w: align.snap_forward(grid.withColumn("n", F.lit(1)), prices.select("ticker", "d"), ("ticker",), clamp=True, width=w),
        lambda w: ledger.later_splits(grid, splits, w),
        lambda w: ledger.reverse_adjusted(prices.withColumn("split_factor", F.lit(1.01)), w),
        lambda w: drawdown.curve(levels, "ticker", w),
        lambda w: drawdown.max_drawdown(levels, "ticker", w),
        lambda w: returns.growth_index(prices.select("ticker", "d", (F.col("close") / 1000).alias("r")), "ticker", w),
    ]
    for f in pairs:
        assert rounded(f(None)) == rounded(f(20))


def value_by_day(rows, closes):
    """Values, day by day, of the trades at the prices so far; trades count from the first day with a price on."""
    own = {t for t, *_ in rows}
    start = min(d for _, d, _ in rows)
    days = sorted({d for t, d, _ in closes if t in own and d >= start})
    snapped = [(t, next((x for x in days if x >= d), None), q) for t, d, q in rows]
    out = {}
    for day in days:
        total = 0.0
        for t in own:
            shares = sum(q for u, d, q in snapped if u == t and d is not None and d <= day)
            known = [(d, c) for u, d, c in closes if u == t and d <= day]
            total += shares * max(known)[1] if known else 0.0
        out[day] = total
    return out


@pytest.mark.parametrize("width", [None, 15])
def test_value_from_changes_equals_the_sum_of_holdings(spark, width):
    r = random.Random(8)
    closes = [(t, D + dt.timedelta(days=n), round(20 + 5 * r.random(), 3)) for t in "ABCD" for n in sorted(r.sample(range(20 if t == "D" else 90), 15))]
    rows = [(t, D + dt.timedelta(days=r.randrange(-3, 95)), float(r.choice([5, 3, 8, -2, -1]))) for t in "ABD" for _ in range(12)]
    df = spark.createDataFrame([("b", t, d, "buy" if q > 0 else "sell", abs(q), 20.0, 0.0, 0.0) for t, d, q in rows] + [("b", "Z", D, "buy", 1.0, 1.0, 0.0, 0.0)], "book string, ticker string, d date, action string, quantity double, price double, fee double, cash double")
    px = spark.createDataFrame(closes, "ticker string, d date, close double")
    got = {x["d"]: x["v"] for x in returns.book_days(df, px, width).collect()}
    expected = value_by_day(rows, closes)
    assert got.keys() == expected.keys()
    assert all(got[d] == pytest.approx(expected[d], abs=1e-6) for d in got)


def test_values_are_exactly_nothing_when_all_is_sold(spark):
    rows = [("b", "A", D, "buy", 0.1), ("b", "A", D + dt.timedelta(days=1), "buy", 0.2), ("b", "A", D + dt.timedelta(days=3), "sell", 0.3)]
    df = spark.createDataFrame([(*x, 7.0, 0.0, 0.0) for x in rows], "book string, ticker string, d date, action string, quantity double, price double, fee double, cash double")
    px = spark.createDataFrame([("A", D + dt.timedelta(days=n), 1000.0 + n / 3) for n in range(8)], "ticker string, d date, close double")
    got = {x["d"]: x["v"] for x in returns.book_days(df, px).collect()}
    assert got[D + dt.timedelta(days=7)] == 0.0 and got[D] == 100.0
    plan = returns.book_days(df, px)._jdf.queryExecution().optimizedPlan().toString()
    assert "wanted" not in plan


def folded(rows):
    """shares, cost, profit, fees and whether a row was left out, of rows (action, quantity, price, fee, cash) in order."""
    s = c = r = f = 0.0
    broken = False
    for action, q, price, fee, cash in rows:
        if action == "buy":
            s, c = s + q, c + q * price + fee
        elif action == "sell":
            if s <= 0 or q > s + 1e-9:
                broken = True
                continue
            cost = q * c / s
            r += q * price - cost - fee
            s, c = (0.0, 0.0) if s - q < 1e-9 else (s - q, c - cost)
        elif action == "fee":
            r -= fee
        else:
            r += cash - fee
        f += fee
    return s, c, r, f, broken


LEDGER = "book string, ticker string, ord long, d date, action string, quantity double, price double, fee double, cash double"


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_holdings_in_stretches(spark, width):
    r = random.Random(width)
    rows, expected = [], {}
    for h in range(40):
        own, have = [], 0.0
        for _ in range(r.randrange(1, 60)):
            action = r.choice(["buy", "sell", "sell", "dividend", "fee", "interest"])
            q = round(r.random() * 10, 2)
            if action == "sell" and h % 4 and have > 0:  # one holding in four breaks the contract now and then
                q = have if r.random() < 0.2 else min(q, have)
            elif action == "sell" and h % 4:
                action = "buy"
            have += q if action == "buy" else -q if action == "sell" else 0
            own.append((action, q, round(r.random() * 100, 2), round(r.random(), 2), round(r.random() * 5, 2)))
        key = ("b" if h % 3 else None, f"T{h}")
        expected[key] = folded(own)
        rows += [(*key, 1000 * h + k, D + dt.timedelta(days=k), *x) for k, x in enumerate(own)]
    r.shuffle(rows)
    got = ledger.positions(spark.createDataFrame(rows, LEDGER).repartition(3), width=width).collect()
    assert len(got) == len(expected)
    for x in got:
        *figures, broken = expected[x["book"], x["ticker"]]
        assert [x[c] for c in ("shares", "cost_basis", "realized", "fees")] == pytest.approx(figures, rel=1e-9, abs=1e-7)
        assert (x["error"] is not None) == broken


@pytest.mark.parametrize("width", [2, 4096])
def test_stretches_name_the_first_broken_row_and_take_missing_figures_as_before(spark, width):
    day = lambda k: D + dt.timedelta(days=k)
    rows = [("b", "A", k, day(k), "buy", 1.0, 10.0, 0.0, 0.0) for k in range(6)]
    rows += [("b", "A", 6, day(6), "sell", 7.0, 10.0, 1.0, 0.0), ("b", "A", 7, day(7), "sell", 6.0, 12.0, 1.0, 0.0), ("b", "A", 8, day(8), "sell", 1.0, 1.0, 0.0, 0.0), ("b", "A", 9, day(9), "buy", 2.0, 5.0, 0.0, 0.0)]
    rows += [("b", "N", 1, day(1), "buy", 1.0, 10.0, 0.0, 0.0), ("b", "N", 2, day(2), "buy", None, 10.0, 0.5, 0.0), ("b", "N", 3, day(3), "fee", None, None, 0.25, None), (None, "N", 4, day(3), "dividend", None, None, None, 1.0)]
    rows += [("b", "D", 1, day(1), "deposit", 0.0, 0.0, 0.0, 5.0), ("b", "CASH", 2, day(2), "buy", 1.0, 1.0, 0.0, 0.0), ("b", "A", None, day(0), "dividend", 0.0, 0.0, 0.0, 3.0)]
    got = {(x["book"], x["ticker"]): x for x in ledger.positions(spark.createDataFrame(rows, LEDGER), width=width).collect()}
    a = got["b", "A"]
    assert (a["shares"], a["cost_basis"], a["fees"]) == (2.0, 10.0, 1.0) and a["realized"] == pytest.approx(3 + 72 - 60 - 1)
    assert a["error"] == f"more is sold than is held on {day(6)}"
    n = got["b", "N"]
    assert n["shares"] is None and n["cost_basis"] is None and n["realized"] == -0.25 and n["fees"] == 0.75
    assert got[None, "N"]["realized"] is None
    assert got["b", "D"]["error"].startswith("transfer on") and got["b", "CASH"]["error"].startswith("cash trade on")


def test_a_holding_with_most_rows_is_folded_in_many_tasks(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit("b").alias("book"), F.lit("A").alias("ticker"), F.col("id").alias("ord"), F.date_add(F.lit(D), (F.col("id") / 100).cast("int")).alias("d"), F.when(F.col("id") % 3 == 2, "sell").otherwise("buy").alias("action"), F.lit(1.0).alias("quantity"), (10 + F.col("id") % 7).cast("double").alias("price"), F.lit(0.01).alias("fee"), F.lit(0.0).alias("cash"))
    out = ledger.positions(rows).first()
    plain = folded([("sell" if k % 3 == 2 else "buy", 1.0, 10.0 + k % 7, 0.01, 0.0) for k in range(n)])
    assert [out[c] for c in ("shares", "cost_basis", "realized", "fees")] == pytest.approx(plain[:4], rel=1e-9)
    parts, held = ledger._holding_rows(rows, ("book", "ticker"))
    parts = parts.withColumn("stretch", F.floor(F.col("ord") / ledger.BLOCK_ROWS))
    starts = ledger._starts(parts.groupBy(*held, "stretch").agg(F.sum(F.lit(1.0)).alias("moved")), held)
    assert ledger._fold_stretches(parts, starts, held).count() == n // ledger.BLOCK_ROWS + 1


@pytest.mark.parametrize("draws", ["seeded", "counted"])
def test_replicates_in_many_tasks_give_the_same_intervals(spark, monkeypatch, draws):
    import numpy as np

    from tidemark.operators import bootstrap

    r = np.random.default_rng(6)
    rows = [(k, D + dt.timedelta(days=i), float(x), float(x / 2)) for k, n in (("a", 150), ("b", 40), ("c", 1), ("d", 9)) for i, x in enumerate(r.normal(0.0004, 0.02, n))]
    df = spark.createDataFrame(rows, "k string, d date, r double, half double").repartition(3)
    pairs = df.select("k", "d", F.col("r").alias("r_without"), F.col("half").alias("r_with"))
    taken = lambda: (sorted(map(tuple, bootstrap.intervals(df, "k", reps=60, draws=draws).collect())), sorted(map(tuple, bootstrap.paired_ulcer_gain(pairs, "k", reps=60, draws=draws).collect())))
    whole = taken()
    for name, value in (("WORK", 900), ("PIECE", 400), ("SHIPPED", 13)):
        monkeypatch.setattr(bootstrap, name, value)
    assert taken() == whole
    assert [x[0] for x in whole[1] if x[1] is not None] == ["a", "b"]
    at = np.concatenate(list(bootstrap.drawn(40, 7, 0, 60, 42, draws)))
    assert (at == bootstrap.block_indices(40, 7, 60, 42, draws)).all()
    assert (np.concatenate(list(bootstrap.drawn(40, 7, 23, 41, 42, draws))) == at[23:41]).all()


@pytest.mark.parametrize("schedule", ["monthly", "never"])
def test_sleeves_equal_two_simulated_legs(spark, schedule):
    import numpy as np

    from tidemark.operators import simulate

    r = np.random.default_rng(9)
    rows = []
    for t, every, first in (("A", 2, 0), ("B", 3, 5), ("C", 1, 40), ("E", 5, 60), ("F", 7, 1)):
        level = 50 * np.cumprod(1 + r.normal(0, 0.02, 420))
        rows += [(t, D + dt.timedelta(days=k), float(level[k])) for k in range(first, 400, every)]
    px = spark.createDataFrame(rows, "ticker string, d date, close double")
    target = spark.createDataFrame([("A", 0.9), ("B", 0.6), ("Z", 0.0)], "ticker string, w double")
    asked = spark.createDataFrame([("C", D + dt.timedelta(days=201), D + dt.timedelta(days=399)), ("E", D + dt.timedelta(days=95), D + dt.timedelta(days=350)), ("F", D + dt.timedelta(days=8), D + dt.timedelta(days=398))], "pair string, oos_start date, hi date")
    got = {(x["pair"], x["d"]): (x["r_without"], x["r_with"]) for x in simulate.sleeve_returns(px, target, asked, schedule, 0.25).collect()}
    legs = [(f"{c}+{k}", t, w * (0.75 if k == "with" else 1)) for c in "CEF" for k in ("with", "without") for t, w in (("A", 0.9), ("B", 0.6))] + [(f"{c}+with", c, 0.25) for c in "CEF"]
    spans = [(f"{x['pair']}+{k}", x["oos_start"], x["hi"]) for x in asked.collect() for k in ("with", "without")]
    curves = simulate.simulate(px, spark.createDataFrame(legs, "leg string, ticker string, w double"), schedule, spark.createDataFrame(spans, "leg string, lo date, hi date"))
    pairs = spark.createDataFrame([(c, f"{c}+without", f"{c}+with") for c in "CEF"], "pair string, without string, tested string")
    expected = {(x["pair"], x["d"]): (x["r_without"], x["r_with"]) for x in simulate.aligned_returns(curves, pairs).collect()}
    assert got.keys() == expected.keys() and len(got) > 300
    for k in got:
        assert got[k] == pytest.approx(expected[k], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("cap", [1, 3])
def test_menus_equal_the_whole_pool(spark, cap):
    from tidemark.operators import discover

    r = random.Random(cap)
    universe = [(f"F{k}", r.choice("xyz"), r.choice(["a", "b", "c", "d", "e"]), r.random() < (0.4 if k % 3 else 0.0), k) for k in range(90)]
    held = [(f"b{b}", f"F{k}", 1.0) for b in range(12) for k in r.sample(range(90), 4 * b)] + [("b12", f"F{k}", 1.0) for k in range(90)] + [("b13", "none", 1.0)]
    roles = [(f"b{b}", x) for b in range(14) for x in "xyz" if r.random() < 0.9] + [("b1", "no such role")]
    u = spark.createDataFrame(universe, "ticker string, role string, flavor string, core boolean, file_ord int")
    h, o = spark.createDataFrame(held, "book string, ticker string, value double"), spark.createDataFrame(roles, "book string, role string")
    menus, shelves = set(), {}
    for b, x in roles:
        own = {t for y, t, _ in held if y == b}
        pool = [f for f in universe if f[1] == x and f[0] not in own]
        if not pool:
            continue
        core = [f for f in pool if f[3]]
        lead = min(core or pool, key=lambda f: f[4])[2]
        first = {s: min(f[4] for f in pool if f[2] == s) for s in {f[2] for f in pool}}
        order = sorted(pool, key=lambda f: (not f[3], f[2] != lead, first[f[2]], f[4]))
        menus |= {(b, x, lead, k + 1, f[0], f[2], f[3]) for k, f in enumerate(order[:cap])}
        for f in order[cap:]:
            if f[2] != lead:
                shelves[b, x, f[2]] = shelves.get((b, x, f[2]), 0) + 1
    assert set(map(tuple, discover.menu(h, u, o, cap).collect())) == menus and len(menus) > 20
    assert {tuple(x)[:3]: x["n"] for x in discover.more_shelves(h, u, o, cap).collect()} == shelves
    assert "Broadcast" not in "".join(str(discover.menu(h, u, o, cap)._jdf.queryExecution().logical()))


def test_menus_are_bounded_by_rows_not_by_sequences_of_places(spark):
    """A book that holds nearly all of a large universe: no row is made for each place, and neither side of the large joins can be broadcast."""
    from tidemark.operators import discover

    n = 3000
    u = spark.range(n).selectExpr("concat('F', id) AS ticker", "concat('r', id % 2) AS role", "concat('s', id % 5) AS flavor", "id % 3 > 0 AS core", "cast(id AS int) AS file_ord")
    h = spark.range(n).where(f"id not in (2990, 2991, {n - 1})").selectExpr("'b' AS book", "concat('F', id) AS ticker", "1.0D AS value")
    o = spark.createDataFrame([("b", "r0"), ("b", "r1")], "book string, role string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    menu = discover.menu(h, u, o)
    assert {(x["role"], x["place"], x["ticker"]) for x in menu.collect()} == {("r0", 1, "F2990"), ("r1", 1, "F2999"), ("r1", 2, "F2991")}
    assert "sequence(" not in plan(menu)
    joins = [line for line in plan(discover.exposure(h, u)).splitlines() if "ticker" in line and "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_holdings_of_one_stretch_are_read_once(spark, monkeypatch):
    """Rows numbered within a ticker are dealt out once for the number and the fold; none is read again where nothing is to be mended."""
    rows = spark.range(400).selectExpr("'b' AS book", "concat('T', id % 7) AS ticker", "date_add(date'2020-01-01', cast(id AS int)) AS d", "'buy' AS action", "1.0D AS quantity", "2.0D AS price", "0.5D AS fee", "0.0D AS cash")
    numbered = rows.withColumn("ord", F.row_number().over(Window.partitionBy("ticker").orderBy("d")))
    kept, plain = [], ledger.keep

    def seen(df, name):
        kept.append((name, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]))
        return plain(df, name)

    monkeypatch.setattr(ledger, "keep", seen)
    out = {x["ticker"]: x for x in ledger.positions(numbered).collect()}
    assert out["T0"]["shares"] == 58 and out["T0"]["cost_basis"] == pytest.approx(58 * 2.5) and len(out) == 7
    plans = dict(kept)
    assert plans["stretches"].count("Exchange") == 1
    assert len([n for n, p in kept if n == "stretches"]) == 1 and "PythonUDF" not in plans["wrong-starts"]


def test_dietz_takes_one_row_for_each_day(spark):
    """A key's flows reach the window over the key by day, however many there are of a day."""
    flows = spark.range(1000).selectExpr("'b' AS book", "date_add(date'2020-01-01', cast(id % 4 AS int) * 100) AS d", "-1.0D AS flow")
    values = spark.createDataFrame([("b", 1100.0)], "book string, value double")
    out = returns.modified_dietz(flows, values, F.lit("2021-01-01").cast("date"))
    assert out.first()["dietz"] == pytest.approx(100 / sum(250 * (366 - 100 * k) / 366 for k in range(4)))
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window = next(k for k, line in enumerate(lines) if "Window [" in line)
    assert any("Aggregate [" in line for line in lines[window + 1 :])


def test_equal_falls_summed_in_other_orders_are_ties(spark):
    """Falls that differ in the last bits only: the first ticker is named, and neither is deeper than the other."""
    low = -0.5 - 2**-53
    assert low < -0.5
    series = spark.createDataFrame([("A", dt.date(2020, 1, 1), -0.5), ("B", dt.date(2020, 1, 1), low), ("C", dt.date(2020, 1, 1), -0.1)], "ticker string, d date, dd double")
    worst = screen.held_falls(series, series.select("ticker")).first()["worst"]
    assert (worst["peer"], worst["depth"]) == ("A", -0.5)
    status = spark.range(1).select(screen.own_drawdown_status(F.lit(9.0), F.lit(-0.2 - 2**-54), F.lit(-0.2)).alias("tie"), screen.own_drawdown_status(F.lit(9.0), F.lit(-0.21), F.lit(-0.2)).alias("deeper")).first()
    assert -0.2 - 2**-54 < -0.2 and (status["tie"], status["deeper"]) == ("pass", "warn")

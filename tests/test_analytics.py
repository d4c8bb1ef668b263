"""Goldens and brute-force checks of the analytics operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import align, allocate, bootstrap, discover, drawdown, fence, ledger, report, returns, screen, simulate
from tidemark.sources import ledger_files, price_tables
from tidemark.streaming import ledger_stream

LEDGER = ledger_stream.LEDGER_SCHEMA
D = dt.date


def book(spark, rows):
    """rows: ticker, day of January 2024, action, quantity, price, fee, cash."""
    return spark.createDataFrame([("b", t, k, D(2024, 1, day), a, float(q), float(p), float(f), float(c)) for k, (t, day, a, q, p, f, c) in enumerate(rows, 1)], LEDGER)


def closes(spark, series):
    return spark.createDataFrame([(t, D(2024, 1, 1) + dt.timedelta(days=k), float(x)) for t, xs in series.items() for k, x in enumerate(xs) if x is not None], "ticker string, d date, close double")


def test_average_cost(spark):
    out = ledger.positions(book(spark, [("A", 1, "buy", 10, 300, 1, 0), ("A", 2, "buy", 5, 400, 2, 0), ("A", 3, "sell", 3, 500, 1.5, 0), ("A", 4, "dividend", 0, 0, 1, 12), ("B", 1, "buy", 1, 10, 0, 0), ("B", 2, "sell", 1, 12, 0, 0)]))
    got = {r["ticker"]: r for r in out.collect()}
    avg = (3001 + 2002) / 15
    assert math.isclose(got["A"]["shares"], 12) and math.isclose(got["A"]["cost_basis"], 5003 - 3 * avg) and math.isclose(got["A"]["realized"], 1500 - 3 * avg - 1.5 + 11) and got["A"]["fees"] == 5.5
    assert got["B"]["shares"] == 0 and got["B"]["cost_basis"] == 0 and got["B"]["realized"] == 2 and got["B"]["error"] is None


def test_contract_errors(spark):
    out = {r["ticker"]: r["error"] for r in ledger.positions(book(spark, [("A", 1, "sell", 1, 1, 0, 0), ("B", 1, "buy", 1, 1, 0, 0), ("B", 3, "sell", 2, 1, 0, 0)])).collect()}
    assert out == {"A": "nothing is held to sell on 2024-01-01", "B": "more is sold than is held on 2024-01-03"}


def test_splits_count_after_the_trade_only(spark):
    rows = book(spark, [("A", 1, "buy", 10, 100, 0, 0), ("A", 5, "buy", 10, 50, 0, 0), ("A", 6, "sell", 5, 20, 0, 0), ("A", 1, "dividend", 0, 0, 0, 5)])
    marks = spark.createDataFrame([("A", D(2024, 1, 5), 2.0), ("A", D(2024, 1, 8), 5.0)], "ticker string, d date, ratio double")
    got = {r["ord"]: (r["factor"], r["quantity"], r["price"]) for r in ledger.adjust_for_splits(rows, marks).collect()}
    assert got == {1: (10.0, 100.0, 10.0), 2: (5.0, 50.0, 10.0), 3: (5.0, 25.0, 4.0), 4: (10.0, 0.0, 0.0)}


def test_fill_and_snap(spark):
    px = closes(spark, {"A": [1, None, 3]})
    grid = spark.createDataFrame([("A", D(2024, 1, k)) for k in (2, 4)] + [("B", D(2024, 1, 2))], "ticker string, d date")
    assert {(r["ticker"], r["d"].day): r["close"] for r in align.asof_fill(px, grid).collect()} == {("A", 2): 1.0, ("A", 4): 3.0, ("B", 2): None}
    days = spark.createDataFrame([("b", D(2024, 1, 3)), ("b", D(2024, 1, 5))], "book string, d date")
    events = spark.createDataFrame([("b", D(2024, 1, k)) for k in (1, 3, 4, 9)], "book string, d date")
    for clamp, last in ((False, None), (True, 5)):
        assert {r["d"].day: r["day"] and r["day"].day for r in align.snap_forward(events, days, ("book",), clamp).collect()} == {1: 3, 3: 3, 4: 5, 9: last}


def test_time_weighted_returns(spark):
    px = closes(spark, {"A": [100, 110, 121]})
    r = returns.daily_returns(book(spark, [("A", 1, "buy", 1, 100, 0, 0)]), px)
    assert [round(x["r"], 12) for x in r.orderBy("d").collect()] == [0.1, 0.1]
    assert round(returns.growth_index(r).agg(F.max("g")).first()[0], 12) == 1.21
    t = returns.time_weighted(r).first()
    assert t["n"] == 2 and round(t["cumulative"], 12) == 0.21 and t["annualized"] is None
    paid = returns.daily_returns(book(spark, [("A", 1, "buy", 1, 100, 0, 0), ("A", 2, "dividend", 0, 0, 0, 2)]), closes(spark, {"A": [100, 98]}))
    assert paid.first()["r"] == 0
    late = returns.daily_returns(book(spark, [("A", 1, "buy", 1, 100, 0, 0), ("A", 9, "buy", 5, 100, 0, 0)]), px)
    assert late.count() == 2 and round(returns.time_weighted(late).first()["cumulative"], 12) == 0.21
    out = returns.daily_returns(book(spark, [("A", 1, "buy", 2, 100, 0, 0), ("A", 2, "sell", 2, 98, 0, 0)]), closes(spark, {"A": [100, 98, 97]}))
    assert [round(x["r"], 12) for x in out.collect()] == [-0.02]


def test_money_weighted(spark):
    flows = spark.createDataFrame([("b", D(2023, 1, 1), -100.0), ("c", D(2023, 1, 1), -100.0), ("s", D(2023, 12, 1), -100.0)], "book string, d date, flow double")
    values = spark.createDataFrame([("b", 110.0), ("c", -5.0), ("s", 120.0), ("none", 3.0)], "book string, value double")
    got = {r["book"]: r["irr"] for r in returns.money_weighted(flows, values, F.lit("2024-01-01").cast("date")).collect()}
    assert math.isclose(got["b"], 1.1 ** (365.25 / 365) - 1, rel_tol=1e-9) and got["c"] is None and got["s"] is None and got["none"] == 0
    dz = {r["book"]: r for r in returns.modified_dietz(flows, values, F.lit("2024-01-01").cast("date")).collect()}
    assert math.isclose(dz["b"]["dietz"], 0.1) and dz["s"]["annualized"] is None and dz["none"]["dietz"] == 0


def test_drawdown_walk(spark):
    level = [1.0, 1.1, 1.2, 0.9, 0.95, 1.25]
    x = spark.createDataFrame([("k", D(2024, 1, k + 1), v) for k, v in enumerate(level)] + [("flat", D(2024, 1, k + 1), 1.0) for k in range(3)], "key string, d date, x double")
    got = {r["key"]: r for r in drawdown.max_drawdown(x, "key").collect()}
    k = got["k"]
    assert math.isclose(k["depth"], -0.25) and (k["peak_date"].day, k["trough_date"].day, k["recovery_date"].day, k["duration_days"]) == (3, 4, 6, 3) and math.isclose(k["underwater"], 2 / 6)
    assert got["flat"]["depth"] == 0 and got["flat"]["trough_date"].day == 1 and got["flat"]["duration_days"] == 0


def test_ratios_against_numpy(spark):
    r = np.random.default_rng(1).normal(0.0005, 0.01, 300)
    rows = spark.createDataFrame([("k", D(2023, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(r)] + [("flat", D(2023, 1, 1) + dt.timedelta(days=i), 0.0) for i in range(9)], "key string, d date, r double")
    got = {x["key"]: x for x in drawdown.ratios(rows, "key").collect()}
    k = got["k"]
    level = np.concatenate(([1], np.cumprod(1 + r)))
    depth = (level / np.maximum.accumulate(level) - 1).min()
    assert math.isclose(k["sharpe"], r.mean() / r.std(ddof=1) * 252**0.5, rel_tol=1e-9) and math.isclose(k["sortino"], r.mean() / np.sqrt((np.minimum(r, 0) ** 2).mean()) * 252**0.5, rel_tol=1e-9)
    assert math.isclose(k["depth"], depth) and math.isclose(k["calmar"], (level[-1] ** (252 / 300) - 1) / -depth, rel_tol=1e-9) and k["is_noisy"]
    assert got["flat"]["sharpe"] is None and got["flat"]["calmar"] is None


def test_bootstrap_against_a_loop(spark):
    r = np.random.default_rng(2).normal(0.0004, 0.02, 90)
    rows = spark.createDataFrame([("k", D(2023, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(r)], "key string, d date, r double")
    got = {x["metric"]: x for x in bootstrap.intervals(rows, "key", reps=200).collect()}
    rng, block, made = np.random.default_rng(42), round(90**0.5), []
    for _ in range(200):
        idx = np.concatenate([np.arange(s, s + block) for s in rng.integers(0, 90 - block + 1, -(-90 // block))])[:90]
        level = np.cumprod(1 + r[idx])
        made.append(np.sqrt(((level / np.maximum.accumulate(level) - 1) ** 2).mean()))
    assert math.isclose(got["ulcer"]["low"], np.quantile(made, 0.025)) and math.isclose(got["ulcer"]["high"], np.quantile(made, 0.975))
    one = bootstrap.intervals(rows.limit(1), "key").collect()
    assert all(x["point"] is None for x in one)


@pytest.mark.parametrize("schedule", ["never", "monthly", "quarterly", "sometimes"])
def test_simulation_against_a_loop(spark, schedule):
    rng = np.random.default_rng(3)
    days = [D(2022, 1, 3) + dt.timedelta(days=3 * k) for k in range(260)]
    px = {t: 50 * np.cumprod(1 + rng.normal(0, 0.02, 260)) for t in "AB"}
    prices = spark.createDataFrame([(t, d, float(px[t][k])) for t in "AB" for k, d in enumerate(days) if t == "A" or k % 4], "ticker string, d date, close double")
    legs = spark.createDataFrame([("x", "A", 0.6), ("x", "B", 0.4)], "leg string, ticker string, w double")
    got = [r["v"] for r in simulate.simulate(prices, legs, schedule).orderBy("d").collect()]
    key = {"monthly": lambda d: (d.year, d.month), "quarterly": lambda d: (d.year, (d.month - 1) // 3)}.get(schedule, lambda d: d.year)
    shares, last, want, prev = None, {}, [], None
    for k, d in enumerate(days):
        last["A"] = px["A"][k]
        if k % 4:
            last["B"] = px["B"][k]
        if "B" not in last:
            continue
        if shares is None:
            shares = {t: w * 10000 / last[t] for t, w in (("A", 0.6), ("B", 0.4))}
        v = sum(shares[t] * last[t] for t in shares)
        want.append(v)
        if prev is not None and schedule != "never" and key(d) != key(prev):
            shares = {t: w * v / last[t] for t, w in (("A", 0.6), ("B", 0.4))}
        prev = d
    assert np.allclose(got, want, rtol=1e-10)


def test_zero_first_price_moves_the_weight(spark):
    legs = spark.createDataFrame([("x", "A", 0.5), ("x", "B", 0.5)], "leg string, ticker string, w double")
    out = simulate.simulate(closes(spark, {"A": [10, 10, 10], "B": [5, 5, 5]}), legs, "never", initial=1000.0).collect()
    assert len(out) == 3 and all(r["v"] == 1000 for r in out)


def test_hedge_improves(spark):
    rng = np.random.default_rng(4)
    days = [D(2020, 1, 1) + dt.timedelta(days=k) for k in range(300)]
    fall = np.concatenate((np.full(220, 0.0005), np.full(80, -0.01))) + rng.normal(0, 0.002, 300)
    px = {"A": 100 * np.cumprod(1 + fall), "H": 100 * np.cumprod(1 - fall)}
    prices = spark.createDataFrame([(t, d, float(px[t][k])) for t in px for k, d in enumerate(days)], "ticker string, d date, close double")
    legs = spark.createDataFrame([("without", "A", 1.0), ("with", "A", 0.5), ("with", "H", 0.5)], "leg string, ticker string, w double")
    split = simulate.split_days(prices.where("ticker = 'A'").select(F.lit("all").alias("leg"), "d")).first()
    assert split["in_sample_end"] == days[209] and split["oos_start"] == days[210]
    spans = spark.createDataFrame([("without", split["oos_start"], split["hi"]), ("with", split["oos_start"], split["hi"])], "leg string, lo date, hi date")
    pair = spark.createDataFrame([("p", "without", "with")], "pair string, without string, tested string")
    r = simulate.aligned_returns(simulate.simulate(prices, legs, "quarterly", spans), pair)
    got = simulate.verdict(simulate.window_stats(r), r).first()
    assert got["verdict"] == "improved" and got["cause"] == "" and got["low"] > 0
    same = legs.where("leg = 'without'").unionByName(legs.where("leg = 'without'").withColumn("leg", F.lit("with")))
    r = simulate.aligned_returns(simulate.simulate(prices, same, "quarterly", spans), pair)
    assert simulate.verdict(simulate.window_stats(r), r).first()["cause"] == "noise_margin"


def test_rebalancing(spark):
    held = spark.createDataFrame([("b", "A", 600.0), ("b", "B", 400.0), ("b", "X", 0.5)], "book string, ticker string, value double")
    prices = spark.createDataFrame([("A", 10.0), ("B", 20.0), ("C", 5.0), ("X", 1.0), ("N", 0.0)], "ticker string, price double")
    target = spark.createDataFrame([("A", 0.5), ("B", 0.3), ("C", 0.2), ("N", 0.0)], "ticker string, w double")
    got = {r["ticker"]: r for r in allocate.suggest("to_total", held, prices, target).collect()}
    assert (got["A"]["action"], got["B"]["action"], got["C"]["action"], got["X"]["action"]) == ("sell", "sell", "buy", "hold") and "N" not in got
    assert math.isclose(got["C"]["dollars"], 0.2 * 1000.5) and math.isclose(got["C"]["shares"], 0.2 * 1000.5 / 5)
    near = spark.createDataFrame([("A", 0.59), ("B", 0.4), ("X", 0.01)], "ticker string, w double")
    assert {r["action"] for r in allocate.suggest("bands", held.where("ticker <> 'X'"), prices, near.where("ticker <> 'X'")).collect()} == {"hold"}
    cash = allocate.suggest("cash_flow_only", held, prices, target, new_cash=100.0).agg(F.sum("dollars")).first()[0]
    assert math.isclose(cash, 100)
    assert math.isclose(allocate.suggest("fixed_dca", held, prices, target, new_cash=50.0).agg(F.sum("dollars")).first()[0], 50)
    with pytest.raises(PermissionError):
        allocate.suggest("momentum", held, prices, target)


def test_caps(spark):
    w = spark.createDataFrame([("b", t, x) for t, x in zip("ABCD", (70.0, 20.0, 6.0, 4.0), strict=True)], "book string, ticker string, w double")
    got = {r["ticker"]: r["w"] for r in allocate.apply_caps(w, 0.4).collect()}
    assert math.isclose(sum(got.values()), 1) and max(got.values()) <= 0.4 + 1e-9 and math.isclose(got["C"] / got["D"], 1.5)
    with pytest.raises(Exception, match="too small"):
        allocate.apply_caps(w, 0.2).collect()


def test_posture(spark):
    rows = spark.createDataFrame([(1, 0, 2, 2), (2, 1, 1, 0), (3, 2, 1, 1), (4, 2, 2, 2)], "id int, horizon int, loss_response int, cash_buffer int")
    assert [r["posture"] for r in allocate.posture(rows).orderBy("id").collect()] == ["conservative", "conservative", "moderate", "aggressive"]


def test_thresholds(spark):
    facts = spark.createDataFrame([("A", 0.0020, 1e8, 1e5, "Large", None, D(2000, 1, 1), 0.5), ("B", 0.0050, 1.0, 1e5, "Inverse x", None, D(2001, 1, 1), 0.51), ("C", 0.0051, 1.0, 1.0, None, "a Note", D(1999, 8, 1), None), ("D", None, None, None, None, None, None, None)], "ticker string, expense_ratio double, aum double, avg_volume double, category string, legal_type string, inception date, top_share double")
    got = {(r["ticker"], r["check"]): r["status"] for r in screen.fact_checks(facts, F.lit("2001-08-01").cast("date")).collect()}
    assert [got["A", c] for c in ("structure", "cost", "liquidity", "age", "concentration")] == ["pass", "pass", "pass", "warn", "pass"]
    assert [got["B", c] for c in ("structure", "cost", "liquidity", "age", "concentration")] == ["fail", "warn", "warn", "fail", "warn"]
    assert [got["C", c] for c in ("structure", "cost", "liquidity", "concentration")] == ["fail", "fail", "fail", "n/a"]
    assert {got["D", c] for c in ("structure", "cost", "liquidity", "age", "concentration")} == {"n/a"}
    verdicts = {r["ticker"]: r["verdict"] for r in screen.roll_up(screen.fact_checks(facts, F.lit("2001-08-01").cast("date"))).collect()}
    assert verdicts == {"A": "warn", "B": "fail", "C": "fail", "D": "n/a"}


def test_correlation_of_constants_is_missing(spark):
    pairs = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", 4.0, 1.0)], "key string, c double, p double")
    got = {r["key"]: r["rho"] for r in screen.correlation(pairs, "key").collect()}
    assert got["a"] is None and math.isclose(got["b"], np.corrcoef([1, 2, 4], [2, 4, 1])[0, 1])


def test_exposure_counts_unmapped_holdings(spark):
    uni = spark.createDataFrame([("V", "us-large", "f", True, 1), ("W", "bond", "f", True, 1)], "ticker string, role string, flavor string, core boolean, file_ord int")
    held = spark.createDataFrame([("b", "V", 500.0), ("b", "Z", 500.0)], "book string, ticker string, value double")
    assert [tuple(r) for r in discover.exposure(held, uni).collect()] == [("b", "us-large", 0.5)]
    assert [(r["role"], r["exposure"]) for r in discover.gaps(held, uni).collect()] == [("bond", 0.0)]
    assert [r["ticker"] for r in discover.menu(held, uni, discover.gaps(held, uni)).collect()] == ["W"]


def test_fence(spark):
    cases = {
        "it fell {{depth}}": "it fell -9.84%", "{{ Depth }} x": "-9.84% x", "": None, "  ": None, "fell 9 percent": None, "½ of it {{depth}}": None, "十 {{depth}}": None, "{{nope}}": None, "{{depth} and": None, "no figures": "no figures",
        "worth {{v1}}": "worth $5\\2",
    }
    claims = F.create_map(F.lit("depth"), F.lit("-9.84%"), F.lit("v1"), F.lit("$5\\2"))
    rows = spark.createDataFrame([(k,) for k in cases], "prose string").select("prose", fence.render(F.col("prose"), claims).alias("out"))
    assert {r["prose"]: r["out"] for r in rows.collect()} == cases


def test_scalars(spark):
    x = spark.createDataFrame([("=1",), ("-2",), ("plain",), ("@a",), (None,)], "t string")
    assert [r[0] for r in x.select(scalar.csv_safe(F.col("t"))).collect()] == ["'=1", "'-2", "plain", "'@a", None]
    v = spark.createDataFrame([(float("nan"),), (float("inf"),), (0.0,), (-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in v.select(scalar.usable_price(F.col("x"))).collect()] == [False, False, False, False, True, False]
    assert [r[0] for r in v.select(scalar.signed_percent(F.col("x"))).collect()] == ["n/a", "n/a", "+0.00%", "-100.00%", "+200.00%", "n/a"]


def test_ledger_csv(spark, tmp_path):
    path = tmp_path / "book.csv"
    path.write_text("﻿Date,Code,Action,Quantity,Price,Fee,Currency\n2024-01-02,aapl ,SELL,1,5,0,\n20240102,AAPL,buy,2,4,,USD\n2024-01-03,CASH,interest,,7,,\n2024-01-03,AAPL,dividend,2,3,0,\n", encoding="utf-8")
    got = ledger_files.read_csv(spark, str(path)).orderBy("ticker", "ord").collect()
    assert [(r["ticker"], r["action"], r["quantity"], r["cash"]) for r in got] == [("AAPL", "buy", 2.0, 0.0), ("AAPL", "sell", 1.0, 0.0), ("AAPL", "dividend", 0.0, 6.0), ("CASH", "interest", 0.0, 7.0)]
    bad = tmp_path / "bad.csv"
    bad.write_text("Date,Code,Action,Quantity,Price,Fee,Currency\nx,A,buy,1,1,0,\n2024-01-01,A,buy,0,1,0,\n2024-01-01,A,hold,1,1,0,\n2024-01-01,../x,buy,1,1,0,\n2024-01-01,A,buy,1,1,0,EUR\n2024-01-01,A,buy,nan,1,0,\n")
    good, errors = ledger_files.read_csv_report(spark, str(bad))
    assert good.count() == 0 and [r["row_no"] for r in errors.orderBy("row_no").collect()] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError, match="data row 1: bad date"):
        ledger_files.read_csv(spark, str(bad))
    short = tmp_path / "short.csv"
    short.write_text("Date,Code\n")
    with pytest.raises(ValueError, match="missing columns"):
        ledger_files.read_csv(spark, str(short))


def test_ledger_json(spark, tmp_path):
    path = tmp_path / "book.json"
    path.write_text('{"activities": [{"symbol": "A", "currency": "USD", "unitPrice": 2, "quantity": 3, "type": "BUY", "fee": 1, "date": "2024-01-01T22:00:00.000Z"}, {"symbol": "A", "currency": "EUR", "unitPrice": 2, "quantity": 3, "type": "BUY", "fee": 1, "date": "2024-01-01"}, {"symbol": "A", "type": "ITEM", "date": "2024-01-01"}]}')
    good, bad = ledger_files.read_ledger(spark, str(path))
    row = good.collect()[0]
    assert (row["ticker"], row["d"], row["quantity"], row["price"], row["fee"]) == ("A", D(2024, 1, 2), 3.0, 2.0, 1.0) and sorted(r["row_no"] for r in bad.collect()) == [2, 3]


def test_target_and_universe_files(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Ticker,Weight\nvti,50\nBND,20\nVTI,10\nX,0\n")
    got = {r["ticker"]: r["w"] for r in ledger_files.read_target(spark, str(path)).collect()}
    assert got == {"VTI": 0.75, "BND": 0.25, "X": 0.0}
    path = tmp_path / "u.csv"
    path.write_text("ticker,name,role,summary,core\nA,a,gold,s,0\nA,again,gold,s,1\nB,b,none,s,\nC,c,gold,s,\n")
    assert [(r["ticker"], r["core"], r["file_ord"]) for r in ledger_files.read_universe(spark, str(path), ["gold"]).orderBy("file_ord").collect()] == [("A", False, 1), ("C", True, 4)]


def test_positions_stream(spark, tmp_path):
    source, seen = tmp_path / "in", []
    book(spark, [("A", 1, "buy", 2, 10, 0, 0), ("B", 1, "buy", 1, 10, 0, 0)]).write.parquet(str(source / "1"))
    rows = ledger_stream.ledger_stream(spark, str(source) + "/*")
    sink = lambda df, n: seen.append({r["ticker"]: r["shares"] for r in df.collect()})
    ledger_stream.refold_positions(rows, str(tmp_path / "ledger"), str(tmp_path / "ck"), sink).awaitTermination()
    book(spark, [("A", 2, "sell", 1, 11, 0, 0)]).withColumn("ord", F.lit(5).cast("long")).write.parquet(str(source / "2"))
    ledger_stream.refold_positions(rows, str(tmp_path / "ledger"), str(tmp_path / "ck"), sink).awaitTermination()
    assert seen == [{"A": 2.0, "B": 1.0}, {"A": 1.0}]


def test_positions_fold_as_a_stream(spark):
    rows = [(t, 1 + k % 28, "buy" if k % 3 else "sell", 1 + k % 5, 300 + 7 * (k % 11), 0.25 * (k % 4), 0) for t in ("A", "B") for k in range(1, 60)]
    expected = {}
    for t, _, action, q, price, fee, _ in rows:
        s, c, r, f = expected.get(t, (0.0, 0.0, 0.0, 0.0))
        if action == "buy":
            s, c, f = s + q, c + q * price + fee, f + fee
        elif 0 < s >= q:
            avg = c / s
            s, c, r, f = s - q, (c - q * avg) * (s > q), r + q * price - q * avg - fee, f + fee
        expected[t] = s, c, r, f
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = book(spark, rows)
        out = ledger.positions(frame)
        got = {x["ticker"]: (x["shares"], x["cost_basis"], x["realized"], x["fees"]) for x in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == expected.keys() and all(got[t] == pytest.approx(expected[t]) for t in got)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()  # no holding in one array


def test_money_weighted_takes_one_entry_a_day(spark):
    days = ["2022-01-01", "2022-07-01", "2023-01-01"]
    rows = [("x", d, a) for d in days for a in (-50.0, -60.0, 10.0)] + [("up", d, a) for d in days for a in (-1.0, 3.0)]
    flows = spark.createDataFrame(rows, "book string, d string, flow double").withColumn("d", F.to_date("d"))
    values = spark.createDataFrame([("x", 350.0), ("up", -7.0), ("none", 1.0)], "book string, value double")
    out = returns.money_weighted(flows, values, F.lit("2024-01-01").cast("date"))
    got = {r["book"]: r["irr"] for r in out.collect()}
    assert got["none"] == 0 and got["up"] is not None  # each day gains, but its flows have both signs
    worth = sum(-100 * (1 + got["x"]) ** -t for t in (0, 181 / 365.25, 365 / 365.25)) + 350 * (1 + got["x"]) ** (-730 / 365.25)
    assert abs(worth) < 1e-6
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [book") == 2  # by day, then the list


def test_four_violations_of_the_ledger_contract(spark):
    rows = [("A", 1, "sell", 1, 1, 0, 0), ("B", 1, "buy", 1, 1, 0, 0), ("B", 3, "sell", 2, 1, 0, 0), ("VOO", 2, "deposit", 0, 0, 0, 100), ("CASH", 4, "buy", 1, 1, 0, 0), ("CASH", 5, "deposit", 0, 0, 0, 9), ("CASH", 5, "interest", 0, 0, 0, 2)]
    out = {r["ticker"]: r for r in ledger.positions(book(spark, rows)).collect()}
    assert {t: r["error"] for t, r in out.items()} == {
        "A": "nothing is held to sell on 2024-01-01", "B": "more is sold than is held on 2024-01-03", "VOO": "transfer on 2024-01-02: only cash is paid in or out", "CASH": "cash trade on 2024-01-04: cash is not bought or sold",
    }
    assert out["VOO"]["shares"] == 0 and out["CASH"]["shares"] == 0
    assert ledger.cash_totals(book(spark, [*rows, ("CASH", 6, "fee", 0, 0, 0.5, 0), ("CASH", 7, "dividend", 0, 0, 0.25, 1)])).first()["cash_realized"] == 2 - 0.5 + 0.75


def test_presets_of_the_thirteen_roles(spark):
    funds = {"us-large": "VTI", "us-small-mid": "VO", "us-dividend": "VIG", "intl-developed": "VXUS", "em-equity": "VWO", "sector-equity": "SEC", "bond-aggregate": "BND", "treasury": "IEF", "tips": "SCHP", "corporate-bond": "VCIT", "gold": "IAU", "commodity-broad": "CMD", "reit": "VNQ"}
    golden = {
        "conservative": {"BND": 0.25, "IAU": 0.09, "IEF": 0.1, "SCHP": 0.06, "VCIT": 0.09, "VIG": 0.035, "VNQ": 0.06, "VO": 0.028, "VTI": 0.1925, "VWO": 0.0175, "VXUS": 0.077},
        "moderate": {"BND": 0.15, "IAU": 0.09, "IEF": 0.06, "SCHP": 0.036, "VCIT": 0.054, "VIG": 0.055, "VNQ": 0.06, "VO": 0.044, "VTI": 0.3025, "VWO": 0.0275, "VXUS": 0.121},
        "aggressive": {"BND": 0.06, "IAU": 0.078, "IEF": 0.024, "SCHP": 0.0144, "VCIT": 0.0216, "VIG": 0.075, "VNQ": 0.052, "VO": 0.06, "VTI": 0.4125, "VWO": 0.0375, "VXUS": 0.165},
    }
    assert {r for roles in allocate.ROLE_WEIGHTS.values() for r in roles} == set(funds)
    roles = spark.createDataFrame([("b", r, t) for r, t in funds.items()], "book string, role string, ticker string")
    for preset, want in golden.items():
        template = spark.createDataFrame([(b, w, r, x) for b, w in allocate.PRESETS[preset].items() for r, x in allocate.ROLE_WEIGHTS[b].items()], "bucket string, bucket_weight double, role string, role_weight double")
        assert {r["ticker"]: round(r["w"], 6) for r in allocate.preset_target(roles, template).collect()} == want
    assert all(math.isclose(sum(m.values()), 1) for m in allocate.REFERENCE_MIXES.values())


def test_allocation_rules(spark):
    members = spark.createDataFrame([("b", t) for t in ("A", "B", "C", "CASH")], "book string, ticker string")
    px = closes(spark, {"A": [10, 11, 10, 12], "B": [10, 10.5, 10, 10.6], "C": [5, 5, 5, 5]})
    assert {r["ticker"]: round(r["w"], 9) for r in allocate.allocate("equal_weight", members).collect()} == {t: round(1 / 3, 9) for t in "ABC"}
    vol = {t: 1 / np.std(np.diff(x) / x[:-1], ddof=1) for t, x in (("A", np.array([10, 11, 10, 12.0])), ("B", np.array([10, 10.5, 10, 10.6])))}
    got = {r["ticker"]: r["w"] for r in allocate.allocate("inverse_vol", members, px).collect()}
    assert got == pytest.approx({t: v / sum(vol.values()) for t, v in vol.items()})
    assert max(r["w"] for r in allocate.allocate("inverse_vol", members, px, cap=0.6).collect()) <= 0.6 + 1e-12
    for rule, error in (("moderate", ValueError), ("momentum", ValueError)):
        with pytest.raises(error):
            allocate.allocate(rule, members)
    assert allocate.needs_series("inverse_vol") and not allocate.needs_series("equal_weight")


def test_overlap_falls_back_to_the_category(spark):
    own = spark.createDataFrame([("A", "x"), ("B", "gold"), ("C", None), ("D", "x"), ("E", "y")], "ticker string, category string")
    held = spark.createDataFrame([("H", "gold"), ("K", "z")], "ticker string, category string")
    look = spark.createDataFrame([("A", "s", 0.5), ("A", "t", 0.5), ("D", "u", 1.0), ("H", "s", 0.9), ("K", "t", 0.3)], "ticker string, symbol string, w double")
    got = {r["ticker"]: (r["held_ticker"], r["overlap"], r["status"]) for r in screen.overlaps(own, held, look).collect()}
    assert got == {"A": ("H", 0.5, "warn"), "B": ("H", None, "warn"), "C": (None, None, "n/a"), "D": (None, 0.0, "pass"), "E": (None, None, "n/a")}
    nothing = {r["ticker"]: r["status"] for r in screen.overlaps(own, held, look.where("ticker in ('A', 'D')")).collect()}
    assert nothing == {"A": "n/a", "B": "warn", "C": "n/a", "D": "n/a", "E": "n/a"}


def test_role_menus(spark):
    uni = spark.createDataFrame(
        [("T1", "treasury", "long", True, 1), ("T2", "treasury", "long", True, 2), ("T3", "treasury", "long", False, 3), ("T4", "treasury", "short", True, 4), ("T5", "treasury", "tilt", False, 5), ("S1", "sector-equity", "tech", True, 6), ("S2", "sector-equity", "energy", True, 7), ("G1", "gold", "", False, 8)],
        "ticker string, role string, flavor string, core boolean, file_ord int",
    )
    held = spark.createDataFrame([("b", "T2", 1.0)], "book string, ticker string, value double")
    ask = lambda *rows: discover.role_menus(spark.createDataFrame([("b", *r) for r in rows], "book string, role string, flavor string"), held, uni)
    menu, index, errors = ask(("treasury", None), ("sector-equity", None), ("gold", None))
    assert [(r["role"], r["ticker"]) for r in menu.orderBy("role", "place").collect()] == [("gold", "G1"), ("treasury", "T1"), ("treasury", "T4")]
    assert {(r["role"], r["flavor"], r["n"]) for r in index.collect()} == {("sector-equity", "tech", 1), ("sector-equity", "energy", 1), ("treasury", "tilt", 1)} and errors.count() == 0
    menu, index, errors = ask(("treasury", "long"), ("gold", "none"))
    assert [r["ticker"] for r in menu.orderBy("place").collect()] == ["T1", "T3"] and {(r["flavor"], r["n"]) for r in index.collect()} == {("short", 1), ("tilt", 1)}
    assert [(r["role"], r["flavor"], r["shelves"]) for r in errors.collect()] == [("gold", "none", [""])]
    menu, _, _ = discover.role_menus(spark.createDataFrame([("b", "sector-equity", None)], "book string, role string, flavor string"), held, uni.where("ticker <> 'S2'"))
    assert [r["ticker"] for r in menu.collect()] == ["S1"]  # a satellite role with one shelf
    assert {r["role"] for r in discover.gaps(held, uni).collect()} == {"gold"} and {r["role"] for r in discover.gaps(held, uni, with_satellites=True).collect()} == {"gold", "sector-equity"}
    assert discover.parse_request("gold, treasury:long,,x,gold:a", {"gold", "treasury"}) == ([("gold", None), ("treasury", "long")], ["x", "gold:a"])
    both = discover.merge_menus(menu.limit(1), menu.unionByName(menu))
    assert both.count() == 1


def test_role_checks_say_why_they_cannot_judge(spark):
    days = 300
    r = np.random.default_rng(3)
    falls = np.concatenate([np.full(220, 0.002), np.full(20, -0.03), np.full(60, 0.001)]) + r.normal(0, 0.001, days)
    hedge = -falls
    px = closes(spark, {"A": (100 * np.cumprod(1 + falls)).tolist(), "H": (100 * np.cumprod(1 + hedge)).tolist(), "S": [None] * 250 + [10.0 + 0.01 * k for k in range(50)]})
    target = spark.createDataFrame([("A", 1.0)], "ticker string, w double")
    asked = spark.createDataFrame([("A",), ("H",), ("S",), ("none",)], "ticker string")
    got = {x["pair"]: x for x in simulate.role_checks(px, target, asked, sleeve=0.5, reps=200).collect()}
    assert got["H"]["verdict"] == "improved" and got["H"]["validated"] and got["H"]["reason"].startswith("Ulcer ")
    assert got["A"]["reason"] == "already in the target" and got["none"]["reason"] == "no usable prices of the candidate" and got["S"]["reason"].startswith("only 50 common days")
    assert {got[t]["verdict"] for t in ("A", "S", "none")} == {"insufficient"}
    unpriced = spark.createDataFrame([("A", 0.5), ("X", 0.5)], "ticker string, w double")
    assert simulate.role_checks(px, unpriced, asked.where("ticker = 'H'"), reps=50).first()["reason"] == "target tickers without prices: X"
    assert simulate.role_checks(px, target, asked, sleeve=1.0).where("verdict = 'insufficient'").count() == 4
    legs = spark.createDataFrame([("t", "A", 0.5), ("t", "H", 0.5), ("r", "A", 1.0), ("r", "X", 0.2)], "leg string, ticker string, w double")
    bench = simulate.benchmark_check(px, legs, "r", "t", reps=200).first()
    assert bench["verdict"] == "shallower" and bench["missing"] == "X" and "vs" in bench["reason"]
    assert simulate.benchmark_check(px.where("d < '2024-02-01'"), legs, "r", "t", reps=50).first()["verdict"] == "insufficient"


def test_counted_starts_stay_in_range():
    at = bootstrap.block_indices(100, 7, 300, 42, "counted")
    assert at.shape == (300, 100) and at.min() >= 0 and at.max() < 100 and (np.diff(at[:, :7]) == 1).all()
    assert abs(bootstrap.counted_starts(50, 2000, 10, 1).mean() - 24.5) < 1


def test_choice_never_sees_held_out_days(spark):
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    end = spark.createDataFrame([(D(2024, 6, 1),)], "in_sample_end date")
    judged = spark.createDataFrame([("A", D(2024, 5, 1)), ("B", D(2024, 7, 1))], "ticker string, in_sample_end date")
    assert {r["ticker"]: r["cut"] for r in screen.cutoffs(asked, end, judged).collect()} == {"A": D(2024, 5, 1), "B": D(2024, 6, 1), "C": D(2024, 6, 1)}
    day = lambda k: D(2024, 1, 1) + dt.timedelta(days=k)
    r = np.random.default_rng(1).normal(0, 0.01, 200)
    book_rows = spark.createDataFrame([(day(k), float(x)) for k, x in enumerate(r)], "d date, r double")
    mine = spark.createDataFrame([("A", day(k), float(x)) for k, x in enumerate(np.concatenate([r[:100], -r[100:]]))], "ticker string, d date, r double")
    cuts = spark.createDataFrame([("A", day(99))], "ticker string, cut date")
    assert math.isclose(screen.diversifier(mine, book_rows, cuts).first()["rho"], 1.0) and abs(screen.diversifier(mine, book_rows).first()["rho"]) < 0.5
    assert [r["status"] for r in asked.select(screen.role_row(F.lit("improved")).alias("status")).limit(1).collect()] == ["pass"]


def test_price_tables(spark, tmp_path):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [("A", D(2024, 1, 8), 5.0, "raw", "x", t("2024-01-09T20:00:00")), ("A", D(2024, 1, 8), 6.0, "raw", "x", t("2024-01-09T23:00:00")), ("A", D(2024, 1, 9), -1.0, "raw", "x", t("2024-01-09T23:00:00")), ("B", D(2024, 1, 1), 7.0, "raw", "x", t("2024-01-01T00:00:00")), ("A", D(2024, 1, 8), 9.0, "total_return", "x", t("2024-01-09T23:00:00"))]
    price_tables.write_series(spark.createDataFrame(rows, price_tables.SERIES), str(tmp_path / "s"))
    got = price_tables.read_series(spark, str(tmp_path / "s"), "raw", now)
    assert [(r["ticker"], r["close"]) for r in got.collect()] == [("A", 6.0)]
    assert price_tables.read_series(spark, str(tmp_path / "s"), "raw", now, allow_stale=True).count() == 2
    price_tables.write_series(spark.createDataFrame([("C", D(2024, 1, 9), 1.0, "raw", "y", t("2024-01-09T23:00:00"))], price_tables.SERIES), str(tmp_path / "s"))
    assert sorted(r["ticker"] for r in price_tables.read_series(spark, str(tmp_path / "s"), "raw", now).collect()) == ["A", "C"] and price_tables.read_series(spark, str(tmp_path / "s"), "total_return", now).count() == 1
    assert [r["ticker"] for r in price_tables.covers(spark.createDataFrame(rows, price_tables.SERIES), F.lit("2024-01-12").cast("date")).collect()] == ["A"]
    first = price_tables.first_provider(spark.createDataFrame([("A", 1.0)], "ticker string, close double"), spark.createDataFrame([("A", 2.0), ("B", 3.0)], "ticker string, close double"))
    assert sorted(tuple(r) for r in first.collect()) == [("A", 1.0), ("B", 3.0)]
    raw = spark.createDataFrame([("A", "2024-01-01T00:00:00Z", "10", "9", "1"), ("A", "2024-01-02", "5", "9.5", "2.0"), ("A", "2024-01-03", "nan", "x", None), ("A", "bad", "1", "1", "1")], "ticker string, date string, close string, adjClose string, splitFactor string")
    assert [r["close"] for r in price_tables.provider_closes(raw, False).orderBy("d").collect()] == [5.0, 5.0] and [r["close"] for r in price_tables.provider_closes(raw, True).orderBy("d").collect()] == [9.0, 9.5]
    splits = spark.createDataFrame([("A", D(2024, 1, 1), 2.0), ("A", D(2024, 1, 2), 1.0), ("B", D(2024, 1, 3), 0.0), ("C", None, 3.0), ("D", D(2024, 1, 3), float("nan"))], "ticker string, d date, ratio double")
    clean = price_tables.clean_splits(splits)
    assert [tuple(r) for r in clean.collect()] == [("A", D(2024, 1, 1), 2.0)]
    kept = price_tables.split_rows_to_keep(clean, spark.createDataFrame([("A",), ("Z",)], "ticker string"), now)
    assert {(r["ticker"], r["ratio"]) for r in kept.collect()} == {("A", 2.0), ("Z", 1.0)}
    latest = spark.createDataFrame([("A", D(2024, 1, 9), 3.0, "p", t("2024-01-09T12:00:00"))], "ticker string, asof_date date, close double, source string, fetched_at timestamp")
    price_tables.append_latest(latest, str(tmp_path / "l"))
    price_tables.append_latest(latest.withColumns({"close": F.lit(4.0), "fetched_at": F.col("fetched_at") + F.expr("interval 1 hour")}), str(tmp_path / "l"))
    assert price_tables.latest_cached(spark.read.parquet(str(tmp_path / "l")), F.lit("2024-01-10").cast("date"), now).first()["close"] == 4.0


def test_cache_tables_can_be_written_again(spark, tmp_path, monkeypatch):
    from tidemark.sources import cache

    monkeypatch.setattr(cache, "BUCKETS", 4)
    now, at = F.lit("2024-02-01 00:00:00").cast("timestamp"), lambda h: dt.datetime(2024, 1, 31, h)
    day = lambda k: D(2024, 1, 1) + dt.timedelta(days=k)
    first = spark.createDataFrame([(f"T{k % 9}", day(k // 9), float(k + 1), "raw", "x", at(8)) for k in range(180)], price_tables.SERIES)
    again = spark.createDataFrame([("T1", day(0), 500.0, "raw", "y", at(9)), ("T1", day(1), 600.0, "raw", "y", at(7)), ("T2", day(40), 700.0, "raw", "y", at(9)), (None, day(1), 1.0, "raw", "y", at(9)), ("T1", day(0), 9.0, "total_return", "y", at(9))], price_tables.SERIES)
    path = str(tmp_path / "s")
    read = lambda: sorted(map(tuple, price_tables.read_series(spark, path, "raw", now, True).select("ticker", "d", "close").collect()))
    files = lambda folder: sorted(p.name for p in (tmp_path / folder).rglob("part-*"))
    price_tables.write_series(first, path)
    once, there = read(), len(files("s"))
    assert len(once) == 180 and there <= 4
    price_tables.write_series(first, path)
    assert read() == once and len(files("s")) == there
    for _ in range(2):
        price_tables.write_series(again, path)
        assert read() == sorted([x for x in once if x[:2] != ("T1", day(0))] + [("T1", day(0), 500.0), ("T2", day(40), 700.0)])
        assert price_tables.read_series(spark, path, "total_return", now, True).count() == 1 and len(files("s")) <= 8
    latest = first.select("ticker", F.col("d").alias("asof_date"), "close", "source", "fetched_at")
    for _ in range(3):
        price_tables.append_latest(latest, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 180 and len(files("l")) <= 4
    splits = spark.createDataFrame([("A", day(1), 2.0, at(1)), ("A", day(2), 3.0, at(1)), ("Z", D(1970, 1, 1), 1.0, at(1))], "ticker string, d date, ratio double, fetched_at timestamp")
    newer = spark.createDataFrame([("A", day(2), 3.0, at(2)), ("A", day(2), 3.0, at(2))], splits.schema)
    for rows, known in ((splits, [("A", day(1), 2.0), ("A", day(2), 3.0)]), (newer, [("A", day(2), 3.0)]), (newer, [("A", day(2), 3.0)]), (splits.limit(0), [("A", day(2), 3.0)])):
        price_tables.write_splits(rows, str(tmp_path / "p"))
        found, asked = price_tables.read_splits(spark, str(tmp_path / "p"), now)
        assert sorted(map(tuple, found.collect())) == known and sorted(r["ticker"] for r in asked.collect()) == ["A", "Z"]


def test_fund_facts(spark, tmp_path):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    raw = spark.createDataFrame(
        [("A", "0.001", "nan", "5", " Large ", "", None, "ETF", "86400", [("x ", 0.5), (None, 0.1), ("y", float("nan"))]), ("B", "oops", "1e9", None, None, "f", "t", "q", None, None)],
        "ticker string, expense_ratio string, aum string, avg_volume string, category string, family string, legal_type string, quote_type string, inception_epoch string, holdings array<struct<symbol:string,weight:double>>",
    )
    facts = {r["ticker"]: r for r in price_tables.normalise_facts(raw).collect()}
    assert (facts["A"]["expense_ratio"], facts["A"]["aum"], facts["A"]["category"], facts["A"]["family"], facts["A"]["inception"], facts["A"]["top_holdings"]) == (0.001, None, "Large", None, D(1970, 1, 2), {"X": 0.5})
    assert (facts["B"]["expense_ratio"], facts["B"]["aum"], facts["B"]["inception"], facts["B"]["top_holdings"]) == (None, 1e9, None, {})
    stored = price_tables.normalise_facts(raw).withColumn("fetched_at", F.lit("2024-01-08 00:00:00").cast("timestamp"))
    price_tables.write_facts(stored, str(tmp_path / "f"))
    price_tables.write_facts(stored.where("ticker = 'A'").withColumns({"category": F.lit("New"), "fetched_at": F.lit("2024-01-09 00:00:00").cast("timestamp")}), str(tmp_path / "f"))
    (tmp_path / "f" / "part-broken.json").write_text('not json\n{"ticker": "C", "fetched_at": "2020-01-01T00:00:00.000Z"}\n{"ticker": "D", "aum": 1.0}\n')
    got = {r["ticker"]: r for r in price_tables.read_facts(spark, str(tmp_path / "f"), now).collect()}
    assert set(got) == {"A", "B"} and got["A"]["category"] == "New" and got["A"]["top_holdings"] == {"X": 0.5} and got["A"]["inception"] == D(1970, 1, 2)
    panel = {r["ticker"]: r for r in report.securities(price_tables.normalise_facts(raw), F.lit("2024-01-01").cast("date")).collect()}
    assert (panel["A"]["expense"], panel["A"]["aum"], panel["A"]["kind"]) == ("0.10%", "n/a", "ETF — Large") and panel["B"]["aum"] == "$1.00B"


def test_exports(spark, tmp_path):
    ledger_files_rows = ledger_files.demo_ledger(spark)
    assert {r["action"] for r in ledger_files_rows.collect()} == {"deposit", "buy", "dividend", "interest", "sell", "fee", "withdraw"}
    price_tables.export_ledger(ledger_files_rows.withColumn("note", F.lit("=x")), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["Date", "Code", "DataSource", "Currency", "Price", "Quantity", "Action", "Fee", "Note"] and {r["Note"] for r in back.collect()} == {"'=x"} and back.count() == len(ledger_files.DEMO)
    rows = price_tables.target_rows(spark.createDataFrame([("A", 0.6), ("B", 0.39999), ("C", 0.00001), ("D", 0.0)], "ticker string, w double"))
    assert [tuple(r) for r in rows.collect()] == [("A", "60.00"), ("B", "40.00"), ("C", "0.01"), ("D", "0.00")]
    price_tables.write_target(spark.createDataFrame([("A", 0.6), ("B", 0.4)], "ticker string, w double"), str(tmp_path / "target"))
    assert {r["ticker"]: r["w"] for r in ledger_files.read_target(spark, str(tmp_path / "target")).collect()} == {"A": 0.6, "B": 0.4}
    figures = spark.createDataFrame([("b", "Max DD", -0.1, "-10%"), ("b", "odd", float("nan"), "nan%")], "book string, token string, value double, rendered string")
    assert fence.claims_of(figures, "book").first()["claims"] == {"max_dd": "-10%"}


def test_claims_and_panels(spark):
    gaps = spark.createDataFrame([("b", "us-large", 0.02), ("b", "gold", float("nan"))], "book string, role string, exposure double")
    menu = spark.createDataFrame([("b", "us-large", 1, "V.1", "Fund  of \n funds", "f"), ("b", "us-large", 2, "W", "Other", "f")], "book string, role string, place int, ticker string, name string, flavor string")
    checks = spark.createDataFrame([("V.1", "cost", "pass"), ("V.1", "overlap", "fail"), ("V.1", "age", "warn"), ("V.1", "role", "pass")], "ticker string, check string, status string")
    verdicts = screen.roll_up(checks).select("ticker", "verdict")
    claims = fence.discovery_claims(gaps, menu, verdicts, checks)
    got = {r["token"]: (r["rendered"], r["label"], r["band"]) for r in claims.collect()}
    assert got == {"gap_us_large": ("2%", "the book's exposure to us-large", "very little"), "cand_v_1": ("V.1", "Fund of funds, us-large: the screen says FAIL (cheap, heavy overlap with what you hold)", None)}
    assert fence.prompt_listing(claims, "book", False).first()["listing"] == "{{cand_v_1}}  — Fund of funds, us-large: the screen says FAIL (cheap, heavy overlap with what you hold)\n{{gap_us_large}}  — the book's exposure to us-large (very little)"
    assert "(2%)" in fence.prompt_listing(claims, "book", True).first()["listing"]
    stats = spark.createDataFrame([("p", "with", 0.03), ("p", "without", 0.12)], "pair string, leg string, ulcer double")
    assert {r["token"]: r["band"] for r in fence.benchmark_claims(stats, "60-40").collect()} == {"bench_ulcer_preset": "moderate", "bench_ulcer_reference": "severe", "bench_reference": None}
    shown = {r["ticker"]: r for r in report.candidates(checks).collect()}["V.1"]
    assert shown["counts"] == "1 fail / 1 warn / 2 pass / 0 n-a" and shown["lines"] == "[warn] age\n[pass] cost\n[fail] overlap\n[pass] role"
    assert report.candidates(checks, only_found=True).first()["lines"] == "[warn] age\n[fail] overlap\n[pass] role"
    shelves = spark.createDataFrame([("b", "us-large", "", 2)], "book string, role string, flavor string, n int")
    found = report.discoveries(gaps, menu, shelves, report.candidates(checks)).collect()
    assert [(r["role"], r["held"], r["shown"], r["also"]) for r in found] == [("us-large", "2%", "V.1 FAIL · W N/A", "(unnamed) (2)")]
    closes_ = spark.createDataFrame([("L", D(2024, 1, 1) + dt.timedelta(days=k), float(x)) for k, x in enumerate(100 * np.cumprod(1 + np.random.default_rng(5).normal(0, 0.01, 60)))], "leg string, d date, x double")
    moves = drawdown.pct_change(closes_, "leg", "x")
    panel = drawdown.panel(closes_, bootstrap.intervals(moves, "leg", reps=100), "leg")
    rows = report.leg_panel(panel, spark.createDataFrame([("L", 0.05, 12345.6)], "leg string, annualized double, final_value double")).orderBy("place").collect()
    assert len(rows) == 14 and rows[-1]["v"] == "$12,346" and rows[-2]["v"] == "+5.00%" and " .. " in rows[1]["v"] and rows[0]["metric"] == "Max drawdown"
    assert "<td>a &amp; b</td>" in report.render("t", [{"x": "a & b"}], "html") and report.render("t", [{"x": "a|b"}], "markdown").endswith("| a\\|b |")


def test_returns_summary(spark):
    rows = book(spark, [("CASH", 1, "deposit", 0, 0, 0, 50), ("A", 3, "buy", 1, 100, 0, 0)])
    values = spark.createDataFrame([("b", 110.0, True)], "book string, value double, fully_priced boolean")
    rates = spark.createDataFrame([("b", 0.1, 0.2)], "book string, cumulative double, annualized double")
    got = returns.summary(rows, values, F.lit("2025-01-03").cast("date"), rates).first()
    assert got["period_start"] == D(2024, 1, 3) and got["twr"] == 0.2 and math.isclose(got["money_weighted"], 1.1 ** (365.25 / 366) - 1, rel_tol=1e-9) and math.isclose(got["modified_dietz"], 1.1 ** (365.25 / 366) - 1, rel_tol=1e-9)
    part = returns.summary(rows, values.withColumn("fully_priced", F.lit(False)), F.lit("2025-01-03").cast("date"), rates).first()
    assert part["money_weighted"] is None and part["modified_dietz"] is None and part["twr_cumulative"] == 0.1


def test_format_is_told_by_the_first_character(spark, tmp_path):
    path = tmp_path / "late.json"
    path.write_text("\n \n\n\n  [" + '{"symbol": "A", "unitPrice": 2, "quantity": 3, "type": "BUY", "date": "2024-01-01"}]')
    assert ledger_files.read_ledger(spark, str(path))[0].count() == 1


def test_rows_are_numbered_over_several_tasks(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("Date,Code,Action,Quantity,Price,Fee\n" + "".join(f"2024-01-01,A,buy,{k},1,0\n" for k in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = ledger_files.read_csv(spark, str(path)).select("row_no", "quantity").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r["row_no"] == r["quantity"] for r in rows) and len(rows) == 4000


def test_backtest_names_what_has_no_prices(spark):
    legs = spark.createDataFrame([("x", "A", 0.5), ("x", "B", 0.3), ("x", "Z", 0.2)], "leg string, ticker string, w double")
    px = closes(spark, {"A": [10 + k % 7 for k in range(80)], "B": [20 - k % 5 for k in range(80)]})
    got = {r["schedule"]: r for r in simulate.backtest(px, legs, "monthly").collect()}
    assert set(got) == {"monthly", "never"} and {r["missing"] for r in got.values()} == {"Z"} and got["monthly"]["final_value"] != got["never"]["final_value"] and got["never"]["n"] == 79


def test_fixed_rounds_the_binary_number(spark):
    import random

    from tidemark.functions.scalar import fixed

    r = random.Random(5)
    xs = [0.245, 1.005, 2.675, 0.125, 0.375, 2.5, 3.5, 0.5, -0.5, -0.001, 1e-9, 123456789.125, 0.0, 0.0005, 0.00049999, 999.9995, 9.995, 1e15 + 0.5]
    xs += [r.choice([1, -1]) * r.random() * 10 ** r.randrange(-5, 9) for _ in range(300)] + [r.randrange(-(10**6), 10**6) / 2 ** r.randrange(1, 12) for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[fixed(F.col("x"), k).alias(f"d{k}") for k in range(4)], fixed(F.col("x"), 1, plus=True).alias("plus"), fixed(F.col("x"), 0, commas=True).alias("commas")).collect()
    for row in rows:
        x = row["x"]
        assert tuple(row)[1:] == (f"{x:.0f}", f"{x:.1f}", f"{x:.2f}", f"{x:.3f}", f"{x:+.1f}", f"{x:,.0f}")
    missing = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(fixed(F.col("x"), 2).alias("v")).collect()
    assert [m["v"] for m in missing] == [None] * 3


def test_cdar_is_a_magnitude(spark):
    from datetime import date, timedelta

    from tidemark.operators import bootstrap, drawdown, fence

    levels = [100.0, 110.0, 99.0, 104.5, 110.0, 88.0, 121.0] + [121.0 + k for k in range(33)]
    df = spark.createDataFrame([("a", date(2020, 1, 1) + timedelta(days=k), x) for k, x in enumerate(levels)], "ticker string, d date, x double")
    # the two deepest of 40 days: 88 and 99 of 110
    assert drawdown.cdar(drawdown.curve(df, "ticker"), "ticker").first()["cdar"] == pytest.approx((0.2 + 0.1) / 2)
    steps = np.diff(levels) / np.array(levels[:-1])
    assert bootstrap.metric(steps[None, :], "cdar")[0] > 0
    words = spark.createDataFrame([("cdar", 0.02), ("cdar", 0.40)], "t string, v double").select(fence.band_of(F.col("t"), F.col("v")).alias("w")).collect()
    assert [w["w"] for w in words] == ["mild", "severe"]


@pytest.mark.parametrize(("n", "told"), [(125, False), (126, True)])
def test_held_out_clause_tells_a_years_return_from_126_returns_on(spark, n, told):
    from datetime import date, timedelta

    from tidemark.operators import simulate

    rows = [("p", date(2020, 1, 1) + timedelta(days=k), 0.01 if k % 2 else -0.008, 0.008 if k % 2 else -0.004) for k in range(n)]
    stats = simulate.window_stats(spark.createDataFrame(rows, "pair string, d date, r_without double, r_with double"))
    clause = simulate.figure_clause(stats).first()["clause"]
    plain = {}
    for leg, at in (("without", 2), ("with", 3)):
        g = np.cumprod([1 + r[at] for r in rows])
        dd = g / np.maximum.accumulate(g) - 1
        deep = (np.append(1.0, g) / np.maximum.accumulate(np.append(1.0, g)) - 1).min()
        plain[leg] = ((dd**2).mean() ** 0.5 * 100, -np.sort(dd)[: int(np.ceil(0.05 * n))].mean() * 100, deep * 100, (g[-1] ** (252 / n) - 1) * 100)
    w, o = plain["with"], plain["without"]
    expected = f"Ulcer {w[0]:.2f}% vs {o[0]:.2f}% without; CDaR {w[1]:.2f}% vs {o[1]:.2f}%; max DD {w[2]:.1f}% vs {o[2]:.1f}% (context)"
    assert clause == expected + (f"; return {w[3]:+.1f}% vs {o[3]:+.1f}%/yr ({w[3] - o[3]:+.1f}pp, context)" if told else "")


def test_brief_claims(spark):
    day = lambda k: D(2024, 1, k)
    totals = spark.createDataFrame([("b", 1234.5, 900.0, 950.0, 284.5, -10.0, 274.5, 3), ("c", 0.0, 0.0, 0.0, 0.0, 5.0, 5.0, 0)], "book string, value double, priced_cost double, cost_basis double, unrealized double, realized double, net double, n_priced long")
    summary = spark.createDataFrame([("b", day(1), D(2025, 1, 1), 0.1, None, 0.12, 0.2), ("c", day(1), day(1), None, float("nan"), None, None)], "book string, period_start date, asof_date date, money_weighted double, modified_dietz double, twr double, twr_cumulative double")
    risk = spark.createDataFrame([("b", -0.0984, day(2), day(5), None, 40, 0.5, 0.024, 0.0667, 1.55, None, 1.73)], "book string, depth double, peak_date date, trough_date date, recovery_date date, duration_days int, underwater double, ulcer double, cdar double, sharpe double, sortino double, calmar double")
    given = spark.createDataFrame([("b", -321.4)], "book string, depth double")
    rows = fence.brief_claims(totals, summary, risk, given).collect()
    got = {r["token"]: (r["rendered"], r["band"]) for r in rows if r["book"] == "b"}
    assert got == {
        "total_market_value": ("$1,234", None), "unrealized_pnl": ("$284", None), "net_pnl": ("$274", None), "n_holdings": ("3", None), "total_cost_basis": ("$950", None), "realized_pnl": ("-$10", None),
        "twr_annual": ("+12.00%", "healthy"), "mwr_annual": ("+10.00%", "healthy"), "period_start": ("2024-01-01", None), "period_end": ("2025-01-01", None), "period_years": ("1.00y", None),
        "max_drawdown": ("-9.84%", "moderate"), "drawdown_peak_date": ("2024-01-02", None), "drawdown_trough_date": ("2024-01-05", None), "drawdown_duration_days": ("40 days", None), "time_underwater_pct": ("50%", None),
        "ulcer": ("2.40%", "moderate"), "cdar": ("6.67%", "moderate"), "sharpe": ("+1.55", "solid"), "calmar": ("+1.73", "solid"), "gains_given_back": ("-$321", None),
    }
    assert {r["token"] for r in rows if r["book"] == "c"} == {"realized_pnl"}


def test_returns_lines(spark):
    summary = spark.createDataFrame([("b", D(2024, 1, 1), D(2024, 3, 1), 0.1, None, None, 0.05), ("c", D(2023, 1, 1), D(2024, 3, 1), None, 0.07, 0.2, 0.25)], "book string, period_start date, asof_date date, money_weighted double, modified_dietz double, twr double, twr_cumulative double")
    left = spark.createDataFrame([("c", "Z"), ("c", "A"), ("c", "A")], "book string, ticker string")
    got = {}
    for r in report.returns_lines(summary, left).orderBy("book", "place").collect():
        got.setdefault(r["book"], []).append((r["metric"], r["v"]))
    assert got["b"] == [("Period", "2024-01-01 to 2024-03-01 (60 days, 0.16 years)"), ("Time-weighted", "n/a"), ("Time-weighted so far, not for a year", "+5.00%"), ("Money-weighted", "+10.00%"), ("Modified Dietz", "n/a")]
    assert got["c"][1:] == [("Time-weighted", "+20.00%"), ("Money-weighted", "n/a"), ("Modified Dietz", "+7.00%"), ("Left out of time-weighted returns and risk", "A, Z")]


def test_no_rebalancing_over_part_of_a_book(spark):
    held = spark.createDataFrame([("b", "A", 60.0), ("b", "B", 40.0), ("c", "A", 10.0), ("c", "X", 5.0), ("c", "N", 5.0)], "book string, ticker string, value double")
    prices = spark.createDataFrame([("A", 2.0), ("B", 4.0), ("N", float("nan"))], "ticker string, price double")
    target = spark.createDataFrame([("A", 0.5), ("B", 0.5), ("Y", 0.0)], "ticker string, w double")
    assert [tuple(r) for r in allocate.refusals(held, prices).collect()] == [("c", "N, X")]
    for mode in ("to_total", "bands", "cash_flow_only", "fixed_dca"):
        assert {r["book"] for r in allocate.suggest(mode, held, prices, target, 10.0).collect()} == {"b"}


def test_screen_gives_reasons_and_looks_no_further_than_the_cut(spark):
    days = 900
    at = lambda k: D(2020, 1, 1) + dt.timedelta(days=k)
    r = np.random.default_rng(12)
    moves = {t: r.normal(0.0005, 0.01, days) for t in ("C", "H", "G")}
    moves["H"][600:620] -= 0.04  # the held fund falls behind the cut
    level = {t: 100 * np.cumprod(1 + m) for t, m in moves.items()}
    px = spark.createDataFrame([(t, at(k), float(x)) for t, xs in level.items() for k, x in enumerate(xs)], "ticker string, d date, close double")
    book_rows = spark.createDataFrame([(at(k), float(m)) for k, m in enumerate(moves["G"]) if k], "d date, r double")
    facts = spark.createDataFrame([("C", "Large", None, 0.004, 2e8, 5e4, D(2018, 1, 1), 0.6), ("H", "Large", None, 0.001, 2e8, 5e5, D(2018, 1, 1), 0.1)], "ticker string, category string, legal_type string, expense_ratio double, aum double, avg_volume double, inception date, top_share double")
    held, asked = spark.createDataFrame([("H",)], "ticker string"), spark.createDataFrame([("C",), ("none",)], "ticker string")
    look = spark.createDataFrame([("C", "x", 0.5), ("H", "x", 0.3)], "ticker string, symbol string, w double")
    role = spark.createDataFrame([("C", "improved", at(800), "Ulcer 1% vs 2%")], "ticker string, verdict string, in_sample_end date, reason string")
    end = spark.createDataFrame([(at(850),)], "in_sample_end date")
    today = F.lit("2022-01-01").cast("date")
    for cut, judged in ((800, role), (400, role.withColumn("in_sample_end", F.lit(at(400)))), (days, None)):
        got = {(x["ticker"], x["check"]): (x["status"], x["reason"]) for x in screen.screen(asked, facts, held, look, px, book_rows, today, judged, end).collect()}
        n = min(cut, days - 1)
        c, g = moves["C"][1 : n + 1], moves["G"][1 : n + 1]
        seen = {t: x[: n + 1] / np.maximum.accumulate(x[: n + 1]) - 1 for t, x in level.items()}
        note = f" [in-sample through {at(cut)}]" if judged is not None else ""
        assert f"correlation {np.corrcoef(c, g)[0, 1]:+.2f} over {n} days, {np.corrcoef(c[g < 0], g[g < 0])[0, 1]:+.2f} on red ones; " in got["C", "diversifier"][1] and got["C", "diversifier"][1].endswith(note)
        if n / 365.25 < 2:
            assert got["C", "own_drawdown"] == ("n/a", f"only {n / 365.25:.1f} years of history{note}")
        else:
            assert f"fell {seen['C'].min() * 100:.1f}%" in got["C", "own_drawdown"][1] and f"H of what is held fell {seen['H'].min() * 100:.1f}%" in got["C", "own_drawdown"][1]
        assert got["C", "cost"] == ("warn", "0.40% a year, not cheap") and got["C", "liquidity"] == ("warn", "$200M, 50,000 shares a day: one too small") and got["C", "concentration"][0] == "warn"
        assert got["C", "overlap"] == ("pass", "30% in common with H") and got["none", "cost"] == ("n/a", "not published") and got["none", "diversifier"] == ("n/a", "no usable price history")
        assert (("C", "role") in got) == (judged is not None)
    assert got["C", "structure"] == ("pass", "Large")


"""Hand-sized cases: boundaries, ties, missing values, and what must not change results."""

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from remitlens.functions import scalar as S
from remitlens.operators import banks, graph, rates, routing
from remitlens.params import Params, Period
from remitlens.plans import queries as Q
from remitlens.schema import TRANSFERS
from remitlens.sources.files import rates_of

P = Params()
NAN = float("nan")


def make(spark, *rows):
    """Transfers from (from_bank, from_account, to_bank, to_account, amount, currency, format, timestamp)."""
    full = []
    for i, r in enumerate(rows):
        a, b, c, d, amount, currency, kind, ts = [*r, *("US Dollar", "Wire", "2022/09/01 10:00")[len(r) - 5 :]]
        at = datetime.strptime(ts, "%Y/%m/%d %H:%M")
        full.append((i, at, int(at.strftime("%Y%m%d")), a, b, c, d, amount, currency, kind))
    return spark.createDataFrame(full, TRANSFERS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_q1_is_strict_and_exact(spark):
    amounts = [49.99, 50.0, 0.0, -1.0, NAN, None]
    tx = make(spark, *[(1, "a", 2, "b", x) for x in amounts], (1, "a", 2, "b", 1.0, "us dollar"))
    assert sorted(r["amount_paid"] for r in Q.small_transfers(tx, P).collect()) == [-1.0, 0.0, 49.99]


def test_q1_keeps_repeated_rows(spark):
    tx = make(spark, (1, "a", 2, "b", 1.0), (1, "a", 2, "b", 1.0))
    assert Q.small_transfers(tx, P).count() == 2


@pytest.mark.parametrize("parts", [1, 5])
def test_q2_tie_takes_the_first_transfer(spark, parts):
    tx = make(spark, (1, "late", 2, "b", 5.0), (1, "first", 2, "b", 9.0), (1, "second", 2, "b", 9.0), (1, "n", 2, "b", NAN))
    assert [r["from_account"] for r in banks.largest(tx.repartition(parts)).collect()] == ["first"]


def test_q2_names(spark):
    accounts = spark.createDataFrame([(0, 1, "One"), (1, 1, "Uno"), (2, 2, "  "), (3, 4, "Four")], "seq long, bank_id long, bank_name string")
    tx = make(spark, *[(b, "a", 9, "z", 1.0) for b in (1, 2, 3, 4)])
    found = {r["from_bank"]: r["bank_name"] for r in Q.largest_per_bank(tx, accounts, P).collect()}
    assert found == {1: "One", 2: "UNKNOWN_2", 3: "UNKNOWN_3", 4: "Four"}
    other = replace(P, bank_names="last", unknown_bank="BANK_")
    found = {r["from_bank"]: r["bank_name"] for r in Q.largest_per_bank(tx, accounts, other).collect()}
    assert found == {1: "Uno", 2: "BANK_2", 3: "BANK_3", 4: "Four"}


def test_q3_is_strict_and_drops_unknown_formats(spark):
    later = "2022/09/06 00:00"
    tx = make(
        spark,
        (1, "a", 2, "b", 100.0),
        (1, "a", 2, "b", 300.0),
        (3, "exact", 2, "b", 2.0, "US Dollar", "Wire", later),
        (3, "below", 2, "b", 1.99, "US Dollar", "Wire", later),
        (3, "other", 2, "b", 0.01, "US Dollar", "Cheque", later),
        (3, "nan", 2, "b", NAN, "US Dollar", "Wire", later),
    )
    assert rows(Q.below_format_average(tx, P)) == [(3, "below", 1.99)]


@pytest.mark.parametrize(
    ("ts", "branch"),
    [("2022/08/31 23:59", 2), ("2022/09/01 00:00", 0), ("2022/09/05 23:59", 0), ("2022/09/06 00:00", 1), ("2022/09/15 23:59", 1), ("2022/09/16 00:00", 2)],
)
def test_period_edges(spark, ts, branch):
    parts = routing.split_periods(make(spark, (1, "a", 2, "b", 1.0, "US Dollar", "Wire", ts)), P)
    assert [p.count() for p in parts] == [int(i == branch) for i in range(3)]


def test_null_goes_to_the_side_of_no_match(spark):
    tx = make(spark, (1, "a", 2, "b", None), (1, "a", 2, "b", 1.0))
    assert [p.count() for p in routing.route(tx, F.col("amount_paid") < 50)] == [1, 1]
    assert tuple(routing.counted(tx, F.col("amount_paid") < 50).first()) == (2, 1, 1)


def fan(n, target, bank=1):
    """a to n intermediaries and on to the target."""
    return [x for i in range(n) for x in ((bank, "a", 5, f"m{i}", 1.0), (5, f"m{i}", *target, 1.0))]


def test_q4_threshold_repeats_and_identity(spark):
    tx = make(spark, *fan(5, (2, "b")), *fan(4, (2, "c")), *fan(5, (2, "b")), (1, "a", 5, "m9", 1.0), (5, "m9", 3, "c", 1.0))
    assert rows(Q.scatter_gather(tx, P)) == [(1, "a", 2, "b")]


def test_q4_excludes_the_account_itself_but_not_its_number(spark):
    tx = make(spark, *fan(5, (1, "a")), *fan(5, (2, "a")))
    assert rows(Q.scatter_gather(tx, P)) == [(1, "a", 2, "a")]


def test_q4_self_loops_are_intermediaries(spark):
    tx = make(spark, (1, "a", 1, "a", 1.0), (1, "a", 2, "b", 1.0), (2, "b", 2, "b", 1.0), *fan(3, (2, "b")))
    assert rows(Q.scatter_gather(tx, P)) == [(1, "a", 2, "b")]


def test_q4_pruning_only_where_it_is_safe(spark):
    tx = make(spark, *fan(6, (2, "b")), (1, "x", 5, "m0", 1.0))
    for degree, least in ((5, 5), (3, 6), (6, 3)):
        found = [rows(graph.scatter_gather(tx, degree, least, prune)) for prune in (True, False)]
        assert found[0] == found[1] and len(found[0]) == 1


@pytest.mark.parametrize("most", [4096, 3, 1])
def test_q4_wide_intermediaries_are_dealt_to_groups(spark, monkeypatch, most):
    star = [x for i in range(30) for x in ((1, f"s{i % 6}", 5, f"m{i % 5}", 1.0), (5, f"m{i % 5}", 2, f"t{i % 12}", 1.0))]
    tx = make(spark, *star, *fan(5, (2, "b")), *((1, f"s{i}", 5, f"m{j}", 1.0) for i in range(6) for j in range(5)), *((5, f"m{j}", 2, "t0", 1.0) for j in range(5)))
    expected = rows(graph.scatter_gather(tx, 5, 5))
    monkeypatch.setattr(graph, "GROUP_EDGES", most)
    assert len(expected) > 6 and rows(graph.scatter_gather(tx, 5, 5)) == expected
    monkeypatch.setattr(graph, "BROADCAST_WIDE", 1)
    assert rows(graph.scatter_gather(tx, 5, 5)) == expected


RATES = [(20220901, "EUR", 0.5), (20220903, "EUR", 4.0), (20220901, "GBP", 0.0)]


@pytest.mark.parametrize(
    ("amount", "currency", "ts", "as_of", "exact"),
    [
        (0.4, "Euro", "2022/09/01 09:00", 1, 1),
        (0.5, "Euro", "2022/09/01 09:00", 0, 0),
        (0.4, "Euro", "2022/09/02 09:00", 1, 0),
        (3.9, "Euro", "2022/09/05 09:00", 1, 0),
        (0.1, "Bitcoin", "2022/09/01 09:00", 0, 0),
        (0.1, "Doubloon", "2022/09/01 09:00", 0, 0),
        (0.1, "UK Pound", "2022/09/01 09:00", 0, 0),
        (0.9, "us DOLLAR", "2022/09/04 09:00", 1, 1),
        (1.0, "US Dollar", "2022/09/04 09:00", 0, 0),
        (NAN, "US Dollar", "2022/09/04 09:00", 0, 0),
    ],
)
def test_q5(spark, amount, currency, ts, as_of, exact):
    tx = make(spark, (1, "a", 2, "b", amount, currency, "ACH", ts))
    quotes = rates_of(spark, RATES)
    assert Q.micro_transfers(tx, quotes, P).first()[0] == as_of
    assert Q.micro_transfers(tx, quotes, replace(P, rates_as_of=False)).first()[0] == exact


def test_q5_takes_the_earliest_rate_where_none_is_earlier(spark):
    tx = make(spark, (1, "a", 2, "b", 0.4, "Euro", "Wire", "2022/09/01 09:00"))
    late = rates_of(spark, [(20220904, "EUR", 0.5), (20220905, "EUR", 0.1)])
    assert Q.micro_transfers(tx, late, P).first()[0] == 1
    assert [tuple(r) for r in rates.as_of_days(tx, late).collect()] == [(20220901, 20220904)]


def test_q5_of_nothing_is_one_row(spark):
    assert [tuple(r) for r in Q.micro_transfers(make(spark, (1, "a", 2, "b", 0.1)).limit(0), rates_of(spark, RATES), P).collect()] == [(0,)]


def test_e6_bounds_are_exclusive(spark):
    out = [(1, f"s{n}", 2, f"t{i}", 1.0) for n in (5, 6, 9, 10) for i in range(n)]
    assert {r["from_account"] for r in Q.fan_out_range(make(spark, *out)).collect()} == {"s6", "s9"}


def test_text_period_leaves_out_the_last_day(spark):
    tx = make(spark, *[(1, "a", 2, "b", 1.0, "US Dollar", "Wire", t) for t in ("2022/09/01 00:00", "2022/09/05 23:59", "2022/09/06 00:00")])
    assert Q.text_period(tx, "2022/09/01", "2022/09/06").count() == 2


def test_union_of_branches_is_the_dollar_filter(spark):
    tx = make(spark, *[(1, "a", 2, "b", 1.0, c, "Wire", t) for c in ("US Dollar", "Euro") for t in ("2022/08/01 00:00", "2022/09/02 00:00", "2022/09/07 00:00")])
    union = routing.union_all([routing.usd(p, P) for p in routing.split_periods(tx, P)])
    assert union.exceptAll(routing.usd(tx, P)).isEmpty() and routing.usd(tx, P).exceptAll(union).isEmpty()


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_change_results(spark, parts):
    tx = make(spark, *fan(7, (2, "b")), *fan(5, (3, "c"), 4)).repartition(parts)
    assert rows(Q.scatter_gather(tx, P)) == [(1, "a", 2, "b"), (1, "a", 3, "c"), (4, "a", 2, "b"), (4, "a", 3, "c")]


def test_empty_transfers(spark):
    tx = make(spark, (1, "a", 2, "b", 1.0)).limit(0)
    accounts = spark.createDataFrame([], "seq long, bank_id long, bank_name string")
    for df in (Q.small_transfers(tx, P), Q.largest_per_bank(tx, accounts, P), Q.below_format_average(tx, P), Q.scatter_gather(tx, P), Q.shared_accounts(tx)):
        assert df.count() == 0


def test_params():
    made = Params.from_env({"PERIOD1_START": "20230101", "PERIOD1_END": "20230102", "AMOUNT_THRESHOLD_USD": "7.5", "SUSPICIOUS_THRESHOLD": "3"})
    assert made.period1 == Period(date(2023, 1, 1), date(2023, 1, 2)) and made.small_amount == 7.5 and made.suspicious_degree == 3
    for bad in ({"AMOUNT_THRESHOLD_USD": "-1"}, {"PERIOD2_START": "20230230"}, {"PERIOD1_START": "20991231"}):
        with pytest.raises(ValueError):
            Params.from_env(bad)


def test_formats_from_the_environment():
    assert Params.from_env({"PAYMENT_FORMATS": " Wire, ,Cash,"}).formats == ("Wire", "Cash")


def test_the_base_currency_is_fixed(spark):
    tx = make(spark, (1, "a", 2, "b", 0.6, "Euro", "Wire", "2022/09/01 09:00"), (1, "a", 2, "b", 0.6, "US Dollar", "Wire", "2022/09/01 09:00"))
    p = Params.from_env({"CURRENCY_USD": "Euro"})
    assert Q.micro_transfers(tx, rates_of(spark, RATES), p).first()[0] == 1 and Q.small_transfers(tx, p).count() == 1


def exchanged(df):
    """The operators under the exchanges of a plan before it runs."""
    return [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "SortMergeJoin" in x or "ShuffledHashJoin" in x]


def test_transfers_are_not_shuffled_for_rates_or_averages(spark):
    from conftest import SMALL

    from remitlens.sources import derived

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tx, p = derived.transfers(spark, SMALL), derived.PARAMS
        for df in (Q.micro_transfers(tx, derived.rates(spark), p), Q.micro_transfers(tx, derived.rates(spark), replace(p, rates_as_of=False)), Q.below_format_average(tx, p)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not exchanged(df) and "BroadcastHashJoin" in plan and plan.count("FileScan") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_user_functions_of_batches(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    tx = make(spark, (1, "a", 9, "b", 5.0), (2, "c", 9, "b", 6.0)).select("tx_id", "amount_paid")
    doubled = routing.map_batches(tx, lambda b: pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), 2.0)], names=["tx_id", "twice"]), "tx_id long, twice double")
    assert rows(doubled) == [(0, 10.0), (1, 12.0)]


def test_as_of_days_by_lookup_and_by_one_pass(spark, monkeypatch):
    days = spark.createDataFrame([(d,) for d in (20220801, 20220901, 20220902, 20221001, 20220902, None)], "tx_date int")
    quotes = rates_of(spark, [(20220901, "EUR", 1.0), (20220905, "EUR", 1.0), (20220905, "GBP", 1.0)])
    expected = [(20220801, 20220901), (20220901, 20220901), (20220902, 20220901), (20221001, 20220905)]
    assert rows(rates.as_of_days(days, quotes)) == expected
    monkeypatch.setattr(rates, "RATE_DAYS", 1)
    assert [r for r in sorted(map(tuple, rates.as_of_days(days, quotes).collect()), key=str) if r[0]] == expected
    assert rates.as_of_days(days, quotes.limit(0)).count() == 0


def test_sorted_results(spark):
    tx = make(spark, (3, "a", 9, "b", 5.0), (1, "a", 9, "b", 4.0, "US Dollar", "Cash", "2022/09/01 09:00"), (2, "c", 9, "b", 6.0))
    from remitlens.operators import formats

    assert [r["from_bank"] for r in Q.in_bank_order(banks.largest(tx)).collect()] == [1, 2, 3]
    assert [r["payment_format"] for r in Q.in_format_order(formats.sums(tx)).collect()] == ["Cash", "Wire"]
    assert [r["tx_id"] for r in Q.head(tx.orderBy("tx_id"), 2).collect()] == [0, 1]


def test_day_numbers(spark):
    row = spark.range(1).select(S.iso_day(F.lit(20240229)), S.iso_day(F.lit(20230229)), S.money_text(F.lit(3.5)), S.account_key(F.lit(7), F.lit("x"))).first()
    assert tuple(row) == ("2024-02-29", None, "3.50", "7|x")


def test_period_filter_reaches_the_scan(spark, capsys):
    from conftest import SMALL

    from remitlens.sources import derived

    Q.small_transfers(routing.in_period(derived.transfers(spark, SMALL), derived.PARAMS.period1), P).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "event_type" not in plan

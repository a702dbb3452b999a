"""Files in, files out, incremental runs."""

import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from remitlens import client, compare
from remitlens.params import Params
from remitlens.plans import queries as Q
from remitlens.sources import derived, files
from remitlens.streaming import ingest

# Fixed value: the header of the original files.
HEAD = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
GOOD = "2022/09/01 00:05,020,8000A,4294967295,8000B,10.50,US Dollar, 10.50,US Dollar,Wire,0"


def written(tmp_path, *lines, head=HEAD):
    path = tmp_path / "in.csv"
    path.write_text("\n".join([head, *lines]) + "\n")
    return str(path)


def test_transfers(spark, tmp_path):
    (row,) = files.read_transfers(spark, written(tmp_path, GOOD)).drop("tx_id").collect()
    assert (row["from_bank"], row["to_bank"], row["amount_paid"], row["tx_date"], row["from_account"], row["to_account"]) == (20, 4294967295, 10.5, 20220901, "8000A", "8000B")


@pytest.mark.parametrize(
    "bad",
    [
        GOOD.replace(" 10.50,US", " ten,US"),
        GOOD.replace(" 10.50,US", ",US"),
        GOOD.replace("020", "-20"),
        GOOD.replace("4294967295", "4294967296"),
        GOOD.replace("020", ""),
        GOOD + ",extra",
        GOOD.rsplit(",", 1)[0],
        GOOD.replace("2022/09/01 00:05", "2022/13/01 00:05"),
    ],
)
def test_a_bad_row_fails_the_read(spark, tmp_path, bad):
    with pytest.raises(files.BadRows):
        files.read_transfers(spark, written(tmp_path, GOOD, bad))


def test_nan_is_read_and_dropped_by_queries(spark, tmp_path):
    tx = files.read_transfers(spark, written(tmp_path, GOOD.replace(" 10.50,US", " NaN,US")))
    assert tx.count() == 1 and Q.small_transfers(tx, Params()).count() == 0


def test_bad_rows_can_be_discarded(spark, tmp_path):
    path = written(tmp_path, GOOD, GOOD.replace("020", "-20"), GOOD + ",extra", GOOD.replace("8000A", "8000C"))
    assert [r["from_account"] for r in files.read_transfers(spark, path, discard=True).orderBy("tx_id").collect()] == ["8000A", "8000C"]


def line(account, amount, bank=20):
    return GOOD.replace("8000A", account).replace(" 10.50,US", f"{amount},US").replace(",020,", f",{bank},")


def test_order_follows_files_however_they_are_split(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([HEAD, line("first", 99)]) + "\n")
    (folder / "b.csv").write_text("\n".join([HEAD, *(line(f"b{i:03d}", 99) for i in range(200))]) + "\n")
    (folder / "c.csv").write_text(HEAD + "\n")
    sizes = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "64b"}
    for conf in ({}, sizes):
        for k, v in conf.items():
            spark.conf.set(k, v)
        tx = files.read_transfers(spark, str(folder))
        found = [r["from_account"] for r in tx.orderBy("tx_id").collect()]
        assert found == ["first", *(f"b{i:03d}" for i in range(200))] and tx.select("tx_id").distinct().count() == 201
        assert [r["from_account"] for r in Q.largest_per_bank(tx, spark.createDataFrame([], "seq long, bank_id long, bank_name string"), Params()).collect()] == ["first"]
        if conf:
            assert tx.rdd.getNumPartitions() > 10
    for k in sizes:
        spark.conf.unset(k)


def test_names_of_several_account_files_follow_file_order(spark, tmp_path):
    head = "Bank Name,Bank ID,Account Number,Entity ID,Entity Name"
    (tmp_path / "a.csv").write_text(f"{head}\nEarly,7,A1,E,x\n")
    (tmp_path / "b.csv").write_text("\n".join([head, *(f"Late {i},7,A{i},E,x" for i in range(60))]) + "\n")
    from remitlens.operators import banks

    accounts = files.read_accounts(spark, str(tmp_path))
    assert [banks.names(accounts, which).first()["bank_name"] for which in ("first", "last")] == ["Early", "Late 59"]


def test_accounts(spark, tmp_path):
    path = written(tmp_path, "First Bank,010,A1,E1,Someone", ",7,A2,E2,", head="Bank Name,Bank ID,Account Number,Entity ID,Entity Name")
    assert [(r["bank_id"], r["bank_name"]) for r in files.read_accounts(spark, path).orderBy("seq").collect()] == [(10, "First Bank"), (7, None)]


def test_rates_drop_bad_dates_and_keep_the_last(spark, tmp_path):
    path = tmp_path / "rates.json"
    entries = [("2022-09-01", "EUR", 0.9), ("2022-09-01", "EUR", 0.8), ("someday", "EUR", 1.0)]
    path.write_text(json.dumps([{"date": d, "quote": q, "rate": r} for d, q, r in entries]))
    assert [tuple(r) for r in files.read_rates(spark, str(path)).collect()] == [(20220901, "EUR", 0.8)]


def test_fetch_retries_overload_but_not_refusal(spark):
    calls = []

    def get(url, codes=(503, 429)):
        calls.append(url)
        if len(calls) <= len(codes):
            raise urllib.error.HTTPError(url, codes[len(calls) - 1], "", None, None)
        return b'[{"date": "2022-09-01", "quote": "EUR", "rate": 0.9}]'

    assert files.fetch_rates(spark, "http://x", "a", "b", wait=0, get=get).count() == 1 and len(calls) == 3
    calls.clear()
    with pytest.raises(urllib.error.HTTPError):
        files.fetch_rates(spark, "http://x", "a", "b", wait=0, get=lambda u: get(u, (404,)))
    assert len(calls) == 1


def test_results_and_the_empty_result(spark, tmp_path):
    tx = files.read_transfers(spark, written(tmp_path, GOOD))
    for frame, lines in ((tx, 2), (tx.limit(0), 1)):
        target = files.write_result(Q.small_transfers(frame, Params()), str(tmp_path / "out"), "q1")
        (part,) = (tmp_path / "out" / "result_q1.csv").glob("part-*.csv")
        text = part.read_text().splitlines()
        assert target.endswith("result_q1.csv") and len(text) == lines and text[0] == "From Bank,Account,To Bank,Account.1,Amount Paid"
    assert (tmp_path / "out" / "result_q1.csv" / "_SUCCESS").exists()


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    assert compare.compare(a, a.orderBy(F.desc("a"))).equal
    assert compare.compare(a, a.distinct()) == compare.Difference(1, 0)
    with pytest.raises(ValueError):
        compare.compare(a, a.select("a"))


def test_streams_equal_batch_and_restart_adds_nothing(spark, tmp_path):
    from conftest import SMALL

    p = derived.PARAMS
    tx = derived.transfers(spark, SMALL)
    tx.repartition(3).write.parquet(str(tmp_path / "in"))
    table, state = str(tmp_path / "bronze"), str(tmp_path / "state")
    for _ in range(2):
        ingest.to_bronze(ingest.deduplicated(ingest.arriving(spark, str(tmp_path / "in")), "60 days"), table, state).awaitTermination()
        kept = ingest.bronze(spark, table)
        assert kept.count() == tx.count()
    for query in (Q.below_format_average, Q.scatter_gather, Q.small_transfers):
        assert compare.compare(query(tx, p), query(kept, p)).equal
    live = ingest.arriving(spark, str(tmp_path / "in"))
    daily = ingest.daily_rates(derived.rates(spark), p)
    ingest.run_complete(ingest.micro_transfers(live, daily, p), "q5_live", str(tmp_path / "s5")).awaitTermination()
    assert spark.table("q5_live").first()[0] == Q.micro_transfers(tx, derived.rates(spark), p).first()[0]
    ingest.run_complete(ingest.largest_per_bank(live, p), "q2_live", str(tmp_path / "s2")).awaitTermination()
    from remitlens.operators import banks, routing

    assert compare.compare(banks.largest(routing.usd(tx, p)), spark.table("q2_live")).equal


def test_csv_streams_number_by_arrival_and_add_nothing_twice(spark, tmp_path):
    arriving, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    arriving.mkdir()
    for name, accounts in (("z.csv", ["A", "B"]), ("a.csv", ["C"])):  # a file that arrives later is later, whatever its name
        (arriving / name).write_text("\n".join([HEAD, *(line(x, 99) for x in accounts)]) + "\n")
        for _ in range(2):
            ingest.transfers_from_csv(spark, str(arriving), table, state).awaitTermination()
    kept = ingest.arrived(spark, table)
    assert [r["from_account"] for r in kept.orderBy("tx_id").collect()] == ["A", "B", "C"]
    none = spark.createDataFrame([], "seq long, bank_id long, bank_name string")
    assert [r["from_account"] for r in Q.largest_per_bank(kept, none, Params()).collect()] == ["A"]
    (arriving / "bad.csv").write_text(f"{HEAD}\n{line('D', 'ten')}\n{line('E', 1)}\n")
    with pytest.raises(Exception, match="amount_paid"):
        ingest.transfers_from_csv(spark, str(arriving), table, state).awaitTermination()
    assert ingest.arrived(spark, table).count() == 3
    ingest.transfers_from_csv(spark, str(arriving), table, state, discard=True).awaitTermination()
    assert ingest.arrived(spark, table).count() == 4


def test_queries_over_what_has_arrived(spark, tmp_path):
    """Period 2 arrives before period 1, whose averages it is compared with."""
    late, early = GOOD.replace("2022/09/01", "2022/09/07").replace(" 10.50,US", "0.01,US"), line("a", 10)
    (tmp_path / "tx").mkdir()
    (tmp_path / "acc").mkdir()
    (tmp_path / "acc" / "a.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nOne,20,A,E,x\n")
    ingest.accounts_from_csv(spark, str(tmp_path / "acc"), str(tmp_path / "banks"), str(tmp_path / "s0")).awaitTermination()
    counts = []
    for i, row in enumerate((late, early)):
        (tmp_path / "tx" / f"{i}.csv").write_text(f"{HEAD}\n{row}\n")
        ingest.transfers_from_csv(spark, str(tmp_path / "tx"), str(tmp_path / "table"), str(tmp_path / "s1")).awaitTermination()
        made = ingest.results(spark, str(tmp_path / "table"), str(tmp_path / "banks"), files.rates_of(spark, []), Params(), ["q2", "q3"])
        counts.append((made["q2"].first()["bank_name"], made["q3"].count()))
    assert counts == [("One", 0), ("One", 1)]


def test_account_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nOne,1,A,E,x\n,2,B,E,y\n")
    table = str(tmp_path / "table")
    ingest.accounts_from_csv(spark, str(tmp_path / "in"), table, str(tmp_path / "state")).awaitTermination()
    assert [(r["bank_id"], r["bank_name"]) for r in ingest.arrived(spark, table, "seq").orderBy("seq").collect()] == [(1, "One"), (2, None)]


def test_late_rows_are_dropped(spark, tmp_path):
    arriving, table, state = str(tmp_path / "in"), str(tmp_path / "bronze"), str(tmp_path / "state")
    tx = derived.transfers(spark, "/root/testdata/sf0.001")
    days = [r["tx_date"] for r in tx.select("tx_date").distinct().orderBy("tx_date").collect()]
    for day in (days[-1], days[-1], days[0]):  # the watermark passes the last day before the first day's rows come
        tx.where(f"tx_date = {day}").write.mode("append").parquet(arriving)
        ingest.to_bronze(ingest.deduplicated(ingest.arriving(spark, arriving), "1 day"), table, state).awaitTermination()
    assert [r["tx_date"] for r in ingest.bronze(spark, table).select("tx_date").distinct().collect()] == [days[-1]]
    assert ingest.bronze(spark, table).count() == tx.where(f"tx_date = {days[-1]}").count()


def test_a_client_runs_all_queries_and_compares(spark, tmp_path):
    root, rates = tmp_path / "sets", tmp_path / "rates.json"
    root.mkdir()
    lines = [line("a", 10), line("b", 20, bank=21), line("a", 0.5), GOOD.replace("2022/09/01", "2022/09/07").replace(" 10.50,US", "0.01,US")]
    (root / "LI-Small_Trans.csv").write_text("\n".join([HEAD, *lines]) + "\n")
    (root / "LI-Small_accounts.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nOne,20,A,E,x\n")
    rates.write_text(json.dumps([{"date": "2022-09-01", "quote": "EUR", "rate": 0.9}]))
    made = client.generate(spark, "small", str(root), str(rates), str(tmp_path / "ref"))
    assert list(made) == ["q1", "q2", "q3", "q4", "q5"]
    read = lambda q: [tuple(r) for r in spark.read.option("header", True).csv(made[q]).collect()]
    assert len(read("q1")) == 4 and sorted(read("q2")) == [("20", "a", "One", "10.00"), ("21", "b", "UNKNOWN_21", "20.00")]
    assert read("q3") == [("20", "8000A", "0.01")] and read("q4") == [] and read("q5") == [("1",)]
    transfers, accounts = files.datasets(str(root))["small"]
    client.run(spark, transfers, accounts, str(rates), str(tmp_path / "out"), which=["q2", "q5"], client="c1")
    assert all(d.equal for d in client.differences(spark, str(tmp_path / "out"), str(tmp_path / "ref"), ["q2", "q5"], "c1").values())
    with pytest.raises(ValueError):
        client.run(spark, transfers, accounts, str(rates), str(tmp_path / "out"), which=["q6"])


def test_a_client_can_be_aborted(spark, tmp_path):
    import threading
    import time

    done = []

    def slow():
        spark.sparkContext.setJobGroup("gone", "", interruptOnCancel=True)
        try:
            spark.range(0, 10**13, numPartitions=4).selectExpr("sum(id % 7)").collect()
        except Exception as e:  # noqa: BLE001
            done.append(str(e))

    from pyspark import InheritableThread

    thread = InheritableThread(target=slow)
    thread.start()
    for _ in range(100):
        time.sleep(0.2)
        if spark.sparkContext.statusTracker().getJobIdsForGroup("gone"):
            break
    client.abort(spark, "gone")
    thread.join(60)
    assert not thread.is_alive() and "cancel" in done[0].lower()
    assert isinstance(thread, threading.Thread) and spark.range(3).count() == 3

"""Checks, ingestion rules, views, freshness and plans on hand-made rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from logs import at, committed, empty_state, log_frame, report_rows, row
from mirrorfold.contracts import ACCOUNTS, BY_NAME, OPERATIONS, contract
from mirrorfold.errors import Refused
from mirrorfold.functions.decimals import fits, text_fits
from mirrorfold.functions.positions import format_position, parse_position
from mirrorfold.functions.text import is_uuid, normal_id, trimmed, utf16_bytes, utf8_bytes
from mirrorfold.operators import checks, compare, fold, ingest, latency, merge, projection, readmodels
from mirrorfold.operators.changes import split_key_changes
from mirrorfold.plans.apply import apply_batch
from mirrorfold.plans.views import create_views
from mirrorfold.sources.snapshot import snapshot
from mirrorfold.sources.synthetic import synthetic_sources


def folded(spark, rows):
    log = log_frame(spark, rows)
    return {r["row_id"]: r for r in fold.fold_columns(split_key_changes(log), OPERATIONS).collect()}


def test_absent_null_delete_and_insert_in_one_batch(spark):
    net = folded(spark, [
        row(1, 0, "operations", "I", "x", account_id="A", description="d", amount="@9999999999999999.99@"),
        row(2, 0, "operations", "U", "x", description=None),
        row(1, 1, "operations", "I", "y", account_id="A", description="d", amount=1),
        row(2, 1, "operations", "D", "y"), row(3, 0, "operations", "I", "y", amount=2),
        row(1, 2, "operations", "I", "z", account_id="A", description="d", amount=1),
        row(2, 2, "operations", "D", "z")])
    assert net["x"]["amount"] == Decimal("9999999999999999.99")
    assert net["x"]["has_description"] and net["x"]["description"] is None
    assert net["y"]["reset"] and not net["y"]["has_account_id"] and net["y"]["amount"] == 2
    assert net["z"]["action"] == "D"


def test_key_change_keeps_what_the_update_left_out(spark):
    state = empty_state(spark)
    chain = [row(1, 0, "operations", "I", "x", account_id="A", description="kept", amount=1),
             row(2, 0, "operations", "U", "y", old="x", amount=2), row(2, 1, "operations", "U", "z", old="y", amount=3)]
    after = apply_batch(state, log_frame(spark, committed(chain))).state
    assert [r[:2] + r[5:7] for r in report_rows(after.report)] == [("z", "A", "kept", Decimal("3.00"))]


def test_decimals_and_text(spark):
    money = OPERATIONS.type_of("amount")
    one = spark.range(1)
    got = one.select(
        fits(F.lit("1.239").cast("decimal(38,10)"), money), fits(F.lit("1.23").cast("decimal(38,10)"), money),
        text_fits(F.lit("1.23000000001"), money), text_fits(F.lit("99999999999999999.00"), money),
        utf8_bytes(F.lit("é")), utf16_bytes(F.lit("é")), trimmed(F.lit("  a b\t　")),
        is_uuid(F.lit("0A0A0A0A-0000-0000-0000-00000000000F")),
        normal_id(F.lit("0A0A0A0A-0000-0000-0000-00000000000F")), parse_position(F.lit("1/FF")),
        format_position(F.lit(2**32 + 255))).first()
    assert list(got) == [False, True, False, False, 2, 2, "a b", True, "0a0a0a0a-0000-0000-0000-00000000000f",
                         2**32 + 255, "1/FF"]


def test_contract_differences_are_named(spark):
    df = spark.createDataFrame([("1", "n", 1)], "id string, name string, status int")
    assert [(v.column, v.problem) for v in checks.check_contract(df, ACCOUNTS)] == [
        ("created_at", "missing"), ("status", "type")]
    with pytest.raises(Refused, match="unsupported_relation"):
        contract("nothing")
    texts = spark.createDataFrame([("a", "1.239"), ("b", "1.23"), ("c", "x")], "id string, amount string")
    assert {r["id"] for r in checks.lossless(texts, OPERATIONS).collect()} == {"a", "c"}


def test_account_and_asset_rules(spark):
    current = spark.createDataFrame([("A", "old", "Active", at(1))], ACCOUNTS.schema)
    inputs = spark.createDataFrame([("A", " new ", None, 1), ("B", "b", " Closed ", 2), ("C", " ", "x", 3),
                                    ("B", "b2", "", 4), ("D", "n" * 201, "x", 5)],
                                   "id string, name string, status string, order int")
    good, bad = ingest.normalize_accounts(inputs, current)
    rows = {r["id"]: r for r in good.collect()}
    assert (rows["A"]["name"], rows["A"]["status"], rows["A"]["action"]) == ("new", "Active", "U")
    assert (rows["B"]["name"], rows["B"]["status"], rows["B"]["action"]) == ("b2", "Active", "I")
    assert {(r["id"], r["reason"]) for r in bad.collect()} == {("C", "missing_field"), ("D", "too_long")}
    assets = spark.createDataFrame([("s", "A", "n", "k", Decimal("1.00"), 1), ("s", "B", "n", "k", Decimal("2.00"), 2),
                                    ("q", "Z", "n", "k", Decimal("1.00"), 3), ("q", "A", "n", " ", Decimal("1.00"), 4)],
                                   "id string, account_id string, name string, kind string, value decimal(18,2), order int")
    accounts = spark.createDataFrame([("A",), ("B",)], "id string")
    none = spark.createDataFrame([], contract("assets").schema)
    good, bad = ingest.validate_assets(assets, accounts, none)
    assert [(r["id"], r["account_id"], r["action"]) for r in good.collect()] == [("s", "A", "I")]
    assert {(r["order"], r["reason"]) for r in bad.collect()} == {
        (2, "wrong_account"), (3, "account_not_found"), (4, "missing_field")}


def test_nested_details_page_a_hot_account(spark):
    accounts = spark.createDataFrame([("A", "a", "Active", at(1)), ("B", "b", "Active", at(1))], ACCOUNTS.schema)
    assets = spark.createDataFrame([(f"s{i:02d}", "A", f"n{i % 7}", "k", Decimal(i)) for i in range(25)],
                                   contract("assets").schema)
    pages = readmodels.account_details(accounts, assets, page_rows=10).orderBy("account_id", "page").collect()
    assert [(r["account_id"], r["page"], len(r["assets"])) for r in pages] == [
        ("A", 0, 10), ("A", 1, 10), ("A", 2, 5), ("B", 0, 0)]
    names = [(a["name"], a["id"]) for r in pages for a in r["assets"]]
    assert names == sorted(names)
    with pytest.raises(Refused, match="not_single"):
        readmodels.single(accounts.union(accounts), "id", "A")


def test_views_are_fresh_and_read_only(spark):
    spark.sql("create database if not exists owner")
    for name in ("accounts", "assets", "contact_information"):
        spark.createDataFrame([], contract(name).schema).write.mode("overwrite").saveAsTable(f"owner.{name}")
    assert len(create_views(spark, "owner")) == 7
    query = "select name from financials.accounts where id = 'A'"
    assert spark.sql(query).collect() == []
    spark.createDataFrame([("A", "new", "Active", at(1))], ACCOUNTS.schema).write.insertInto("owner.accounts")
    assert spark.sql(query).first()["name"] == "new"
    with pytest.raises(Exception, match="EXPECT_TABLE_NOT_VIEW|VIEW"):
        spark.sql("insert into financials.accounts select * from owner.accounts")
    spark.sql("drop view notifications.accounts")
    spark.createDataFrame([], ACCOUNTS.schema).write.saveAsTable("notifications.accounts")
    with pytest.raises(Refused, match="read_only"):
        create_views(spark, "owner", ["notifications"])


def test_nearest_rank_and_backlog(spark):
    values = spark.range(100).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    got = latency.nearest_rank("v", ["g"], values).first()
    assert (got["count"], got["p50"], got["p95"], got["p99"], got["max"]) == (100, 49, 94, 98, 99)
    commits = spark.createDataFrame([("a", at(1)), ("b", at(2)), ("c", at(3))], "id string, committed_at timestamp")
    seen = spark.createDataFrame([("a", at(3)), ("b", at(5))], "id string, visible_at timestamp")
    assert latency.peak_backlog(commits, seen).first()[0] == 3
    assert {r["id"]: r["latency_ms"] for r in latency.visibility_latency(commits, seen).collect()} == {
        "a": 2000, "b": 3000, "c": None}


def test_synthetic_blocks_and_snapshot_scan(spark, tmp_path):
    made = synthetic_sources(spark, 3, 450)
    counts = sorted(r["count"] for r in made["operations"].groupBy("account_id").count().collect())
    assert counts == [100, 150, 200] and made["operations"].filter(~is_uuid(F.col("id"))).isEmpty()
    again = synthetic_sources(spark, 3, 450)
    assert compare.multiset_difference(made["operations"], again["operations"]).isEmpty()
    made["operations"].write.parquet(str(tmp_path / "ops"))
    read = snapshot(spark, {"operations": str(tmp_path / "ops")})["operations"].filter("id = 'x'").select("amount")
    plan = read._jdf.queryExecution().toString()
    assert "EqualTo(id,x)" in plan and "ReadSchema: struct<id:string,amount:decimal(18,2)>" in plan


def test_skewed_join_is_split_and_report_has_no_python(spark, tmp_path):
    operations = spark.range(0, 20000, 1, 8).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("a"), F.col("id").cast("string"))).alias("account_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("description"), F.lit(1).cast("decimal(18,2)").alias("amount"))
    accounts = operations.select("account_id").distinct().select(
        F.col("account_id").alias("id"), F.lit("n").alias("name"), F.lit("s").alias("status"),
        F.lit(at(1)).alias("created_at"))
    accounts.write.parquet(str(tmp_path / "accounts"))
    accounts = spark.read.parquet(str(tmp_path / "accounts"))
    ledger = accounts.select(F.lit("account").alias("kind"), F.col("id").alias("key"),
                             F.col("created_at").alias("last_commit_ts"))
    none = spark.createDataFrame([], contract("transactions").schema)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        for known, splits in ((None, 1), (ledger, 2)):
            report = projection.project(operations, accounts, none, known)
            assert len(report.collect()) == 20000
            plan = report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert plan.count("skew=true") == splits, plan
            assert "Python" not in plan and "CartesianProduct" not in plan
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_incomplete_rows_are_named(spark):
    delta = spark.createDataFrame([("a", "A", None, None, False), ("b", None, None, None, True)],
                                  "id string, account_id string, description string, amount decimal(18,2), _deleted boolean")
    assert [(r["id"], r["missing"]) for r in merge.incomplete_rows(delta, OPERATIONS).collect()] == [
        ("a", ["description", "amount"])]


def test_payload_drift(spark):
    rows = [("accounts", '{"id":"a","name":"x","created_at":"2024-01-01T00:00:00Z"}'), ("accounts", '{"id":"b","name":null}'),
            ("accounts", None), ("operations", '{"id":"o","amount":1,"extra":{"deep":[1]}}'),
            ("operations", '{"id":"o","amount":1.25,"description":7}'), ("operations", "null"), (None, '{"id":"n"}'),
            ("assets", '{"id":"s","value":"1.00"}'), ("assets", '{"id":"s","value":2}'), ("payment_means", "[1]"),
            ("transactions", '{"id":"t","OBJECT<x":1}'), ("elsewhere", '{"id":1}'), ("contact_information", '{"email":null}'),
            ("account_history", "{}")]
    log = spark.createDataFrame(rows, "table_name string, text string").selectExpr("table_name", "parse_json(text) as payload")
    found = {tuple(r)[:3] for r in checks.payload_drift(log, BY_NAME).collect()}
    assert found == {("operations", "extra", "unknown"), ("operations", "description", "type"), ("assets", "value", "type"),
                     ("payment_means", "*", "type"), ("elsewhere", "*", "unknown"), ("transactions", "OBJECT<x", "unknown")}
    assert checks.payload_drift(log.limit(0), BY_NAME).isEmpty()


def test_any_row_looks_at_all_partitions_at_once(spark):
    from mirrorfold.session import any_row

    rows = spark.range(0, 400, 1, 16)
    tracker, group = spark.sparkContext.statusTracker(), "any-row"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert any_row(rows.filter("id < 0")) is None
        ran = len(tracker.getJobIdsForGroup(group))
        assert any_row(rows.filter("id = 399"))["id"] == 399
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 1 <= ran <= 2

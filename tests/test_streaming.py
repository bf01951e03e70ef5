"""The streaming job: late markers, replays, refusals, crash points."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import mirrorfold.streaming.job as job
from logs import at, committed, log_frame, mark, row
from mirrorfold.errors import Refused
from mirrorfold.operators import changes
from mirrorfold.operators.budgets import txn_usage
from mirrorfold.plans.lifecycle import (
    checkpoints_frame, descriptors_frame, load_snapshot, observe, reconcile_store, resnapshot)
from mirrorfold.plans.views import read_store
from mirrorfold.plans.window import drain
from mirrorfold.operators.progress import source_status
from mirrorfold.settings import Limits
from mirrorfold.sources.changelog import read_change_log
from mirrorfold.sources.store import EMPTY
from mirrorfold.streaming.job import start_stream, sync_batch
from stores import data, descriptors, frames, new_store, report_map, write_log


@pytest.fixture()
def store(spark, tmp_path):
    made = new_store(spark, tmp_path)
    load_snapshot(made, frames(spark, data()), descriptors(10, 20))
    return made


def push(spark, store, rows, limits=Limits(), **kw):
    return sync_batch(store, log_frame(spark, rows), limits, **kw)


def refuses(spark, store, code, rows, limits=Limits()):
    before = store.manifest()
    with pytest.raises(Refused, match=f"^{code}:"):
        push(spark, store, rows, limits)
    assert store.manifest() == before


def test_stream_applies_logs_of_both_sources_and_resumes(spark, store, tmp_path):
    logs = [tmp_path / "accounts", tmp_path / "financials"]
    # already contained in the snapshot, must not apply twice
    write_log(logs[0], committed([row(5, 0, "accounts", "D", "A")]))
    write_log(logs[0], committed([row(11, 0, "accounts", "U", "A", name="joined-account-update")]))
    write_log(logs[1], committed([
        row(21, 0, "operations", "I", "o2", account_id="Z", description="early", amount=1.25),
        row(21, 1, "transactions", "U", "t1", operation_id="o2", amount="@9999999999999999.99@"),
        row(22, 0, "operations", "U", "o1", account_id="B", amount=99.25)]) + [mark(23, kind="heartbeat")])
    paths, checkpoint = [str(p) for p in logs], str(tmp_path / "checkpoint")
    query = start_stream(spark, store, paths, checkpoint, Limits(), descriptors(11, 23))
    query.awaitTermination(120)
    rows = report_map(store)
    assert (rows["o1"]["account_id"], rows["o1"]["account_name"], rows["o1"]["amount"]) == (
        "B", "verification B", Decimal("99.25"))
    assert rows["o1"]["description"] == "verification original" and rows["o1"]["transaction_count"] == 0
    assert rows["o2"]["account_missing"] and rows["o2"]["transaction_total"] == Decimal("9999999999999999.99")
    points = store.manifest()["published"]["checkpoints"]
    assert (points["accounts"]["position"], points["financials"]["position"]) == (11, 23)
    # the account arrives later and repairs the report; the same checkpoint resumes
    write_log(logs[0], committed([row(12, 0, "accounts", "I", "Z", name="late", status="Active",
                                      created_at=at(1).isoformat())]))
    start_stream(spark, store, paths, checkpoint, Limits()).awaitTermination(120)
    assert report_map(store)["o2"]["account_name"] == "late"
    version = store.manifest()["version"]
    start_stream(spark, store, paths, checkpoint, Limits()).awaitTermination(120)
    assert store.manifest()["version"] == version
    # a new streaming checkpoint reads everything again; nothing changes
    before = report_map(store)
    counts = {s: p["rows_applied"] for s, p in store.manifest()["published"]["checkpoints"].items()}
    start_stream(spark, store, paths, str(tmp_path / "again"), Limits()).awaitTermination(120)
    assert report_map(store) == before
    assert counts == {s: p["rows_applied"] for s, p in store.manifest()["published"]["checkpoints"].items()}


def test_open_transaction_waits_and_keeps_the_order(spark, store):
    push(spark, store, [row(21, 0, "operations", "U", "o1", amount=1), row(22, 0, "operations", "U", "o1", amount=2),
                        mark(22, prev=21)])
    assert report_map(store)["o1"]["amount"] == Decimal("10.25")
    manifest = store.manifest()
    assert manifest["pending_rows"] == 3 and manifest["published"]["checkpoints"]["financials"]["position"] == 20
    push(spark, store, [mark(21)])
    assert report_map(store)["o1"]["amount"] == Decimal("2.00")
    manifest = store.manifest()
    assert manifest["pending"] is None and manifest["published"]["checkpoints"]["financials"]["position"] == 22


def test_refusals_publish_nothing(spark, store):
    one = row(21, 0, "operations", "U", "o1", amount=1)
    refuses(spark, store, "truncate", [one, mark(21), mark(22, kind="truncate")])
    refuses(spark, store, "schema_drift", committed([row(21, 0, "operations", "U", "o1", amount=1.239)]))
    refuses(spark, store, "schema_drift", committed([row(21, 0, "operations", "U", "o1", colour="red")]))
    refuses(spark, store, "unknown_action", committed([row(21, 0, "operations", "X", "o1")]))
    refuses(spark, store, "row_contract", committed([row(21, 0, "operations", "U", "nobody", amount=1)]))
    three = committed([row(21, n, "operations", "I", f"x{n}", account_id="A", description="d", amount=1)
                       for n in range(3)])
    refuses(spark, store, "transaction_budget", three, Limits(txn_rows=2))
    refuses(spark, store, "transaction_budget", committed([row(
        21, 0, "operations", "I", "x", account_id="A", description="é" * 500, amount=1)]), Limits(txn_bytes=1024))
    refuses(spark, store, "transaction_budget", three[:3], Limits(txn_rows=2))
    rename = committed([row(11, 0, "accounts", "U", "A", name="n"), *[
        row(21, n, "operations", "I", f"x{n}", account_id="A", description="d", amount=1) for n in range(2)]])
    refuses(spark, store, "fanout_rows", rename, Limits(projection_rows=1))
    refuses(spark, store, "fanout_bytes", rename, Limits(projection_bytes=1024))
    refuses(spark, store, "row_after_commit", [mark(21, seq=0), row(21, 1, "operations", "U", "o1", amount=1)])


def test_crash_points_and_replay(spark, store, monkeypatch):
    rows = committed([row(21, 0, "operations", "U", "o1", amount=7)])
    before = report_map(store)
    for target in ("_apply", "batch_progress"):
        with monkeypatch.context() as patch:
            patch.setattr(job, target, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash")))
            with pytest.raises(RuntimeError):
                push(spark, store, rows)
        assert report_map(store) == before
    with monkeypatch.context() as patch:
        patch.setattr(type(store), "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            push(spark, store, rows)
    assert report_map(store) == before
    done = push(spark, store, rows)
    assert report_map(store)["o1"]["amount"] == Decimal("7.00")
    assert push(spark, store, rows) == done
    replay = push(spark, store, rows)
    assert replay["published"]["checkpoints"] == done["published"]["checkpoints"]


def financials(store):
    manifest = store.manifest()
    return manifest["published"]["checkpoints"]["financials"]["position"], manifest["pending_rows"]


def test_a_late_row_is_waited_for(spark, store):
    first = row(21, 0, "operations", "U", "o1", amount=1)
    late = row(21, 1, "operations", "I", "o9", account_id="B", description="late", amount=2)
    push(spark, store, [first, mark(21, rows=2)])
    assert financials(store) == (20, 2) and "o9" not in report_map(store)
    push(spark, store, [late])
    assert financials(store) == (21, 0) and report_map(store)["o9"]["amount"] == Decimal("2.00")
    assert report_map(store)["o1"]["amount"] == Decimal("1.00")
    refuses(spark, store, "rows_beyond_count", [
        row(22, n, "operations", "U", "o1", amount=n) for n in (0, 1)] + [mark(22, rows=1)])


def test_an_older_transaction_in_a_later_file_is_waited_for(spark, store):
    push(spark, store, [row(23, 0, "operations", "U", "o1", amount=3), mark(23, prev=21)])
    assert financials(store) == (20, 2) and report_map(store)["o1"]["amount"] == Decimal("10.25")
    push(spark, store, [row(21, 0, "operations", "I", "o9", account_id="B", description="older", amount=2), mark(21, prev=18)])
    assert financials(store) == (23, 0)
    rows = report_map(store)
    assert (rows["o1"]["amount"], rows["o9"]["amount"]) == (Decimal("3.00"), Decimal("2.00"))


def test_markers_without_proof_and_rows_without_place_are_refused(spark, store):
    change = row(21, 0, "operations", "U", "o1", amount=1)
    bare = list(mark(21))
    refuses(spark, store, "marker_without_count", [change, tuple(bare[:-2] + [None, 20])])
    refuses(spark, store, "marker_without_chain", [change, tuple(bare[:-2] + [1, None])])
    for at_place in (2, 4):
        lost = list(change)
        lost[at_place] = None
        refuses(spark, store, "row_outside_transaction", [tuple(lost)])


def without_chain(marker):
    return (*marker[:-1], None)


def test_only_the_start_of_a_log_needs_no_chain(spark, tmp_path):
    store = new_store(spark, tmp_path)
    load_snapshot(store, frames(spark, data()), descriptors(0, 0))
    nine = [row(9, 0, "operations", "U", "o1", amount=9), without_chain(mark(9))]
    five = [row(5, 0, "operations", "U", "o1", description="five")]
    refuses(spark, store, "marker_without_chain", [*nine, *five, without_chain(mark(5))])
    refuses(spark, store, "marker_without_chain", [*nine, *five])
    push(spark, store, nine)
    assert financials(store) == (9, 0)
    # an older transaction proves that the log did not start there: refused, not taken for a replay
    refuses(spark, store, "before_log_start", [*five, without_chain(mark(5))])
    refuses(spark, store, "before_log_start", [*five, mark(5, prev=0)])
    refuses(spark, store, "marker_without_chain", [row(10, 0, "operations", "U", "o1", amount=1), without_chain(mark(10))])
    assert push(spark, store, nine)["published"]["checkpoints"]["financials"]["position"] == 9


def test_different_rows_of_one_number_are_refused(spark, store):
    one = row(21, 0, "operations", "U", "o1", amount=1)
    other = row(21, 0, "operations", "U", "o1", amount=2)
    refuses(spark, store, "conflicting_rows", [one, other, mark(21)])
    push(spark, store, [one, one])
    refuses(spark, store, "conflicting_rows", [other, mark(21)])
    push(spark, store, [one, mark(21), mark(21)])
    assert financials(store) == (21, 0) and report_map(store)["o1"]["amount"] == Decimal("1.00")


def test_a_transaction_that_stays_open_is_reported_and_refused(spark, store):
    push(spark, store, [row(21, 0, "operations", "U", "o1", amount=1), mark(21, rows=2)])
    seen = observe(store).first()
    assert seen["first_open"] == {"financials": 21} and seen["longest_open_ms"] >= 0
    since = store.manifest()["open"]["financials"]["since"]
    push(spark, store, [row(23, 0, "operations", "U", "o1", amount=3)])
    assert store.manifest()["open"]["financials"] == {"position": 21, "since": since}
    refuses(spark, store, "transaction_open", [mark(23, prev=21)], Limits(open_seconds=0))
    push(spark, store, [row(21, 1, "operations", "U", "o1", amount=2), mark(23, prev=21)])
    assert financials(store) == (23, 0) and observe(store).first()["first_open"] == {}


def test_own_byte_count(spark, store):
    rows = [list(row(21, n, "operations", "I", f"x{n}", account_id="A", description="d" * 200, amount=1)) for n in range(6)]
    for values in rows:
        values[10] = None
    refuses(spark, store, "transaction_budget", [*map(tuple, rows), mark(21, rows=6)], Limits(txn_bytes=1024))


def test_a_checkpoint_folder_used_again_skips_nothing(spark, store, tmp_path):
    checkpoint, folder = tmp_path / "checkpoint", tmp_path / "log"
    write_log(folder, committed([row(21, 0, "operations", "U", "o1", amount=1)]))
    start_stream(spark, store, str(folder), str(checkpoint), Limits()).awaitTermination(120)
    emptied = tmp_path / "emptied"
    checkpoint.rename(emptied)
    folder.rename(tmp_path / "read")
    write_log(folder, committed([row(22, 0, "operations", "U", "o1", amount=5)]))
    start_stream(spark, store, str(folder), str(checkpoint), Limits()).awaitTermination(120)
    assert financials(store) == (22, 0) and report_map(store)["o1"]["amount"] == Decimal("5.00")


def test_resnapshot_keeps_what_is_open_above_it(spark, store):
    push(spark, store, [row(21, 0, "operations", "U", "o1", amount=1), row(25, 0, "operations", "U", "o1", description="open")])
    assert financials(store) == (20, 2)
    resnapshot(store, frames(spark, data()), descriptors(10, 22))
    assert financials(store) == (22, 1)
    push(spark, store, [row(25, 1, "operations", "U", "o1", amount=9), mark(25, rows=2, prev=22)])
    assert financials(store) == (25, 0)
    assert (report_map(store)["o1"]["description"], report_map(store)["o1"]["amount"]) == ("open", Decimal("9.00"))


def test_a_window_keeps_the_stamps_of_the_stream(spark, store):
    push(spark, store, committed([row(21, 0, "operations", "U", "o1", amount=7)]))
    stamp = report_map(store)["o1"]["last_source_commit_at"]
    assert stamp is not None
    rows = data(operations=[("o1", "A", "changed by the window", Decimal("8.00"))])
    drain(store, frames(spark, rows), descriptors(10, 30), Limits())
    now = report_map(store)["o1"]
    assert (now["description"], now["last_source_commit_at"]) == ("changed by the window", stamp)


def test_facts_reconciliation_and_newest_version(spark, store, tmp_path):
    sources = frames(spark, data())
    assert reconcile_store(store, sources).isEmpty()
    assert read_store(store, "select amount from operations where id = 'o1'").first()[0] == Decimal("10.25")
    write_log(tmp_path / "log", committed([row(21, 0, "operations", "U", "o1", amount=7)]))
    start_stream(spark, store, str(tmp_path / "log"), str(tmp_path / "c"), Limits(), facts=str(tmp_path / "facts")).awaitTermination(120)
    assert read_store(store, "select amount from account_operations where operation_id = 'o1'").first()[0] == Decimal("7.00")
    facts = spark.read.json(str(tmp_path / "facts")).collect()
    assert [(r["source"], r["position"], r["rows"], r["transactions"]) for r in facts] == [("financials", 21, 1, 1)]
    assert facts[0]["apply_lag_ms"] > 0
    found = {tuple(r) for r in reconcile_store(store, sources).collect()}
    assert found == {("operations", "differing", 1)}
    # A fault in the report itself is found too.
    manifest = store.manifest()
    tables = {**manifest["published"]["tables"], "account_operations": EMPTY}
    store.publish(manifest["version"], {**manifest, "published": {**manifest["published"], "tables": tables}})
    assert ("account_operations", "only_in_source", 1) in {tuple(r) for r in reconcile_store(store, sources).collect()}


def test_contacts_that_repeat_are_refused(spark, tmp_path):
    twice = data(contact_information=[("c1", "A", "a@x.test", "1"), ("c2", "A", "b@x.test", "2")])
    with pytest.raises(Refused, match="^key_contract:"):
        load_snapshot(new_store(spark, tmp_path), frames(spark, twice), descriptors(10, 20))


def test_start_guards(spark, store):
    def check(code, **changed):
        with pytest.raises(Refused, match=f"^{code}:"):
            job.guard_start(store, descriptors(10, 20, {"financials": changed}), Limits())
    check("source_identity", system_id="other")
    check("source_binding", database="db_other")
    check("source_epoch", epoch="e2")
    check("position_backwards", max_pos=3)
    check("retention_expired", min_pos=21, max_pos=30)
    check("source_unavailable", available=False)
    check("lag_limit", max_pos=10**12)
    tables = dict(descriptors()["financials"].tables, operations="operations-2")
    check("table_identity", tables=tables)
    job.guard_start(store, descriptors(10, 20), Limits())


def test_status_and_log_round_trip(spark, store, tmp_path):
    status = {r["source"]: r for r in source_status(
        checkpoints_frame(store, store.manifest()), descriptors_frame(store, descriptors(15, 20)),
        F.current_timestamp()).collect()}
    assert status["accounts"]["lag"] == 5 and status["accounts"]["initialized"]
    rows = committed([row(1, 0, "operations", "I", "o", account_id="A", note=None, amount="@9999999999999999.99@")])
    write_log(tmp_path / "log", rows)
    log = read_change_log(spark, str(tmp_path / "log")).filter("kind = 'row'")
    got = log.selectExpr("is_variant_null(variant_get(payload, '$.note')) n",
                         "variant_get(payload, '$.amount', 'decimal(18,2)') a").first()
    assert got["n"] and got["a"] == Decimal("9999999999999999.99")


def test_transactions_are_judged_once_without_payloads(spark, tmp_path):
    """Copies count once, as after dropping them, and no payload is read to judge transactions."""
    rows = committed([row(21, 0, "operations", "I", "o2", account_id="Z", description="x", amount=1), row(21, 1, "operations", "D", "o1"),
                      row(22, 0, "operations", "D", "o2")])
    log = changes.counted_bytes(log_frame(spark, rows))
    log.union(log).write.parquet(str(tmp_path / "log"))
    twice = spark.read.parquet(str(tmp_path / "log"))
    found = changes.counted_transactions(twice)
    plain = changes.transactions(changes.distinct_changes(twice))
    assert sorted(found.select(*plain.columns).collect()) == sorted(plain.collect())
    usage = {(r["source"], r["commit_pos"]): (r["rows"], r["bytes"]) for r in txn_usage(changes.distinct_changes(twice)).collect()}
    assert {(r["source"], r["commit_pos"]): (r["_have"], r["bytes"]) for r in found.collect()} == usage
    assert {r["copies"] for r in found.collect()} == {2}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "commit_pos" in plan and "payload" not in plan

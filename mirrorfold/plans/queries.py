"""Registered queries: one per operator, each over the whole test tables.

``QUERIES`` maps a name to ``(spark, folder) -> DataFrame`` and ``ORACLE`` the
same name to SQL over the raw tables that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mirrorfold.contracts import (
    ACCOUNTS, BY_NAME, ENVELOPE, LEDGER, MIRRORED, OPERATIONS, RELATIONS, REPORT, TRANSACTIONS, Contract)
from mirrorfold.functions.payload import has_field, try_field
from mirrorfold.functions.positions import format_position, millis_between, parse_position
from mirrorfold.functions.text import default_if_blank, is_blank, stable_id, trimmed, utf8_bytes, utf16_bytes
from mirrorfold.operators import affected, budgets, changes, checks, compare, digests, fold, ingest, latency, ledger, merge
from mirrorfold.operators import progress, projection, readmodels
from mirrorfold.operators.ordered import running_sums, values_before
from mirrorfold.plans import lifecycle, window
from mirrorfold.plans.apply import State, apply_batch
from mirrorfold.plans.bindings import Bindings, sql
from mirrorfold.plans.lifecycle import CHECKPOINTS
from mirrorfold.plans.views import temporary_views
from mirrorfold.session import cut_lineage, scratch
from mirrorfold.settings import UNBOUNDED, Binding
from mirrorfold.sources import changelog
from mirrorfold.sources.snapshot import as_changes, snapshot
from mirrorfold.sources.store import Store
from mirrorfold.streaming.job import start_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(build: Callable[[Bindings], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Bindings(spark, folder))
        if oracle is not None:
            ORACLE[name] = oracle
        return build
    return register


REPORT_SQL = """select o.id as operation_id, o.account_id, a.name as account_name, a.status as account_status,
    a.id is null as account_missing, o.description, o.amount,
    cast(coalesce(t.total, 0) as decimal(38,2)) as transaction_total,
    cast(coalesce(t.n, 0) as bigint) as transaction_count, a.created_at as source_account_created_at
    from {operations} o left join {accounts} a on a.id = o.account_id
    left join (select operation_id, sum(amount) as total, count(*) as n from {transactions} group by operation_id) t
    on t.operation_id = o.id"""


def report_sql(operations: str = "operations", accounts: str = "accounts", transactions: str = "transactions") -> str:
    return REPORT_SQL.format(operations=operations, accounts=accounts, transactions=transactions)


def _report(df: DataFrame) -> DataFrame:
    """The report without its clock columns."""
    return df.drop("last_source_commit_at", "materialized_at")


# the report

@query(sql(report_sql(), "accounts", "operations", "transactions"))
def account_operations(b):
    return _report(projection.project(b.operations(), b.accounts(), b.transactions()))


@query(sql("""select o.id as operation_id, o.account_id from operations o
    where not exists (select 1 from accounts a where a.id = o.account_id)""", "accounts", "operations"))
def missing_accounts(b):
    report = projection.project(b.operations(), b.accounts(), b.transactions())
    return report.filter("account_missing").select("operation_id", "account_id")


@query(sql("""select operation_id, cast(sum(amount) as decimal(38,2)) as transaction_total,
    count(*) as transaction_count from transactions group by operation_id""", "transactions"))
def operation_totals(b):
    return projection.transaction_totals(b.transactions())


@query(sql(report_sql(transactions="keyed_transactions"), "accounts", "operations", "keyed_transactions"))
def full_rebuild(b):
    return _report(projection.rebuild_projection(
        {"operations": b.operations(), "accounts": b.accounts(), "transactions": b.keyed_transactions()}))


# scans and the change log

def _tables(b: Bindings) -> dict[str, DataFrame]:
    return {"accounts": b.accounts(), "account_history": b.account_history(), "assets": b.assets(),
            "contact_information": b.contacts(), "operations": b.operations(),
            "collection_orders": b.collection_orders(), "payment_means": b.payment_means()}


_FRAMES = {"accounts": "accounts", "assets": "assets", "contact_information": "contacts",
           "account_history": "account_history", "payment_means": "payment_means", "operations": "operations",
           "transactions": "keyed_transactions", "collection_orders": "collection_orders"}


def cells_sql(frames: dict[str, str]) -> str:
    """Every value of the given tables as a row, as text."""
    return " union all ".join(
        f"""select '{name}' as table_name, id as row_id, '{c}' as "column", cast({c} as varchar) as value from {frame}"""
        for name, frame in frames.items() for c in BY_NAME[name].columns)


def _cells(name: str, df: DataFrame) -> DataFrame:
    def text(f: T.StructField):
        value = F.col(f.name).cast("timestamp_ntz") if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        return value.cast("string")

    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), text(f).alias("value")) for f in df.schema.fields])
    return df.select(F.lit(name).alias("table_name"), F.col(BY_NAME[name].key).alias("row_id"), F.explode(cells).alias("c")
                     ).select("table_name", "row_id", "c.*")


def _all_cells(tables: dict[str, DataFrame]) -> DataFrame:
    union = None
    for name, df in tables.items():
        union = _cells(name, df) if union is None else union.unionByName(_cells(name, df))
    return union


@query(sql(cells_sql(_FRAMES), *_FRAMES.values()))
def source_snapshot(b):
    """Every table, written as a source keeps it and read with its contract."""
    paths = {}
    for name, df in _whole_sources(b).items():
        paths[name] = scratch(b.spark, f"source-{name}")
        df.write.parquet(paths[name])
    return _all_cells(snapshot(b.spark, paths))


@query(sql(" union all ".join(f"select '{n}' as table_name, id as row_id, 'I' as action from {f}" for n, f in _FRAMES.items()),
           *_FRAMES.values()))
def snapshot_as_changes(b):
    union = None
    for name, df in _whole_sources(b).items():
        part = as_changes(df, name).select("table_name", "row_id", "action")
        union = part if union is None else union.unionByName(part)
    return union


@query("""select event_id, cast(user_id as varchar) as row_id, json_extract_string(props, '$.k') as k,
    cast(json_extract(props, '$.k') as bigint) > 50 as large from events where event_type <> 'error'""")
def change_decode(b):
    raw = b.raw("events").select(
        "event_id", F.when(F.col("event_type") == "error", "D").otherwise("U").alias("action"),
        F.col("user_id").cast("string").alias("row_id"), F.col("props").alias("payload"))
    decoded, _ = changes.decode_changes(raw, require_uuid=False)
    return decoded.filter("action <> 'D'").select(
        "event_id", "row_id", try_field(F.col("payload"), "k", T.StringType()).alias("k"),
        (try_field(F.col("payload"), "k", T.LongType()) > 50).alias("large"))


@query("""select event_id, cast(user_id as varchar) as row_id, 'unsupported_id' as reason from events""")
def undecodable_changes(b):
    raw = b.raw("events").select("event_id", F.lit("U").alias("action"), F.col("user_id").cast("string").alias("row_id"),
                                 F.col("props").alias("payload"))
    return changes.decode_changes(raw)[1].select("event_id", "row_id", "reason")


@query(sql("""select event_id, key, value from (select event_id, unnest(json_keys(props)) as key,
    json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events)"""))
def payload_fields(b):
    body = b.raw("events").select("event_id", F.parse_json("props").alias("payload"))
    each = body.lateralJoin(body.sparkSession.tvf.variant_explode(F.col("payload").outer()))
    return each.select("event_id", "key", F.col("value").cast("string").alias("value"))


@query(sql("""select commit_pos, seq, cast(0 as int) as sub, action, row_id from event_log
    where not (action = 'U' and has_amount)
    union all select commit_pos, seq, s.sub, s.action, s.row_id from (select commit_pos, seq, unnest([
      {'sub': cast(0 as int), 'action': 'D', 'row_id': concat('old-', row_id)},
      {'sub': cast(1 as int), 'action': 'D', 'row_id': row_id},
      {'sub': cast(2 as int), 'action': action, 'row_id': row_id}]) as s
      from event_log where action = 'U' and has_amount)""", "event_log"))
def key_change_split(b):
    moved = (F.col("action") == "U") & has_field(F.col("payload"), "amount")
    log = b.event_log().withColumn("old_row_id", F.when(moved, F.concat(F.lit("old-"), "row_id")))
    return changes.split_key_changes(log).select("commit_pos", "seq", "sub", "action", "row_id")


@query(sql("""select commit_pos, seq, row_id from event_log
    where commit_pos > (select max(commit_pos) // 2 from event_log)""", "event_log"))
def after_checkpoint_changes(b):
    log = b.event_log()
    half = log.groupBy("source").agg(F.floor(F.max("commit_pos") / 2).cast("bigint").alias("position"))
    return changes.after_checkpoint(log, half).select("commit_pos", "seq", "row_id")


@query(sql("""select l.row_id as id, case when o.id is null then 'D' when l.action = 'D' then 'I' else l.action end
    as action, o.account_id, o.description, o.amount
    from (select row_id, arg_max(action, ord) as action from event_log where commit_pos > 500 group by row_id) l
    left join operations o on o.id = l.row_id""", "event_log", "operations"))
def net_changes_since(b):
    log = b.event_log().filter("commit_pos > 500")
    return compare.changed_rows(fold.fold_rows(log), b.operations())


@query(sql("""select case when c.id is null then 'D' when p.id is null then 'I' else 'U' end as action,
    coalesce(p.id, c.id) as id, c.name, c.status, c.created_at from accounts p full join post_accounts c on p.id = c.id
    where p.id is null or c.id is null or p.name is distinct from c.name or p.status is distinct from c.status
    or p.created_at is distinct from c.created_at""",
           "accounts", "post_accounts"))
def snapshot_diff(b):
    later = _post_accounts(b)
    return compare.snapshot_diff(b.accounts(), later, "id", ACCOUNTS.columns)


def _post_accounts(b: Bindings, log: DataFrame | None = None) -> DataFrame:
    """The accounts after the account log, through the column merge."""
    contract = _ntz(ACCOUNTS)
    return merge.merge_columns(b.accounts(), fold.fold_columns(log or b.account_log(), contract), contract)


def _ntz(contract: Contract) -> Contract:
    """The contract with wall-clock times, which is what the test tables hold."""
    fields = [T.StructField(f.name, T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType) else f.dataType,
                            f.nullable, f.metadata) for f in contract.schema.fields]
    return Contract(contract.name, contract.source, T.StructType(fields), contract.key)


# folds

@query(sql("""select table_name, row_id, arg_max(action, ord) as action, bool_or(action = 'D') as reset,
    count(*) as changes, arg_max(commit_pos, ord) as commit_pos from event_log group by table_name, row_id""",
           "event_log"))
def net_change_fold(b):
    return fold.fold_rows(b.event_log(), ["commit_pos"])


@query(sql("""select row_id, action, commit_pos, seq from (select *, row_number() over (
    partition by row_id order by commit_pos desc, seq desc) as n from line_log) where n = 1""", "line_log"))
def last_change_per_key(b):
    return fold.fold_rows(b.line_log(), ["commit_pos", "seq"]).select("row_id", "action", "commit_pos", "seq")


OVERLAY_SQL = """select e.row_id, arg_max(action, ord) as action, any_value(d.ord) is not null as reset,
    count(*) as changes, """ + ", ".join(
    f"""count(*) filter (has_{c} and ord > coalesce(d.last, -1)) > 0 as has_{c},
    (arg_max({{'v': {c}}}, ord) filter (has_{c} and ord > coalesce(d.last, -1))).v as {c}"""
    for c in ("account_id", "description", "amount")) + """ from event_log e left join
    (select row_id, max(ord) as last, max(ord) as ord from event_log where action = 'D' group by row_id) d
    using (row_id) group by e.row_id"""
OVERLAY_SQL = OVERLAY_SQL.replace("arg_max(action, ord)", "arg_max(action, e.ord)").replace(
    "ord > coalesce", "e.ord > coalesce").replace("}, ord)", "}, e.ord)").replace("select e.row_id", "select row_id"
    ).replace("group by e.row_id", "group by row_id")


@query(sql(OVERLAY_SQL, "event_log"))
def column_overlay(b):
    return fold.fold_columns(b.event_log(), OPERATIONS)


@query(sql(f"""select row_id, has_description and description is null as written_null,
    not has_description as absent from ({OVERLAY_SQL}) where action <> 'D'""", "event_log"))
def absent_versus_null(b):
    net = fold.fold_columns(b.event_log(), OPERATIONS).filter("action <> 'D'")
    return net.select("row_id", (F.col("has_description") & F.col("description").isNull()).alias("written_null"),
                      (~F.col("has_description")).alias("absent"))


@query(sql("""select row_id, action from (select row_id, arg_max(action, ord) as action from event_log group by row_id)
    where action = 'D'""", "event_log"))
def tombstones(b):
    return fold.fold_rows(b.event_log()).filter("action = 'D'").select("row_id", "action")


# merges

def _whole_rows(b: Bindings, log: DataFrame | None = None) -> DataFrame:
    """Net changes of operations that carry whole rows."""
    net = fold.fold_rows(log or b.operation_log())
    value = lambda c: try_field(F.col("payload"), c, OPERATIONS.type_of(c)).alias(c)
    return net.select("action", F.col("row_id").alias("id"), *[value(c) for c in OPERATIONS.values])


@query(sql("select id, account_id, description, amount from post_operations", "post_operations"))
def merged_mirror(b):
    return merge.merge_full(b.operations(), _whole_rows(b), OPERATIONS)


@query(sql("select id, name, status, created_at from post_accounts", "post_accounts"))
def overlaid_mirror(b):
    return _post_accounts(b)


@query(sql(
    f"""select n.row_id as id, n.action <> 'D' and (case when n.has_account_id then n.account_id
    when not n.reset then o.account_id end is null or case when n.has_description then n.description
    when not n.reset then o.description end is null or case when n.has_amount then n.amount
    when not n.reset then o.amount end is null) as incomplete
    from ({OVERLAY_SQL}) n left join operations o on o.id = n.row_id""", "event_log", "operations"))
def incomplete_changes(b):
    net = fold.fold_columns(b.event_log(), OPERATIONS)
    delta = merge.column_delta(b.operations(), net, OPERATIONS)
    bad = merge.incomplete_rows(delta, OPERATIONS).select("id", F.lit(True).alias("_bad"))
    return delta.select("id").join(bad, "id", "left").select("id", F.col("_bad").isNotNull().alias("incomplete"))


# affected rows

@query(sql("""select o.id as operation_id from operations o
    where o.account_id in (select row_id from account_log)""", "operations", "account_log"))
def affected_by_accounts(b):
    return affected.operations_of_accounts(b.operations(), b.account_log())


@query(sql("""select distinct t.operation_id from keyed_transactions t join parent_log l on l.row_id = t.id""",
           "keyed_transactions", "parent_log"))
def affected_old_parents(b):
    return affected.old_parents(b.keyed_transactions(), b.parent_log())


@query(sql("select distinct operation_id from line_log where action <> 'D'", "line_log"))
def affected_new_parents(b):
    return affected.new_parents(b.line_log())


def _affected(b: Bindings, log: DataFrame | None = None) -> DataFrame:
    pre = {"operations": b.operations(), "transactions": b.keyed_transactions()}
    return affected.affected_operations(pre, log or b.mixed_log())


AFFECTED_SQL = """select o.id as operation_id from operations o join account_log l on l.row_id = o.account_id
    union select cast(user_id as varchar) from events
    union select t.operation_id from keyed_transactions t join parent_log l on l.row_id = t.id
    union select cast(o_orderkey + 1 as varchar) from parent_log where action = 'U'"""
AFFECTED_NEEDS = ("operations", "account_log", "keyed_transactions", "parent_log")


@query(sql(AFFECTED_SQL, *AFFECTED_NEEDS))
def affected_operations(b):
    return _affected(b)


@query(sql("""select id as operation_id from collection_orders union
    select distinct operation_id from line_log where action <> 'D'""", "collection_orders", "line_log"))
def queue_after_enqueue(b):
    queue = b.collection_orders().select("operation_id")
    return affected.enqueue(queue, affected.new_parents(b.line_log()))


@query(sql("""select commit_pos, seq, row_id from event_log where action <> 'D'""", "event_log"))
def stage_after_consume(b):
    log = b.event_log()
    return affected.consume(log, log.filter("action = 'D'"), ["commit_pos", "seq"]).select("commit_pos", "seq", "row_id")


# ledger and incremental refresh

def _post_tables(b: Bindings, log: DataFrame) -> dict[str, DataFrame]:
    transactions = _ntz(TRANSACTIONS)
    net = fold.fold_columns(log, transactions)
    return {"accounts": _post_accounts(b, log),
            "operations": merge.merge_full(b.operations(), _whole_rows(b, log.filter("table_name = 'operations'")),
                                           OPERATIONS),
            "transactions": merge.merge_columns(b.keyed_transactions(), net, transactions)}


@query(sql("select * from ledger", "ledger"))
def touch_ledger(b):
    return ledger.new_touches({"transactions": b.keyed_transactions()}, b.mixed_log())


POST = ("post_accounts", "post_operations", "post_transactions")


@query(sql(report_sql("post_operations", "post_accounts", "post_transactions"), *POST))
def incremental_report(b):
    pre = {"operations": b.operations(), "accounts": b.accounts(), "transactions": b.keyed_transactions()}
    report = projection.rebuild_projection(pre)
    log = cut_lineage(b.mixed_log())
    touched = cut_lineage(_affected(b, log))
    return _report(projection.refresh_projection(report, touched, _post_tables(b, log)))


@query(sql(f"""select r.operation_id, greatest(a.last_commit_ts, x.last_commit_ts) as last_source_commit_at
    from ({report_sql("post_operations", "post_accounts", "post_transactions")}) r
    left join (select key, last_commit_ts from ledger where kind = 'account') a on a.key = r.account_id
    left join (select key, max(last_commit_ts) as last_commit_ts from ledger where kind <> 'account' group by key) x
    on x.key = r.operation_id""", *POST, "ledger"))
def report_commit_stamps(b):
    log = cut_lineage(b.mixed_log())
    touched = cut_lineage(ledger.new_touches({"transactions": b.keyed_transactions()}, log))
    return projection.rebuild_projection(_post_tables(b, log), touched).select("operation_id", "last_source_commit_at")


def _state(b: Bindings) -> State:
    spark = b.spark
    as_time = lambda df: df.select(*[
        F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
        for f in df.schema.fields])
    tables = {c.name: spark.createDataFrame([], c.schema) for c in MIRRORED}
    tables |= {"operations": b.operations(), "accounts": as_time(b.accounts()),
               "transactions": as_time(b.keyed_transactions())}
    return State(tables, projection.rebuild_projection(tables), spark.createDataFrame([], LEDGER),
                 spark.createDataFrame([], CHECKPOINTS))


def _applied(b: Bindings):
    # As the streaming job does, the log is staged once and read by every step.
    log = cut_lineage(b.mixed_log().withColumn("commit_ts", F.col("commit_ts").cast("timestamp")))
    return apply_batch(_state(b), log, keep=lambda _, df: cut_lineage(df))


@query(sql(report_sql("post_operations", "post_accounts", "post_transactions"), *POST))
def apply_batch_report(b):
    report = _report(_applied(b).state.report)
    return report.withColumn("source_account_created_at", F.col("source_account_created_at").cast("timestamp_ntz"))


_POST_FRAMES = {"accounts": "post_accounts", "operations": "post_operations", "transactions": "post_transactions"}


@query(sql(cells_sql(_POST_FRAMES), *POST))
def apply_batch_mirrors(b):
    state = _applied(b).state
    return _all_cells({name: state.tables[name] for name in _POST_FRAMES})


@query(sql("""select 'accounts' as source, max(commit_pos) as position, count(*) as rows_applied,
    count(distinct commit_pos) as batches_applied from account_log
    union all select 'financials', max(p), cast(sum(n) as bigint), count(*) from (
    select commit_pos as p, count(*) as n from event_log group by 1 union all
    select commit_pos, count(*) from parent_log group by 1)""", "account_log", "event_log", "parent_log"))
def progress_by_source(b):
    return progress.batch_progress(b.mixed_log()).drop("last_commit_at")


@query(sql("""select 'accounts' as source, max(commit_pos) as position, count(*) + 10 as rows_applied,
    count(*) + 1 as batches_applied from account_log""", "account_log"))
def accumulated_progress(b):
    log = b.account_log()
    old = log.groupBy("source").agg(F.min("commit_pos").alias("position"), F.min("commit_ts").alias("last_commit_at"),
                                    F.lit(10).cast("bigint").alias("rows_applied"),
                                    F.lit(1).cast("bigint").alias("batches_applied"))
    return progress.advance(old, progress.batch_progress(log)).drop("last_commit_at")


@query(sql("""select 'accounts' as source, (select max(commit_pos) from account_log) as position, 'e1' as epoch
    union all select 'financials', (select max(commit_pos) from parent_log), 'e2'""", "account_log", "parent_log"))
def window_checkpoint_advance(b):
    top = b.mixed_log().groupBy("source").agg(F.max("commit_pos").alias("version"))
    entry = F.struct("source", "version", F.when(F.col("source") == "accounts", "e1").otherwise("e2").alias("epoch"))
    window = top.agg(F.collect_set(entry).alias("versions"), F.lit(0).alias("captured_at"))
    old = top.select("source", F.lit(0).cast("bigint").alias("position"), F.lit("e0").alias("epoch"))
    return progress.window_checkpoints(top.select("source"), old, window).drop("captured_at")


# transactions and budgets

def _marked(b: Bindings) -> DataFrame:
    """The event log with commit markers for all but every 97th transaction of
    its last tenth, which are still open."""
    log = b.event_log()
    top = log.agg(F.max("commit_pos").alias("m")).select((F.col("m") * 9 / 10).cast("bigint"))
    ended = log.select("source", "commit_pos").distinct().withColumn("_late", top.scalar()).filter(
        ~((F.col("commit_pos") > F.col("_late")) & (F.col("commit_pos") % 97 == 0)))
    return changes.with_marks(log, ended)


OPEN_SQL = """(select coalesce(min(commit_pos), 1e18) from event_log where commit_pos % 97 = 0 and commit_pos >
    (select max(commit_pos) * 9 // 10 from event_log))"""


@query(sql(f"""select commit_pos, seq, row_id, max(commit_ts) over (partition by commit_pos) as commit_ts
    from event_log where commit_pos < {OPEN_SQL}""", "event_log"))
def committed_changes(b):
    ready, _ = changes.committed_only(_marked(b))
    return ready.filter("kind = 'row'").select("commit_pos", "seq", "row_id", "commit_ts")


@query(sql(f"select commit_pos, seq, row_id from event_log where commit_pos >= {OPEN_SQL}", "event_log"))
def open_changes(b):
    _, still_open = changes.committed_only(_marked(b))
    return still_open.filter("kind = 'row'").select("commit_pos", "seq", "row_id")


@query(sql("select commit_pos, seq, row_id from event_log", "event_log"))
def deduplicated_changes(b):
    log = b.event_log()
    return changes.distinct_changes(log.unionByName(log)).select("commit_pos", "seq", "row_id")


@query(sql("""select 'financials' as source, commit_pos, 'row_after_commit' as fault, count(*) + 1 as messages
    from event_log where commit_pos % 50 = 0 group by commit_pos having count(*) > 0""", "event_log"))
def transaction_faults(b):
    log = b.event_log().filter("true")
    bad = log.filter("commit_pos % 50 = 0 and seq = 0").withColumn("kind", F.lit("commit")).withColumn("seq", F.lit(-1))
    return changes.transaction_faults(log.unionByName(bad))


@query(sql("""select 'financials' as source, commit_pos, count(*) as rows, cast(sum(byte_count) as bigint) as bytes
    from event_log group by commit_pos having sum(byte_count) > 684""", "event_log"))
def txn_budget_violations(b):
    return budgets.txn_budget_violations(b.event_log(), 1000, 684)


@query(sql("""select commit_pos, seq, row_id, byte_count from event_log where byte_count > 136""", "event_log"))
def oversized_rows(b):
    return budgets.oversized_rows(b.event_log(), 136).select("commit_pos", "seq", "row_id", "byte_count")


@query(sql("""select count(*) as rows, cast(sum(byte_count) as bigint) as bytes,
    count(*) > 1000000 or sum(byte_count) > 1000000 as exceeded from line_log""", "line_log"))
def window_usage(b):
    return budgets.window_usage(b.line_log(), 1000000, 1000000)


PREFIX_SQL = """select commit_pos, seq, row_id, byte_count from (select *, sum(byte_count) over w as used,
    row_number() over w as n from {log} window w as (order by commit_pos, seq, row_id rows unbounded preceding))
    where used <= {bytes} and n <= {rows}"""


@query(sql(PREFIX_SQL.format(log="line_log", rows=40000, bytes="2000000"), "line_log"))
def byte_budget_prefix(b):
    return budgets.prefix_within(b.line_log().select("commit_pos", "seq", "row_id", "byte_count"),
                                 ["commit_pos", "seq", "row_id"], "byte_count", 40000, 2000000)


@query(sql(PREFIX_SQL.format(log="event_log", rows=3000, bytes="100000000"), "event_log"))
def row_budget_prefix(b):
    return budgets.prefix_within(b.event_log().select("commit_pos", "seq", "row_id", "byte_count"),
                                 ["commit_pos", "seq", "row_id"], "byte_count", 3000, 100000000)


@query(sql("""with sized as (select o.id as operation_id, cast(128 + 2 * coalesce(length(a.name), 0)
    + 2 * coalesce(length(a.status), 0) + 2 * length(o.description) as bigint) as byte_count
    from operations o left join accounts a on a.id = o.account_id)
    select operation_id, byte_count from (select *, sum(byte_count) over (order by operation_id
    rows unbounded preceding) as used from sized) where used <= 1000000""", "operations", "accounts").replace(
    ") with sized", "), sized"))
def projection_budget_prefix(b):
    queue = b.operations().select(F.col("id").alias("operation_id"))
    sized = budgets.queued_sizes(queue, b.operations(), b.accounts())
    return budgets.prefix_within(sized, ["operation_id"], "byte_count", 10**9, 1000000)


@query(sql("""select commit_pos, seq, row_id, row_number() over (order by commit_pos, seq, row_id) as sequence
    from line_log""", "line_log"))
def staged_sequence(b):
    log = b.line_log().select("commit_pos", "seq", "row_id")
    return running_sums(log, ["commit_pos", "seq", "row_id"], {"sequence": F.lit(1)})


@query(sql("""select commit_pos, seq, row_id, byte_count from event_log
    order by commit_pos, seq limit 1000""", "event_log"))
def batch_candidates(b):
    log = b.event_log().select("commit_pos", "seq", "row_id", "byte_count")
    return budgets.first_rows(log, ["commit_pos", "seq"], 1000)


@query(sql("""select row_id, commit_pos, seq, lag(operation_id) over (partition by row_id order by commit_pos, seq)
    as parent_before from line_log where action <> 'D'""", "line_log"))
def parent_before(b):
    log = b.line_log().filter("action <> 'D'").select(
        "row_id", "commit_pos", "seq", try_field(F.col("payload"), "operation_id", T.StringType()).alias("_parent"))
    return values_before(log, ["row_id"], ["commit_pos", "seq"], {"parent_before": "_parent"}).drop("_parent")


@query(sql("""select row_id as operation_id, cast(max(strlen(description)) as bigint) as incoming_bytes
    from event_log group by row_id""", "event_log"))
def incoming_description_bytes(b):
    return budgets.incoming_description_bytes(b.event_log())


@query(sql(f"""select count(*) as rows, cast(sum(1216 + greatest(coalesce(strlen(o.description), 0),
    coalesce(i.n, 0))) as bigint) as bytes from ({AFFECTED_SQL}) d left join operations o on o.id = d.operation_id
    left join (select cast(user_id as varchar) as id, max(strlen(concat(event_type, '-', event_id))) as n
    from events group by user_id) i on i.id = d.operation_id""", *AFFECTED_NEEDS))
def fanout_estimate(b):
    return budgets.fanout_usage(_affected(b), b.operations(), b.mixed_log())


# contracts and quality

@query("""select concat(l_orderkey, '-', l_linenumber) as key, count(*) as rows, 'duplicate_key' as problem
    from lineitem group by l_orderkey, l_linenumber having count(*) > 1""")
def key_violations(b):
    lines = b.raw("lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"),
                                                 F.col("l_linenumber").cast("string")).alias("id"))
    return checks.check_keys(lines)


@query(sql("select account_id, count(*) as rows from assets group by account_id having count(*) > 1", "assets"))
def one_contact_per_account(b):
    return checks.one_per(b.assets(), "account_id")


@query(sql("""select 'title' as "column", 'too_long' as problem, count(*) as rows from documents
    where length(text) > 200 having count(*) > 0
    union all select 'asset_id', 'null', count(*) from cases where asset_id is null having count(*) > 0""", "cases"))
def value_violations(b):
    fields = [T.StructField("title", T.StringType(), False, {"max_length": 200}),
              T.StructField("asset_id", T.StringType(), False)]
    rows = b.raw("documents").select(F.col("text").alias("title"), F.when(
        F.col("doc_id") % 4 != 0, (F.col("doc_id") % 300).cast("string")).alias("asset_id"))
    return checks.value_violations(rows, Contract("cases", "cases", T.StructType(fields)))


@query("""select l_orderkey, l_linenumber, l_partkey from lineitem
    where cast(cast(l_extendedprice * (1 - l_discount) as decimal(38,10)) as decimal(18,2))
    <> cast(l_extendedprice * (1 - l_discount) as decimal(38,10))""")
def lossy_amounts(b):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = b.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", net.cast("decimal(38,10)").alias("amount"))
    return checks.lossless(rows, OPERATIONS).select("l_orderkey", "l_linenumber", "l_partkey")


@query(sql("""select 'financials' as source, commit_pos, seq, table_name, row_id, 'null:description' as problem
    from event_log where event_type = 'click'""", "event_log"))
def payload_violations(b):
    return (checks.payload_violations(b.event_log(), OPERATIONS)
            .withColumn("problem", F.concat_ws(",", "problems")).drop("problems"))


@query("""select distinct 'operations' as table_name, d.* from events, (values
    ('amount', 'type', 'decimal(18,2)', 'variant'), ('props', 'unknown', '', 'struct<k:bigint>'))
    d(field, problem, expected, found) where event_type = 'purchase'""")
def payload_drift(b):
    """Schema of all payloads of the mixed log, in which purchases write their amount as text and carry a new field."""
    body = F.concat(F.lit('{"id":"'), F.col("user_id").cast("string"), F.lit('","amount":"'), F.col("value").cast("string"),
                    F.lit('","props":'), F.col("props"), F.lit("}"))
    drifted = b.raw("events").filter("event_type = 'purchase'").select(
        F.lit("operations").alias("table_name"), F.parse_json(body).alias("payload"))
    return checks.payload_drift(b.mixed_log().select("table_name", "payload").unionByName(drifted), BY_NAME)


@query(sql("""select 'unsupported_relation' as problem, 'financials' as source, event_type as table_name,
    count(*) as rows from event_log group by event_type""", "event_log"))
def domain_violations(b):
    return checks.domain_violations(b.event_log().drop("table_name").join(
        b.raw("events").select(F.floor(F.col("event_id") / 5).cast("bigint").alias("commit_pos"),
                               (F.col("event_id") % 5).cast("int").alias("seq"),
                               F.col("event_type").alias("table_name")), ["commit_pos", "seq"]))


_CHILDREN = {"assets": "assets", "contact_information": "contacts", "account_history": "account_history",
             "operations": "operations", "transactions": "keyed_transactions",
             "collection_orders": "collection_orders", "cases": "cases", "notifications": "notifications"}
_PARENTS = {"accounts": "accounts", "operations": "operations", "payment_means": "payment_means", "assets": "assets",
            "case_types": "case_types", "case_groups": "case_groups", "notification_types": "notification_types"}


@query(sql(" union all ".join(
    f"""select '{child}.{fk}' as relation, c.id as child_id, c.{fk} as parent_id from {_CHILDREN[child]} c
    where c.{fk} is not null and not exists (select 1 from {_PARENTS[parent]} p where p.id = c.{fk})"""
    for child, fk, parent in RELATIONS), *dict.fromkeys([*_CHILDREN.values(), *_PARENTS.values()])))
def orphan_report(b):
    union = None
    for child, fk, parent in RELATIONS:
        found = compare.orphans(getattr(b, _CHILDREN[child])(), getattr(b, _PARENTS[parent])(), fk)
        part = found.select(F.lit(f"{child}.{fk}").alias("relation"), "child_id", "parent_id")
        union = part if union is None else union.unionByName(part)
    return union


@query(sql("""select case when m.id is null then 'only_in_source' when s.id is null then 'only_in_mirror'
    else 'differing' end as kind, coalesce(s.id, m.id) as key, case when m.id is not null and s.id is not null then
    concat_ws(',', case when s.name is distinct from m.name then 'name' end,
    case when s.status is distinct from m.status then 'status' end,
    case when s.created_at is distinct from m.created_at then 'created_at' end) end as columns
    from post_accounts s full join accounts m on s.id = m.id
    where m.id is null or s.id is null or s.name is distinct from m.name or s.status is distinct from m.status
    or s.created_at is distinct from m.created_at""",
           "accounts", "post_accounts"))
def reconcile_diff(b):
    return compare.reconcile(_post_accounts(b), b.accounts(), "id", ACCOUNTS.columns)


RECONCILE_SQL = sql("""select 'operations' as table_name, case when m.id is null then 'only_in_source' else 'only_in_mirror'
    end as kind, count(*) as keys from post_operations s full join operations m on s.id = m.id
    where m.id is null or s.id is null group by 1, 2
    union all select 'operations', 'differing', count(*) from post_operations s join operations m on s.id = m.id
    where (s.account_id, s.description, s.amount) is distinct from (m.account_id, m.description, m.amount)
    having count(*) > 0""", "operations", "post_operations")


@query(RECONCILE_SQL)
def reconcile_store(b):
    """The same over every table, column and the report of a store."""
    store, sources = _store(b, "reconciled"), _whole_sources(b)
    lifecycle.load_snapshot(store, sources, _descriptors(0))
    sources["operations"] = merge.merge_full(b.operations(), _whole_rows(b), OPERATIONS)
    return lifecycle.reconcile_store(store, sources)


@query(RECONCILE_SQL)
def reconcile_summary(b):
    source = merge.merge_full(b.operations(), _whole_rows(b), OPERATIONS)
    return compare.reconcile_summary({"operations": compare.reconcile(
        source, b.operations(), "id", OPERATIONS.columns)})


# Lines of two versions of a table without a key: in the second, large orders are gone and discounted lines twice.
@query("""select l.*, case when n > 0 then 'left' else 'right' end as side, cast(abs(n) as bigint) as copies from (
    select l, sum(n) as n from (select l, 1 as n from lineitem l union all
    select l, -1 from lineitem l, range(2) t(i) where l_quantity <= 45 and (i = 0 or l_discount = 0.05)) group by l) x
    where n <> 0""")
def multiset_difference(b):
    lines = b.raw("lineitem")
    small = lines.filter("l_quantity <= 45")
    later = small.unionByName(small.filter("l_discount = 0.05"))
    return compare.multiset_difference(*digests.narrowed_rows(lines, later))


# read models

DETAILS_SQL = """select a.id as account_id, a.name, a.status, a.created_at, c.email, c.phone,
    s.n as asset_no, s.id as asset_id, s.name as asset_name, s.kind as asset_kind, s.value as asset_value
    from accounts a left join contacts c on c.account_id = a.id left join (select *, row_number() over (
    partition by account_id order by name, id) as n from assets) s on s.account_id = a.id"""


@query(sql(DETAILS_SQL, "accounts", "contacts", "assets"))
def account_details_flat(b):
    return readmodels.account_details_flat(b.accounts(), b.assets(), b.contacts())


def _flattened(details: DataFrame) -> DataFrame:
    """One row per page: its asset ids in order, to compare nested results."""
    out = details
    if "assets" in out.columns:
        out = out.withColumn("asset_ids", F.concat_ws(",", "assets.id")).drop("assets")
    if "contact_information" in out.columns:
        out = out.withColumn("email", F.col("contact_information.email")).drop("contact_information")
    return out


def _details_sql(contact: bool, assets: bool, page_rows: int) -> str:
    columns = ["a.id as account_id", "a.name", "a.status", "a.created_at"]
    joins = ""
    if contact:
        columns.append("c.email")
        joins += " left join contacts c on c.account_id = a.id"
    if assets:
        columns += ["cast(coalesce(p.page, 0) as int) as page", "coalesce(p.ids, '') as asset_ids"]
        joins += f""" left join (select account_id, (n - 1) // {page_rows} as page, string_agg(id, ',' order by n) as ids
            from (select *, row_number() over (partition by account_id order by name, id) as n from assets)
            group by 1, 2) p on p.account_id = a.id"""
    return f"select {', '.join(columns)} from accounts a{joins}"


def _consumer(b: Bindings, consumer: str, page_rows: int = readmodels.PAGE_ROWS) -> DataFrame:
    tables = {"accounts": b.accounts(), "assets": b.assets(), "contact_information": b.contacts()}
    return _flattened(readmodels.consumer_details(consumer, tables, page_rows))


@query(sql(_details_sql(False, True, 1000), "accounts", "assets"))
def financials_account_details(b):
    return _consumer(b, "financials")


@query(sql(_details_sql(True, True, 4), "accounts", "assets", "contacts"))
def cases_account_details(b):
    return _consumer(b, "cases", page_rows=4)


@query(sql(_details_sql(True, False, 1000), "accounts", "contacts"))
def notifications_account_details(b):
    return _consumer(b, "notifications")


@query(sql("""select 'financials' as consumer, 'accounts' as view_name, id from accounts
    union all select 'financials', 'assets', id from assets union all select 'cases', 'accounts', id from accounts
    union all select 'cases', 'assets', id from assets union all select 'cases', 'contact_information', id from contacts
    union all select 'notifications', 'accounts', id from accounts
    union all select 'notifications', 'contact_information', id from contacts""", "accounts", "assets", "contacts"))
def consumer_views(b):
    tables = {"accounts": b.accounts(), "assets": b.assets(), "contact_information": b.contacts()}
    union = None
    for name in temporary_views(tables):
        consumer, view = name.split("_", 1)
        part = b.spark.table(name).select(F.lit(consumer).alias("consumer"), F.lit(view).alias("view_name"), "id")
        union = part if union is None else union.unionByName(part)
    return union


@query(sql("""select a.id, a.name, a.status, a.created_at from accounts a
    where a.id in (select account_id from assets)""", "accounts", "assets"))
def account_lookup(b):
    return readmodels.lookup(b.accounts(), b.assets().select(F.col("account_id").alias("id")))


@query(sql("""select operation_id, payment_means_id as payment_mean_id, amount, occurred_at from transactions""",
           "transactions"))
def renamed_transactions(b):
    return readmodels.to_model(b.transactions())


@query(sql("""select t.operation_id, t.payment_means_id, t.amount as transaction_amount, t.occurred_at,
    p.name as payment_means, o.account_id, o.description, o.amount as operation_amount from transactions t
    left join payment_means p on p.id = t.payment_means_id left join operations o on o.id = t.operation_id""",
           "transactions", "payment_means", "operations"))
def transaction_star(b):
    return readmodels.transaction_star(b.transactions(), b.operations(), b.payment_means())


@query(sql("""select o.id as operation_id, o.account_id, o.description, o.amount, c.id as order_id, c.due_at
    from operations o left join collection_orders c on c.operation_id = o.id""", "operations", "collection_orders"))
def operation_orders(b):
    return readmodels.operation_orders(b.operations(), b.collection_orders())


@query(sql("""select c.id as case_id, c.account_id, c.asset_id, c.case_type_id, c.case_group_id, c.title,
    a.name as account_name, a.status as account_status, s.name as asset_name, s.kind as asset_kind,
    t.name as case_type, g.name as case_group from cases c left join accounts a on a.id = c.account_id
    left join assets s on s.id = c.asset_id left join case_types t on t.id = c.case_type_id
    left join case_groups g on g.id = c.case_group_id""", "cases", "accounts", "assets", "case_types", "case_groups"))
def case_star(b):
    return readmodels.case_star(b.cases(), b.accounts(), b.assets(), b.case_types(), b.case_groups())


@query(sql("""select n.id as notification_id, n.account_id, n.notification_type_id, n.message, a.name as account_name,
    a.status as account_status, t.name as notification_type from notifications n
    left join accounts a on a.id = n.account_id left join notification_types t on t.id = n.notification_type_id""",
           "notifications", "accounts", "notification_types"))
def notification_star(b):
    return readmodels.notification_star(b.notifications(), b.accounts(), b.notification_types())


# validated ingestion

def _account_inputs(b: Bindings) -> DataFrame:
    """Account writes from the events: some without a name, some without a status."""
    n = F.col("event_id")
    return b.raw("events").select(
        F.col("user_id").cast("string").alias("id"),
        F.when(n % 9 != 0, F.concat(F.lit("  user "), n.cast("string"), F.lit(" "))).otherwise("  ").alias("name"),
        F.when(n % 4 == 0, F.lit(" ")).when(n % 4 == 1, F.lit(None)).otherwise(
            F.concat(F.lit(" "), F.col("event_type"))).alias("status"), n.alias("order"))


ACCOUNT_INPUT_SQL = """(select cast(user_id as varchar) as id, event_id, event_type,
    event_id % 9 <> 0 as ok from events)"""


@query(sql(f"""select i.id, concat('user ', i.n) as name, case when i.n % 4 in (0, 1) then 'Active' else i.kind end
    as status, coalesce(a.created_at, timestamp '2024-06-01') as created_at,
    case when a.id is null then 'I' else 'U' end as action from (select id, max(event_id) as n,
    arg_max(event_type, event_id) as kind from {ACCOUNT_INPUT_SQL} where ok group by id) i
    left join accounts a on a.id = i.id""", "accounts"))
def accepted_accounts(b):
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    return ingest.normalize_accounts(_account_inputs(b), b.accounts(), now)[0]


@query(sql(f"select id, event_id, 'missing_field' as reason from {ACCOUNT_INPUT_SQL} where not ok"))
def rejected_accounts(b):
    rejected = ingest.normalize_accounts(_account_inputs(b), b.accounts())[1]
    return rejected.select("id", F.col("order").alias("event_id"), "reason")


def _asset_inputs(b: Bindings) -> DataFrame:
    """Asset writes: known and new assets, some without a kind, some under another account."""
    n = F.col("event_id")
    asset = F.col("user_id")
    owner = F.when(n % 6 == 0, (asset + 1) % 150).otherwise(asset % 150)
    return b.raw("events").select(
        asset.cast("string").alias("id"), owner.cast("string").alias("account_id"),
        F.concat(F.lit("asset "), n.cast("string")).alias("name"),
        F.when(n % 8 == 3, F.lit("")).otherwise(F.col("event_type")).alias("kind"),
        F.col("value").cast("decimal(18,2)").alias("value"), n.alias("order"))


ASSET_SQL = """(select e.*, case when event_id % 8 = 3 then 'missing_field' when a.id is null then 'account_not_found'
    when s.account_id <> owner then 'wrong_account' end as reason from (select event_id, cast(user_id as varchar) as id,
    event_type, value, cast(case when event_id % 6 = 0 then (user_id + 1) % 150 else user_id % 150 end as varchar)
    as owner from events) e left join accounts a on a.id = e.owner left join assets s on s.id = e.id)"""


@query(sql(f"""select id, arg_max(owner, event_id) as account_id, concat('asset ', max(event_id)) as name,
    arg_max(event_type, event_id) as kind, cast(arg_max(value, event_id) as decimal(18,2)) as value, 'U' as action
    from {ASSET_SQL} where reason is null group by id""", "accounts", "assets"))
def accepted_assets(b):
    return ingest.validate_assets(_asset_inputs(b), b.accounts(), b.assets())[0]


@query(sql(f"select event_id, id, reason from {ASSET_SQL} where reason is not null", "accounts", "assets"))
def rejected_assets(b):
    rejected = ingest.validate_assets(_asset_inputs(b), b.accounts(), b.assets())[1]
    return rejected.select(F.col("order").alias("event_id"), "id", "reason")


def _contact_inputs(b: Bindings) -> DataFrame:
    n = F.col("o_orderkey")
    return b.raw("orders").select(
        F.col("o_custkey").cast("string").alias("account_id"),
        F.concat(F.lit(" mail"), n.cast("string"), F.lit("@example.test ")).alias("email"),
        F.when(n % 5 == 0, F.lit(" ")).otherwise(n.cast("string")).alias("phone"), n.alias("order"))


@query(sql("""select coalesce(c.id, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])) as id, i.account_id,
    concat('mail', i.n, '@example.test') as email, cast(i.n as varchar) as phone,
    case when c.id is null then 'I' else 'U' end as action from (select account_id, n,
    sha256(concat('contact', chr(31), account_id)) as h from (select cast(o_custkey as varchar) as account_id,
    max(o_orderkey) as n from orders where o_orderkey % 5 <> 0 group by o_custkey)
    where account_id in (select id from accounts)) i left join contacts c on c.account_id = i.account_id""",
           "accounts", "contacts"))
def upserted_contacts(b):
    return ingest.upsert_contacts(_contact_inputs(b), b.accounts(), b.contacts())[0]


def _operation_inputs(b: Bindings) -> DataFrame:
    """Operation requests from the documents: whole texts as descriptions."""
    return b.raw("documents").select(
        F.col("doc_id").alias("request_id"), (F.col("doc_id") % 200).cast("string").alias("account_id"),
        F.when(F.col("doc_id") % 13 == 0, F.lit("   ")).otherwise(
            F.regexp_replace("text", r"\s+", " ")).alias("description"),
        F.col("n_chars").cast("decimal(18,2)").alias("amount"))


OPERATION_SQL = r"""(select d.*, case when description = '' then 'missing_field' when length(description) > 500
    then 'too_long' when a.id is null then 'account_not_found' end as reason from (select doc_id as request_id,
    cast(doc_id % 200 as varchar) as account_id, case when doc_id % 13 = 0 then '' else
    trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')) end as description, cast(n_chars as decimal(18,2)) as amount
    from documents) d left join accounts a on a.id = d.account_id)"""


@query(sql(f"""select request_id, account_id, description, amount from {OPERATION_SQL} where reason is null""",
           "accounts"))
def validated_operations(b):
    return ingest.validate_operations(_operation_inputs(b), b.accounts())[0].drop("id")


@query(sql(f"select request_id, reason from {OPERATION_SQL} where reason is not null", "accounts"))
def rejected_operations(b):
    return ingest.validate_operations(_operation_inputs(b), b.accounts())[1].select("request_id", "reason")


@query(sql("""select o.account_id, o.id, o.description, o.amount from operations o
    where o.account_id in (select id from accounts)""", "operations", "accounts"))
def operations_with_account(b):
    return ingest.operations_with_account(b.operations(), b.accounts())


# freshness and load

@query(sql("""select c.id, case when s.id is not null then cast(date_diff('millisecond', c.committed_at, s.visible_at)
    as bigint) end as latency_ms from commits c left join sightings s on s.id = c.id""", "commits", "sightings"))
def visibility_latency(b):
    return latency.visibility_latency(b.commits(), b.sightings()).select("id", "latency_ms")


def _ranks(value: str, table: str, by: str = "") -> str:
    partition = f"partition by {by}" if by else ""
    picks = ", ".join(f"min(v) filter (k >= ceil(count * {p})) as {n}" for n, p in latency.PERCENTILES.items())
    lead = f"{by}, " if by else ""
    return f"""select {lead}count, {picks}, max(v) as max from (select {lead}{value} as v, row_number() over
        ({partition} order by {value}) as k, count(*) over ({partition}) as count from {table}
        where {value} is not null) group by {lead}count"""


@query(sql(_ranks("end_to_end_ms", "requests", "rate"), "requests"))
def latency_percentiles(b):
    return latency.nearest_rank("end_to_end_ms", ["rate"], b.requests())


@query(sql(_ranks("latency_ms", """(select cast(date_diff('millisecond', c.committed_at, s.visible_at) as bigint)
    as latency_ms from commits c join sightings s on s.id = c.id)"""), "commits", "sightings"))
def freshness_percentiles(b):
    return latency.nearest_rank("latency_ms", [], latency.visibility_latency(b.commits(), b.sightings()))


STEPS_SQL = """(select t, leaving, cast(sum(case when leaving = 0 then n else -n end) over (
    order by t, leaving rows unbounded preceding) as bigint) as pending from (
    select t, leaving, count(*) as n from (select committed_at as t, 0 as leaving from commits
    union all select visible_at, 1 from sightings) group by t, leaving))"""


@query(sql(f"select max(pending) as peak_pending from {STEPS_SQL}", "commits", "sightings"))
def peak_backlog(b):
    return latency.peak_backlog(b.commits(), b.sightings())


@query(sql(f"""select date_trunc('month', t) as bucket, arg_max(pending, (t, leaving)) as pending from {STEPS_SQL}
    group by 1""", "commits", "sightings"))
def backlog_over_time(b):
    month = F.date_trunc("month", "at").cast("timestamp_ntz")
    return latency.backlog_per(b.commits(), b.sightings(), month)


@query(sql("""select c.id, c.committed_at from commits c where c.id not in (select id from sightings)""",
           "commits", "sightings"))
def pending_rows(b):
    return latency.pending(b.commits(), b.sightings())


@query(sql("""select c.id, c.committed_at from commits c where c.id in (select id from sightings)""",
           "commits", "sightings"))
def visible_pending(b):
    return latency.observed(b.commits(), b.sightings())


@query(sql("""select rate, failed_stage, count(*) as failures from requests where not ok group by rate, failed_stage""",
           "requests"))
def failures_by_stage(b):
    return latency.failures_by_stage(b.requests(), ["rate"])


@query(sql("""select rate, rate * 30 as scheduled, count(*) as flows, count(*) filter (ok) as successful,
    count(*) filter (not ok) as failed, count(*) filter (failed_stage = 'concurrency_limit') as rejected,
    count(*) filter (failed_stage is null or failed_stage <> 'concurrency_limit') as started,
    round(count(*) filter (ok) / 30, 3) as per_offered_second, round(count(*) filter (ok) / 32, 3) as per_wall_second
    from requests group by rate""", "requests"))
def load_by_rate(b):
    requests = b.requests()
    profiles = requests.select("rate").distinct().select("rate", F.lit(30).alias("duration_seconds"),
                                                         F.lit(32).alias("wall_seconds"))
    return latency.load_summary(requests, profiles, "concurrency_limit")


@query(sql("""select source, true as initialized, position, top - position as lag, n as rows_applied from (
    select 'accounts' as source, max(commit_pos) // 2 as position, max(commit_pos) as top, count(*) as n
    from account_log union all select 'financials', max(commit_pos) // 2, max(commit_pos), count(*) from event_log)""",
           "account_log", "event_log"))
def source_status(b):
    log = b.account_log().select("source", "commit_pos", "commit_ts").unionByName(
        b.event_log().select("source", "commit_pos", "commit_ts"))
    per = log.groupBy("source").agg(F.max("commit_pos").alias("max_pos"), F.max("commit_ts").alias("last_commit_at"),
                                    F.count(F.lit(1)).alias("rows_applied"))
    checkpoints = per.select("source", F.floor(F.col("max_pos") / 2).cast("bigint").alias("position"),
                             "last_commit_at", "rows_applied", F.col("rows_applied").alias("batches_applied"))
    status = progress.source_status(checkpoints, per.select("source", "max_pos"), F.lit("2025-01-01").cast("timestamp_ntz"))
    return status.select("source", "initialized", "position", "lag", "rows_applied")


@query(sql("""select commit_pos, greatest(0, cast(date_sub('millisecond', max(commit_ts), timestamp '2024-01-15')
    as bigint)) as lag_ms from event_log group by commit_pos""", "event_log"))
def apply_lag(b):
    per = b.event_log().groupBy("commit_pos").agg(F.max("commit_ts").alias("ts"))
    return per.select("commit_pos", millis_between(F.col("ts"), F.lit("2024-01-15").cast("timestamp_ntz")).alias("lag_ms"))


# scalar functions

@query(r"""select doc_id, cast(strlen(text) as bigint) as utf8_bytes, cast(2 * length(text) + 2 * len(list_filter(
    string_split(text, ''), lambda c: c <> '' and unicode(c) > 65535)) as bigint) as utf16_bytes, sha256(text) as digest,
    lower(source) as source, regexp_full_match(source, 'src[0-9]+') as matches from documents""")
def text_functions(b):
    text = F.col("text")
    return b.raw("documents").select(
        "doc_id", utf8_bytes(text).alias("utf8_bytes"), utf16_bytes(text).alias("utf16_bytes"),
        F.sha2(text, 256).alias("digest"), F.lower("source").alias("source"),
        F.col("source").rlike("^src[0-9]+$").alias("matches"))


@query("""select l_orderkey, l_linenumber, l_partkey, concat(hex((l_orderkey * 5000000000 + l_partkey) >> 32), '/',
    hex((l_orderkey * 5000000000 + l_partkey) & 4294967295)) as position_text,
    l_orderkey * 5000000000 + l_partkey as position from lineitem""")
def log_positions(b):
    position = F.col("l_orderkey") * F.lit(5000000000) + F.col("l_partkey")
    text = format_position(position)
    return b.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("position_text"),
                                    parse_position(text).alias("position"))


@query("""select event_id, trim(concat('  ', event_type, ' ')) as trimmed, event_type = 'error' as blank,
    case when event_type = 'error' then 'Active' else event_type end as defaulted from events""")
def blank_rules(b):
    kind = F.col("event_type")
    padded = F.concat(F.lit("  "), kind, F.lit(" "))
    value = F.when(kind == "error", F.lit("\t ")).otherwise(padded)
    return b.raw("events").select("event_id", trimmed(padded).alias("trimmed"), is_blank(value).alias("blank"),
                                  default_if_blank(value, "Active").alias("defaulted"))


@query("""select o_orderkey, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) as id from (
    select o_orderkey, sha256(concat('operation', chr(31), o_orderkey)) as h from orders)""")
def stable_ids(b):
    return b.raw("orders").select("o_orderkey", stable_id(F.lit("operation"), F.col("o_orderkey").cast("string")).alias("id"))


# publishing, streaming and bounded windows, end to end

def _whole_sources(b: Bindings) -> dict[str, DataFrame]:
    """All mirrored tables in their contract's types."""
    made = {"accounts": b.accounts(), "assets": b.assets(), "contact_information": b.contacts(),
            "account_history": b.account_history(), "payment_means": b.payment_means(), "operations": b.operations(),
            "transactions": b.keyed_transactions(), "collection_orders": b.collection_orders()}
    return {c.name: made[c.name].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in c.schema.fields])
            for c in MIRRORED}


def _descriptors(position: int) -> dict[str, checks.SourceDescriptor]:
    return {s: checks.SourceDescriptor(s, f"db_{s}", "system", "e1", -1, position,
                                       {c.name: c.name for c in MIRRORED if c.source == s})
            for s in ("accounts", "financials")}


def _store(b: Bindings, label: str) -> Store:
    store = Store(b.spark, scratch(b.spark, label))
    lifecycle.bootstrap(store, Binding("db_accounts", "db_financials", "db_target"))
    return store


def _wall(report: DataFrame) -> DataFrame:
    report = _report(report)
    return report.withColumn("source_account_created_at", F.col("source_account_created_at").cast("timestamp_ntz"))


@query(sql(report_sql(transactions="keyed_transactions"), "accounts", "operations", "keyed_transactions"))
def published_report(b):
    store = _store(b, "published")
    lifecycle.load_snapshot(store, _whole_sources(b), _descriptors(0))
    return _wall(store.report())


def _streamed(b: Bindings, files: int | None = None) -> Store:
    """A store with the snapshot and then the mixed log, as JSON lines, streamed
    into it: all files at once, or ``files`` files one after the other, into
    which rows and markers are dealt by their hash."""
    store, folder = _store(b, "streamed"), scratch(b.spark, "log")
    lifecycle.load_snapshot(store, _whole_sources(b), _descriptors(-1))
    log = changes.with_marks(b.mixed_log().withColumn("commit_ts", F.col("commit_ts").cast("timestamp")))
    log = log.select(*ENVELOPE.fieldNames())
    if files:
        log = log.repartition(files, F.xxhash64("source", "commit_pos", "seq", "kind"))
    changelog.write_change_log(log, folder)
    start_stream(b.spark, store, folder, scratch(b.spark, "checkpoint"), UNBOUNDED,
                 files_per_trigger=1 if files else None).awaitTermination()
    return store


@query(sql(report_sql("post_operations", "post_accounts", "post_transactions"), *POST))
def streamed_report(b):
    """Snapshot, then the mixed log through the streaming job."""
    return _wall(_streamed(b).report())


@query(sql(report_sql("post_operations", "post_accounts", "post_transactions"), *POST))
def streamed_in_parts(b):
    """The same, file by file, with transactions torn over files in no order."""
    return _wall(_streamed(b, 3).report())


@query(sql("""select 'accounts' as source, max(commit_pos) as position, cast((select count(*) from accounts)
    + (select count(*) from assets) + (select count(*) from contacts) + (select count(*) from account_history)
    + count(*) as bigint) as rows_applied from account_log
    union all select 'financials', max(commit_pos), cast((select count(*) from operations)
    + (select count(*) from keyed_transactions) + (select count(*) from payment_means)
    + (select count(*) from collection_orders) + count(*) as bigint) from (
    select commit_pos from event_log union all select commit_pos from parent_log)""",
           "accounts", "assets", "contacts", "account_history", "account_log", "operations", "keyed_transactions",
           "payment_means", "collection_orders", "event_log", "parent_log"))
def streamed_checkpoints(b):
    """Positions and counters as the stream leaves them."""
    store = _streamed(b)
    return lifecycle.checkpoints_frame(store, store.require()).select("source", "position", "rows_applied")


def _later_sources(b: Bindings) -> dict[str, DataFrame]:
    """The sources after the mixed log: accounts, operations and transactions have changed."""
    later = _post_tables(b, cut_lineage(b.mixed_log()))
    return _whole_sources(b) | {name: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                                                  for f in BY_NAME[name].schema.fields]) for name, df in later.items()}


@query(sql(report_sql("post_operations", "post_accounts", "post_transactions"), *POST))
def windowed_report(b):
    """A first window of whole tables, then a window of what changed in three of them, drained in bounded steps."""
    store = _store(b, "windowed")
    window.drain(store, _whole_sources(b), _descriptors(0), UNBOUNDED)
    opened = window.capture_window(store, _later_sources(b), _descriptors(1), UNBOUNDED)
    # Two steps for the rows, and as many as their fan-out takes.
    step = replace(UNBOUNDED, batch_rows=-(-opened["working"]["staged_rows"] // 2))
    while window.apply_step(store, step):
        pass
    return _wall(store.report())


def _changed_sql(name: str, post: str, pre: str) -> str:
    """How many rows of a table a window stages."""
    values = " or ".join(f"p.{c} is distinct from c.{c}" for c in BY_NAME[name].values)
    return f"""(select count(*) from {post} p full join {pre} c on p.id = c.id
        where p.id is null or c.id is null or {values})"""


STAGED_SQL = " + ".join(_changed_sql(name, post, _FRAMES[name]) for name, post in _POST_FRAMES.items())


@query(sql(f"""select r.*, cast((n - 10) as bigint) as staged_rows from (
    {report_sql(transactions="keyed_transactions")}) r, (select {STAGED_SQL} as n) s""",
           "accounts", "operations", "keyed_transactions", *POST))
def half_way_window(b):
    """What readers see, and what is staged, after a first step of ten rows: the report of the window before."""
    store = _store(b, "half-way")
    window.drain(store, _whole_sources(b), _descriptors(0), UNBOUNDED)
    window.sync(store, _later_sources(b), _descriptors(1), replace(UNBOUNDED, batch_rows=10))
    staged = lifecycle.observe(store).first()["staged_rows"]
    return _wall(store.report()).withColumn("staged_rows", F.lit(staged).cast("bigint"))


@query(sql(" union all ".join(f"select '{n}' as table_name, count(*) as rows from {f}" for n, f in (
    *_FRAMES.items(), ("account_operations", "operations"))), *_FRAMES.values()))
def table_cardinalities(b):
    """Counts as the store's observation gives them, without a scan."""
    store = _store(b, "observed")
    lifecycle.load_snapshot(store, _whole_sources(b), _descriptors(0))
    names = [c.name for c in (*MIRRORED, REPORT)]
    each = F.array(*[F.struct(F.lit(n).alias("table_name"), F.col(n).alias("rows")) for n in names])
    return lifecycle.observe(store).select(F.explode(each).alias("r")).select("r.*")

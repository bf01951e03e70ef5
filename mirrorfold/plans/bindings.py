"""The model's tables and logs, derived from the test tables of a folder.

Every frame here has a twin of the same name in :data:`SQL`, the common table
expressions the query checks are written over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mirrorfold.contracts import MONEY


def _money(column: str) -> Column:
    return F.col(column).cast(MONEY)


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _after(day: str, seconds: Column) -> Column:
    """A wall-clock time without zone, ``seconds`` after the start of a day."""
    return F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


class Bindings:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # current-state tables

    def all_accounts(self) -> DataFrame:
        first = self.raw("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.min("o_orderdate").alias("created_at"))
        return self.raw("customer").join(first, "c_custkey").select(
            "c_custkey", _text("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("status"), "created_at")

    def accounts(self) -> DataFrame:
        return self.all_accounts().filter(F.col("c_custkey") % 10 != 0).drop("c_custkey")

    def operations(self) -> DataFrame:
        return self.raw("orders").select(
            _text("o_orderkey").alias("id"), _text("o_custkey").alias("account_id"),
            F.col("o_orderpriority").alias("description"), _money("o_totalprice").alias("amount"))

    def transactions(self) -> DataFrame:
        """Transaction lines; they have no key of their own."""
        return self.raw("lineitem").select(
            _text("l_orderkey").alias("operation_id"), F.col("l_returnflag").alias("payment_means_id"),
            _money("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("occurred_at"))

    def keyed_transactions(self) -> DataFrame:
        """One transaction per order, with a key."""
        return self.raw("orders").select(
            F.concat(F.lit("t"), _text("o_orderkey")).alias("id"), _text("o_orderkey").alias("operation_id"),
            F.col("o_orderstatus").alias("payment_means_id"), _money("o_totalprice").alias("amount"),
            F.col("o_orderdate").alias("occurred_at"))

    def payment_means(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_returnflag").alias("id")).distinct().withColumn(
            "name", F.concat(F.lit("means-"), F.col("id")))

    def collection_orders(self) -> DataFrame:
        return self.raw("orders").filter(F.col("o_orderstatus") == "O").select(
            _text("o_orderkey").alias("id"), _text("o_orderkey").alias("operation_id"),
            F.col("o_orderdate").alias("due_at"))

    def account_history(self) -> DataFrame:
        return self.raw("events").select(
            _text("event_id").alias("id"), _text("user_id").alias("account_id"),
            F.col("event_type").alias("description"), F.col("ts").alias("occurred_at"))

    def assets(self) -> DataFrame:
        return self.raw("part").select(
            _text("p_partkey").alias("id"), (F.col("p_partkey") % 150).cast("string").alias("account_id"),
            F.col("p_name").alias("name"), F.col("p_type").alias("kind"), _money("p_retailprice").alias("value"))

    def contacts(self) -> DataFrame:
        return self.raw("customer").filter(F.col("c_custkey") % 3 != 0).select(
            F.concat(F.lit("c"), _text("c_custkey")).alias("id"), _text("c_custkey").alias("account_id"),
            F.concat(F.lower("c_name"), F.lit("@example.test")).alias("email"),
            F.concat(F.lit("0"), _text("c_nationkey")).alias("phone"))

    def case_types(self) -> DataFrame:
        return self.raw("documents").select(F.col("lang").alias("id")).distinct().withColumn(
            "name", F.concat(F.lit("type-"), F.col("id")))

    def case_groups(self) -> DataFrame:
        return self.raw("documents").select(F.col("source").alias("id")).distinct().withColumn(
            "name", F.concat(F.lit("group-"), F.col("id")))

    def cases(self) -> DataFrame:
        return self.raw("documents").select(
            _text("doc_id").alias("id"), (F.col("doc_id") % 200).cast("string").alias("account_id"),
            F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 300).cast("string")).alias("asset_id"),
            F.col("lang").alias("case_type_id"), F.col("source").alias("case_group_id"),
            F.concat(F.lit("document "), _text("doc_id")).alias("title"))

    def notification_types(self) -> DataFrame:
        return self.raw("conversations").select(F.col("role").alias("id")).distinct().withColumn(
            "name", F.concat(F.lit("type-"), F.col("id")))

    def notifications(self) -> DataFrame:
        return self.raw("conversations").select(
            F.concat_ws("-", _text("conv_id"), _text("turn")).alias("id"), _text("conv_id").alias("account_id"),
            F.col("role").alias("notification_type_id"), F.col("text").alias("message"))

    # change logs

    def event_log(self) -> DataFrame:
        """Changes of operations from the events: partial updates, written nulls,
        deletes; five events per source transaction."""
        kind = F.col("event_type")
        body = F.concat(
            F.lit('{"id":"'), _text("user_id"), F.lit('"'),
            F.when(kind == "signup", F.concat(F.lit(',"account_id":"'), (F.col("event_id") % 100).cast("string"),
                                              F.lit('"'))).otherwise(""),
            F.when(kind.isin("signup", "purchase", "click"),
                   F.concat(F.lit(',"amount":'), _money("value").cast("string"))).otherwise(""),
            F.when(kind.isin("signup", "view"), F.concat(F.lit(',"description":"'), kind, F.lit("-"),
                                                         _text("event_id"), F.lit('"')))
            .when(kind == "click", F.lit(',"description":null')).otherwise(""), F.lit("}"))
        return self._events_as_changes(body, F.length("props") + 128)

    def _events_as_changes(self, body: Column, size: Column) -> DataFrame:
        kind = F.col("event_type")
        action = F.when(kind == "signup", "I").when(kind == "error", "D").otherwise("U")
        return self.raw("events").select(
            F.lit("financials").alias("source"), F.lit("operations").alias("table_name"),
            F.floor(F.col("event_id") / 5).cast("bigint").alias("commit_pos"), F.col("ts").alias("commit_ts"),
            (F.col("event_id") % 5).cast("int").alias("seq"), F.lit("row").alias("kind"), action.alias("action"),
            _text("user_id").alias("row_id"), F.lit(None).cast("string").alias("old_row_id"),
            F.parse_json(body).alias("payload"), size.cast("bigint").alias("byte_count"))

    def line_log(self) -> DataFrame:
        """Changes of transactions from the order lines: whole rows, repeated
        keys, and parents that move between neighbouring orders."""
        action = F.when(F.col("l_returnflag") == "R", "D").when(F.col("l_returnflag") == "A", "I").otherwise("U")
        key = F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber"))
        parent = (F.col("l_orderkey") + F.col("l_partkey") % 2).cast("string")
        body = F.concat(F.lit('{"id":"'), key, F.lit('","operation_id":"'), parent, F.lit('","amount":'),
                        _money("l_extendedprice").cast("string"), F.lit("}"))
        return self.raw("lineitem").select(
            F.lit("financials").alias("source"), F.lit("transactions").alias("table_name"),
            F.datediff("l_shipdate", F.lit("1990-01-01")).cast("bigint").alias("commit_pos"),
            F.col("l_shipdate").alias("commit_ts"),
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("seq"), F.lit("row").alias("kind"),
            action.alias("action"), key.alias("row_id"), F.lit(None).cast("string").alias("old_row_id"),
            F.parse_json(body).alias("payload"), F.octet_length(body).cast("bigint").alias("byte_count"))

    def account_log(self) -> DataFrame:
        """One change per account: withheld ones arrive, some leave, the rest are renamed."""
        key = F.col("c_custkey")
        action = F.when(key % 10 == 0, "I").when(key % 7 == 0, "D").otherwise("U")
        body = F.when(action == "I", F.concat(
            F.lit('{"id":"'), F.col("id"), F.lit('","name":"'), F.col("name"),
            F.lit('","status":"New","created_at":"2020-01-01 00:00:00"}'))).otherwise(
            F.concat(F.lit('{"id":"'), F.col("id"), F.lit('","name":"'), F.col("name"), F.lit('-r"}')))
        return self.all_accounts().select(
            F.lit("accounts").alias("source"), F.lit("accounts").alias("table_name"), key.alias("commit_pos"),
            _after("2024-02-01", key).alias("commit_ts"), F.lit(0).alias("seq"), F.lit("row").alias("kind"),
            action.alias("action"), "id", F.lit(None).cast("string").alias("old_row_id"),
            F.parse_json(body).alias("payload"), (F.octet_length(body) + 128).cast("bigint").alias("byte_count")
        ).withColumnRenamed("id", "row_id")

    def operation_log(self) -> DataFrame:
        """The events again, as whole rows of operations."""
        body = F.concat(F.lit('{"id":"'), _text("user_id"), F.lit('","account_id":"'),
                        (F.col("event_id") % 100).cast("string"), F.lit('","description":"'), F.col("event_type"),
                        F.lit("-"), _text("event_id"), F.lit('","amount":'), _money("value").cast("string"),
                        F.lit("}"))
        return self._events_as_changes(body, F.octet_length(body) + 128)

    def parent_log(self) -> DataFrame:
        """Some keyed transactions leave, some move to the next order."""
        key = F.col("o_orderkey")
        gone = key % 7 == 0
        ident = F.concat(F.lit("t"), _text("o_orderkey"))
        body = F.when(gone, F.concat(F.lit('{"id":"'), ident, F.lit('"}'))).otherwise(
            F.concat(F.lit('{"id":"'), ident, F.lit('","operation_id":"'), (key + 1).cast("string"), F.lit('"}')))
        return self.raw("orders").filter(gone | (key % 5 == 0)).select(
            F.lit("financials").alias("source"), F.lit("transactions").alias("table_name"),
            (key + 100000000).alias("commit_pos"), _after("2024-03-01", key).alias("commit_ts"),
            F.lit(0).alias("seq"), F.lit("row").alias("kind"), F.when(gone, "D").otherwise("U").alias("action"),
            ident.alias("row_id"), F.lit(None).cast("string").alias("old_row_id"), F.parse_json(body).alias("payload"),
            (F.octet_length(body) + 128).cast("bigint").alias("byte_count"))

    def mixed_log(self) -> DataFrame:
        return self.account_log().select(*LOG).unionByName(self.operation_log()).unionByName(self.parent_log())

    def commits(self) -> DataFrame:
        """A commit per order; it is seen some whole hours after, or not at all."""
        return self.raw("orders").select(_text("o_orderkey").alias("id"), F.col("o_orderdate").alias("committed_at"))

    def sightings(self) -> DataFrame:
        wait = F.make_dt_interval(hours=(F.col("o_orderkey") % 240).cast("int"))
        return self.raw("orders").filter(F.col("o_orderkey") % 11 != 0).select(
            _text("o_orderkey").alias("id"), (F.col("o_orderdate") + wait).alias("visible_at"))

    def requests(self) -> DataFrame:
        """A request log: five offered rates, an outcome and a time per request."""
        stage = (F.when(F.col("event_type") == "error", "operation_create")
                 .when(F.col("event_type") == "view", "concurrency_limit"))
        return self.raw("events").select(
            (F.col("user_id") % 5 + 1).alias("rate"), stage.isNull().alias("ok"), stage.alias("failed_stage"),
            _money("value").alias("end_to_end_ms"), "event_id")


LOG = ["source", "table_name", "commit_pos", "commit_ts", "seq", "kind", "action", "row_id", "old_row_id", "payload",
       "byte_count"]

SQL = {
    "all_accounts": """select c.c_custkey, cast(c.c_custkey as varchar) as id, c.c_name as name,
        c.c_mktsegment as status, o.created_at from customer c
        join (select o_custkey, min(o_orderdate) as created_at from orders group by o_custkey) o
        on o.o_custkey = c.c_custkey""",
    "accounts": "select id, name, status, created_at from all_accounts where c_custkey % 10 <> 0",
    "operations": """select cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as account_id,
        o_orderpriority as description, cast(o_totalprice as decimal(18,2)) as amount from orders""",
    "transactions": """select cast(l_orderkey as varchar) as operation_id, l_returnflag as payment_means_id,
        cast(l_extendedprice as decimal(18,2)) as amount, l_shipdate as occurred_at from lineitem""",
    "keyed_transactions": """select concat('t', o_orderkey) as id, cast(o_orderkey as varchar) as operation_id,
        o_orderstatus as payment_means_id, cast(o_totalprice as decimal(18,2)) as amount, o_orderdate as occurred_at
        from orders""",
    "payment_means": "select distinct l_returnflag as id, concat('means-', l_returnflag) as name from lineitem",
    "collection_orders": """select cast(o_orderkey as varchar) as id, cast(o_orderkey as varchar) as operation_id,
        o_orderdate as due_at from orders where o_orderstatus = 'O'""",
    "account_history": """select cast(event_id as varchar) as id, cast(user_id as varchar) as account_id,
        event_type as description, ts as occurred_at from events""",
    "assets": """select cast(p_partkey as varchar) as id, cast(p_partkey % 150 as varchar) as account_id,
        p_name as name, p_type as kind, cast(p_retailprice as decimal(18,2)) as value from part""",
    "contacts": """select concat('c', c_custkey) as id, cast(c_custkey as varchar) as account_id,
        concat(lower(c_name), '@example.test') as email, concat('0', c_nationkey) as phone
        from customer where c_custkey % 3 <> 0""",
    "case_types": "select distinct lang as id, concat('type-', lang) as name from documents",
    "case_groups": "select distinct source as id, concat('group-', source) as name from documents",
    "cases": """select cast(doc_id as varchar) as id, cast(doc_id % 200 as varchar) as account_id,
        case when doc_id % 4 <> 0 then cast(doc_id % 300 as varchar) end as asset_id, lang as case_type_id,
        source as case_group_id, concat('document ', doc_id) as title from documents""",
    "notification_types": "select distinct role as id, concat('type-', role) as name from conversations",
    "notifications": """select concat(conv_id, '-', turn) as id, cast(conv_id as varchar) as account_id,
        role as notification_type_id, text as message from conversations""",
    "event_log": """select 'operations' as table_name, event_id // 5 as commit_pos, ts as commit_ts,
        cast(event_id % 5 as int) as seq, event_id as ord, event_type,
        case event_type when 'signup' then 'I' when 'error' then 'D' else 'U' end as action,
        cast(user_id as varchar) as row_id, event_type = 'signup' as has_account_id,
        case when event_type = 'signup' then cast(event_id % 100 as varchar) end as account_id,
        event_type in ('signup', 'purchase', 'click') as has_amount,
        case when event_type in ('signup', 'purchase', 'click') then cast(value as decimal(18,2)) end as amount,
        event_type in ('signup', 'view', 'click') as has_description,
        case when event_type in ('signup', 'view') then concat(event_type, '-', event_id) end as description,
        cast(length(props) + 128 as bigint) as byte_count from events""",
    "line_log": """select 'transactions' as table_name,
        cast(date_diff('day', date '1990-01-01', cast(l_shipdate as date)) as bigint) as commit_pos,
        l_shipdate as commit_ts, l_partkey * 100000 + l_suppkey as seq,
        case l_returnflag when 'R' then 'D' when 'A' then 'I' else 'U' end as action,
        concat(l_orderkey, '-', l_linenumber) as row_id,
        cast(l_orderkey + l_partkey % 2 as varchar) as operation_id,
        cast(l_extendedprice as decimal(18,2)) as amount,
        strlen(concat('{"id":"', l_orderkey, '-', l_linenumber, '","operation_id":"', l_orderkey + l_partkey % 2,
        '","amount":', cast(l_extendedprice as decimal(18,2)), '}')) as byte_count from lineitem""",
    "account_log": """select c_custkey as commit_pos, id as row_id,
        timestamp '2024-02-01' + to_seconds(c_custkey) as commit_ts,
        case when c_custkey % 10 = 0 then 'I' when c_custkey % 7 = 0 then 'D' else 'U' end as action,
        name, c_custkey from all_accounts""",
    "parent_log": """select o_orderkey + 100000000 as commit_pos, concat('t', o_orderkey) as row_id,
        timestamp '2024-03-01' + to_seconds(o_orderkey) as commit_ts,
        case when o_orderkey % 7 = 0 then 'D' else 'U' end as action, o_orderkey from orders
        where o_orderkey % 7 = 0 or o_orderkey % 5 = 0""",
    "post_accounts": """select id, case when c_custkey % 10 = 0 then name else concat(name, '-r') end as name,
        case when c_custkey % 10 = 0 then 'New' else status end as status,
        case when c_custkey % 10 = 0 then timestamp '2020-01-01' else created_at end as created_at
        from all_accounts where c_custkey % 10 = 0 or c_custkey % 7 <> 0""",
    "last_event": """select cast(user_id as varchar) as id, max(event_id) as event_id,
        arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value, max(ts) as ts
        from events group by user_id""",
    "post_operations": """select id, account_id, description, amount from operations
        where id not in (select id from last_event)
        union all select id, cast(event_id % 100 as varchar), concat(event_type, '-', event_id),
        cast(value as decimal(18,2)) from last_event where event_type <> 'error'""",
    "post_transactions": """select concat('t', o_orderkey) as id,
        cast(case when o_orderkey % 5 = 0 then o_orderkey + 1 else o_orderkey end as varchar) as operation_id,
        o_orderstatus as payment_means_id, cast(o_totalprice as decimal(18,2)) as amount, o_orderdate as occurred_at
        from orders where o_orderkey % 7 <> 0""",
    "touches": """select 'account' as kind, row_id as key, commit_ts from account_log
        union all select 'operation', cast(user_id as varchar), ts from events
        union all select 'through_transaction', cast(o_orderkey as varchar), commit_ts from parent_log
        union all select 'through_transaction', cast(o_orderkey + 1 as varchar), commit_ts from parent_log
        where action = 'U'""",
    "ledger": "select kind, key, max(commit_ts) as last_commit_ts from touches group by kind, key",
    "commits": "select cast(o_orderkey as varchar) as id, o_orderdate as committed_at from orders",
    "sightings": """select cast(o_orderkey as varchar) as id,
        o_orderdate + to_hours(cast(o_orderkey % 240 as int)) as visible_at from orders where o_orderkey % 11 <> 0""",
    "requests": """select user_id % 5 + 1 as rate, event_type not in ('error', 'view') as ok,
        case event_type when 'error' then 'operation_create' when 'view' then 'concurrency_limit' end as failed_stage,
        cast(value as decimal(18,2)) as end_to_end_ms, event_id from events""",
}

NEEDS = {
    "accounts": ["all_accounts"], "account_log": ["all_accounts"], "post_accounts": ["all_accounts"],
    "post_operations": ["operations", "last_event"], "touches": ["account_log", "parent_log"], "ledger": ["touches"],
}


def sql(body: str, *names: str) -> str:
    """A check: the named common table expressions and what they need, then the body."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ", ".join(f"{n} as ({SQL[n]})" for n in ordered)
    return f"with {ctes} {body}" if ctes else body

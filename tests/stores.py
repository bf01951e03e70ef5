"""Helpers for tests that publish: small sources, descriptors, log files."""

import json
import uuid
from decimal import Decimal

from logs import START, at
from mirrorfold.contracts import BY_NAME, MIRRORED
from mirrorfold.operators.checks import SourceDescriptor
from mirrorfold.plans.lifecycle import bootstrap
from mirrorfold.settings import Binding
from mirrorfold.sources.store import Store

BINDING = Binding("db_accounts", "db_financials", "db_target")
TABLES = {s: [c.name for c in MIRRORED if c.source == s] for s in ("accounts", "financials")}


def descriptors(accounts=0, financials=0, changed=None):
    made = {}
    for source, position in (("accounts", accounts), ("financials", financials)):
        values = dict(source=source, database=f"db_{source}", system_id="sys", epoch="e1", min_pos=0, max_pos=position,
                      tables={t: f"{t}-1" for t in TABLES[source]})
        values.update((changed or {}).get(source, {}))
        made[source] = SourceDescriptor(**values)
    return made


def data(**tables):
    """Source rows per table, as dictionaries of tuples."""
    base = {c.name: [] for c in MIRRORED}
    base["accounts"] = [("A", "verification A", "Active", START), ("B", "verification B", "Active", START)]
    base["assets"] = [("s1", "A", "vehicle", "car", Decimal("120.00"))]
    base["contact_information"] = [("c1", "A", "a@example.test", "0000000000")]
    base["account_history"] = [("h1", "A", "existing historical row", START)]
    base["payment_means"] = [("p1", "synthetic payment")]
    base["operations"] = [("o1", "A", "verification original", Decimal("10.25"))]
    base["transactions"] = [("t1", "o1", "p1", Decimal("3.50"), START)]
    base["collection_orders"] = [("d1", "o1", START)]
    base.update(tables)
    return base


def frames(spark, rows):
    return {name: spark.createDataFrame(rows[name], BY_NAME[name].schema) for name in rows}


def new_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / uuid.uuid4().hex))
    bootstrap(store, BINDING)
    return store


def write_log(folder, rows):
    """One file of JSON lines in the envelope's form."""
    folder.mkdir(parents=True, exist_ok=True)
    names = ("source", "table_name", "commit_pos", "commit_ts", "seq", "kind", "action", "row_id", "old_row_id",
             "payload", "byte_count", "txn_rows", "prev_pos")
    with open(folder / f"{uuid.uuid4().hex}.json", "w") as out:
        for values in rows:
            message = dict(zip(names, values))
            message["commit_ts"] = message["commit_ts"].isoformat(timespec="microseconds")
            payload = message.pop("payload") or "null"  # as it is, so that no digit is lost
            line = json.dumps({k: v for k, v in message.items() if v is not None})
            out.write(f'{line[:-1]}, "payload": {payload}}}\n')


def report_map(store):
    return {r["operation_id"]: r.asDict() for r in store.report().collect()}


def ops(n, account="B", start=100):
    return [(f"n{i:03d}", account, "synthetic operation", Decimal("12.50")) for i in range(start, start + n)]


__all__ = ["BINDING", "at", "data", "descriptors", "frames", "new_store", "ops", "report_map", "write_log"]

"""Helpers for tests: change logs as lists, and a plain model of their effect."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from mirrorfold.contracts import BY_NAME, ENVELOPE, LEDGER, MIRRORED, REPORT
from mirrorfold.plans.apply import State
from mirrorfold.plans.lifecycle import CHECKPOINTS

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
RAW = ("source string, table_name string, commit_pos bigint, commit_ts timestamp, seq int, kind string, "
       "action string, row_id string, old_row_id string, payload string, byte_count bigint, txn_rows bigint, "
       "prev_pos bigint")


def at(pos):
    return START + timedelta(seconds=pos)


def row(pos, seq, table, action, row_id, old=None, **values):
    payload = json.dumps({"id": row_id, **values} if action != "D" else {"id": row_id})
    payload = payload.replace('"@', "").replace('@"', "")  # "@1.20@" stands for the bare number
    return (BY_NAME[table].source, table, pos, at(pos), seq, "row", action, row_id, old, payload, len(payload) + 128,
            None, None)


def mark(pos, source="financials", kind="commit", seq=1000, rows=None, prev=None):
    """A marker: ``rows`` in its transaction (1, or 0 for a heartbeat), the one before it at ``prev`` (the position below)."""
    rows = int(kind == "commit") if rows is None else rows
    return (source, None, pos, at(pos), seq, kind, None, None, None, None, None, rows, pos - 1 if prev is None else prev)


def log_frame(spark, rows):
    raw = spark.createDataFrame(rows, RAW)
    return raw.withColumn("payload", F.parse_json("payload")).select(*ENVELOPE.fieldNames())


def empty_state(spark):
    tables = {c.name: spark.createDataFrame([], c.schema) for c in MIRRORED}
    return State(tables, spark.createDataFrame([], REPORT.schema), spark.createDataFrame([], LEDGER),
                 spark.createDataFrame([], CHECKPOINTS))


def committed(rows, start=None):
    """Adds a commit marker after every transaction, each with its rows and the position before it;
    ``start`` is the position before the first one of each source."""
    counts, before, marks = Counter((r[0], r[2]) for r in rows), dict(start or {}), []
    for source, pos in sorted(counts):
        marks.append(mark(pos, source, rows=counts[source, pos], prev=before.get(source)))
        before[source] = pos
    return rows + marks


class Model:
    """Applies one transaction after another, the slow and obvious way."""

    def __init__(self):
        self.tables = {c.name: {} for c in MIRRORED}
        self.touch = {}

    def apply(self, rows):
        for source, table, pos, ts, seq, kind, action, key, old, payload, *_ in sorted(rows, key=lambda r: (r[2], r[4])):
            store, values = self.tables[table], json.loads(payload)
            before = dict(store.get(key) or {})
            if action == "D":
                store.pop(key, None)
                after = {}
            else:
                base = store.pop(old, {}) if old and old != key else store.get(key, {})
                if old and old != key:
                    before = dict(base)
                    self._touch(table, old, ts)
                after = store[key] = {**base, **values}
            self._touch(table, key, ts)
            if table == "transactions":
                for parent in (before.get("operation_id"), after.get("operation_id")):
                    if parent:
                        self.touch["op", parent] = max(self.touch.get(("op", parent), ts), ts)

    def _touch(self, table, key, ts):
        kind = {"accounts": "acc", "operations": "op"}.get(table)
        if kind:
            self.touch[kind, key] = max(self.touch.get((kind, key), ts), ts)

    def report(self):
        out = set()
        for key, op in self.tables["operations"].items():
            account = self.tables["accounts"].get(op["account_id"])
            mine = [t for t in self.tables["transactions"].values() if t["operation_id"] == key]
            stamps = [self.touch.get(("op", key)), self.touch.get(("acc", op["account_id"]))]
            out.add((key, op["account_id"], account and account["name"], account and account["status"], account is None,
                     op["description"], Decimal(op["amount"]).quantize(Decimal("0.01")),
                     sum((Decimal(t["amount"]) for t in mine), Decimal(0)).quantize(Decimal("0.01")), len(mine),
                     max((s for s in stamps if s), default=None)))
        return out


REPORT_COLUMNS = ["operation_id", "account_id", "account_name", "account_status", "account_missing", "description",
                  "amount", "transaction_total", "transaction_count", "last_source_commit_at"]


def report_rows(df):
    rows = set()
    for r in df.select(*REPORT_COLUMNS).collect():
        stamp = r["last_source_commit_at"]
        rows.add((*r[:-1], stamp.astimezone(timezone.utc) if stamp else None))
    return rows


def random_log(seed, transactions=14):
    """Random transactions over few keys: partial updates, deletes, re-inserts,
    reparenting and key changes. Inserts carry whole rows, as sources write them."""
    rng, rows = random.Random(seed), []
    alive = {"accounts": set(), "operations": set(), "transactions": set()}
    columns = {
        "accounts": lambda: {"name": f"n{rng.randint(0, 99)}", "status": rng.choice(["Active", "Closed"]),
                             "created_at": at(rng.randint(0, 9)).isoformat()},
        "operations": lambda: {"account_id": f"a{rng.randint(0, 3)}", "description": f"d{rng.randint(0, 99)}",
                               "amount": round(rng.uniform(1, 99), 2)},
        "transactions": lambda: {"operation_id": f"o{rng.randint(0, 4)}", "payment_means_id": "p",
                                 "amount": round(rng.uniform(1, 99), 2)}}
    prefix = {"accounts": "a", "operations": "o", "transactions": "t"}
    for pos in range(1, transactions + 1):
        tables = ["accounts"] if rng.random() < 0.3 else ["operations", "transactions"]
        for seq in range(rng.randint(1, 4)):
            table = rng.choice(tables)
            key = f"{prefix[table]}{rng.randint(0, 4)}"
            values = columns[table]()
            if key not in alive[table]:
                moved = sorted(alive[table])
                if moved and rng.random() < 0.3:
                    old = rng.choice(moved)
                    part = {k: v for k, v in values.items() if rng.random() < 0.5}
                    rows.append(row(pos, seq, table, "U", key, old=old, **part))
                    alive[table].discard(old)
                else:
                    rows.append(row(pos, seq, table, "I", key, **values))
                alive[table].add(key)
            elif rng.random() < 0.3:
                rows.append(row(pos, seq, table, "D", key))
                alive[table].discard(key)
            else:
                rows.append(row(pos, seq, table, "U", key, **{k: v for k, v in values.items() if rng.random() < 0.5}))
    return rows

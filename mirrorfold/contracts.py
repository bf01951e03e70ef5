"""Fixed table contracts. Nothing is inferred and nothing evolves by itself.

Every table has one text key. Lengths are kept in the field metadata so that a
contract stays an ordinary ``StructType``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import types as T

from mirrorfold.errors import Refused

MONEY = T.DecimalType(18, 2)
TOTAL = T.DecimalType(38, 2)
ID_LENGTH = 36


@dataclass(frozen=True)
class Contract:
    name: str
    source: str
    schema: T.StructType
    key: str = "id"

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    @property
    def values(self) -> list[str]:
        """All columns except the key."""
        return [name for name in self.columns if name != self.key]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]

    def type_of(self, column: str) -> T.DataType:
        return self.schema[column].dataType

    def max_length(self, column: str) -> int | None:
        return (self.schema[column].metadata or {}).get("max_length")


def text(name: str, length: int, nullable: bool = False) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable, {"max_length": length})


def ident(name: str, nullable: bool = False) -> T.StructField:
    return text(name, ID_LENGTH, nullable)


def _field(name: str, kind: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, kind, nullable)


def _table(name: str, source: str, *fields: T.StructField, key: str = "id") -> Contract:
    return Contract(name, source, T.StructType(list(fields)), key)


# Tables, columns, types, lengths and nullability.
ACCOUNTS = _table("accounts", "accounts",
                  ident("id"), text("name", 200), text("status", 40), _field("created_at", T.TimestampType()))
ASSETS = _table("assets", "accounts",
                ident("id"), ident("account_id"), text("name", 200), text("kind", 80), _field("value", MONEY))
CONTACT_INFORMATION = _table("contact_information", "accounts",
                             ident("id"), ident("account_id"), text("email", 320), text("phone", 50))
ACCOUNT_HISTORY = _table("account_history", "accounts",
                         ident("id"), ident("account_id"), text("description", 1000),
                         _field("occurred_at", T.TimestampType()))
PAYMENT_MEANS = _table("payment_means", "financials", ident("id"), text("name", 100))
OPERATIONS = _table("operations", "financials",
                    ident("id"), ident("account_id"), text("description", 500), _field("amount", MONEY))
TRANSACTIONS = _table("transactions", "financials",
                      ident("id"), ident("operation_id"), ident("payment_means_id"), _field("amount", MONEY),
                      _field("occurred_at", T.TimestampType(), True))
COLLECTION_ORDERS = _table("collection_orders", "financials",
                           ident("id"), ident("operation_id"), _field("due_at", T.TimestampType()))
CASE_TYPES = _table("case_types", "cases", ident("id"), text("name", 100))
CASE_GROUPS = _table("case_groups", "cases", ident("id"), text("name", 100))
CASES = _table("cases", "cases",
               ident("id"), ident("account_id"), ident("asset_id", True), ident("case_type_id"),
               ident("case_group_id"), text("title", 200))
NOTIFICATION_TYPES = _table("notification_types", "notifications", ident("id"), text("name", 100))
NOTIFICATIONS = _table("notifications", "notifications",
                       ident("id"), ident("account_id"), ident("notification_type_id"), text("message", 1000))

#: Mirrored tables, parents before children; a bounded step applies them in this order.
MIRRORED = (ACCOUNTS, ASSETS, CONTACT_INFORMATION, ACCOUNT_HISTORY,
            PAYMENT_MEANS, OPERATIONS, TRANSACTIONS, COLLECTION_ORDERS)
BY_NAME = {c.name: c for c in (*MIRRORED, CASE_TYPES, CASE_GROUPS, CASES, NOTIFICATION_TYPES, NOTIFICATIONS)}
SOURCES = ("accounts", "financials")

REPORT = _table("account_operations", "report",
                ident("operation_id"), ident("account_id"), text("account_name", 200, True),
                text("account_status", 40, True), _field("account_missing", T.BooleanType()),
                text("description", 500), _field("amount", MONEY),
                _field("transaction_total", TOTAL), _field("transaction_count", T.LongType()),
                _field("source_account_created_at", T.TimestampType(), True),
                _field("last_source_commit_at", T.TimestampType(), True),
                _field("materialized_at", T.TimestampType(), True), key="operation_id")

LEDGER = T.StructType([_field("kind", T.StringType()), _field("key", T.StringType()),
                       _field("last_commit_ts", T.TimestampType())])

#: One row of the change log. ``kind`` is row, commit, truncate or heartbeat. A commit or
#: heartbeat has the number of rows of its transaction and the position of the commit or
#: heartbeat before it, which prove that nothing is missing.
ENVELOPE = T.StructType([
    _field("source", T.StringType(), True), _field("table_name", T.StringType(), True),
    _field("commit_pos", T.LongType(), True), _field("commit_ts", T.TimestampType(), True),
    _field("seq", T.IntegerType(), True), _field("kind", T.StringType(), True),
    _field("action", T.StringType(), True), _field("row_id", T.StringType(), True),
    _field("old_row_id", T.StringType(), True), _field("payload", T.VariantType(), True),
    _field("byte_count", T.LongType(), True), _field("txn_rows", T.LongType(), True),
    _field("prev_pos", T.LongType(), True),
])

# Declared relations (child table, column, parent table).
RELATIONS = (
    ("assets", "account_id", "accounts"),
    ("contact_information", "account_id", "accounts"),
    ("account_history", "account_id", "accounts"),
    ("operations", "account_id", "accounts"),
    ("transactions", "operation_id", "operations"),
    ("transactions", "payment_means_id", "payment_means"),
    ("collection_orders", "operation_id", "operations"),
    ("cases", "account_id", "accounts"),
    ("cases", "asset_id", "assets"),
    ("cases", "case_type_id", "case_types"),
    ("cases", "case_group_id", "case_groups"),
    ("notifications", "account_id", "accounts"),
    ("notifications", "notification_type_id", "notification_types"),
)

# Which owner tables each consumer may read, all columns listed.
CONSUMER_VIEWS = {
    "financials": ("accounts", "assets"),
    "cases": ("accounts", "assets", "contact_information"),
    "notifications": ("accounts", "contact_information"),
}


def contract(name: str) -> Contract:
    try:
        return BY_NAME[name]
    except KeyError:
        raise Refused("unsupported_relation", f"no contract for table {name!r}") from None


def fingerprint(*contracts: Contract) -> str:
    """Hash of the given contracts, stored with the data they describe."""
    described = [(c.name, c.key, c.schema.json()) for c in contracts]
    return hashlib.sha256(repr(described).encode()).hexdigest()

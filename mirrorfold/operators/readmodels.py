"""Consumer read models: account details and the declared dimension joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mirrorfold.contracts import CONSUMER_VIEWS, contract
from mirrorfold.errors import Refused
from mirrorfold.operators.ordered import running_sums

PAGE_ROWS = 1000


def project_columns(df: DataFrame, name: str) -> DataFrame:
    """Exactly the contract's columns, in its order."""
    return df.select(*contract(name).columns)


def lookup(table: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """Many key lookups at once: the rows whose key is requested."""
    return table.join(requests.select(key).distinct(), key, "left_semi")


def single(table: DataFrame, key: str, value: str) -> DataFrame:
    """Action. The row of one key, or none; more than one is refused."""
    found = table.filter(F.col(key) == value)
    if len(found.select(key).limit(2).collect()) > 1:
        raise Refused("not_single", f"more than one row with {key} {value!r}")
    return found


def _account_columns(accounts: DataFrame) -> DataFrame:
    return accounts.select(F.col("id").alias("account_id"), "name", "status", "created_at")


def _contacts(contacts: DataFrame) -> DataFrame:
    return contacts.select("account_id", F.struct("id", "account_id", "email", "phone").alias("contact_information"))


def account_details_flat(accounts: DataFrame, assets: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row per account and asset (one row without asset for an account that
    has none), with the asset's place in name order."""
    ranked = running_sums(assets, ["name", "id"], {"asset_no": F.lit(1)}, keys=["account_id"])
    ranked = ranked.select("account_id", "asset_no", F.col("id").alias("asset_id"), F.col("name").alias("asset_name"),
                           F.col("kind").alias("asset_kind"), F.col("value").alias("asset_value"))
    reachable = contacts.select("account_id", "email", "phone")
    return (_account_columns(accounts).join(reachable, "account_id", "left").join(ranked, "account_id", "left"))


def account_details(accounts: DataFrame, assets: DataFrame | None = None, contacts: DataFrame | None = None,
                    page_rows: int = PAGE_ROWS) -> DataFrame:
    """Nested details: assets as an array in name order, contact as a struct.

    An account's assets come in pages of ``page_rows``; an ordinary account has
    the single page 0. So no row and no group grows with one account's assets,
    and no asset is left out.
    """
    out = _account_columns(accounts)
    if contacts is not None:
        out = out.join(_contacts(contacts), "account_id", "left")
    if assets is None:
        return out
    ranked = running_sums(assets, ["name", "id"], {"asset_no": F.lit(1)}, keys=["account_id"])
    asset = F.struct("asset_no", "id", "account_id", "name", "kind", "value")
    pages = (ranked.withColumn("page", F.floor((F.col("asset_no") - 1) / page_rows).cast("int"))
             .groupBy("account_id", "page").agg(F.sort_array(F.collect_list(asset)).alias("_assets")))
    pages = pages.select("account_id", "page", F.transform(
        "_assets", lambda a: F.struct(a["id"].alias("id"), a["account_id"].alias("account_id"), a["name"].alias("name"),
                                      a["kind"].alias("kind"), a["value"].alias("value"))).alias("assets"))
    empty = F.array().cast("array<struct<id:string,account_id:string,name:string,kind:string,value:decimal(18,2)>>")
    return (out.join(pages, "account_id", "left")
            .withColumn("page", F.coalesce("page", F.lit(0))).withColumn("assets", F.coalesce("assets", empty)))


def consumer_details(consumer: str, tables: dict[str, DataFrame], page_rows: int = PAGE_ROWS) -> DataFrame:
    """The details one consumer sees, from the views it may read."""
    allowed = CONSUMER_VIEWS[consumer]
    return account_details(tables["accounts"], tables["assets"] if "assets" in allowed else None,
                           tables["contact_information"] if "contact_information" in allowed else None, page_rows)


def _parent(df: DataFrame, key: str, **columns: str) -> DataFrame:
    return df.select(F.col("id").alias(key), *[F.col(c).alias(out) for out, c in columns.items()])


def transaction_star(transactions: DataFrame, operations: DataFrame, payment_means: DataFrame) -> DataFrame:
    return (transactions.withColumnRenamed("amount", "transaction_amount")
            .join(_parent(payment_means, "payment_means_id", payment_means="name"), "payment_means_id", "left")
            .join(_parent(operations, "operation_id", account_id="account_id", description="description",
                          operation_amount="amount"), "operation_id", "left"))


def operation_orders(operations: DataFrame, collection_orders: DataFrame) -> DataFrame:
    orders = collection_orders.select("operation_id", F.col("id").alias("order_id"), "due_at")
    return operations.withColumnRenamed("id", "operation_id").join(orders, "operation_id", "left")


def case_star(cases: DataFrame, accounts: DataFrame, assets: DataFrame, case_types: DataFrame,
              case_groups: DataFrame) -> DataFrame:
    """Cases with their dimensions; the asset is optional."""
    return (cases.withColumnRenamed("id", "case_id")
            .join(_parent(accounts, "account_id", account_name="name", account_status="status"), "account_id", "left")
            .join(_parent(assets, "asset_id", asset_name="name", asset_kind="kind"), "asset_id", "left")
            .join(_parent(case_types, "case_type_id", case_type="name"), "case_type_id", "left")
            .join(_parent(case_groups, "case_group_id", case_group="name"), "case_group_id", "left"))


def notification_star(notifications: DataFrame, accounts: DataFrame, notification_types: DataFrame) -> DataFrame:
    return (notifications.withColumnRenamed("id", "notification_id")
            .join(_parent(accounts, "account_id", account_name="name", account_status="status"), "account_id", "left")
            .join(_parent(notification_types, "notification_type_id", notification_type="name"),
                  "notification_type_id", "left"))


def to_model(transactions: DataFrame) -> DataFrame:
    """Storage name to model name of the payment reference."""
    return transactions.withColumnRenamed("payment_means_id", "payment_mean_id")


def to_storage(transactions: DataFrame) -> DataFrame:
    return transactions.withColumnRenamed("payment_mean_id", "payment_means_id")

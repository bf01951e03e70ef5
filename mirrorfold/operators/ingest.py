"""Validated ingestion. Each rule returns ``(accepted, rejected)``; rejected rows
keep their input and get a ``reason``. When a key comes several times, the rows
are judged one by one and the last accepted one (by ``order``) wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mirrorfold.contracts import ACCOUNTS, ASSETS, CONTACT_INFORMATION, OPERATIONS
from mirrorfold.functions.text import default_if_blank, is_blank, stable_id, trimmed, utf16_length

DEFAULT_STATUS = "Active"


def _split(judged: DataFrame, inputs: list[str]) -> tuple[DataFrame, DataFrame]:
    return (judged.filter(F.col("reason").isNull()),
            judged.filter(F.col("reason").isNotNull()).select(*inputs, "reason"))


def _winner(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; partial winners are picked on the map side."""
    values = [c for c in rows.columns if c != key]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_w"))
            .select(key, *[F.col(f"_w.{c}").alias(c) for c in values]))


def _too_long(column: str, longest: int) -> Column:
    return utf16_length(trimmed(F.col(column))) > longest


def _exists(inputs: DataFrame, accounts: DataFrame) -> DataFrame:
    known = accounts.select(F.col("id").alias("account_id"), F.lit(True).alias("_account"))
    return inputs.join(known, "account_id", "left")


def normalize_accounts(inputs: DataFrame, current: DataFrame, now: Column | None = None,
                       order: str = "order") -> tuple[DataFrame, DataFrame]:
    """Account writes ``(id, name, status, order)``. A name is required, texts are
    trimmed, a blank status becomes the default; the creation time is set once."""
    stamp = F.current_timestamp() if now is None else now
    reason = (F.when(is_blank(F.col("name")), "missing_field")
              .when(_too_long("name", ACCOUNTS.max_length("name"))
                    | _too_long("status", ACCOUNTS.max_length("status")), "too_long"))
    good, bad = _split(inputs.withColumn("reason", reason), inputs.columns)
    kept = current.select("id", F.col("created_at").alias("_created"))
    accepted = (_winner(good.select("id", "name", "status", order), "id", order).join(kept, "id", "left")
                .select("id", trimmed(F.col("name")).alias("name"),
                        default_if_blank(F.col("status"), DEFAULT_STATUS).alias("status"),
                        F.coalesce("_created", stamp).alias("created_at"),
                        F.when(F.col("_created").isNull(), "I").otherwise("U").alias("action")))
    return accepted, bad


def validate_assets(inputs: DataFrame, accounts: DataFrame, current: DataFrame,
                    order: str = "order") -> tuple[DataFrame, DataFrame]:
    """Asset writes ``(id, account_id, name, kind, value, order)``. An asset keeps
    the account it was first written under, also within one batch."""
    reason = (F.when(is_blank(F.col("name")) | is_blank(F.col("kind")), "missing_field")
              .when(_too_long("name", ASSETS.max_length("name"))
                    | _too_long("kind", ASSETS.max_length("kind")), "too_long")
              .when(F.col("_account").isNull(), "account_not_found"))
    judged = _exists(inputs, accounts).withColumn("reason", reason)
    owner = current.select("id", F.col("account_id").alias("_owner"))
    first = (judged.filter(F.col("reason").isNull()).groupBy("id")
             .agg(F.min_by("account_id", order).alias("_first")))
    judged = judged.join(owner, "id", "left").join(first, "id", "left")
    wrong = F.coalesce("_owner", "_first") != F.col("account_id")
    judged = judged.withColumn("reason", F.coalesce("reason", F.when(wrong, "wrong_account")))
    good, bad = _split(judged, inputs.columns)
    accepted = _winner(good.select("id", "account_id", "name", "kind", "value", order,
                                   F.col("_owner").isNull().alias("_new")), "id", order)
    return accepted.select("id", "account_id", trimmed(F.col("name")).alias("name"),
                           trimmed(F.col("kind")).alias("kind"), "value",
                           F.when(F.col("_new"), "I").otherwise("U").alias("action")), bad


def upsert_contacts(inputs: DataFrame, accounts: DataFrame, current: DataFrame,
                    order: str = "order") -> tuple[DataFrame, DataFrame]:
    """Contact writes ``(account_id, email, phone, order)``, one per account. A
    first contact gets an id derived from its account, so a replay repeats it."""
    reason = (F.when(is_blank(F.col("email")) | is_blank(F.col("phone")), "missing_field")
              .when(_too_long("email", CONTACT_INFORMATION.max_length("email"))
                    | _too_long("phone", CONTACT_INFORMATION.max_length("phone")), "too_long")
              .when(F.col("_account").isNull(), "account_not_found"))
    good, bad = _split(_exists(inputs, accounts).withColumn("reason", reason), inputs.columns)
    known = current.select("account_id", F.col("id").alias("_id"))
    accepted = (_winner(good.select("account_id", "email", "phone", order), "account_id", order)
                .join(known, "account_id", "left"))
    return accepted.select(F.coalesce("_id", stable_id(F.lit("contact"), F.col("account_id"))).alias("id"),
                           "account_id", trimmed(F.col("email")).alias("email"),
                           trimmed(F.col("phone")).alias("phone"),
                           F.when(F.col("_id").isNull(), "I").otherwise("U").alias("action")), bad


def validate_operations(inputs: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operation writes ``(request_id, account_id, description, amount)``. Each
    request creates one operation, with an id derived from the request."""
    longest = OPERATIONS.max_length("description")
    reason = (F.when(is_blank(F.col("description")), "missing_field")
              .when(_too_long("description", longest), "too_long")
              .when(F.col("_account").isNull(), "account_not_found"))
    good, bad = _split(_exists(inputs, accounts).withColumn("reason", reason), inputs.columns)
    return good.select(stable_id(F.lit("operation"), F.col("request_id").cast("string")).alias("id"), "request_id",
                       "account_id", trimmed(F.col("description")).alias("description"), "amount"), bad


def operations_with_account(operations: DataFrame, accounts: DataFrame) -> DataFrame:
    return operations.join(accounts.select(F.col("id").alias("account_id")), "account_id", "left_semi")

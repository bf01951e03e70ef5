"""Contract, key and value checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field as _field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from mirrorfold.contracts import BY_NAME, SOURCES, Contract
from mirrorfold.errors import Refused
from mirrorfold.functions.decimals import fits, text_fits
from mirrorfold.functions.payload import has_field, try_field
from mirrorfold.functions.text import utf16_length
from mirrorfold.operators.merge import DELETED
from mirrorfold.session import any_row

# What a log may contain.
ACTIONS = ("I", "U", "D")
KINDS = ("row", "commit", "truncate", "heartbeat")
CAPTURED = ("insert", "update", "delete", "truncate")


@dataclass(frozen=True)
class Violation:
    table: str
    column: str
    problem: str
    expected: str
    found: str


def check_contract(df: DataFrame, contract: Contract, ordered: bool = True) -> list[Violation]:
    """Compares schemas only: names, order, types, precision and scale. No job."""
    expected = {f.name: f for f in contract.schema.fields}
    found = {f.name: f for f in df.schema.fields}
    problems = [Violation(contract.name, n, "missing", f.dataType.simpleString(), "")
                for n, f in expected.items() if n not in found]
    problems += [Violation(contract.name, n, "unexpected", "", f.dataType.simpleString())
                 for n, f in found.items() if n not in expected]
    for name in expected.keys() & found.keys():
        want, have = expected[name].dataType, found[name].dataType
        if want != have:
            problems.append(Violation(contract.name, name, "type", want.simpleString(), have.simpleString()))
    if not problems and ordered and list(expected) != list(found):
        problems.append(Violation(contract.name, "*", "order", ",".join(expected), ",".join(found)))
    return sorted(problems, key=lambda v: (v.column, v.problem))


def require_contract(df: DataFrame, contract: Contract) -> DataFrame:
    problems = check_contract(df, contract)
    if problems:
        raise Refused("schema_drift", "; ".join(
            f"{p.table}.{p.column} {p.problem} (expected {p.expected or '-'}, found {p.found or '-'})" for p in problems))
    return df


def value_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """``(column, problem, rows)``: nulls in required columns and texts that are
    too long, counted in one pass. Lengths are in UTF-16 units."""
    tests = []
    for f in contract.schema.fields:
        if f.name not in df.columns:
            continue
        if not f.nullable:
            tests.append((f.name, "null", f"`{f.name}` is null"))
        longest = contract.max_length(f.name)
        if longest:
            tests.append((f.name, "too_long", f"octet_length(encode(`{f.name}`, 'UTF-16LE')) > {2 * longest}"))
    sums = df.agg(F.expr("array(" + ", ".join(
        f"struct('{column}' as column, '{problem}' as problem, count_if({test}) as rows)"
        for column, problem, test in tests) + ")").alias("counted"))
    return sums.selectExpr("inline(counted)").filter("rows > 0")


def check_keys(df: DataFrame, key: str = "id") -> DataFrame:
    """Keys that are null or not unique, with their row counts."""
    return (df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
            .filter(F.col("key").isNull() | (F.col("rows") > 1))
            .withColumn("problem", F.when(F.col("key").isNull(), "null_key").otherwise("duplicate_key")))


def one_per(df: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that more than one row carries."""
    return (df.groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("rows")).filter(F.col("rows") > 1))


def lossless(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows whose decimals a cast to the contract would round or overflow.

    ``df`` holds the values as wide decimals, doubles or number text.
    """
    lossy = []
    for f in contract.schema.fields:
        if isinstance(f.dataType, T.DecimalType) and f.name in df.columns:
            is_text = isinstance(df.schema[f.name].dataType, T.StringType)
            ok = text_fits(F.col(f.name), f.dataType) if is_text else fits(F.col(f.name), f.dataType)
            lossy.append(F.when(~ok, F.lit(f.name)))
    return (df.withColumn("lossy", F.filter(F.array(*lossy), lambda c: c.isNotNull()))
            .filter(F.size("lossy") > 0))


def payload_violations(log: DataFrame, contract: Contract) -> DataFrame:
    """Changes of one table whose payload has unknown keys, a null in a required
    column, a value of the wrong type, or a number that would be rounded."""
    rows = log.filter((F.col("table_name") == contract.name) & (F.col("action") != "D"))
    keys = F.json_object_keys(F.to_json("payload"))
    tests = [F.when(F.size(F.array_except(keys, F.array(*[F.lit(c) for c in contract.columns]))) > 0, "unknown_column")]
    for f in contract.schema.fields:
        if f.name == contract.key:
            continue
        present = has_field(F.col("payload"), f.name)
        is_null = F.coalesce(F.is_variant_null(F.variant_get("payload", f"$.{f.name}", "variant")), F.lit(False))
        if not f.nullable:
            tests.append(F.when(present & is_null, f"null:{f.name}"))
        if isinstance(f.dataType, T.DecimalType):
            ok = text_fits(try_field(F.col("payload"), f.name, T.StringType()), f.dataType)
        else:
            ok = try_field(F.col("payload"), f.name, f.dataType).isNotNull()
        tests.append(F.when(present & ~is_null & ~ok, f"value:{f.name}"))
        longest = contract.max_length(f.name)
        if longest:
            size = utf16_length(try_field(F.col("payload"), f.name, T.StringType()))
            tests.append(F.when(present & ~is_null & (size > longest), f"too_long:{f.name}"))
    problems = F.filter(F.array(*tests), lambda p: p.isNotNull())
    order = [c for c in ("source", "commit_pos", "seq") if c in log.columns]
    return (rows.select(*order, "table_name", "row_id", problems.alias("problems"))
            .filter(F.size("problems") > 0))


DRIFT = T.StructType([T.StructField(n, T.StringType()) for n in ("table_name", "field", "problem", "expected", "found")])
_NUMBERS = (T.LongType, T.DecimalType, T.DoubleType)


def _could_be(found: T.DataType, expected: T.DataType) -> bool:
    """Whether JSON values of one type can be values of a contract's: numbers for
    numbers, text for text and times, and nulls alone for all."""
    if isinstance(found, T.NullType):
        return True
    if isinstance(expected, T.StringType | T.TimestampType):
        return isinstance(found, T.StringType)
    return isinstance(found, _NUMBERS) if isinstance(expected, _NUMBERS) else type(found) is type(expected)


def payload_schema(log: DataFrame) -> DataFrame:
    """``(table_name, schema)``: the one type that all payloads of a table fit, as
    text. Mixed types of a field are ``VARIANT``. Partial types combine before
    the shuffle; a type is as large as the field names that occur."""
    rows = log.filter(F.col("payload").isNotNull() & F.col("table_name").isNotNull())
    return rows.groupBy("table_name").agg(F.schema_of_variant_agg("payload").alias("schema"))


def payload_drift(log: DataFrame, contracts: dict[str, Contract]) -> DataFrame:
    """Fields that payloads carry and the contract does not know (``unknown``), and
    fields whose values are not, or not all, of its type (``type``); a payload
    that is no object, and a table without contract, are named by field ``*``.

    Action: one aggregate over the log; a schema per table reaches the driver.
    """
    out = []
    for name, schema in payload_schema(log).collect():
        if name not in contracts:
            out.append((name, "*", "unknown", "", schema))
            continue
        # Names are left alone: odd ones are in backticks.
        kind = T.DataType.fromDDL(re.sub("(`[^`]*`)|OBJECT<", lambda m: m[1] or "STRUCT<", schema))
        if not isinstance(kind, T.StructType):
            if not isinstance(kind, T.NullType):
                out.append((name, "*", "type", "object", kind.simpleString()))
            continue
        known = {f.name: f.dataType for f in contracts[name].schema.fields}
        for f in kind.fields:
            if f.name not in known:
                out.append((name, f.name, "unknown", "", f.dataType.simpleString()))
            elif not _could_be(f.dataType, known[f.name]):
                out.append((name, f.name, "type", known[f.name].simpleString(), f.dataType.simpleString()))
    return log.sparkSession.createDataFrame(sorted(out), DRIFT)


def domain_problem() -> Column:
    """What is wrong with a log row: an unknown source, kind, action or table; null where nothing is."""
    is_row = F.col("kind") == "row"
    known = F.lit(False)
    for source in SOURCES:
        names = [c.name for c in BY_NAME.values() if c.source == source]
        known = known | ((F.col("source") == source) & F.col("table_name").isin(names))
    return (F.when(~F.col("source").isin(*SOURCES) | F.col("source").isNull(), "unknown_source")
               .when(~F.col("kind").isin(*KINDS) | F.col("kind").isNull(), "unknown_kind")
               .when(is_row & (~F.col("action").isin(*ACTIONS) | F.col("action").isNull()), "unknown_action")
               .when(is_row & ~F.coalesce(known, F.lit(False)), "unsupported_relation")
               .when(is_row & F.col("row_id").isNull(), "missing_id")
               .when(F.col("kind") == "truncate", "truncate"))


def domain_violations(log: DataFrame) -> DataFrame:
    """Log rows with a :func:`domain_problem`, as counts."""
    return (log.withColumn("problem", domain_problem()).filter(F.col("problem").isNotNull())
            .groupBy("problem", "source", "table_name").agg(F.count(F.lit(1)).cast("bigint").alias("rows")))


def require_values(frames: list[tuple[Contract, DataFrame]]) -> None:
    """Action. Refuses rows that break their contract's values; all frames are
    checked in one job."""
    parts = [value_violations(df, c).withColumn("table", F.lit(c.name)) for c, df in frames]
    if not parts:
        return
    bad = any_row(reduce(DataFrame.unionByName, parts))
    if bad is not None:
        raise Refused("row_contract", f"{bad['rows']} rows of {bad['table']} have {bad['column']} {bad['problem']}")


def require_keys(frames: list[tuple[Contract, DataFrame]]) -> None:
    """Action. Refuses null and repeated keys, in one job."""
    bad = any_row(reduce(DataFrame.unionByName, [
        check_keys(df, c.key).select(F.lit(c.name).alias("table"), "problem") for c, df in frames]))
    if bad is not None:
        raise Refused("key_contract", f"{bad['table']} has a {bad['problem']}")


def require_deltas(deltas: dict[str, DataFrame]) -> None:
    """Action. The value check of rows about to be written."""
    require_values([(BY_NAME[name], delta.filter(~F.col(DELETED))) for name, delta in deltas.items()])


def require_payloads(rows: DataFrame, names: list[str]) -> None:
    """Action. Refuses changes that do not fit their table's contract."""
    parts = [payload_violations(rows, BY_NAME[name]).select("table_name", "problems") for name in names]
    if not parts:
        return
    bad = any_row(reduce(DataFrame.unionByName, parts))
    if bad is not None:
        raise Refused("schema_drift", f"{bad['table_name']}: {', '.join(bad['problems'])}")


@dataclass(frozen=True)
class SourceDescriptor:
    """What a source says about itself before its log is read."""

    source: str
    database: str
    system_id: str
    epoch: str
    min_pos: int
    max_pos: int
    tables: dict[str, str] = _field(default_factory=dict)
    captured: tuple[str, ...] = CAPTURED
    filtered: bool = False
    available: bool = True


def guard_descriptor(descriptor: SourceDescriptor, tables: list[str]) -> None:
    """The source must emit every kind of change of exactly the expected tables."""
    if set(descriptor.captured) != set(CAPTURED):
        raise Refused("incomplete_capture", f"{descriptor.source} captures only {sorted(descriptor.captured)}")
    if descriptor.filtered:
        raise Refused("filtered_capture", f"{descriptor.source} filters rows or columns")
    if set(descriptor.tables) != set(tables):
        raise Refused("table_set", f"{descriptor.source} publishes {sorted(descriptor.tables)}, expected {sorted(tables)}")


def guard_position(descriptor: SourceDescriptor, checkpoint: dict, lag_limit: int | None = None) -> None:
    """Refuses to continue from a checkpoint the source no longer reaches."""
    name = descriptor.source
    if not descriptor.available:
        raise Refused("source_unavailable", f"the log of {name} is gone; resnapshot")
    if (descriptor.database, descriptor.system_id) != (checkpoint["database"], checkpoint["system_id"]):
        raise Refused("source_identity", f"{name} is another system than the checkpoint's; resnapshot")
    if descriptor.epoch != checkpoint["epoch"]:
        raise Refused("source_epoch", f"the epoch of {name} changed; resnapshot")
    if checkpoint["position"] > descriptor.max_pos:
        raise Refused("position_backwards", f"{name} moved backwards; resnapshot")
    if checkpoint["position"] < descriptor.min_pos:
        raise Refused("retention_expired", f"{name} no longer holds changes after the checkpoint; resnapshot")
    for table, identity in (checkpoint.get("tables") or {}).items():
        if descriptor.tables.get(table) != identity:
            raise Refused("table_identity", f"{name}.{table} was truncated or created anew; resnapshot")
    if lag_limit is not None and descriptor.max_pos - checkpoint["position"] > lag_limit:
        raise Refused("lag_limit", f"{name} is {descriptor.max_pos - checkpoint['position']} behind")

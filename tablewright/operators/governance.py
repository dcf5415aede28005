"""Contracts, catalog checks, audit reports, access decisions and alert rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.labels import compare
from tablewright.operators.columns import absent, quoted

# --- contracts -------------------------------------------------------------------------

# Fixed names of contract types.
CONTRACT_TYPES = {
    "string": "string", "integer": "bigint", "float": "double", "boolean": "boolean",
    "date": "date", "datetime": "timestamp_ntz", "json": "string", "array": "array<string>",
}


@dataclass
class ContractColumn:
    name: str
    data_type: str
    nullable: bool = True


@dataclass
class Rule:
    """``kind`` is not_null, unique, range, pattern or custom."""

    column: str
    kind: str
    parameters: Mapping[str, Any] = field(default_factory=dict)
    severity: str = "error"

    @property
    def code(self) -> str:
        return f"{self.column}:{self.kind}"


@dataclass
class Transform:
    """``kind`` is map, format or calculate; the result replaces or adds ``target``."""

    target: str
    kind: str
    source: str | None = None
    parameters: Mapping[str, Any] = field(default_factory=dict)


@dataclass
class Contract:
    id: str
    name: str
    version: str
    columns: Sequence[ContractColumn]
    rules: Sequence[Rule] = ()
    transforms: Sequence[Transform] = ()

    def findings(self) -> list[str]:
        """What is wrong with the contract itself."""
        out = [f"missing_{k}" for k in ("id", "name", "version") if not getattr(self, k)]
        names = [c.name for c in self.columns]
        out += [f"duplicate_column:{n}" for n in dict.fromkeys(n for n in names if names.count(n) > 1)]
        out += [f"unknown_column:{r.column}" for r in self.rules if r.column not in names]
        out += [f"unknown_type:{c.name}" for c in self.columns if c.data_type not in CONTRACT_TYPES]
        return out


def contract_findings(spark: SparkSession, contracts: Sequence[Contract]) -> DataFrame:
    rows = [(c.id, f) for c in contracts for f in c.findings()]
    return spark.createDataFrame(rows, "contract_id string, finding string")


def _broken(df: DataFrame, rule: Rule) -> Column:
    c = quoted(rule.column)
    if rule.kind == "not_null":
        return absent(df, rule.column)
    if rule.kind == "range":
        tests = []
        if rule.parameters.get("min") is not None:
            tests.append(c < F.lit(rule.parameters["min"]))
        if rule.parameters.get("max") is not None:
            tests.append(c > F.lit(rule.parameters["max"]))
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    if rule.kind == "pattern":
        return ~c.cast("string").rlike(f"^(?:{rule.parameters['pattern']})")
    if rule.kind == "custom":
        return ~F.expr(rule.parameters["expression"])
    raise ValueError(f"unknown rule: {rule.kind}")


def check_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """The table with ``_errors`` and ``_warnings``, the codes each row breaks.

    Row rules are one projection. A uniqueness rule counts its key, joins back
    the keys that occur more than once, and leaves everything else in place.
    """
    tests: list[tuple[str, str, Column]] = []
    for c in contract.columns:
        if c.name not in df.columns:
            tests.append(("error", f"{c.name}:missing", F.lit(not c.nullable)))
            continue
        if not c.nullable:
            tests.append(("error", f"{c.name}:required", absent(df, c.name)))
        kind = CONTRACT_TYPES[c.data_type]
        if df.schema[c.name].dataType != T._parse_datatype_string(kind):
            tests.append(("error", f"{c.name}:type", quoted(c.name).isNotNull() & quoted(c.name).try_cast(kind).isNull()))
    helpers = []
    out = df
    for i, r in enumerate(r for r in contract.rules if r.column in df.columns):
        if r.kind == "unique":
            mark = f"_u{i}"
            repeated = (
                df.filter(quoted(r.column).isNotNull())
                .groupBy(quoted(r.column).alias(f"_k{i}"))
                .agg(F.count(F.lit(1)).alias("_n"))
                .filter("_n > 1")
                .select(f"_k{i}", F.lit(True).alias(mark))
            )
            out = out.join(repeated, quoted(r.column) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
            helpers.append(mark)
            tests.append((r.severity, r.code, F.coalesce(F.col(mark), F.lit(False))))
        else:
            tests.append((r.severity, r.code, F.coalesce(_broken(df, r), F.lit(False))))

    def codes(level: str) -> Column:
        hits = [F.when(t, F.lit(code)) for severity, code, t in tests if (severity == "error") == (level == "error")]
        if not hits:
            return F.array().cast("array<string>")
        return F.filter(F.array(*hits), lambda c: c.isNotNull())

    return out.withColumns({"_errors": codes("error"), "_warnings": codes("warning")}).drop(*helpers)


def violation_summary(checked: DataFrame) -> DataFrame:
    """Rows per broken code and severity."""
    cells = F.explode(
        F.concat(
            F.transform("_errors", lambda c: F.struct(F.lit("error").alias("severity"), c.alias("code"))),
            F.transform("_warnings", lambda c: F.struct(F.lit("warning").alias("severity"), c.alias("code"))),
        )
    ).alias("v")
    return checked.select(cells).groupBy("v.severity", "v.code").agg(F.count(F.lit(1)).alias("rows"))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows as they came, and the quarantined ones with their codes."""
    good = checked.filter(F.size("_errors") == 0).drop("_errors", "_warnings")
    return good, checked.filter(F.size("_errors") > 0)


def apply_transforms(df: DataFrame, transforms: Sequence[Transform]) -> DataFrame:
    for t in transforms:
        if t.kind == "map":
            pairs = [F.lit(v) for kv in t.parameters["values"].items() for v in kv]
            value = F.create_map(*pairs)[quoted(t.source)]
            if "default" in t.parameters:
                value = F.coalesce(value, F.lit(t.parameters["default"]))
        elif t.kind == "format":
            if isinstance(df.schema[t.source].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                value = F.date_format(quoted(t.source), t.parameters["pattern"])
            else:
                value = F.format_number(quoted(t.source), t.parameters["decimals"])
        elif t.kind == "calculate":
            value = F.expr(t.parameters["expression"])
        else:
            raise ValueError(f"unknown transform: {t.kind}")
        df = df.withColumn(t.target, value)
    return df


# --- catalog ----------------------------------------------------------------------------


def dangling(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose reference does not exist in ``parent``."""
    keys = parent.select(quoted(parent_key).alias("_k")).distinct()
    return child.join(keys, quoted(child_key) == F.col("_k"), "left_anti")


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows with ``text`` in any of the columns, whatever the case."""
    low = text.lower()
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.lower(quoted(c)).contains(low), F.lit(False)) for c in columns]))


def sample_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Up to ``k`` smallest distinct values per column, as text."""
    columns = list(columns or df.columns)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns]))
    w = Window.partitionBy("column").orderBy("value")
    return (
        df.select(cells)
        .filter("value IS NOT NULL")
        .distinct()
        .withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= k)
        .groupBy("column")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("samples"))
    )


# --- audit ------------------------------------------------------------------------------

# Fixed event classes of the audit log.
WRITE_WORDS = ("write", "update", "create")
DELETE_WORDS = ("delete", "remove")
DATA_EVENTS = ("data_read", "data_write", "data_delete")
AUTH_EVENTS = ("login", "logout")
PERMISSION_EVENTS = ("role_assign", "role_remove", "permission_grant", "permission_revoke")
HIGH_SEVERITIES = ("high", "critical")


def data_event_type(action: Column) -> Column:
    low = F.lower(action)
    return F.when(low.isin(*WRITE_WORDS), "data_write").when(low.isin(*DELETE_WORDS), "data_delete").otherwise("data_read")


def permission_event_type(action: Column) -> Column:
    low = F.lower(action)
    role = F.when(low.contains("assign"), "role_assign").otherwise("role_remove")
    return F.when(low.contains("role"), role).otherwise(F.when(low.contains("grant"), "permission_grant").otherwise("permission_revoke"))


def find_events(
    events: DataFrame,
    user: Any = None,
    event_type: str | None = None,
    severity: str | Sequence[str] | None = None,
    success: bool | None = None,
    start: Column | None = None,
    end: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Audit events by any of the filters, newest first; all of them, or the newest ``limit``."""
    if user is not None:
        events = events.filter(F.col("user_id") == user)
    if event_type is not None:
        events = events.filter(F.col("event_type") == event_type)
    if severity is not None:
        wanted = [severity] if isinstance(severity, str) else list(severity)
        events = events.filter(F.col("severity").isin(*wanted))
    if success is not None:
        events = events.filter(F.col("success") == success)
    if start is not None:
        events = events.filter(F.col("ts") >= start)
    if end is not None:
        events = events.filter(F.col("ts") <= end)
    ordered = events.orderBy(F.desc("ts"), F.desc("event_id"))
    return ordered if limit is None else ordered.limit(limit)


def audit_summary(events: DataFrame, start: Column | None = None) -> DataFrame:
    """Totals and counts by type, severity and user in one grouping-sets pass."""
    if start is not None:
        events = events.filter(F.col("ts") >= start)
    bad = F.count_if(~F.col("success"))
    high = F.count_if(F.col("severity").isin(*HIGH_SEVERITIES))
    user = F.col("user_id").cast("string")
    rows = (
        events.withColumn("user_id", user)
        .groupingSets([["event_type"], ["severity"], ["user_id"], []], "event_type", "severity", "user_id")
        .agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("events"), bad.alias("failed"), high.alias("high_severity"))
    )
    kind = F.when(F.col("g") == 3, "event_type").when(F.col("g") == 5, "severity").when(F.col("g") == 6, "user").otherwise("total")
    value = F.coalesce("event_type", "severity", "user_id", F.lit("*"))
    return rows.select(kind.alias("kind"), value.alias("value"), "events", (F.col("events") - F.col("failed")).alias("successful"), "failed", "high_severity")


def compliance(events: DataFrame, start: Column | None = None) -> DataFrame:
    """Event class counts and a score: 100 less 30 x failed and 20 x high-severity share."""
    if start is not None:
        events = events.filter(F.col("ts") >= start)
    n = F.count(F.lit(1))
    row = events.agg(
        n.alias("total_events"),
        F.count_if(F.col("event_type").isin(*DATA_EVENTS)).alias("data_access_events"),
        F.count_if(F.col("event_type").isin(*AUTH_EVENTS)).alias("authentication_events"),
        F.count_if(F.col("event_type").isin(*PERMISSION_EVENTS)).alias("permission_events"),
        F.count_if(~F.col("success")).alias("failed_events"),
        F.count_if(F.col("severity").isin(*HIGH_SEVERITIES)).alias("high_severity_events"),
    )
    share = lambda c: F.coalesce(F.try_divide(c, "total_events"), F.lit(0.0))
    score = F.greatest(F.lit(0.0), 100.0 - share("failed_events") * 30 - share("high_severity_events") * 20)
    advice = F.filter(
        F.array(
            F.when(F.col("failed_events") > F.col("total_events") * 0.1, F.lit("check_system")),
            F.when(F.col("high_severity_events") > 0, F.lit("act_on_high_severity")),
            F.when(F.col("data_access_events") == 0, F.lit("check_logging")),
        ),
        lambda c: c.isNotNull(),
    )
    return row.select("*", score.alias("compliance_score"), F.concat_ws(",", advice).alias("advice"))


def collection_status(sources: DataFrame, collected: DataFrame, source: str = "source") -> DataFrame:
    """failed, partial or completed per job, from wanted sources and collected ones.

    ``collected`` has ``source`` and ``error`` (null when it went well).
    """
    got = collected.groupBy(source).agg(F.count_if(F.col("error").isNotNull()).alias("errors"))
    joined = sources.join(got, source, "left")
    row = joined.groupBy("job").agg(
        F.count_if(F.col("errors").isNull()).alias("missing"), F.count_if(F.col("errors") > 0).alias("with_errors"), F.count(F.lit(1)).alias("sources")
    )
    both = (F.col("missing") > 0) & (F.col("with_errors") > 0)
    status = F.when(both, "failed").when((F.col("missing") > 0) | (F.col("with_errors") > 0), "partial").otherwise("completed")
    return row.withColumn("status", status)


# --- access ------------------------------------------------------------------------------


def authorise(requests: DataFrame, users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Decide a whole log of requests: each gets ``allowed``.

    requests(request_id, user_id, resource_type, resource_id, action); users(user_id,
    is_active); user_roles(user_id, role_id); role_permissions(role_id, resource_type,
    resource_id, action). Grants are expanded per user and keyed by everything a
    request must match, so each alternative is an equality join.
    """
    active = users.filter("is_active").select("user_id")
    grants = active.join(user_roles, "user_id").join(role_permissions, "role_id").select("user_id", "resource_type", "resource_id", "action").distinct()
    wanted = requests.withColumn(
        "_key",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("any_id"), F.col("action").alias("act")),
                F.struct(F.lit(True).alias("any_id"), F.lit("admin").alias("act")),
                F.struct(F.lit(False).alias("any_id"), F.col("action").alias("act")),
                F.struct(F.lit(False).alias("any_id"), F.lit("admin").alias("act")),
            )
        ),
    ).select(
        "request_id",
        F.col("user_id").alias("_u"),
        F.col("resource_type").alias("_t"),
        F.when(F.col("_key.any_id"), F.lit(None).cast("string")).otherwise(F.col("resource_id")).alias("_r"),
        F.col("_key.act").alias("_a"),
    )
    match = (
        (F.col("_u") == F.col("user_id"))
        & (F.col("_t") == F.col("resource_type"))
        & F.col("_r").eqNullSafe(F.col("resource_id"))
        & (F.col("_a") == F.col("action"))
    )
    allowed = wanted.join(grants, match, "left_semi").select("request_id").distinct().withColumn("_ok", F.lit(True))
    return requests.join(allowed, "request_id", "left").select(*requests.columns, F.coalesce("_ok", F.lit(False)).alias("allowed"))


@dataclass
class PolicyRule:
    effect: str
    conditions: Mapping[str, Any] = field(default_factory=dict)


def evaluate_policy(requests: DataFrame, rules: Sequence[PolicyRule]) -> DataFrame:
    """First rule whose conditions all hold decides; nothing matching means deny.

    The rule list is code, so it becomes one CASE expression over the request's
    columns and costs no join.
    """
    decision = None
    for r in rules:
        tests = [quoted(k).isin(*v) if isinstance(v, (list, tuple, set)) else quoted(k) == F.lit(v) for k, v in r.conditions.items()]
        hit = F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if tests else F.lit(True)
        outcome = F.lit("allow" if r.effect == "allow" else "deny")
        decision = F.when(hit, outcome) if decision is None else decision.when(hit, outcome)
    return requests.withColumn("decision", decision.otherwise("deny") if decision is not None else F.lit("deny"))


# --- alert rules --------------------------------------------------------------------------


@dataclass
class AlertRule:
    id: str
    name: str
    event_type: str
    conditions: Mapping[str, Any] = field(default_factory=dict)
    template: str = "alert"
    priority: str = "medium"
    cooldown_minutes: int = 0


def _condition(df: DataFrame, name: str, expected: Any) -> Column:
    if name not in df.columns:
        return F.lit(False)
    c = quoted(name)
    if isinstance(expected, Mapping):
        return compare(F.lit(expected["operator"]), c, F.lit(expected["value"]))
    return c == F.lit(expected)


def fill_template(template: str, df: DataFrame) -> Column:
    """Text with ``{field}`` marks filled from columns; unknown marks keep the template as is."""
    marks = re.findall(r"\{(\w+)\}", template)
    if any(m not in df.columns for m in marks):
        return F.lit(template)
    pieces = re.split(r"\{(\w+)\}", template)
    cols = [F.coalesce(quoted(p).cast("string"), F.lit("None")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    return F.concat(*cols)


def match_alerts(events: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    """One row per event and matching rule, with the filled message.

    Rules are code: they become an array of candidate alerts on each event, of
    which the matching ones are kept. No join, no shuffle.
    """
    candidates = []
    for r in rules:
        tests = [F.col("event_type") == r.event_type] + [_condition(events, k, v) for k, v in r.conditions.items()]
        hit = F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))
        candidates.append(
            F.when(
                hit,
                F.struct(
                    F.lit(r.id).alias("rule_id"),
                    F.lit(r.priority).alias("priority"),
                    fill_template(r.name, events).alias("title"),
                    fill_template(r.template, events).alias("message"),
                    F.lit(r.cooldown_minutes).alias("cooldown_minutes"),
                ),
            )
        )
    return events.select("*", F.inline(F.filter(F.array(*candidates), lambda c: c.isNotNull())))


def alert_stats(messages: DataFrame) -> DataFrame:
    """Message counts by rule, priority and status."""
    rows = messages.groupingSets([["rule_id"], ["priority"], ["status"], []], "rule_id", "priority", "status").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("messages")
    )
    kind = F.when(F.col("g") == 3, "rule").when(F.col("g") == 5, "priority").when(F.col("g") == 6, "status").otherwise("total")
    return rows.select(kind.alias("kind"), F.coalesce("rule_id", "priority", "status", F.lit("*")).alias("value"), "messages")

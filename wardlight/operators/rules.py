"""Collections of waste records: identity, content and severity rules, as specs of columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import scalars as S


@dataclass(frozen=True)
class Collection:
    """What makes a record of a collection, and how bad it is; ``severity`` gets whether the record changed."""

    name: str
    identity: tuple[str, ...]
    content: tuple[str, ...]
    label: Callable[[], Column]
    detail: Callable[[], Column]
    date: Callable[[], Column]
    severity: Callable[[Column], Column]
    doc_type: Callable[[], Column]
    risk: str


def _upper_has(column: str, *words: str) -> Column:
    return F.upper(F.coalesce(F.col(column), F.lit(""))).rlike("|".join(words))


def quarterly_report() -> Collection:
    return Collection(
        "quarterly_reports",
        ("site", "period"),
        ("exceedence",),
        lambda: F.concat(F.lit("Quarterly report "), F.col("period")),
        lambda: F.concat(F.lit("Exceedance: "), S.first_filled("exceedence")),
        lambda: S.us_date_to_iso("received"),
        lambda changed: F.when(F.lower(S.first_filled("exceedence")) == "yes", "notable").otherwise("watch"),
        lambda: F.lit("evidence"),
        "R5",
    )


def application() -> Collection:
    permit = "CONSTRUCTION PERMIT"
    return Collection(
        "applications",
        ("site", "application"),
        ("type", "status"),
        lambda: S.first_filled("type"),
        lambda: S.first_filled("status"),
        lambda: S.us_date_to_iso("received"),
        lambda changed: F.when(_upper_has("type", permit), "urgent").otherwise("notable"),
        lambda: F.when(_upper_has("type", permit), "evidence").otherwise("procedural"),
        "R1",
    )


def annual_report(floor: float = 3.0) -> Collection:
    years = "try_cast(coalesce(nullif(trim(years_end), ''), nullif(trim(years_start), '')) as double)"
    return Collection(
        "annual_reports",
        ("site", "year"),
        ("years_start", "years_end"),
        lambda: F.concat(F.lit("Annual report "), F.col("year")),
        lambda: F.concat(F.lit("Years left: "), S.first_filled("years_end", "years_start")),
        lambda: F.concat(F.col("year"), F.lit("-12-31")),
        lambda changed: F.when(F.expr(years) < floor, "notable").otherwise("watch"),
        lambda: F.lit("evidence"),
        "R1",
    )


def evaluation() -> Collection:
    return Collection(
        "evaluations",
        ("site", "evaluation"),
        ("kind",),
        lambda: F.concat(F.lit("Evaluation "), F.col("evaluation")),
        lambda: S.first_filled("kind"),
        lambda: S.us_date_to_iso("received"),
        lambda changed: F.lit("watch"),
        lambda: F.lit("procedural"),
        "R2",
    )


def compliance_action() -> Collection:
    # Words of settled and of adverse actions.
    settled = ("PAID", "RESOLVED", "CLOSED", "WITHDRAWN", "RESCIND")
    adverse = ("VIOLATION", "PENALTY DEMAND", "COMPLIANCE ORDER", "CONSENT", "CIVIL", "CRIMINAL", "ENFORCEMENT", "FINAL MONETARY")
    return Collection(
        "compliance_actions",
        ("site", "action", "type"),
        ("response",),
        lambda: S.first_filled("type"),
        lambda: F.concat(F.lit("Response: "), S.first_filled("response")),
        lambda: S.us_date_to_iso("received"),
        lambda changed: F.when(_upper_has("type", *settled), "watch").when(_upper_has("type", *adverse), F.when(changed, "notable").otherwise("urgent")).otherwise("notable"),
        lambda: F.when(_upper_has("type", *settled), "procedural").when(_upper_has("type", *adverse), "evidence").otherwise("procedural"),
        "R2",
    )


def events(df: DataFrame, spec: Collection, changed: Column, kind: Column) -> DataFrame:
    """Each record of a collection as an event with label, detail, date, severity, type and risk."""
    named = df.where(F.concat_ws("", *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in spec.identity]) != "")
    return named.select(
        F.lit(spec.name).alias("collection"),
        S.identity_key(*spec.identity).alias("identity"),
        S.content_hash(*spec.content).alias("hash"),
        spec.label().alias("label"),
        spec.detail().alias("detail"),
        spec.date().alias("date"),
        spec.severity(changed).alias("severity"),
        spec.doc_type().alias("doc_type"),
        F.lit(spec.risk).alias("risk"),
        kind.alias("kind"),
    )


def against_seen(df: DataFrame, spec: Collection, seen: DataFrame) -> DataFrame:
    """Events of new and changed records only; ``seen`` has collection, identity and hash."""
    before = seen.where(F.col("collection") == spec.name).select(F.col("identity").alias("_i"), F.col("hash").alias("_h"))
    keyed = df.withColumns({"_key": S.identity_key(*spec.identity), "_now": S.content_hash(*spec.content)}).join(before, F.col("_key") == F.col("_i"), "left")
    moved = keyed.where(F.col("_h").isNull() | (F.col("_h") != F.col("_now")))
    return events(moved, spec, F.col("_h").isNotNull(), F.when(F.col("_h").isNull(), "new").otherwise("changed"))


def historical(frames: Sequence[tuple[DataFrame, Collection]], loaded: DataFrame) -> DataFrame:
    """One event for each present record of the collections that weren't loaded before, by the live rules."""
    parts = [events(df, spec, F.lit(False), F.lit("historical")) for df, spec in frames]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(loaded.select("collection").distinct(), "collection", "left_anti")

"""Facade: one loaded cluster (or many, with ``cluster_id``) and every question about it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight import config
from innsight.functions.frames import CLUSTER, natural_key, scope, stage
from innsight.operators import (
    benchmark,
    changepoint,
    decisions,
    intervention,
    labels,
    market,
    search,
    spatial,
    units,
)
from innsight.sources import locations as places
from innsight.sources import reviews as sources
from innsight.sources import sinks


def mentions_synthetic(path: str) -> bool:
    return "synthetic" in str(path).lower()


@dataclass
class Cluster:
    """Lazy frames over one data set; shared tables are built once and staged."""

    reviews: DataFrame
    mentions: DataFrame
    is_synthetic: bool = False
    source_name: str = ""
    locations: DataFrame | None = None
    aspects: dict[str, list[str]] = field(default_factory=lambda: config.ASPECTS)
    permutations: int = config.NEIGHBOURHOOD_PERMUTATIONS
    label: Callable[[DataFrame], DataFrame] | None = None
    _tables: dict = field(default_factory=dict, repr=False)

    def _once(self, name: str, build):
        if name not in self._tables:
            self._tables[name] = build()
        return self._tables[name]

    # -- shared tables --
    def cells(self) -> DataFrame:
        return self._once("cells", lambda: stage(
            units.unit_cells(units.review_units(self.mentions)), "cells"))

    def monthly(self) -> DataFrame:
        return self._once("monthly", lambda: stage(units.monthly_sums(self.cells()), "monthly"))

    def mention_months(self) -> DataFrame:
        return self._once("mention_months", lambda: stage(
            units.mention_months(self.mentions), "mention-months"))

    def _changepoints(self) -> DataFrame:
        return self._once("changepoints", lambda: stage(
            changepoint.detect_changepoints(self.monthly()), "changepoints"))

    def _market(self) -> tuple[DataFrame, DataFrame]:
        return self._once("market", lambda: market.market_findings(self.monthly()))

    def _hoods(self) -> tuple[DataFrame | None, DataFrame | None]:
        if self.locations is None:
            return None, None
        return self._once("hoods", lambda: spatial.neighbourhood_findings(
            self.monthly(), self.locations, permutations=self.permutations))

    # -- lookups --
    def list_properties(self) -> DataFrame:
        return units.list_properties(self.reviews)

    def list_aspects(self) -> list[str]:
        return list(self.aspects)

    def date_range(self) -> DataFrame:
        return units.date_range(self.reviews)

    def _check(self, property_id: str | None, aspect: str | None) -> None:
        if aspect is not None and aspect not in self.aspects:
            raise ValueError(f"Unknown aspect {aspect!r}. Valid: {list(self.aspects)}")
        if property_id is not None and self.reviews.where(
                F.col("property_id") == property_id).isEmpty():
            raise ValueError(f"Unknown property_id {property_id!r}")

    # -- analyses --
    def property_scorecard(self, property_id: str) -> DataFrame:
        self._check(property_id, None)
        return benchmark.scorecard(self.cells(), property_id, list(self.aspects))

    def benchmark(self) -> DataFrame:
        return self._once("bench", lambda: stage(
            benchmark.benchmark_vs_cluster(self.cells()), "benchmark"))

    def cluster_matrix(self) -> DataFrame:
        return units.cluster_matrix(self.mentions, list(self.aspects))

    def trend(self, property_id: str | None = None, aspect: str | None = None) -> DataFrame:
        self._check(property_id, aspect)
        return units.trend(self.mentions, property_id, aspect)

    def changepoints(self, property_id: str | None = None,
                     aspect: str | None = None) -> DataFrame:
        """Filtered after the q-values, which always span every series."""
        self._check(property_id, aspect)
        rows = self._changepoints()
        if property_id is not None:
            rows = rows.where(F.col("property_id") == property_id)
        return rows if aspect is None else rows.where(F.col("aspect") == aspect)

    def market_patterns(self) -> DataFrame:
        return market.market_patterns(*self._market())

    def seasonal_dips(self, month: int | None = None) -> DataFrame:
        return market.seasonal_dips(self._market()[1], month)

    def property_locations(self) -> DataFrame | None:
        if self.locations is None:
            return None
        return self.locations.select(*scope(self.locations), *places.LOCATION_COLUMNS).orderBy(
            natural_key(F.col("property_id")))

    def neighbourhoods(self) -> DataFrame | None:
        findings, members = self._hoods()
        return None if findings is None else spatial.neighbourhood_table(findings, members)

    def market_scope(self) -> DataFrame:
        return self._once("scope", lambda: stage(decisions.market_scope(
            self.monthly(), self._changepoints(), *self._market(), *self._hoods()), "scope"))

    def destination_summary(self) -> DataFrame:
        return decisions.destination_summary(self.mention_months(), self.market_scope())

    def all_priorities(self, top_n: int = 5) -> DataFrame:
        return decisions.priority_actions(self.mention_months(), self.cells(), self.monthly(),
                                          *self._hoods(), top_n=top_n)

    def priority_actions(self, property_id: str, top_n: int = 5) -> DataFrame:
        self._check(property_id, None)
        return self.all_priorities(top_n).where(F.col("property_id") == property_id).orderBy(
            "rank").select(*decisions.PRIORITY_COLUMNS)

    def intervention_check(self, property_id: str, aspect: str, start: str,
                           baseline_start: str | None = None) -> DataFrame:
        self._check(property_id, aspect)
        lo, hi = self.reviews.agg(F.date_format(F.min("date"), "yyyy-MM"),
                                  F.date_format(F.max("date"), "yyyy-MM")).first()
        if not re.match(r"^\d{4}-\d{2}", str(start)):
            raise ValueError(f"Not a date or month: {start!r} (use e.g. '2025-06')")
        if not lo < start[:7] <= hi:
            raise ValueError(f"start {start} must be after the first month of data ({lo}) and "
                             f"no later than the last ({hi})")
        return intervention.intervention_check(self.monthly(), property_id, aspect, start,
                                               baseline_start)

    def fix_check_grid(self) -> DataFrame:
        return intervention.fix_check_grid(self.monthly())

    def search_reviews(self, **filters) -> DataFrame:
        """Only the reviews that the filters leave are labelled."""
        self._check(filters.get("property_id"), filters.get("aspect"))
        return search.search_reviews(self.reviews, self.label or self.mentions, **filters)

    def classify_text(self, text: str | None) -> DataFrame:
        return labels.classify_text(self.reviews.sparkSession, text, self.aspects)

    # -- export --
    def export_snapshot(self, folder: str, fix_checks: bool = False) -> list[str]:
        """Every table of the static site as JSON, published together with their meta data."""
        destination = self.destination_summary()
        tables = {
            "scorecards": self.benchmark(), "priorities": self.all_priorities(),
            "trends": self.trend(), "changepoints": self.changepoints(),
            "market_scope": self.market_scope(), "destination_summary": destination,
            "market_headline": decisions.market_headline(destination),
            "reviews": self.reviews, "mentions": self.mentions,
        }
        if self.locations is not None:
            tables["locations"] = sinks.public_locations(self.locations, self.is_synthetic)
            tables["neighbourhoods"] = self.neighbourhoods()
        if fix_checks:
            tables["fix_checks"] = self.fix_check_grid()
        tables["properties"] = self.list_properties()
        return sinks.write_snapshot(tables, folder, {
            "is_synthetic": self.is_synthetic, "source_name": self.source_name, "aspects": self.list_aspects(),
            "generated_at": datetime.now(UTC).isoformat(timespec="seconds"), "locations_exact": self.is_synthetic})


def cluster_from_reviews(reviews: DataFrame, locations: DataFrame | None = None,
                         aspects: dict[str, list[str]] | None = None,
                         lexicon: dict[str, list[str]] | None = None,
                         scorer: labels.BatchScorer | None = None, **info) -> Cluster:
    """Label validated reviews and wrap them. ``scorer`` switches to model sentiment."""
    aspects = aspects or config.ASPECTS

    def label(rows: DataFrame) -> DataFrame:
        return (labels.label_with_model(rows, scorer, aspects) if scorer is not None
                else labels.label_reviews(rows, aspects, lexicon))

    return Cluster(reviews, label(reviews), locations=locations, aspects=aspects, label=label, **info)


def load_cluster(spark: SparkSession, path: str, locations: str | DataFrame | None = None,
                 multiline: bool = True, **options) -> Cluster:
    """Load, validate, identify and label a review file or a folder of them.

    A ``cluster_id`` column makes it many clusters, each judged by itself.
    """
    path = str(path)
    single = path.lower().endswith(sources.SUFFIXES)
    read = sources.load_reviews if single else sources.load_dir
    raw = read(spark, path, multiline)
    names = [path] if single else [path, *sources.list_files(spark, path)]
    ready = sources.normalise_property_ids(sources.with_review_ids(
        raw.select(*[c for c in [*config.REQUIRED_COLUMNS, *config.OPTIONAL_COLUMNS, CLUSTER]
                     if c in raw.columns])))
    placed = None
    if locations is not None:
        known = ready.select("property_id").distinct()
        placed = (places.load_locations(spark, locations, known) if isinstance(locations, str)
                  else places.validate_locations(locations, known))
    return cluster_from_reviews(
        ready, placed, is_synthetic=any(map(mentions_synthetic, names)),
        source_name=path.rstrip("/").rsplit("/", 1)[-1], **options)

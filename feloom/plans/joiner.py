"""Feature joins from a configuration: sources to domains to one table per entity."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import expand
from ..operators import domains, joins, pipelines
from ..operators.projections import SourceConfig, prepare_source, replace_nan_inf
from ..sources.checkpoints import check_unique, stage_and_gate


@dataclass
class Domain:
    """A named set of features: its sources, the rule that joins them and the layout."""

    name: str
    layout: str
    sources: dict[str, SourceConfig]
    rule: str = ""
    features: list[str] = field(default_factory=list)
    extra: str | None = None
    options: dict = field(default_factory=dict)
    aggregation: dict = field(default_factory=dict)


@dataclass
class JoinerConfig:
    domains: list[Domain]
    rule: str = ""
    keys: list[str] = field(default_factory=lambda: ["uid", "uid_type"])
    match_in: list[str] = field(default_factory=list)
    match_out: str | None = None
    min_rows: int = 0
    final: list[str] = field(default_factory=list)


def config_from_json(text: str, encoded: bool = False) -> JoinerConfig:
    """A configuration from JSON, or from JSON in base64."""
    raw = json.loads(base64.b64decode(text) if encoded else text)
    made = [Domain(**{**d, "sources": {n: SourceConfig(**s) for n, s in d["sources"].items()}}) for d in raw.pop("domains")]
    return JoinerConfig(domains=made, **raw)


def domain_source(domain: Domain, tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The prepared sources of a domain, joined; ``features`` are SQL over ``source.column``."""
    frames = {n: prepare_source(tables[n], cfg) for n, cfg in domain.sources.items()}
    if not domain.features:
        return joins.join_with_aliases(frames, domain.rule, keys)
    packed = {n: domains.source_struct(df, n, keys) for n, df in frames.items()}
    joined = joins.join_by_rule(packed, domain.rule, keys)
    return joined.select(*keys, *[F.expr(expand(e, joined)) for e in domain.features])


def build(config: JoinerConfig, tables: dict[str, DataFrame], cross: DataFrame | None = None, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All domains joined by rule; with ``match_out`` ids are matched and domains aggregated per id."""
    keys = config.keys
    made = {}
    for d in config.domains:
        source = domain_source(d, tables, keys)
        made[d.name] = domains.build_domain(source, d.name, d.layout, d.extra, keys=tuple(keys), **d.options)
    joined = joins.join_by_rule(made, config.rule, keys, checkpoint)
    if config.match_out:
        matched = joins.match_uids(joined, cross, config.match_in, config.match_out)
        aggregation = {}
        for d in config.domains:
            for c in (c for c in joined.columns if c == d.name or c.startswith(f"{d.name}_")):
                aggregation[c] = d.aggregation
        joined = pipelines.aggregate_columns(matched, aggregation, keys)
    return joined.selectExpr(*config.final) if config.final else joined


def run(config: JoinerConfig, tables: dict[str, DataFrame], staging: str, cross: DataFrame | None = None) -> DataFrame:
    """Build, stage, and require row count and unique keys."""
    staged = stage_and_gate(build(config, tables, cross), staging, config.min_rows)
    check_unique(staged, config.keys)
    return staged


def join_features(source: DataFrame, *, dimensions: list[dict] | None = None, uids: dict[str, str] | None = None, cross: DataFrame | None = None, in_types: list[str] | None = None, out_type: str | None = None, grouping: dict[str, str] | None = None, keys: tuple[str, ...] = ("uid", "uid_type")) -> DataFrame:
    """The newer preparation of a source: dimensions, one row per id, matching, then SQL aggregates per id."""
    df = replace_nan_inf(source)
    for d in dimensions or []:
        df = joins.dimension_join(df, **d)
    if uids:
        df = domains.explode_uids(df, uids)
    if out_type:
        df = joins.match_uids_split(df, cross, in_types or [], out_type)
    if grouping:
        df = df.groupBy(*keys).agg(*[F.expr(expand(e, df)).alias(n) for n, e in grouping.items()])
    return df

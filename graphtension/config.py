"""Engine settings: one frozen dataclass, checked on construction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

from graphtension.errors import InvalidConfig

ColumnFunc = Callable[..., Column]


@dataclass(frozen=True)
class Config:
    """All knobs of the engine.

    ``weight_func`` and ``node_type_func`` map Columns to a Column, so they stay in generated code.
    ``threshold_func(node_id, tension)`` overrides the calibrator, which overrides ``threshold``.
    Realtime checks look at the overlay only unless ``realtime_scope`` is ``unified``. A stream hands the engine at
    most ``channel_size`` events at once. ``topology(nodes, edges)`` gives a frame that analyses carry. Nodes of fewer
    than ``min_degree`` edges are never anomalies. An event of weight 0 (or none) gets ``default_weight``; None leaves
    it as it is.
    """

    divergence: Any = "jsd"
    curvature_alpha: float = 0.0
    curvature_func: Any = None
    detectability_alpha: float = 0.05
    threshold: float = 0.2
    threshold_func: ColumnFunc | None = None
    weight_func: ColumnFunc | None = None
    node_type_func: ColumnFunc | None = None
    aggregation: str | Callable = "mean"
    topology: Callable | None = None
    gc_snapshot_warning_s: float = 300.0
    gc_snapshot_force_s: float = 900.0
    compaction_strategy: str = "volume"
    compaction_threshold: int = 10_000
    compaction_interval_s: float = 0.0
    concealment_lambda: float = 0.0
    concealment_hops: int = 0
    temporal_capacity: int = 100
    diffusivity_alpha: float = 0.1
    tension_spike_threshold: float = 0.3
    channel_size: int = 10_000
    upkeep_s: float = 60.0
    min_degree: int = 0
    cache_ttl_s: float | None = None
    base_graph: Any = None
    storage: Any = None
    calibrator: Any = None
    logger: Any = None
    realtime_scope: str = "overlay"
    callbacks: dict[str, Callable] = field(default_factory=dict)
    default_weight: float | None = 1.0

    def __post_init__(self) -> None:
        if self.curvature_func is not None and self.curvature_alpha == 0:
            object.__setattr__(self, "curvature_alpha", 0.5)
        if self.cache_ttl_s is not None and self.cache_ttl_s <= 0:
            object.__setattr__(self, "cache_ttl_s", 60.0)
        rules = {
            "threshold must not be negative": self.threshold >= 0,
            "forced snapshot closing must not come before its warning": not (self.gc_snapshot_force_s > 0 and self.gc_snapshot_warning_s > 0) or self.gc_snapshot_force_s >= self.gc_snapshot_warning_s,
            "default_weight must not be negative": self.default_weight is None or self.default_weight >= 0,
            "channel_size must be positive": self.channel_size > 0,
            "detectability_alpha must lie between 0 and 1": 0 < self.detectability_alpha < 1,
            "concealment_lambda must not be negative": self.concealment_lambda >= 0,
            "concealment_hops must not be negative": self.concealment_hops >= 0,
            "compaction_strategy is volume, time or manual": self.compaction_strategy in ("volume", "time", "manual"),
            "realtime_scope is overlay or unified": self.realtime_scope in ("overlay", "unified"),
        }
        for said, holds in rules.items():
            if not holds:
                raise InvalidConfig(said)

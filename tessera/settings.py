"""Settings of the harmonization plans (production values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    described_columns: int = 60
    described_values: int = 10
    description_waves: int = 4
    max_enum: int = 120
    cluster_threshold: float = 0.56
    batches_per_cluster: int = 6
    max_clusters: int = 40
    noise_fraction: float = 0.22
    noise_count: int = 4
    suffix_count: int = 2
    columns_per_field: int = 30

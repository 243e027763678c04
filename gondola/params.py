"""Tunable limits of the jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    promo_min_market_ratio: float = 0.519
    promo_max_unverified_pct: float = 50.0
    promo_max_market_pct: float = 70.0
    promo_min_pct: float = 10.0
    promo_min_verified: int = 10_000
    max_dates_per_run: int = 4
    min_paired_products: int = 10
    relative_low: float = 0.5
    relative_high: float = 2.0
    credible_low: float = 0.5
    credible_high: float = 2.0
    agreement_tolerance: float = 0.10
    min_reference_companies: int = 3
    carry_days: int = 2
    min_change_pct: float = 3.0
    change_days: int = 30
    price_epsilon: float = 0.005
    min_samples_chain: int = 20
    min_samples_locality: int = 10
    min_samples_store: int = 3
    min_offered: int = 20
    min_market_companies: int = 3
    min_category_products: int = 20
    min_extreme_stores: int = 3
    min_highlight_companies: int = 3
    min_level_products: int = 5
    min_rule_products: int = 100
    equal_tolerance: float = 0.003
    near_km: float = 3.0
    near_store_km: float = 50.0
    few_promos_per_store: float = 50.0
    # Fixed values of the taxonomy.
    per_piece_categories: tuple[str, ...] = ("Huevos", "Panales", "Higiene bebe", "Descartables")
    pharmacy_sections: tuple[str, ...] = ("Higiene", "Bebes")


DEFAULTS = Params()

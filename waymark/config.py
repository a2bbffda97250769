"""Every threshold in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    stay_radius_m: float = 300.0
    drift_kmh: float = 1.5
    max_gap_s: int = 90 * 60
    min_stay_s: int = 10 * 60
    min_photos: int = 5
    max_absence_s: int = 8 * 3600
    anchor_radius_m: float = 500.0
    anchor_min_visits: int = 5
    anchor_saturation: int = 4
    night_hours: tuple[int, int] = (20, 6)
    working_hours: tuple[int, int] = (10, 17)
    report_radius_m: float = 500.0
    place_radius_m: float = 150.0
    highlights: int = 5
    early_hour: int = 9
    trip_away_m: float = 50_000.0
    trip_gap_s: int = 36 * 3600
    regular_visits: int = 3
    regular_span_days: int = 30
    ambient_share: float = 0.25
    ambient_min_readings: int = 8
    subject_score_half: float = 2.0
    subject_confidence_half: float = 4.0
    span_half_days: float = 30.0
    evidence_cap: int = 10
    min_members: int = 2
    screen_min_count: int = 2
    screen_evidence_cap: int = 5
    screen_full: int = 8
    trend_span_days: int = 14
    trend_delta: float = 0.05
    enduring_strength: float = 0.6
    insight_evidence_cap: int = 6
    feed_limit: int = 10
    importance_full: int = 6
    mixed_limit: int = 3
    compare_refs: int = 3
    suggestion_cap: int = 5
    overdue_factor: int = 2
    suggestion_full: int = 6
    min_seen: int = 2
    quiet_days: int = 180
    day_trip_max_visits: int = 2
    day_trip_min_km: float = 1.0
    day_trip_cap: int = 3
    neighbour_km: float = 2.0
    reach_share: float = 0.8
    drift_months: int = 4
    persistent_months: int = 3
    alignment: float = 0.6
    drift_sigma: float = 1.5
    rrf_k: int = 60
    depth: int = 30
    filtered_depth: int = 300
    supporting: int = 3
    place_facts: int = 3
    insight_facts: int = 8
    nearby_m: float = 500.0
    nearby_quotes: int = 2
    name_within_m: float = 25_000.0
    trips_shown: int = 15
    keep_profiles: int = 12
    answer_limit: int = 8
    subject_facts: int = 8
    ask_reach_m: float = 30_000.0
    coverage_half: float = 2.0
    theme_strong: float = 0.75
    theme_weak: float = 0.60
    theme_shared: float = 0.5
    blur_decimals: int = 2
    name_radius_m: float = 25_000.0
    gazetteer_grid: float = 0.5


DEFAULT = Settings()

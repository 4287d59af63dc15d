"""Every threshold that changes a result, with its default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    max_upload_bytes: int = 100 * 1024 * 1024
    max_pages: int = 1000
    lease_seconds: int = 900
    max_attempts: int = 3
    result_ttl_hours: int = 0
    mode: str = "balanced"
    rows_per_strip: int = 22
    rows_per_strip_raster: int = 11
    max_strips: int = 24
    strip_overlap: float = 0.04
    raster_area: float = 0.25
    router_min_rows: int = 3
    router_min_cols: int = 2
    router_min_short_lines: int = 30
    router_max_line: int = 45
    ground_identifiers: bool = True
    ground_numbers: bool = False
    identifier_similarity: float = 0.62
    identifier_margin: float = 0.08
    max_nest_depth: int = 3
    currency: str = "AUD"
    locale_hint: str = ""
    locale_agreement: float = 0.8
    suppress_min_rows: int = 3
    suppress_min_cols: int = 2
    suppress_list_rows: int = 10
    furniture_pages: int = 3
    header_conflict: float = 0.95
    signature_agreement: float = 0.75
    merge_similarity: float = 0.85
    row_similarity: float = 0.9
    max_warnings: int = 50


DEFAULTS = Settings()

"""The parameters of a run."""

from __future__ import annotations

import os
from dataclasses import dataclass

CONCURRENCY = min(64, max(16, 6 * (os.cpu_count() or 1)))
PER_ORIGIN = min(CONCURRENCY, 8)


@dataclass(frozen=True)
class Config:
    seed_url: str = ""
    out_dir: str = ""
    max: int = 50
    max_explicit: bool = False
    concurrency: int = CONCURRENCY
    per_origin: int = PER_ORIGIN
    clean: bool = False
    dry_run: bool = False
    agent_files: bool = False
    page_only: bool = False
    ignore_robots: bool = False
    user_agent: str = "Mozilla/5.0 (compatible; driftloom/0.1)"
    timeout_ms: int = 10_000
    max_bytes: int = 12 << 20
    retry_http: bool = True
    fail_on_low_quality: bool = False
    json: bool = False
    quiet: bool = False

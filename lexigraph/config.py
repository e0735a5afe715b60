"""Settings from the environment and an optional file of KEY=VALUE lines; the environment wins."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


def read_settings(path: str | Path = ".env") -> dict[str, str]:
    """Blank lines and comments are skipped, matching quotes around values removed."""
    file, found = Path(path), {}
    for line in map(str.strip, file.read_text(encoding="utf-8").splitlines() if file.exists() else []):
        name, equals, value = line.partition("=")
        if equals and not line.startswith("#"):
            found.setdefault(name.strip(), value.strip().strip('"').strip("'"))
    return found


@dataclass(frozen=True)
class EngineConfig:
    """The defaults of crawling and scheduling."""

    seed_url: str = ""
    allowed_domain: str = ""
    user_agent: str = "lexigraph/1.0"
    crawl_delay_seconds: float = 2.0
    request_timeout_seconds: int = 20
    max_listing_pages: int = 5
    max_profile_pages: int = 10
    max_publications: int = 25
    scheduler_interval_days: float = 7
    store: str | None = None

    @classmethod
    def from_env(cls, path: str | Path = ".env") -> "EngineConfig":
        held = read_settings(path) | os.environ
        values = {}
        for name, kind in (("seed_url", str), ("allowed_domain", str), ("user_agent", str), ("crawl_delay_seconds", float), ("request_timeout_seconds", int), ("max_listing_pages", int), ("max_profile_pages", int), ("max_publications", int), ("scheduler_interval_days", float), ("store", str)):
            key = f"LEXIGRAPH_{name.upper()}"
            if key in held:
                values[name] = kind(held[key])
        return cls(**values)

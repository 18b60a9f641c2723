"""Settings from the environment, checked once."""

from __future__ import annotations

import hmac
import json
import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    max_file_size_mb: int = 20
    max_pages: int = 100
    max_ai_tokens_per_check: int = 60_000
    max_checks_per_day: int = 20
    max_active_checks: int = 2
    file_retention_hours: int = 24
    report_retention_hours: int = 168
    result_retention_days: int = 30
    max_archive_parts: int = 2000
    max_uncompressed_mb: int = 100
    max_archive_part_mb: int = 32
    max_compression_ratio: int = 200
    job_timeout_seconds: int = 900
    worker_max_jobs: int = 2
    max_job_attempts: int = 3
    llm_timeout_seconds: int = 60
    llm_analysis_timeout_seconds: int = 600
    llm_max_retries: int = 3
    llm_max_output_tokens: int = 2000
    api_tokens: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for f in fields(self):
            if isinstance(v := getattr(self, f.name), int) and v <= 0:
                raise ValueError(f"{f.name} must be greater than 0")
        if any(len(t) < 32 for t in self.api_tokens):
            raise ValueError("API tokens need 32 characters or more")

    def owner(self, token: str | None) -> int | None:
        """The user of a bearer token, compared in constant time; None if there is none (SEC6)."""
        found = None
        for known, user in self.api_tokens.items():
            if hmac.compare_digest(known.encode(), (token or "").encode()):
                found = user
        return found

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        given = {f.name: env[f.name.upper()] for f in fields(cls) if f.name.upper() in env}
        return cls(**{k: json.loads(v) for k, v in given.items()})

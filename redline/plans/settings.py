"""Settings from the environment; unusable values fall back to their defaults."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    api_key: str = ""
    model: str = ""
    temperature: float = 0.2
    max_output_tokens: int = 8192
    request_delay_seconds: float = 2.0
    max_retries: int = 3
    retry_backoff_base_seconds: float = 2.0

    def backoff(self, attempt: int) -> float:
        """Seconds to wait after a failed attempt; a zero delay turns waiting off."""
        if self.request_delay_seconds <= 0:
            return 0.0
        return self.retry_backoff_base_seconds * 2 ** (attempt - 1)

    def require_api_key(self) -> str:
        if not self.api_key:
            raise RuntimeError("MODEL_API_KEY is not set")
        return self.api_key


_LEAST = {
    "temperature": 0.0, "max_output_tokens": 1, "request_delay_seconds": 0.0,
    "max_retries": 1, "retry_backoff_base_seconds": 0.0,
}
_VARIABLES = {
    "api_key": "MODEL_API_KEY", "model": "MODEL_NAME", "temperature": "MODEL_TEMPERATURE",
    "max_output_tokens": "MODEL_MAX_OUTPUT_TOKENS",
    "request_delay_seconds": "REQUEST_DELAY_SECONDS", "max_retries": "MAX_RETRIES",
    "retry_backoff_base_seconds": "RETRY_BACKOFF_BASE_SECONDS",
}


def load(env: Mapping[str, str] | None = None) -> Settings:
    env = os.environ if env is None else env
    values = {}
    for name, variable in _VARIABLES.items():
        default = getattr(Settings, name)
        raw = str(env.get(variable) or "").strip()
        if not raw:
            continue
        kind: Callable = type(default)
        try:
            value = kind(raw)
        except ValueError:
            continue
        if name not in _LEAST or value >= _LEAST[name]:
            values[name] = value
    return Settings(**values)

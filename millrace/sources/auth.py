"""Who a connector is (H5, H6): headers of the four kinds of auth, and where tokens are kept."""

from __future__ import annotations

import base64
import json
import os
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol


@dataclass
class Tokens:
    access: str
    refresh: str | None = None
    expires_at: float | None = None

    def stale(self, now: float, margin: float = 60.0) -> bool:
        return self.expires_at is not None and now >= self.expires_at - margin


class TokenStore(Protocol):
    def get(self, key: str) -> Tokens | None: ...

    def put(self, key: str, tokens: Tokens) -> None: ...


@dataclass
class MemoryTokens:
    held: dict[str, Tokens] = field(default_factory=dict)

    def get(self, key: str) -> Tokens | None:
        return self.held.get(key)

    def put(self, key: str, tokens: Tokens) -> None:
        self.held[key] = tokens


@dataclass
class FileTokens:
    """One JSON file, readable by its owner only; a corrupt or missing one is empty."""

    path: str

    def _all(self) -> dict:
        try:
            with open(self.path) as f:
                got = json.load(f)
            return got if isinstance(got, dict) else {}
        except (OSError, ValueError):
            return {}

    def get(self, key: str) -> Tokens | None:
        got = self._all().get(key)
        return Tokens(**got) if got else None

    def put(self, key: str, tokens: Tokens) -> None:
        new = self._all() | {key: tokens.__dict__}
        part = self.path + ".part"
        with os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            json.dump(new, f)
        os.replace(part, self.path)


@dataclass
class OAuth2:
    """Access tokens from a store, refreshed when stale or refused; threads that need a new
    one at once wait for one refresh."""

    key: str
    store: TokenStore
    refresh: Callable[[Tokens], Tokens]
    clock: Callable[[], float] = time.time
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def __call__(self, refused: bool = False) -> str:
        had = self.store.get(self.key)
        if had is None:
            raise LookupError(f"no token for {self.key}")
        if not refused and not had.stale(self.clock()):
            return had.access
        with self._lock:
            now = self.store.get(self.key) or had
            if now.access == had.access:
                now = self.refresh(had)
                self.store.put(self.key, now)
        return now.access


def headers(kind: str, **given: str) -> dict[str, str]:
    """Static headers: bearer (token), basic (user, password), api_key (name, value), none."""
    if kind == "bearer":
        return {"Authorization": f"Bearer {given['token']}"}
    if kind == "basic":
        return {"Authorization": "Basic " + base64.b64encode(f"{given['user']}:{given['password']}".encode()).decode()}
    if kind == "api_key":
        return {given.get("name", "X-API-Key"): given["value"]}
    if kind == "none":
        return {}
    raise ValueError(f"unknown auth: {kind}")


def from_environment(text: str, env: dict[str, str] | None = None) -> str:
    """$NAME, ${NAME} and ${NAME:-default} by the environment; an unset one without a
    default is empty."""
    env = os.environ if env is None else env
    return re.sub(r"\$(?:\{(\w+)(?::-([^}]*))?\}|(\w+))", lambda m: env.get(m[1] or m[3]) or m[2] or "", text)

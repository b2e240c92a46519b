"""What a connector needs around a request (H1-H6): backoff, retry, rate limit, breaker.

These run where requests run, in a reader's task; none of them sees DataFrames."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Backoff:
    """H2: delay before try n + 1, in ms: exponential, linear or constant, with jitter of
    up to a tenth, capped."""

    initial: int = 1000
    most: int = 30000
    kind: str = "exponential"
    attempts: int = 3

    def delay(self, n: int, jitter: bool = True) -> float:
        base = {"exponential": self.initial * 2 ** (n - 1), "linear": self.initial * n, "constant": self.initial}[self.kind]
        if jitter:
            base *= 1 + random.uniform(-0.1, 0.1)
        return min(base, self.most)


class BreakerOpen(RuntimeError):
    """A request was refused because its source fails."""


@dataclass
class Breaker:
    """H4: closed -> open at `failures` within `window` s -> half-open after `reset` s ->
    closed after `successes`; a failure while half-open opens it again."""

    failures: int = 5
    window: float = 60.0
    reset: float = 30.0
    successes: int = 2
    state: str = "closed"
    _fails: list[float] = field(default_factory=list)
    _opened: float = 0.0
    _good: int = 0

    def allow(self, now: float) -> bool:
        if self.state == "open" and now - self._opened >= self.reset:
            self.state, self._good = "half-open", 0
        return self.state != "open"

    def success(self, now: float) -> None:
        if self.state == "half-open":
            self._good += 1
            if self._good >= self.successes:
                self.state, self._fails = "closed", []

    def failure(self, now: float) -> None:
        self._fails = [t for t in self._fails if t >= now - self.window] + [now]
        if self.state == "half-open" or (self.state == "closed" and len(self._fails) >= self.failures):
            self.state, self._opened = "open", now


class RateLimited(RuntimeError):
    """The limit is reached and the strategy is to fail."""


@dataclass
class Limiter:
    """H3: waits (pause), spreads (throttle) or fails when a source's limit is reached.
    Limits come from response headers, else from requests per minute."""

    strategy: str = "pause"
    per_minute: int = 60
    longest: float = 300.0
    remaining: int | None = None
    reset_at: float | None = None
    _sent: list[float] = field(default_factory=list)

    def learn(self, headers: dict[str, str], now: float) -> None:
        h = {k.lower(): v for k, v in headers.items()}
        if (left := h.get("x-ratelimit-remaining")) and left.isdigit():
            self.remaining = int(left)
        if (at := h.get("x-ratelimit-reset")) and at.isdigit():
            self.reset_at = float(at) if float(at) > 1e9 else now + float(at)
        if (after := h.get("retry-after")) and after.isdigit():
            self.remaining, self.reset_at = 0, now + float(after)

    def wait(self, now: float) -> float:
        """Seconds to wait before the next request."""
        self._sent = [t for t in self._sent if t > now - 60]
        need = 0.0
        if self.remaining == 0 and self.reset_at and self.reset_at > now:
            need = self.reset_at - now
        elif self.remaining is None and len(self._sent) >= self.per_minute:
            need = self._sent[0] + 60 - now
        elif self.strategy == "throttle" and self.remaining and self.reset_at and self.reset_at > now:
            need = (self.reset_at - now) / self.remaining
        if need and (self.strategy == "fail" or need > self.longest):
            raise RateLimited(f"limit reached for {need:.0f} s")
        return need

    def sent(self, now: float) -> None:
        self._sent.append(now)
        if self.remaining:
            self.remaining -= 1


@dataclass
class Client:
    """H1: JSON over HTTP. 429 waits, 5xx and network errors are tried again, other answers
    are data; a 401 refreshes the token once."""

    base: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    token: Callable[[bool], str] | None = None
    backoff: Backoff = field(default_factory=Backoff)
    breaker: Breaker = field(default_factory=Breaker)
    limiter: Limiter = field(default_factory=Limiter)
    timeout: float = 30.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time
    send: Callable[[str, str, dict, bytes | None, float], tuple[int, dict, bytes]] | None = None

    def request(self, verb: str, path: str, params: dict | None = None, body: object = None) -> object:
        from urllib.parse import urlencode

        url = self.base + path + (f"?{urlencode(params)}" if params else "")
        raw = None if body is None else json.dumps(body).encode()
        fresh = False
        for n in range(1, self.backoff.attempts + 2):
            if not self.breaker.allow(self.clock()):
                raise BreakerOpen(url)
            if need := self.limiter.wait(self.clock()):
                self.sleep(need)
            headers = {"Content-Type": "application/json", **self.headers}
            if self.token:
                headers["Authorization"] = f"Bearer {self.token(fresh)}"
            self.limiter.sent(self.clock())
            last = n > self.backoff.attempts
            try:
                status, got, data = (self.send or _send)(verb, url, headers, raw, self.timeout)
            except OSError:
                self.breaker.failure(self.clock())
                if last:
                    raise
                self.sleep(self.backoff.delay(n) / 1000)
                continue
            self.limiter.learn(got, self.clock())
            if status == 401 and self.token and not fresh and not last:
                fresh = True
                continue
            if status == 429 and not last:
                self.sleep(max(self.limiter.wait(self.clock()), self.backoff.delay(n) / 1000))
                continue
            if status >= 500:
                self.breaker.failure(self.clock())
                if not last:
                    self.sleep(self.backoff.delay(n) / 1000)
                    continue
            else:
                self.breaker.success(self.clock())
            return json.loads(data) if data.strip() else None
        raise RuntimeError("unreachable")


def _send(verb: str, url: str, headers: dict, body: bytes | None, timeout: float) -> tuple[int, dict, bytes]:
    req = urllib.request.Request(url, data=body, headers=headers, method=verb.upper())
    try:
        with urllib.request.urlopen(req, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), e.read()

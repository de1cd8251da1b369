"""Retry with growing pauses, a circuit breaker, and callbacks that can't stop one another."""

from __future__ import annotations

import asyncio
import functools
import inspect
import logging
import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

log = logging.getLogger(__name__)
TRANSIENT = (ConnectionError, TimeoutError, OSError)


def pause(attempt: int, base: float, factor: float, most: float, jitter: float = 0.0) -> float:
    """Seconds before the attempt after this one (counted from 1)."""
    return min(base * factor ** (attempt - 1), most) * (1 + jitter)


def retry(attempts: int = 3, base: float = 1.0, factor: float = 2.0, most: float = 60.0, on: tuple = TRANSIENT, sleep: Callable = time.sleep, chance: Callable = random.random, on_retry: Callable[[int, Exception], None] | None = None):
    """Calls again, after pauses with up to half as much again by chance, on errors that may pass; others pass through.

    on_retry hears of each attempt that failed. Coroutines are awaited; their pauses don't block.
    """

    def told(n: int, x: Exception) -> None:
        if on_retry is not None:
            try:
                on_retry(n, x)
            except Exception:
                log.exception("on_retry failed")

    def wrap(f):
        if inspect.iscoroutinefunction(f):

            @functools.wraps(f)
            async def wait(*a, **k):
                for n in range(1, attempts + 1):
                    try:
                        return await f(*a, **k)
                    except on as x:
                        if n == attempts:
                            raise
                        told(n, x)
                        rest = sleep(pause(n, base, factor, most, chance() / 2)) if sleep is not time.sleep else asyncio.sleep(pause(n, base, factor, most, chance() / 2))
                        if inspect.isawaitable(rest):
                            await rest

            return wait

        @functools.wraps(f)
        def run(*a, **k):
            for n in range(1, attempts + 1):
                try:
                    return f(*a, **k)
                except on as x:
                    if n == attempts:
                        raise
                    told(n, x)
                    sleep(pause(n, base, factor, most, chance() / 2))

        return run

    return wrap


class CircuitOpen(RuntimeError):
    """The circuit is open; the call was not made."""


@dataclass
class CircuitBreaker:
    """Opens after failures in a row within window seconds, lets a single trial through after recovery seconds."""

    failures: int = 5
    recovery: float = 30.0
    window: float = 60.0
    clock: Callable[[], float] = time.monotonic
    state: str = "closed"
    _times: list[float] = field(default_factory=list)
    _opened: float = 0.0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lock"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._lock = threading.Lock()

    def call(self, f: Callable, *a, **k):
        with self._lock:
            now = self.clock()
            if self.state == "half-open" or (self.state == "open" and now - self._opened < self.recovery):
                raise CircuitOpen(self.state)
            if self.state == "open":
                self.state = "half-open"
        try:
            out = f(*a, **k)
        except Exception:
            with self._lock:
                now = self.clock()
                self._times = [t for t in self._times if now - t <= self.window] + [now]
                if self.state == "half-open" or len(self._times) >= self.failures:
                    self.state, self._opened = "open", now
            raise
        with self._lock:
            self.state, self._times = "closed", []
        return out


class Callbacks:
    """Named events go to all listeners as they stand when the event is sent; errors of one are logged and don't stop the others."""

    def __init__(self):
        self._listeners: list[Callable[[str, dict], None]] = []
        self._lock = threading.Lock()

    def add(self, f: Callable[[str, dict], None]) -> None:
        with self._lock:
            self._listeners.append(f)

    def remove(self, f: Callable[[str, dict], None]) -> None:
        with self._lock:
            self._listeners.remove(f)

    def send(self, event: str, **details) -> int:
        """Sends an event; the number of listeners that failed."""
        with self._lock:
            listeners = list(self._listeners)
        failed = 0
        for f in listeners:
            try:
                f(event, details)
            except Exception:
                failed += 1
                log.exception("listener failed on %s", event)
        return failed


class Prompts:
    """Prompt texts by language: one language at a time is shown, English fills what it lacks; a switch is a single step for all readers."""

    def __init__(self, english: dict[str, str]):
        self._languages: dict[str, dict[str, str]] = {"en": dict(english)}
        self._shown, self._name = dict(english), "en"
        self._lock = threading.Lock()

    def register(self, language: str, prompts: dict[str, str]) -> None:
        with self._lock:
            self._languages[language.lower()] = dict(prompts)
            if self._name == language.lower():
                self._shown = self._languages["en"] | self._languages[self._name]

    def switch(self, language: str) -> None:
        with self._lock:
            if language.lower() not in self._languages:
                raise KeyError(language)
            self._name = language.lower()
            self._shown = self._languages["en"] | self._languages[self._name]

    def overlay(self, prompts: dict[str, str]) -> None:
        """Replaces some prompts of the language shown, until the next switch."""
        with self._lock:
            self._shown = self._shown | prompts

    @property
    def language(self) -> str:
        return self._name

    def languages(self) -> list[str]:
        return sorted(self._languages)

    def __getitem__(self, key: str) -> str:
        return self._shown[key]

    def get(self, key: str, other: str | None = None) -> str | None:
        return self._shown.get(key, other)


class Stalled(RuntimeError):
    """A build made no progress, or took too long."""


def watched(query, newest: Callable[[], float], stall: float = 6000.0, total: float = 43_200.0, every: float = 5.0, clock: Callable[[], float] = time.time) -> None:
    """Waits for a query of a stream to end; stops it and raises when nothing was written for stall seconds, or after total seconds.

    newest gives the time of the last write, on the clock.
    """
    began = clock()
    while not query.awaitTermination(every):
        now = clock()
        late = now - max(began, newest()) > stall
        if late or now - began > total:
            query.stop()
            raise Stalled("nothing was written" if late else "it took too long")

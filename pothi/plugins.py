"""Points where outside models and services are plugged in, with offline stand-ins.

The stand-ins are deterministic and serve tests and dry runs; their quality
says nothing about the operators.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """Unit vectors, a row for each text."""


class PairScorer(Protocol):
    def score(self, left: list[str], right: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str | None]: ...


class Detector(Protocol):
    def detect(self, text: str) -> str | None: ...


class PageExtractor(Protocol):
    def pages(self, content: bytes) -> list[str]: ...


@dataclass
class HashingEmbedder:
    """Signed hashing of words by MD5, unit length; an empty text is the zero vector."""

    dimensions: int = 256

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
                out[i, int(h[:8], 16) % self.dimensions] += 1.0 if int(h[8:16], 16) % 2 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


class OverlapScorer:
    """Share of the words of the left text that stand in the right one, from -5 to 5."""

    def score(self, left: list[str], right: list[str]) -> list[float]:
        out = []
        for a, b in zip(left, right, strict=True):
            words, seen = a.lower().split(), set(b.lower().split())
            out.append(10.0 * sum(w in seen for w in words) / len(words) - 5.0 if words else -5.0)
        return out


class FirstWords:
    """A generator that answers with the first words of the first passage of a prompt, or with the last ones of its question."""

    def __init__(self, words: int = 12) -> None:
        self.words = words

    def generate(self, prompts: list[str]) -> list[str | None]:
        out = []
        for prompt in prompts:
            asked = prompt.rpartition("Question: ")[2].rpartition("\nAnswer:")[0]
            before, found, after = prompt.rpartition("Passage 1:\n")
            passage = after.partition("\n\n")[0] if found and before else None
            out.append(" ".join(asked.split()[-self.words :]) if passage is None else " ".join(passage.split()[: self.words]))
        return out


class LengthVerifier:
    """A verifier that lets prompts of an even length pass, fails the others, and gives nothing for every seventh length."""

    def generate(self, prompts: list[str]) -> list[str | None]:
        return [None if len(p) % 7 == 0 else "PASS" if len(p) % 2 == 0 else "FAIL" for p in prompts]


class ScriptDetector:
    """Language of a text by its script; nothing for a text without letters."""

    def detect(self, text: str) -> str | None:
        bengali = sum("ঀ" <= c <= "৿" for c in text)
        latin = sum(c.isascii() and c.isalpha() for c in text)
        return None if not bengali + latin else "bn" if bengali > latin else "en"


class PlainTextExtractor:
    """Pages of a UTF-8 file, parted by form feeds."""

    def pages(self, content: bytes) -> list[str]:
        return [p.strip() for p in content.decode("utf-8").split("\f")]


@dataclass
class CallPolicy:
    """How a service is called: attempts, waiting, and the least interval between calls of one task."""

    attempts: int = 4
    first_wait: float = 1.0
    calls_per_minute: float = 500.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self) -> None:
        self._last = float("-inf")

    def call(self, function: Callable[[], str], limited: Callable[[Exception], bool] = lambda e: False) -> str | None:
        """The function's result, or nothing after all attempts failed; only limited calls wait, twice as long each time."""
        for attempt in range(self.attempts):
            wait = 60.0 / self.calls_per_minute - (self.clock() - self._last)
            if wait > 0:
                self.sleep(wait)
            self._last = self.clock()
            try:
                return function()
            except Exception as e:  # noqa: BLE001 - a service may raise anything
                if limited(e):
                    self.sleep(self.first_wait * 2**attempt)
        return None

    def shared(self, tasks: int) -> CallPolicy:
        """The policy of one of so many concurrent tasks, which divide the rate among them."""
        return CallPolicy(self.attempts, self.first_wait, self.calls_per_minute / max(1, tasks), self.sleep, self.clock)


@dataclass
class ServiceGenerator:
    """A generator that calls a service for each prompt under a policy; ``tasks`` of them run at once."""

    ask: Callable[[str], str]
    policy: CallPolicy
    tasks: int = 1
    limited: Callable[[Exception], bool] = lambda e: "429" in str(e)

    def generate(self, prompts: list[str]) -> list[str | None]:
        # Each task has its own limiter, made where it runs.
        own = self.__dict__.setdefault("_own", self.policy.shared(self.tasks))
        return [own.call(lambda p=p: self.ask(p), self.limited) for p in prompts]

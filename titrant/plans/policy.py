"""Generator policy: settings, provider chain, circuit breaker, retries with backoff. Not Spark task retry.

A chain is made on the driver and travels with a generator to the tasks. Each task opens breakers of its own, as each process
of a service would; what the tasks of a wave have opened comes back as rows, is reduced by entry and is known to all tasks of
the next wave. ``generator`` makes one of a chain and a prompt.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PROVIDER_WIDE = ("429", "rate limit", "500", "502", "503", "504", "connection", "nameresolutionerror", "max retries exceeded")
TRANSIENT = ("429", "rate limit", "500", "502", "503", "504", "timeout", "timed out", "overloaded", "connection", "temporarily")
FATAL = ("404", "401", "403", "not found", "cannot process image")
RETRY_AFTER = r"(?i)(?:try again in|retry_delay|retry in)\D{0,20}?(\d+(?:\.\d+)?)"
SLACK = 1.0  # seconds after the wait that a provider asks for


@dataclass(frozen=True)
class Settings:
    """Chains are comma-separated entries, a provider or provider:model, in the order they are tried."""

    text_chain: tuple[str, ...] = ()
    vision_chain: tuple[str, ...] = ()
    reserved_chain: tuple[str, ...] = ()
    retries: int = 2  # attempts at an entry
    backoff: float = 1.5
    cooldown: float = 60.0

    @classmethod
    def read(cls, env: dict[str, str] | None = None) -> Settings:
        """Settings by the variables TEXT_FALLBACK_CHAIN, VISION_FALLBACK_CHAIN, RETRY_RESERVED_CHAIN, LLM_MAX_RETRIES,
        LLM_RETRY_BACKOFF_SEC and LLM_CIRCUIT_COOLDOWN_SEC, where they are set."""
        env = dict(os.environ) if env is None else env
        listed = lambda name: tuple(p.strip() for p in env.get(name, "").split(",") if p.strip())
        return cls(
            listed("TEXT_FALLBACK_CHAIN"), listed("VISION_FALLBACK_CHAIN"), listed("RETRY_RESERVED_CHAIN"), int(env.get("LLM_MAX_RETRIES", cls.retries)),
            float(env.get("LLM_RETRY_BACKOFF_SEC", cls.backoff)), float(env.get("LLM_CIRCUIT_COOLDOWN_SEC", cls.cooldown)),
        )


def provider_wide(reason: Column | str) -> Column:
    """Whether a failure's reason concerns the provider rather than one model."""
    return F.coalesce(F.lower(reason).rlike("|".join(PROVIDER_WIDE)), F.lit(False))


def transient(reason: str) -> bool:
    """Whether the same entry may answer when asked again."""
    reason = reason.lower()
    return not any(m in reason for m in FATAL) and any(m in reason for m in TRANSIENT)


class Unavailable(RuntimeError):
    """No entry of the chain could answer."""


@dataclass
class Chain:
    """Calls entries in turn. One that fails is left out until its cooldown ends, with all of its provider's where the
    failure concerns the provider; if that would leave none, all are tried.

    providers: name to a function of (prompt, model or None); vision: providers that read images; keyless: providers
    without a key, which are never asked.
    """

    providers: dict[str, Callable[[str, str | None], str]]
    settings: Settings = Settings()
    vision: frozenset[str] = frozenset()
    keyless: frozenset[str] = frozenset()
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    shut: dict[str, float] = field(default_factory=dict)  # by this process's clock
    known: dict[str, float] = field(default_factory=dict)  # what other tasks have shut, by the time of day
    today: Callable[[], float] = time.time

    def opened(self) -> dict[str, float]:
        """Entries and providers that are shut now and the time of day until which they are."""
        now = self.today()
        own = {k: now + left for k, t in self.shut.items() if (left := t - self.clock()) > 0}
        return {k: max(t, own.get(k, t)) for k, t in (own | {k: t for k, t in self.known.items() if t > now}).items()}

    def cooldown(self, reason: str) -> float:
        """Seconds that an entry is left out: what it asks for and some slack, at most the settings' own."""
        said = re.search(RETRY_AFTER, reason or "")
        return min(float(said[1]) + SLACK, self.settings.cooldown) if said else self.settings.cooldown

    def _open(self, entry: str) -> bool:
        never = float("-inf")
        return any(self.shut.get(k, never) > self.clock() or self.known.get(k, never) > self.today() for k in (entry, entry.split(":", 1)[0]))

    def order(self, offset: int = 0, reserve: bool = False, capability: str = "text") -> list[str]:
        """The entries of one call: the capability's chain begun at ``offset``, behind the reserved one if asked for (which
        reads no images)."""
        images = capability == "vision"
        own = self.settings.vision_chain if images else self.settings.text_chain or tuple(self.providers)
        own = own[offset % len(own) :] + own[: offset % len(own)] if own else own
        entries = [*(self.settings.reserved_chain if reserve and not images else ()), *own]
        able = [e for e in entries if (p := e.split(":", 1)[0]) in self.providers and p not in self.keyless and (not images or p in self.vision)]
        return [e for e in able if not self._open(e)] or able

    def call(self, prompt: str, offset: int = 0, reserve: bool = False, capability: str = "text") -> str:
        last: Exception | None = None
        for entry in self.order(offset, reserve, capability):
            provider, _, model = entry.partition(":")
            attempts = max(1, self.settings.retries)
            for attempt in range(attempts):
                try:
                    answer = self.providers[provider](prompt, model or None)
                except Exception as e:
                    last = e
                    if attempt + 1 < attempts and transient(str(e)):
                        self.sleep(self.settings.backoff * 2**attempt)
                        continue
                    wide = any(m in str(e).lower() for m in PROVIDER_WIDE)
                    self.shut[provider if wide else entry] = self.clock() + self.cooldown(str(e))
                    break
                for closed in (self.shut, self.known):
                    closed.pop(provider, None), closed.pop(entry, None)
                return answer
        raise Unavailable(f"no entry answered a {capability} call") from last


def batch_prompt(batch: pd.DataFrame) -> str:
    """The tests of one batch with their reference text; the readings are not among the columns."""
    return "\n".join(f"- Test ID: {t.test_id} | Name: {t.raw_name}\n  Reference context: {t.text}" for t in batch.itertuples())


@dataclass
class ChainGenerator:
    """A generator for ``explain``: one call for each batch, begun at the batch's place in the chain, with the reserved chain in
    the first repeated wave. Answers are JSON with explanations by test_id; a batch whose call fails gives no rows."""

    chain: Chain
    prompt: Callable[[pd.DataFrame], str] = batch_prompt

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (number, wave), batch in frame.groupby(["batch", "wave"], sort=True):
            try:
                told = json.loads(self.chain.call(self.prompt(batch), int(number), reserve=wave == 1))
            except (Unavailable, ValueError):
                continue
            told = told.get("explanations", []) if isinstance(told, dict) else []
            by_id = {x.get("test_id"): x for x in told if isinstance(x, dict)}
            for t in batch.itertuples():
                if x := by_id.get(t.test_id):
                    listed = x.get("lifestyle_suggestions")
                    rows.append((t.slot, x.get("what_it_measures"), listed if isinstance(listed, list) else None, x.get("gp_question")))
        return pd.DataFrame(rows, columns=["slot", "what_it_measures", "lifestyle_suggestions", "gp_question"])

    def traced(self, frame: pd.DataFrame) -> pd.DataFrame:
        """The answers, and a row without a slot whose ``opened`` has what this task has shut by the end of the call."""
        rows = [(*r, None) for r in self(frame).itertuples(index=False)] + [(None, None, None, None, self.chain.opened())]
        return pd.DataFrame(rows, columns=["slot", "what_it_measures", "lifestyle_suggestions", "gp_question", "opened"]).astype({"slot": "Int64"})

    def knowing(self, opened: dict[str, float]) -> ChainGenerator:
        """The generator with breakers open that other tasks have opened."""
        return replace(self, chain=replace(self.chain, shut={}, known=self.chain.opened() | opened))


def generator(chain: Chain, prompt: Callable[[pd.DataFrame], str] = batch_prompt) -> ChainGenerator:
    return ChainGenerator(chain, prompt)


def reader(chain: Chain, capability: str = "vision") -> Callable[[str, list[str]], str]:
    """A reader for ``vision``: the prompt of one call is its text and, for providers that read images, its images as blocks."""

    def read(text: str, images: list[str]) -> str:
        blocks = [{"type": "text", "text": text}, *({"type": "image_url", "image_url": {"url": i}} for i in images)]
        return chain.call(json.dumps(blocks) if images else text, capability=capability)

    return read

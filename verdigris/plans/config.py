"""Run manifests and judge profiles: small configuration, checked on the driver."""

import hashlib
import json
from dataclasses import dataclass, field

SECRET_HEADERS = ("authorization", "cookie", "x-api-key", "proxy-authorization")


@dataclass(frozen=True)
class Selection:
    split: str = "test"
    ids: tuple[str, ...] = ()
    limit: int | None = None
    seed: str = "0"


@dataclass(frozen=True)
class JudgeProfile:
    transport: str
    model: str
    temperature: float = 0.0
    max_retries: int = 2
    timeout_seconds: int = 120
    endpoint: str | None = None
    command: tuple[str, ...] = ()

    def problems(self) -> list[str]:
        found = []
        if self.transport == "openai_compatible" and not self.endpoint:
            found.append("an HTTP judge needs an endpoint")
        if self.transport == "process" and not self.command:
            found.append("a process judge needs a command")
        if self.transport not in ("openai_compatible", "process"):
            found.append(f"unknown transport: {self.transport}")
        if not 0 <= self.temperature <= 2:
            found.append("temperature is out of range")
        return found


@dataclass(frozen=True)
class Manifest:
    run_id: str
    benchmark_id: str
    sut_id: str
    adapter: str
    worker: str = "local"
    selection: Selection = field(default_factory=Selection)
    concurrency: int = 1
    max_concurrency: int = 1
    timeout_seconds: int = 900
    tracks: tuple[str, ...] = ("short_fact", "long_form")
    headers: tuple[tuple[str, str], ...] = ()
    judge: JudgeProfile | None = None

    def problems(self, tracks_needed: tuple[str, ...] = ()) -> list[str]:
        """Why the run must not start; empty if it may."""
        found = []
        if not self.run_id or not self.sut_id:
            found.append("run and system need ids")
        if self.concurrency > self.max_concurrency:
            found.append("concurrency exceeds what the system allows")
        if not self.selection.ids and self.selection.limit is not None and self.selection.limit <= 0:
            found.append("the selection is empty")
        if self.adapter == "browser" and self.worker != "browser":
            found.append("a browser adapter needs a browser worker")
        found += [f"secret header in the manifest: {k}" for k, _ in self.headers if k.lower() in SECRET_HEADERS]
        found += [f"the system cannot do {t}" for t in tracks_needed if t not in self.tracks]
        return found + (self.judge.problems() if self.judge else [])


def locked(manifest: Manifest) -> tuple[str, str]:
    """The manifest in canonical JSON, and its digest."""
    text = json.dumps(manifest, default=lambda o: o.__dict__, sort_keys=True, ensure_ascii=False)
    return text, "sha256:" + hashlib.sha256(text.encode()).hexdigest()

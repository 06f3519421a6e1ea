"""Text generators, the way a summary or response is written."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from ..schema import Settings

Generator = Callable[[str], str]


def extractive(prompt: str) -> str:
    """Needs no service: the last line of the prompt that has text."""
    found = [line.strip() for line in prompt.splitlines() if line.strip()]
    return found[-1] if found else ""


@dataclass(frozen=True)
class HttpGenerator:
    """A language model behind HTTP. With a key: chat messages, answer at
    ``choices[0].message.content``; without: {model, prompt}, answer at
    ``response``. Any failure raises."""

    url: str
    model: str
    key: str = ""
    temperature: float = 0.1
    max_tokens: int = 4000
    timeout_s: float | None = 30.0

    def __call__(self, prompt: str) -> str:
        if self.key:
            body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens, "stream": False}
        else:
            body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature}}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout_s) as r:
            found = json.loads(r.read())
        text = (found.get("choices") or [{}])[0].get("message", {}).get("content") if self.key else found.get("response")
        if not isinstance(text, str):
            raise ValueError("the language model gave no text")
        return text


def generator_of(settings: Settings, url: str = "", model: str = "", key: str = "") -> Generator:
    """The generator that goes with the settings' provider, with their
    temperature, length and timeout; the cloud service alone has a timeout."""
    if settings.provider == "hashing":
        return extractive
    local = settings.provider == "local"
    return generator(settings.provider, url=url, model=model, key="" if local else key, temperature=settings.temperature, max_tokens=settings.max_tokens, timeout_s=None if local else settings.timeout_s)


def generator(kind: str, **how) -> Generator:
    """By name; an unknown one is an error."""
    if kind == "extractive":
        return extractive
    if kind in ("local", "cloud"):
        return HttpGenerator(**how)
    raise ValueError(f"unknown generator {kind}")

"""Settings of the remote labeler, from a file of settings and the environment, as one checked object."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

from docweave.functions.llm_api import DEFAULT_MODEL
from docweave.sources.remote import Service

# Names of the settings.
KEY, ENDPOINT, MODEL, TIMEOUT, REQUESTS = "LLM_API_KEY", "LLM_API_ENDPOINT", "LLM_MODEL_ID", "LLM_API_CALL_TIMEOUT", "MAX_CONCURRENT_LLM_REQUESTS"

_LINE = re.compile(r"""\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|'([^']*)'|([^#\n]*?))\s*(?:#.*)?$""")


def read_file(path: str) -> dict[str, str]:
    """NAME=value lines of a file; quotes, comments and export are understood, other lines are passed over. Empty where there is no such file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as source:
        found = filter(None, map(_LINE.match, source))
        return {m[1]: re.sub(r"\\(.)", r"\1", m[2]) if m[2] is not None else m[3] if m[3] is not None else m[4] for m in found}


def positive(text: str | None, default: int) -> int:
    """The integer if it is one above zero, else the default."""
    try:
        value = int((text or "").strip())
    except ValueError:
        return default
    return value if value > 0 else default


@dataclass(frozen=True)
class Settings:
    """What a remote labeler needs. The key isn't shown."""

    key: str
    base_url: str
    model: str = DEFAULT_MODEL
    timeout: int = 300
    requests: int = 5

    def __post_init__(self) -> None:
        missing = [name for name, value in ((KEY, self.key), (ENDPOINT, self.base_url)) if not value]
        if missing:
            raise ValueError(f"not set: {', '.join(missing)}")

    def __repr__(self) -> str:
        shown = "*" * len(self.key) if len(self.key) <= 4 else "*" * (len(self.key) - 4) + self.key[-4:]
        return f"Settings(key={shown}, base_url={self.base_url}, model={self.model}, timeout={self.timeout}, requests={self.requests})"

    @classmethod
    def load(cls, path: str = ".env", environment: Mapping[str, str] | None = None) -> Settings:
        """From the environment, over which the file goes. Only key and endpoint have to be there; numbers that aren't above zero are the defaults."""
        of = {**(os.environ if environment is None else environment), **read_file(path)}
        return cls(of.get(KEY, ""), of.get(ENDPOINT, ""), of.get(MODEL) or DEFAULT_MODEL, positive(of.get(TIMEOUT), 300), positive(of.get(REQUESTS), 5))

    def service(self) -> Service:
        return Service(self.base_url, self.key, self.model, self.timeout, self.requests)

    def label_setting(self, prompt: str) -> str:
        """What decides a label besides the text, for a store of labels (sources.labels)."""
        return f"{self.model}\n{prompt}"

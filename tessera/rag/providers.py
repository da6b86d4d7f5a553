"""Model providers by name, each a callable from a prompt to the model's text.

A provider is plain data (address, model, key), so it can be sent to the tasks
that ask it; retries, parsing and the range of the confidence are retrieve's.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import ConfigError, RemoteError
from ..http import Transport, call, over_network

SYSTEM = "You name the semantic datatype of a data field. Answer with one JSON object and nothing else."


@dataclass(frozen=True)
class Chat:
    """A chat completion service. json_mode asks it for JSON only; plain_options leaves temperature and length out."""

    url: str
    model: str
    key: str | None = field(default=None, repr=False)
    json_mode: bool = True
    local_form: bool = False
    temperature: float = 0.0
    max_tokens: int = 500
    timeout: float = 30.0
    transport: Transport = over_network

    def payload(self, prompt: str) -> dict:
        body: dict = {"model": self.model, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}]}
        if self.local_form:
            return body | {"stream": False, "format": "json"}
        body |= {"temperature": self.temperature, "max_tokens": self.max_tokens}
        return body | ({"response_format": {"type": "json_object"}} if self.json_mode else {})

    def __call__(self, prompt: str) -> str:
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        status, answer = call("POST", self.url, self.payload(prompt), headers, timeout=self.timeout, transport=self.transport)
        if status >= 400 or not isinstance(answer, dict):
            raise RemoteError(f"{self.url}: {status}")
        try:
            return answer["message"]["content"] if self.local_form else answer["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise RemoteError(f"{self.url}: an answer without content") from e


@dataclass(frozen=True)
class Service:
    base: str
    path: str
    model: str
    key_name: str | None = None
    json_mode: bool = True
    local_form: bool = False


SERVICES = {
    "openai": Service("https://api.openai.com/v1", "/chat/completions", "gpt-4o-mini", "OPENAI_API_KEY"),
    "openrouter": Service("https://openrouter.ai/api/v1", "/chat/completions", "openai/gpt-4o-mini", "OPENROUTER_API_KEY"),
    "ollama": Service("http://localhost:11434", "/api/chat", "llama3", None, True, True),
    "lmstudio": Service("http://localhost:1234/v1", "/chat/completions", "local-model"),
    "perplexity": Service("https://api.perplexity.ai", "/chat/completions", "sonar", "PERPLEXITY_API_KEY", False),
}
_OWN: dict[str, Callable[..., Callable[[str], str]]] = {}


def register_provider(name: str, make: Callable[..., Callable[[str], str]]) -> None:
    """Make a factory of callables known by name."""
    _OWN[name.lower()] = make


def list_providers() -> list[str]:
    return [*SERVICES, *(n for n in _OWN if n not in SERVICES)]


def get_provider(name: str, model: str | None = None, api_key: str | None = None, base_url: str | None = None, **more) -> Callable[[str], str]:
    """A provider by name, whatever its case. Keys come from the argument or the service's usual environment variable."""
    low = name.lower()
    if low in _OWN:
        return _OWN[low](model=model, api_key=api_key, base_url=base_url, **more)
    if low not in SERVICES:
        raise ConfigError(f"unknown provider {name!r}; there are {', '.join(list_providers())}")
    s = SERVICES[low]
    key = api_key or (os.environ.get(s.key_name) if s.key_name else None)
    if s.key_name and not key:
        raise ConfigError(f"{name} needs a key: api_key or {s.key_name}")
    return Chat((base_url or s.base).rstrip("/") + s.path, model or s.model, key, s.json_mode, s.local_form, **more)

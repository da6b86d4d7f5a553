"""JSON over HTTP with a transport that can be replaced."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from typing import Any

from .errors import RemoteError

#: (method, address, headers, body, seconds) to (status, body).
Transport = Callable[[str, str, dict[str, str], bytes | None, float], tuple[int, bytes]]


def over_network(method: str, url: str, headers: dict[str, str], body: bytes | None, timeout: float) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    except OSError as e:
        raise RemoteError(f"{url}: {e}") from e


def call(method: str, url: str, body: Any = None, headers: dict[str, str] | None = None, query: dict[str, str] | None = None, timeout: float = 30.0, transport: Transport = over_network, kind: str = "application/json") -> tuple[int, Any]:
    """(status, what the JSON answer holds, or None where it isn't JSON)."""
    if query:
        url += "?" + urllib.parse.urlencode(query)
    raw = None if body is None else json.dumps(body).encode()
    status, answer = transport(method, url, {"Accept": "application/json", **({"Content-Type": kind} if raw is not None else {}), **(headers or {})}, raw, timeout)
    try:
        return status, json.loads(answer) if answer else None
    except ValueError:
        return status, None

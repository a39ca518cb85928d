"""The model as an operator: a pluggable backend over partitions, with retries and a fallback model."""

from __future__ import annotations

import http.client
import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

from findmill.functions.rules import (
    CONTAINER_ENDPOINTS,
    DEFAULT_ENDPOINT,
    ENDPOINT_VARIABLE,
    FALLBACK_MODEL,
    NATIVE_ENDPOINTS,
    OTHER_ENDPOINTS,
    PROBE_MODEL,
    model_of,
)

ATTEMPTS = 3
CALLS_PER_TASK = 64


class Backend(Protocol):
    def call(self, model: str, prompt: str, timeout: int) -> str: ...


class ReplayBackend:
    """Answers by a function of the prompt: for tests and for replaying saved responses."""

    def __init__(self, answer: Callable[[str], str]):
        self.answer = answer

    def call(self, model: str, prompt: str, timeout: int) -> str:
        return self.answer(prompt)


class HttpBackend:
    """A model server that takes a JSON request and answers {"response": text}; a task keeps its connection open."""

    def __init__(self, url: str, context: int, **options):
        self.url, self.options = url, {"num_ctx": context, "temperature": 0.1, **options}
        self.held: http.client.HTTPConnection | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "held": None}  # a connection stays with its process

    def call(self, model: str, prompt: str, timeout: int) -> str:
        body = {"model": model, "prompt": prompt, "stream": False, "format": "json", "options": self.options}
        reused = self.held is not None
        try:
            answer = self._post(json.dumps(body).encode(), timeout)
        except (http.client.BadStatusLine, ConnectionError):
            if not reused:
                raise
            answer = self._post(json.dumps(body).encode(), timeout)  # the server had closed a connection that lay idle
        return json.loads(answer).get("response", "{}")

    def _post(self, body: bytes, timeout: int) -> bytes:
        at = urlsplit(self.url)
        if self.held is None:
            self.held = (http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection)(at.netloc, timeout=timeout)
        held, self.held = self.held, None
        held.timeout = timeout
        if held.sock:
            held.sock.settimeout(timeout)
        try:
            held.request("POST", f"{at.path or '/'}{f'?{at.query}' if at.query else ''}", body, {"Content-Type": "application/json"})
            answer = held.getresponse()
            data = answer.read()
            if answer.status != 200:
                raise OSError(f"status {answer.status}")
        except BaseException:
            held.close()
            raise
        self.held = held
        return data


_PARTS = (r"\[\s*\{.*\}\s*\]", r"\{.*\}", r"```json\s*(\[.*?\]|\{.*?\})\s*```")


def _usable(text: str) -> bool:
    """Whether a JSON value other than null can be recovered; else the call counts as failed."""
    found = [text]
    for part in _PARTS:
        if m := re.search(part, text, re.DOTALL):
            found.append(m[m.lastindex or 0])
    for candidate in found:
        try:
            return json.loads(candidate) is not None
        except ValueError:
            continue
    return False


def in_container(marker: str = "/.dockerenv", groups: str = "/proc/1/cgroup") -> bool:
    """Whether this program runs in a container, by a file that is there or by the groups of its first process."""
    if os.path.exists(marker):
        return True
    try:
        with open(groups, encoding="utf-8", errors="ignore") as f:
            text = f.read()
    except OSError:
        return False
    return "docker" in text or "containerd" in text


def endpoint_candidates(container: bool | None = None) -> tuple[str, ...]:
    """Addresses to try, in order: those of where the program runs, then others in case that was told wrongly."""
    inside = in_container() if container is None else container
    return (*(CONTAINER_ENDPOINTS if inside else NATIVE_ENDPOINTS), *OTHER_ENDPOINTS)


def _answers(url: str, timeout: float) -> bool:
    body = json.dumps({"model": PROBE_MODEL, "prompt": "ping", "stream": False}).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            return answer.status == 200
    except OSError:
        return False


def resolve_endpoint(
    given: str | None = None, candidates: Sequence[str] | None = None, default: str = DEFAULT_ENDPOINT, tries: int = 2, timeout: float = 2.0,
    variable: str | None = ENDPOINT_VARIABLE, pause: float = 0.3,
) -> str:
    """The address given, else that in the environment, else the first candidate that answers a short request with 200, else the default.

    Without ``candidates`` they are those of a container or of a machine, whichever this is.
    """
    if given or variable and os.environ.get(variable):
        return given or os.environ[variable]
    for url in endpoint_candidates() if candidates is None else candidates:
        for i in range(tries):
            if i:
                time.sleep(pause)
            if _answers(url, timeout):
                return url
    return default


def ask(backend: Backend, model: str, prompt: str, pause: Callable[[float], None] = time.sleep) -> tuple[str, str | None, str]:
    """(status, response, model used): up to three attempts with back-off, then once the fallback model."""
    timeout = model_of(model).timeout + 10 * (len(prompt) // 10000)
    for attempt in range(ATTEMPTS + 1):
        last = attempt == ATTEMPTS
        if last and model == FALLBACK_MODEL:
            break
        if attempt and not last:
            pause(2.0**attempt)
        try:
            text = backend.call(FALLBACK_MODEL if last else model, prompt, timeout)
        except Exception:  # a backend may fail in any way; the call counts as failed
            continue
        if isinstance(text, str) and _usable(text):
            return "ok", text, FALLBACK_MODEL if last else model
    return "failed", None, model


def infer(prompted: DataFrame, backend: Backend, model: str, max_calls: int = 2, profile: ResourceProfile | None = None) -> DataFrame:
    """``prompted`` with status, raw and model.

    Calls at a time are bounded by ``max_calls`` partitions, or by a resource profile whose task resource
    stands for one call: then a partition is ``CALLS_PER_TASK`` calls, and a lost executor repeats no more
    than its own. Store the result before using it: a task that is repeated calls the model again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [ask(backend, model, p) for p in batch["prompt"]]
            yield batch.assign(**{c: [a[i] for a in answers] for i, c in enumerate(("status", "raw", "model"))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompted.schema)
    tasks = max_calls if profile is None else max(max_calls, -(-prompted.count() // CALLS_PER_TASK))
    more = {} if profile is None else {"profile": profile}
    return prompted.repartition(tasks).mapInPandas(run, f"{schema}, status string, raw string, model string", **more)

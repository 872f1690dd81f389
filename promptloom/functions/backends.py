"""Model backends: what turns a finished prompt into a reply.

A backend has ``complete``, called on the executors with a list of prompts. One that can
also state its reply as a column expression has ``expression`` and then never leaves the
JVM; the hash backend does, which makes semantic queries checkable in SQL.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

from pyspark import Accumulator
from pyspark.sql import Column
from pyspark.sql import functions as F

YES_NO = ("Yes", "No")


class Backend(Protocol):
    def complete(self, prompts: Sequence[str], choices: Sequence[Sequence[str] | None], json_schema: Mapping[str, Any] | None = None) -> list[str | None]:
        """A reply for each prompt, in order; None where there is none. ``choices`` has for
        each prompt the replies allowed, or None. A backend that takes images has a further
        argument ``images``, an encoded image or None for each prompt."""
        ...


class HashBackend:
    """A deterministic stand-in for a model: the prompt's MD5 picks one of the choices."""

    def __init__(self, choices: Sequence[str] = YES_NO) -> None:
        self.choices = tuple(choices)

    def _reply(self, prompt: str, choices: Sequence[str] | None, json_schema: Mapping[str, Any] | None) -> str:
        options = tuple(choices or self.choices)
        reply = options[int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16) % len(options)]
        return json.dumps({_answer_key(json_schema): reply}) if json_schema else reply

    def complete(self, prompts, choices, json_schema=None):
        return [None if p is None else self._reply(p, c, json_schema) for p, c in zip(prompts, choices, strict=True)]

    def expression(self, prompt: Column, choices: Column | None = None, json_schema: Mapping[str, Any] | None = None) -> Column:
        own = F.array(*[F.lit(c) for c in self.choices])
        options = own if choices is None else F.when(F.size(choices) > 0, choices).otherwise(own)
        number = F.conv(F.substring(F.md5(prompt), 1, 8), 16, 10).cast("long")
        reply = F.get(options, F.pmod(number, F.size(options)).cast("int"))
        return F.to_json(F.struct(reply.alias(_answer_key(json_schema)))) if json_schema else reply


def _answer_key(json_schema: Mapping[str, Any] | None) -> str:
    return next(iter((json_schema or {}).get("properties", {"Answer": None})))


class RecordedBackend:
    """Replies from a table of prompts; None for others."""

    def __init__(self, replies: Mapping[str, str]) -> None:
        self.replies = dict(replies)

    def complete(self, prompts, choices, json_schema=None):
        return [self.replies.get(p) for p in prompts]


class CountingBackend:
    """Another backend, with the number of prompts it was asked counted in an accumulator."""

    def __init__(self, inner: Backend, calls: Accumulator) -> None:
        self.inner, self.calls = inner, calls

    def complete(self, prompts, choices, json_schema=None, **images):
        self.calls.add(len(prompts))
        return self.inner.complete(prompts, choices, json_schema, **images)


class DelayedBackend:
    """Another backend that takes a fixed time for each prompt, to measure plans with."""

    def __init__(self, inner: Backend, seconds: float) -> None:
        self.inner, self.seconds = inner, seconds

    def complete(self, prompts, choices, json_schema=None, **images):
        time.sleep(self.seconds * len(prompts))
        return self.inner.complete(prompts, choices, json_schema, **images)


#: Replies that ``complete_once`` remembers.
REMEMBERED = 100_000


def complete_once(backend: Backend, prompts: Sequence[str | None], choices: Sequence[str] | None, json_schema: Mapping[str, Any] | None, known: dict[str, str]) -> list[str | None]:
    """Replies to prompts that share their choices; each is asked once as long as ``known``
    keeps its reply. Null prompts are not asked, failures are not remembered."""
    new = list(dict.fromkeys(p for p in prompts if p is not None and p not in known))
    replies = dict(zip(new, backend.complete(new, [choices] * len(new), json_schema), strict=True)) if new else {}
    found = [None if p is None else replies.get(p, known.get(p)) for p in prompts]
    if len(known) > REMEMBERED:
        known.clear()
    known.update((p, r) for p, r in replies.items() if r is not None)
    return found


class HttpBackend:
    """A chat-completions server. Requests of a batch run on at most ``threads`` threads,
    or one after another with ``threads=1``; with ``chunk`` over 1 that many prompts that
    have the same choices and no image go in one completions request. Requests that the
    server cannot take now are sent again up to ``retries`` times, after ``backoff`` seconds
    and twice as many each time. A failed or malformed reply is None for its rows only."""

    def __init__(self, base_url: str, model: str, temperature: float = 0.0, threads: int = 8, chunk: int = 1, timeout: float = 300.0, retries: int = 2, backoff: float = 0.5) -> None:
        self.base_url, self.model, self.temperature, self.threads, self.chunk, self.timeout = base_url.rstrip("/"), model, temperature, threads, chunk, timeout
        self.retries, self.backoff = retries, backoff

    def payload(self, prompt: str, choices: Sequence[str] | None = None, json_schema: Mapping[str, Any] | None = None, image_embeds: str | None = None) -> dict[str, Any]:
        content = [{"type": "text", "text": prompt}] + ([{"type": "image_embeds", "image_embeds": image_embeds}] if image_embeds else [])
        return {"model": self.model, "messages": [{"role": "user", "content": content}], "temperature": self.temperature} | self._guides(choices, json_schema)

    @staticmethod
    def _guides(choices: Sequence[str] | None, json_schema: Mapping[str, Any] | None) -> dict[str, Any]:
        return ({"guided_json": dict(json_schema)} if json_schema else {}) | ({"guided_choice": list(choices)} if choices else {})

    def _post(self, path: str, body: Mapping[str, Any] | None) -> Any:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"{self.base_url}{path}", data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def _ask(self, path: str, body: Mapping[str, Any]) -> Any:
        for again in range(self.retries + 1):
            try:
                return self._post(path, body)
            except OSError as e:
                refused = isinstance(e, urllib.error.HTTPError) and e.code != 429 and e.code < 500
                if refused or again == self.retries:
                    raise
                time.sleep(self.backoff * 2**again)

    def alive(self) -> bool:
        """Whether the server lists its models."""
        try:
            return "data" in self._post("/models", None)
        except (OSError, ValueError):
            return False

    def _one(self, prompt: str | None, choices: Sequence[str] | None, json_schema: Mapping[str, Any] | None, image: str | None) -> str | None:
        if prompt is None:
            return None
        try:
            return self._ask("/chat/completions", self.payload(prompt, choices, json_schema, image))["choices"][0]["message"]["content"] or None
        except (OSError, ValueError, KeyError, IndexError, TypeError):
            return None

    def _many(self, prompts: Sequence[str], choices: Sequence[str] | None, json_schema: Mapping[str, Any] | None) -> list[str | None]:
        body = {"model": self.model, "prompt": list(prompts), "temperature": self.temperature} | self._guides(choices, json_schema)
        try:
            found = [c["text"] or None for c in self._ask("/completions", body)["choices"]]
        except (OSError, ValueError, KeyError, TypeError):
            found = []
        return found if len(found) == len(prompts) else [None] * len(prompts)

    def complete(self, prompts, choices, json_schema=None, images=None):
        shown, alike, jobs = images or [None] * len(prompts), {}, []
        for i, (p, c, image) in enumerate(zip(prompts, choices, shown, strict=True)):
            if p is not None and (self.chunk == 1 or image):
                jobs.append([i])
            elif p is not None:
                alike.setdefault(tuple(c or ()), []).append(i)
        jobs += [rows[k : k + self.chunk] for rows in alike.values() for k in range(0, len(rows), self.chunk)]

        def ask(rows: list[int]) -> list[str | None]:
            first = rows[0]
            if self.chunk == 1 or shown[first]:
                return [self._one(prompts[first], choices[first], json_schema, shown[first])]
            return self._many([prompts[i] for i in rows], choices[first], json_schema)

        out: list[str | None] = [None] * len(prompts)
        with ThreadPoolExecutor(max(1, self.threads)) as pool:
            for rows, replies in zip(jobs, pool.map(ask, jobs), strict=True):
                for i, reply in zip(rows, replies, strict=True):
                    out[i] = reply
        return out


_backends: dict[str, Any] = {"hash": HashBackend, "recorded": RecordedBackend, "http": HttpBackend}


def register_backend(name: str, make: Any) -> None:
    _backends[name] = make


def backend(name: str, *args: Any, **options: Any) -> Backend:
    """A backend by name."""
    if name not in _backends:
        raise ValueError(f"unknown backend {name!r}; known: {sorted(_backends)}")
    return _backends[name](*args, **options)

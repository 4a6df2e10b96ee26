"""Translation as a plug-in: any batch function from texts to texts, run inside partitions.

Providers are created once per partition. A failing batch is tried text by text with retries and
the other providers; a text that still fails keeps its original, with the error beside it. Nothing
here needs a network: DictionaryProvider and EchoProvider serve tests and dry runs, the HTTP
providers only build and parse their messages and take the transport as a parameter.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.scalars import PHRASES, SYSTEM_PROMPT
from loomtext.operators.routing import failover_order, schedule


class Translator(Protocol):
    """translate() gives one text per text, in order."""

    name: str
    max_input_chars: int

    def translate(self, texts: list[str], source: str, target: str) -> list[str]: ...


class TransportError(Exception):
    """A failed call that may be repeated."""


@dataclass
class EchoProvider:
    name: str = "echo"
    max_input_chars: int = 0

    def translate(self, texts, source, target):
        return list(texts)


@dataclass
class DictionaryProvider:
    """Translates by a dictionary; unknown texts come back unchanged."""

    words: dict[str, str] = field(default_factory=dict)
    name: str = "dictionary"
    max_input_chars: int = 0

    def translate(self, texts, source, target):
        return [self.words.get(t, t) for t in texts]


Transport = Callable[[str, dict[str, str], str], str]


def placeholders(text: str) -> list[str]:
    """${...} with nested braces, and {{...}} up to the last closing pair, in order."""
    out, i = [], 0
    while i < len(text):
        if text.startswith("${", i):
            depth, j = 1, i + 2
            while j < len(text) and depth:
                depth += {"{": 1, "}": -1}.get(text[j], 0)
                j += 1
            if not depth:
                out.append(text[i:j])
                i = j
                continue
        elif text.startswith("{{", i):
            j = text.find("}}", i + 2)
            if j >= 0:
                while text.startswith("}}", j + 1):
                    j += 1
                out.append(text[i : j + 2])
                i = j + 2
                continue
        i += 1
    return out


def protect(text: str) -> tuple[str, list[str]]:
    """Placeholders as [[i]]; of one that occurs several times all occurrences."""
    found = list(dict.fromkeys(placeholders(text)))
    for i, p in sorted(enumerate(found), key=lambda x: -len(x[1])):
        text = text.replace(p, f"[[{i}]]")
    return text, found


def restore(text: str, found: list[str]) -> str:
    for i in range(len(found) - 1, -1, -1):
        text = text.replace(f"[[{i}]]", found[i])
    return text


def unwrapped(text: str) -> str:
    t = text.strip()
    m = re.fullmatch(r"(?s)```\w*\n?(.*?)\n?```", t)
    if m:
        return m.group(1).strip()
    m = re.fullmatch(r"`([^`]+)`", t)
    return m.group(1) if m else t


def check(original: str, translated: str) -> str | None:
    """Why a translation isn't valid; None if it is."""
    if not translated:
        return "empty"
    if len(original) and len(translated) / len(original) > 5.0:
        return "too_long"
    return "phrase" if any(p in translated.lower() and p not in original.lower() for p in PHRASES) else None


@dataclass
class ChatProvider:
    """A chat model: placeholders protected, the reply unwrapped, restored and checked. Keys in turn."""

    url: str
    model: str
    keys: list[str]
    send: Transport
    name: str = "llm"
    max_input_chars: int = 4000
    template: str | None = None
    turn: int = 0

    def translate(self, texts, source, target):
        return [self._one(t, source, target) for t in texts]

    def _one(self, text: str, source: str, target: str) -> str:
        if self.max_input_chars and len(text.encode()) > self.max_input_chars:
            raise ValueError("text exceeds the capacity")
        safe, found = protect(text)
        ask = f"Auto-detect the source language and translate to {target}" if source.upper() == "AUTO" else f"Translate from {source} to {target}"
        prompt = f"{ask}:\n\n{safe}"
        if self.template is not None:
            prompt = self.template.replace("{source_lang}", source).replace("{target_lang}", target).replace("{text}", safe)
        body = {"model": self.model, "messages": [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": prompt}]}
        key = self.keys[self.turn % len(self.keys)] if self.keys else ""
        self.turn += 1
        reply = json.loads(self.send(self.url, {"Authorization": f"Bearer {key}"}, json.dumps(body)))
        if "error" in reply:
            raise TransportError(str(reply["error"].get("message", reply["error"])))
        out = restore(unwrapped(reply["choices"][0]["message"]["content"]), found)
        why = check(text, out)
        if why:
            raise TransportError(f"invalid translation: {why}")
        return out


@dataclass
class PlainHttpProvider:
    """One POST per text with text, source and target; an empty text comes back as it is."""

    url: str
    send: Transport
    key: str = ""
    name: str = "deeplx"
    max_input_chars: int = 5000

    def translate(self, texts, source, target):
        out = []
        for t in texts:
            if not t:
                out.append(t)
                continue
            base = f"{self.url.rstrip('/')}/{self.key}/translate" if self.key else f"{self.url.rstrip('/')}/translate"
            reply = json.loads(self.send(base, {}, json.dumps({"text": t, "source_lang": source, "target_lang": target})))
            if reply.get("code", 200) != 200:
                raise TransportError(str(reply.get("message", "failed")))
            out.append(reply["data"])
        return out


@dataclass
class SignedProvider:
    """A service that takes one signed POST per text, with the texts in fields of its own; an empty text comes back as it is."""

    secret_id: str
    secret_key: str
    send: Transport
    region: str = "ap-beijing"
    name: str = "tencent"
    max_input_chars: int = 6000
    clock: Callable[[], float] = time.time

    # The public interface of the service.
    HOST = "tmt.tencentcloudapi.com"
    SERVICE = "tmt"
    ACTION = "TextTranslate"
    VERSION = "2018-03-21"

    def translate(self, texts, source, target):
        return [self._one(t, source, target) if t else t for t in texts]

    def _one(self, text: str, source: str, target: str) -> str:
        if self.max_input_chars and len(text.encode()) > self.max_input_chars:
            raise ValueError("text exceeds the capacity")
        body = json.dumps({"SourceText": text, "Source": source.lower(), "Target": target.lower(), "ProjectId": 0})
        now = int(self.clock())
        authorization, _ = sign(self.secret_id, self.secret_key, self.SERVICE, self.HOST, body, now)
        headers = {
            "Authorization": authorization, "Content-Type": "application/json; charset=utf-8", "Host": self.HOST,
            "X-TC-Action": self.ACTION, "X-TC-Version": self.VERSION, "X-TC-Timestamp": str(now), "X-TC-Region": self.region,
        }
        reply = json.loads(self.send(f"https://{self.HOST}", headers, body)).get("Response", {})
        if "Error" in reply:
            raise TransportError(f"{reply['Error'].get('Code')}: {reply['Error'].get('Message')}")
        if "TargetText" not in reply:
            raise TransportError("a reply without a translation")
        return reply["TargetText"]


def sign(secret_id: str, secret_key: str, service: str, host: str, payload: str, timestamp: int) -> tuple[str, str]:
    """(authorization, date) of a request signed by chained HMAC-SHA256 over its canonical form."""
    date = time.strftime("%Y-%m-%d", time.gmtime(timestamp))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    canonical = f"POST\n/\n\ncontent-type:application/json; charset=utf-8\nhost:{host}\n\ncontent-type;host\n{sha(payload)}"
    scope = f"{date}/{service}/tc3_request"
    to_sign = f"TC3-HMAC-SHA256\n{timestamp}\n{scope}\n{sha(canonical)}"
    key = ("TC3" + secret_key).encode()
    for part in (date, service, "tc3_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    signature = hmac.new(key, to_sign.encode(), hashlib.sha256).hexdigest()
    return f"TC3-HMAC-SHA256 Credential={secret_id}/{scope}, SignedHeaders=content-type;host, Signature={signature}", date


def split_text(text: str, most: int) -> list[str]:
    """A text in parts of at most so many characters, cut between paragraphs, else between
    sentences, else anywhere; the parts together are the text."""
    if len(text) <= most:
        return [text]
    out, room = [], ""
    for p in re.split(r"(?<=\n\n)", text):
        pieces = [p] if len(p) <= most else re.split(r"(?<=[.!?。！？])", p)
        for s in pieces:
            for x in [s[i : i + most] for i in range(0, len(s), most)] or [""]:
                if room and len(room) + len(x) > most:
                    out.append(room)
                    room = ""
                room += x
    return out + [room] if room else out


@dataclass
class Options:
    batch_size: int = 50
    max_retries: int = 3
    base_delay: float = 0.0
    split_above: int = 5000
    split_size: int = 0  # of the parts; 0 is split_above
    rate: float = 0.0


class Health:
    """down failures in all make a provider unhealthy, up successes healthy again."""

    def __init__(self, down: int = 3, up: int = 2):
        self.down, self.up, self.healthy, self.failures, self.successes = down, up, True, 0, 0

    def record(self, ok: bool) -> None:
        if self.healthy and not ok:
            self.failures += 1
        if not self.healthy and ok:
            self.successes += 1
        if self.healthy and self.failures >= self.down or not self.healthy and self.successes >= self.up:
            self.healthy = not self.healthy
            self.failures = self.successes = 0


class TokenBucket:
    """At most rate calls a second in this partition; 0 is no limit. For a limit over a job its rate is shared
    by the partitions that may run at once (commands.service_options)."""

    def __init__(self, rate: float, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.clock, self.sleep, self.next = rate, clock, sleep, 0.0

    def take(self) -> None:
        if self.rate > 0:
            now = self.clock()
            if now < self.next:
                self.sleep(self.next - now)
            self.next = max(now, self.next) + 1.0 / self.rate


class Service:
    """Batches with failover over weighted providers."""

    def __init__(self, providers: list[Translator], weights: dict[str, int] | None = None, options: Options | None = None):
        self.by_name = {p.name: p for p in providers}
        self.turns = schedule(weights or {p.name: 1 for p in providers})
        self.options, self.n = options or Options(), 0
        self.health = {p.name: Health() for p in providers}
        self.bucket = TokenBucket(self.options.rate)

    def pick(self, size: int) -> str:
        """The next provider in turn that is healthy and can take the text; else the next in turn."""
        for k in range(len(self.turns)):
            name = self.turns[(self.n + k) % len(self.turns)]
            cap = self.by_name[name].max_input_chars
            if self.health[name].healthy and (not cap or size <= cap):
                self.n += k + 1
                return name
        self.n += 1
        return self.turns[(self.n - 1) % len(self.turns)]

    def _call(self, name: str, texts: list[str], source: str, target: str) -> list[str]:
        self.bucket.take()
        try:
            out = self.by_name[name].translate(texts, source, target)
            if len(out) != len(texts):
                raise TransportError("another number of texts came back")
        except Exception:
            self.health[name].record(False)
            raise
        self.health[name].record(True)
        return out

    def one(self, text: str, source: str, target: str) -> tuple[str, str | None, str | None]:
        """(translation or original, provider, error)."""
        above = self.options.split_above
        parts = split_text(text, min(above, self.options.split_size or above)) if above and len(text) > above else [text]
        if len(parts) > 1:
            done = [self.one(p, source, target) for p in parts]
            error = next((e for *_, e in done if e), None)
            return ("".join(t for t, *_ in done), done[0][1], None) if not error else (text, None, error)
        first = self.pick(len(text.encode()))
        error = None
        for k, name in enumerate([first, *failover_order(list(self.by_name), first, self.options.max_retries)]):
            try:
                return self._call(name, [text], source, target)[0], name, None
            except Exception as x:  # the next provider is tried
                error = str(x)[:300]
                if self.options.base_delay:
                    time.sleep(self.options.base_delay * 2**k)
        return text, None, error

    def batch(self, texts: list[str], source: str, target: str) -> list[tuple[str, str | None, str | None]]:
        if not texts:
            return []
        if all(len(t) <= (self.options.split_above or 1 << 60) for t in texts):
            name = self.pick(max(len(t.encode()) for t in texts))
            try:
                return [(t, name, None) for t in self._call(name, texts, source, target)]
            except Exception:  # text by text
                pass
        return [self.one(t, source, target) for t in texts]


def translate(units: DataFrame, make: Callable[[], Service], text: str = "content", source: str = "source_lang", target: str = "target_lang") -> DataFrame:
    """units with translated, provider and error. make builds the service, once per partition.
    Null texts have a null translation; results stay with their rows, whatever the batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema) + ", translated string, provider string, error string"

    def run(frames):
        s = make()
        for pdf in frames:
            done: list = [(None, None, None)] * len(pdf)
            groups: dict[tuple, list[int]] = {}
            for i, (t, a, b) in enumerate(zip(pdf[text], pdf[source], pdf[target])):
                if isinstance(t, str):
                    groups.setdefault((a or "AUTO", b or "EN"), []).append(i)
            values = list(pdf[text])
            for (a, b), ids in groups.items():
                for k in range(0, len(ids), s.options.batch_size):
                    part = ids[k : k + s.options.batch_size]
                    for i, r in zip(part, s.batch([values[i] for i in part], a, b)):
                        done[i] = r
            out = pdf.copy()
            out["translated"], out["provider"], out["error"] = (list(c) for c in zip(*done)) if done else ([], [], [])
            yield out

    return units.mapInPandas(run, schema)


def totals(done: DataFrame) -> DataFrame:
    """Texts, characters, successes and failures of a translated table."""
    ok = F.col("error").isNull() & F.col("translated").isNotNull()
    return done.agg(F.count("*").alias("total"), F.sum(ok.cast("long")).alias("success_count"), F.sum((~ok).cast("long")).alias("failed_count"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("total_chars"))


def available(provider: Translator) -> bool:
    """Does a provider answer a probe?"""
    try:
        return bool(provider.translate(["hello"], "EN", "ZH"))
    except Exception:
        return False



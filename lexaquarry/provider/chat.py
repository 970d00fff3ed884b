"""Chat completions as text or as a checked JSON object, one by one or over a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, trim_white
from .failures import SCHEMA, Details, ProviderError, classify, error_value
from .http import RetryPolicy, Secret, Target, base_url, request

REPAIR = "Answer with a single valid JSON object that fits the schema, without any other text, code fence or list."


@dataclass(frozen=True)
class Config:
    url: str = ""
    model: str = ""
    timeout: float = 30.0
    token: str = field(default="", repr=False)
    max_retries: int = 0
    max_response_bytes: int = 0

    def __post_init__(self):
        object.__setattr__(self, "url", base_url(self.url))
        object.__setattr__(self, "model", self.model.strip())
        object.__setattr__(self, "token", Secret(self.token.strip()) if not isinstance(self.token, Secret) else self.token)
        if self.timeout <= 0:
            object.__setattr__(self, "timeout", 30.0)

    @property
    def enabled(self) -> bool:
        return bool(self.url and self.model)


@dataclass(frozen=True)
class JSONCall:
    messages: list[dict]
    schema: str | None = None
    temperature: float = 0.0
    max_tokens: int = 0
    max_repairs: int = 0  #: at most one
    repair_message: str = ""


def message_text(content) -> str | None:
    """The text of a message's content: a string, or parts with texts, blank ones left out; None for any other shape."""
    if isinstance(content, str):
        return content.strip(WHITE)
    if isinstance(content, list) and all(isinstance(x, dict) and isinstance(x.get("text", ""), (str, type(None))) for x in content):
        return "\n".join(t for x in content if (t := (x.get("text") or "").strip(WHITE)))
    return None


def json_object(text: str) -> str:
    """The JSON object in a model's answer: the whole answer, or else the first balanced braces that parse. An answer that
    is JSON of another kind, or several values, is an error."""
    text = text.strip(WHITE)
    if not text:
        raise ValueError("empty response")
    decoder = json.JSONDecoder(parse_constant=_no_constant)
    try:
        value, end = decoder.raw_decode(text)
    except ValueError:
        value, end = None, -1
    if end >= 0:
        if not isinstance(value, dict):
            raise ValueError("the JSON root is no object")
        rest = text[end:].strip(" \t\r\n")
        if not rest:
            return text[:end]
        try:
            decoder.raw_decode(rest)
        except ValueError:
            pass
        else:
            raise ValueError("the response has more than one JSON value")
    at = text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            return text[at:end]
        except ValueError:
            at = text.find("{", at + 1)
    raise ValueError("the response has no JSON object")


def _no_constant(x: str):
    raise ValueError(f"{x} is no JSON")


class Chat:
    def __init__(self, config: Config):
        self.config = config

    def _details(self, n: int) -> Details:
        c = self.config
        return Details(c.model, c.url, timeout_ms=int(c.timeout * 1000), max_retries=c.max_retries, input_count=n)

    def text(self, messages: list[dict], temperature: float = 0.0, max_tokens: int = 0, response_format: dict | None = None) -> str:
        if not self.config.enabled:
            raise RuntimeError("the chat client has no URL or model")
        body = {"model": self.config.model, "messages": messages, "temperature": temperature}
        if max_tokens:
            body["max_tokens"] = max_tokens
        if response_format is not None:
            body["response_format"] = response_format
        details = self._details(len(messages))
        wrong = lambda what: ProviderError(what, replace(details, failure_class=SCHEMA))

        def decode(raw: bytes) -> str:
            payload = json.loads(raw)
            if not isinstance(payload, dict):
                raise wrong("the response is no object")
            if said := error_value(payload.get("error")):
                raise ProviderError(f"{self.config.url} returned an error: {said}", replace(details, failure_class=classify(0, None, said)))
            choices = payload.get("choices")
            if not choices:
                raise wrong("the response has no choices")
            text = message_text(choices[0].get("message", {}).get("content"))
            if text is None:
                raise wrong("the message's content has no known shape")
            if not text:
                raise wrong("the message is empty")
            return text

        target = Target(f"{self.config.url}/chat/completions", json.dumps(body).encode(), self.config.token)
        return request(target, decode, details, RetryPolicy(self.config.max_retries, self.config.max_response_bytes), self.config.timeout)

    def json(self, call: JSONCall, decode: Callable[[dict], object] = lambda x: x):
        """What ``decode`` makes of the answer's object; a mismatch may be repaired once by asking again."""
        form = None
        if call.schema and call.schema.strip():
            form = {"type": "json_schema", "json_schema": {"name": "json_response", "schema": json.loads(call.schema)}}
        messages, details = list(call.messages), self._details(len(call.messages))
        repairs = min(1, max(0, call.max_repairs))
        ask = {"role": "user", "content": call.repair_message.strip() or REPAIR}
        for attempt in range(repairs + 1):
            try:
                text = self.text(messages, call.temperature, call.max_tokens, form)
            except ProviderError as e:
                if e.failure_class != SCHEMA or attempt == repairs:
                    raise
                messages.append(ask)
                continue
            try:
                return decode(json.loads(json_object(text)))
            except Exception as e:
                if attempt == repairs:
                    raise ProviderError(f"structured JSON response: {e}", replace(details, failure_class=SCHEMA), 0, e) from e
                messages += [{"role": "assistant", "content": text}, ask]
        raise AssertionError("unreachable")


ANSWERS = "answer string, failure_class string, http_status int, error string"


def _ask(batches: Iterator[pa.RecordBatch], config: Config, prompt: str, names: list[str], options: dict) -> Iterator[pa.RecordBatch]:
    client = Chat(config)
    for batch in batches:
        rows = []
        for x in batch.column(prompt).to_pylist():
            try:
                rows.append((client.text([{"role": "user", "content": x or ""}], **options), None, None, None))
            except ProviderError as e:
                rows.append((None, e.failure_class, e.status or None, str(e)))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.string()))] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int32(), pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + columns, names=names + [x.split()[0] for x in ANSWERS.split(", ")])


def ask(rows: DataFrame, prompt: str, config: Config, **options) -> DataFrame:
    """The rows with the model's answer to each prompt, or the class and text of its failure: one failed call fails no job."""
    names = [c for c in rows.columns if c not in ("answer", "failure_class", "http_status", "error")]
    rows = rows.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(partial(_ask, config=config, prompt=prompt, names=names, options=options), f"{schema}, {ANSWERS}")


def content_texts(content: Column) -> Column:
    """``message_text`` for a column of JSON contents."""
    parts = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: trim_white(F.coalesce(p["text"], F.lit("")))), lambda t: t != ""), "\n")
    plain = F.get_json_object(F.concat(F.lit('{"x":'), content, F.lit("}")), "$.x")
    return F.when(F.trim(content).startswith('"'), trim_white(plain)).when(F.trim(content).startswith("["), joined)


def _json_objects(batches: Iterator[pa.RecordBatch], names: list[str], column: str, out: str) -> Iterator[pa.RecordBatch]:
    def one(x):
        try:
            return json_object(x or "")
        except ValueError:
            return None

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(map(one, batch.column(column).to_pylist()), pa.string())], names=[*names, out])


def json_objects(rows: DataFrame, column: str, out: str = "object") -> DataFrame:
    """The rows with ``json_object`` of a column, null where there is none."""
    names = [c for c in rows.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out)
    return rows.mapInArrow(partial(_json_objects, names=names, column=column, out=out), f"{schema}, `{out}` string")

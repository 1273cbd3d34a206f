"""Recognition services: a stage that sends images and prompts, behind a transport that tests replace.

A *transport* is ``send(url, headers, body, timeout, limit) -> (status, bytes)``. A *client* turns a request into calls of it
and an answer. :func:`transcribe` runs clients over a DataFrame, as :mod:`.calls` says; a row's failure is
a value in ``error``, with secrets masked, and the others go on.
"""

from __future__ import annotations

import base64
import json
import math
import mimetypes
import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import ClassVar

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import ANSWER_PREFIXES, SECRET_PLACES, UPLOAD_NAMES
from .calls import Caller, Calls

MODEL_BYTES, PROMPT_BYTES, REMOTE_MODEL_BYTES = 1 << 10, 1 << 20, 256
IMAGE_BYTES, RESPONSE_BYTES = 50 << 20, 8 << 20
# HTTP statuses and what they mean; others are upstream errors, to be retried from 500 on.
STATUS_KINDS = {401: ("authentication", False), 403: ("authentication", False), 408: ("timeout", True), 504: ("timeout", True), 429: ("rate_limited", True)} | {s: ("invalid_request", False) for s in (400, 404, 405, 409, 413, 422)}


class ServiceError(Exception):
    """Says what went wrong, never with a URL, a credential or a body."""

    def __init__(self, kind: str, status: int = 0, retryable: bool = False):
        super().__init__(f"{kind} (status {status})" if status else kind)
        self.kind, self.status, self.retryable = kind, status, retryable


def error_for_status(status: int) -> ServiceError:
    kind, again = STATUS_KINDS.get(status, ("upstream", status >= 500))
    return ServiceError(kind, status, again)


def mask(text: str) -> str:
    for pattern, to in SECRET_PLACES:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\g<\1>", to), text)
    return text


#: The white space of :data:`~quillspark.functions.text.WS`, and its ``\\s``, which is ASCII.
_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def clean(text: str) -> str:
    """As :func:`~quillspark.functions.text.clean_response`."""
    text = text.strip(_SPACE)
    for prefix in ANSWER_PREFIXES:
        text = re.sub(f"^{prefix}", "", text, count=1, flags=re.IGNORECASE | re.ASCII).strip(_SPACE)
    text = text.strip("\"'")
    if text.startswith("```") and text.endswith("```"):
        text = text.removeprefix("```").removesuffix("```").strip(_SPACE)
    return text


def pretty(text: str) -> str:
    """JSON laid out with two spaces; other texts as they are."""
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False) if text.lstrip()[:1] in ("{", "[") else text
    except ValueError:
        return text


@dataclass(frozen=True)
class Image:
    data: bytes
    media_type: str
    name: str = "image"


@dataclass(frozen=True)
class Request:
    model: str
    prompt: str
    image: Image
    temperature: float = 0.0


@dataclass(frozen=True)
class Answer:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    model: str = ""


def media_type(path: str, data: bytes) -> str:
    """By extension, else by the first bytes."""
    known = mimetypes.guess_type(path)[0]
    if known:
        return known
    for start, kind in ((b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF8", "image/gif"), (b"BM", "image/bmp")):
        if data.startswith(start):
            return kind
    return "image/webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else "application/octet-stream"


def valid_model(model: str) -> bool:
    return bool(model) and model == model.strip() and len(model.encode()) <= MODEL_BYTES and not set("\r\n\0") & set(model)


def validate(request: Request, image_bytes: int = IMAGE_BYTES, needs_model: bool = True) -> None:
    prompt_ok = request.prompt.strip() and len(request.prompt.encode()) <= PROMPT_BYTES and "\0" not in request.prompt
    image = request.image
    image_ok = 0 < len(image.data) <= image_bytes and image.media_type.lower().startswith("image/")
    model_ok = valid_model(request.model) or not (needs_model or request.model)
    if not (model_ok and prompt_ok and request.temperature >= 0 and math.isfinite(request.temperature) and image_ok):
        raise ServiceError("invalid_request")


def endpoint(base: str, *parts: str) -> str:
    """``base`` with path segments added. No credentials, query, fragment, escapes or control characters in ``base``."""
    url = urllib.parse.urlsplit(base)
    if url.scheme not in ("http", "https") or not url.hostname or "@" in url.netloc or url.query or url.fragment or "%" in url.path or any(ord(c) < 33 or ord(c) == 127 for c in base) or base.endswith(("?", "#")):
        raise ServiceError("invalid_request")
    return "/".join([base.rstrip("/"), *(urllib.parse.quote(p, safe="") for p in parts)])


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def http_send(url: str, headers: dict, body: bytes | None, timeout: float, limit: int = RESPONSE_BYTES) -> tuple[int, bytes, dict]:
    """One HTTP call: no redirects, at most ``limit`` bytes of answer."""
    request = urllib.request.Request(url, data=body, headers=headers, method="GET" if body is None else "POST")
    try:
        answer = urllib.request.build_opener(_NoRedirect).open(request, timeout=timeout)
    except urllib.error.HTTPError as e:
        answer = e
    except TimeoutError:
        raise ServiceError("timeout", 0, True) from None
    except OSError as e:
        raise ServiceError("timeout" if "timed out" in str(e) else "transport", 0, True) from None
    with answer:
        data = answer.read(limit + 1)
        if len(data) > limit:
            raise ServiceError("response_too_large", answer.status)
        return answer.status, data, {k.lower(): v for k, v in answer.headers.items()}


def static_header(name: str, value: str) -> Callable[[], dict]:
    """An authenticator; line breaks in a header are refused."""
    if not re.fullmatch(r"[A-Za-z0-9!#$%&'*+.^_`|~-]+", name) or not value or any(ord(c) < 32 or ord(c) == 127 for c in value):
        raise ServiceError("authentication")
    return lambda: {name: value}


def bearer(source: Callable[[], str]) -> Callable[[], dict]:
    return lambda: static_header("Authorization", f"Bearer {source()}")()


class TokenCache:
    """Tokens by audience: fetched once however many ask, renewed two minutes ahead, kept an hour at most, 128 of them."""

    def __init__(self, fetch: Callable[[str], tuple[str, float]], clock: Callable[[], float] = time.time, most: int = 128):
        self.fetch, self.clock, self.most = fetch, clock, most
        self.held: dict[str, tuple[str, float]] = {}
        self.lock = threading.Lock()

    def get(self, audience: str) -> str:
        if not audience or audience != audience.strip() or any(ord(c) < 33 for c in audience):
            raise ServiceError("authentication")
        with self.lock:
            now = self.clock()
            token, until = self.held.get(audience, ("", 0))
            if until <= now:
                token, expires = self.fetch(audience)
                if len(self.held) >= self.most:
                    self.held.pop(min(self.held, key=lambda a: self.held[a][1]))
                self.held[audience] = (token, min(expires - 120, now + 3600))
            return token


def identity_token(audience: str, send: Callable = None, timeout: float = 10.0) -> tuple[str, float]:
    """(token, expiry) for an audience from the machine's metadata service."""
    where = f"http://metadata.google.internal/computeMetadata/v1/instance/service-accounts/default/identity?audience={urllib.parse.quote(audience, safe='')}&format=full"
    status, body, *_ = (send or http_send)(where, {"Metadata-Flavor": "Google"}, None, timeout, 1 << 16)
    token = body.decode("ascii", "replace").strip()
    if status != 200 or token.count(".") != 2:
        raise ServiceError("authentication", status)
    middle = token.split(".")[1]
    try:
        expires = float(json.loads(base64.urlsafe_b64decode(middle + "=" * (-len(middle) % 4)))["exp"])
    except (ValueError, KeyError, TypeError):
        raise ServiceError("authentication") from None
    return token, expires


#: One for each Python worker: whatever the partitions, an audience's token is fetched once there.
TOKENS = TokenCache(identity_token)


def audience_of(base: str) -> str:
    """The audience of a hosted service, '' for services that need no identity."""
    url = urllib.parse.urlsplit(base)
    return f"https://{url.hostname}" if url.scheme == "https" and (url.hostname or "").endswith(".run.app") else ""


def _json(data: bytes):
    try:
        return json.loads(data)
    except ValueError:
        raise ServiceError("invalid_response") from None


@dataclass
class Client:
    """Base of the clients: where, how to sign in, how to send."""

    base: str
    auth: Callable[[], dict] = dict
    send: Callable = http_send
    timeout: float = 120.0
    sleep: Callable[[float], None] = field(default=time.sleep)
    #: Whether a request must name a model; else an empty name leaves the choice to the service.
    needs_model: ClassVar[bool] = True

    def post(self, url: str, body: bytes, kind: str = "application/json", **headers) -> tuple[int, bytes, dict]:
        got = self.send(url, {"Content-Type": kind, **headers, **self.auth()}, body, self.timeout, RESPONSE_BYTES)
        if not 200 <= got[0] < 300:
            raise error_for_status(got[0])
        return got if len(got) == 3 else (*got, {})

    def ask(self, url: str, body: dict):
        return _json(self.post(url, json.dumps(body).encode())[1])

    def extract(self, request: Request) -> Answer:
        raise NotImplementedError

    def cleaned(self, text: str) -> str:
        """What is left of an answer's text; a provider whose answers need other care has its own."""
        return clean(text)

    @staticmethod
    def data(request: Request) -> str:
        return base64.b64encode(request.image.data).decode()


class ChatClient(Client):
    """Chat completions with the image as a data URL."""

    def extract(self, request):
        picture = {"type": "image_url", "image_url": {"url": f"data:{request.image.media_type};base64,{self.data(request)}"}}
        said = [{"role": "user", "content": [{"type": "text", "text": request.prompt}, picture]}]
        x = self.ask(endpoint(self.base, "chat", "completions"), {"model": request.model, "messages": said, "temperature": request.temperature})
        if not x.get("choices"):
            raise ServiceError("invalid_response")
        use = x.get("usage") or {}
        return Answer(self.cleaned(x["choices"][0]["message"].get("content") or ""), use.get("prompt_tokens", 0), use.get("completion_tokens", 0), x.get("model") or request.model)


@dataclass
class PartsClient(Client):
    """Generated content in parts; a cut-off answer is asked for again at other resolutions, four attempts at most."""

    resolution: str = "MEDIA_RESOLUTION_UNSPECIFIED"
    fallback: bool = False

    def extract(self, request):
        order = [self.resolution]
        if self.fallback:
            order += [r for r in ("MEDIA_RESOLUTION_UNSPECIFIED", "MEDIA_RESOLUTION_HIGH", "MEDIA_RESOLUTION_MEDIUM", "MEDIA_RESOLUTION_LOW") if r != self.resolution]
        for resolution in order[:4]:
            answer, reason = self._once(request, resolution)
            if reason != "MAX_TOKENS":
                break
        return answer

    def _once(self, request, resolution):
        parts = [{"text": request.prompt}, {"inline_data": {"mime_type": request.image.media_type, "data": self.data(request)}}]
        config = {"temperature": request.temperature} | ({"mediaResolution": resolution} if resolution else {})
        x = self.ask(endpoint(self.base, "models", f"{request.model}") + ":generateContent", {"contents": [{"parts": parts}], "generationConfig": config})
        if not x.get("candidates"):
            raise ServiceError("invalid_response")
        first, use = x["candidates"][0], x.get("usageMetadata") or {}
        said = (p["text"] for p in (first.get("content") or {}).get("parts") or [] if not p.get("thought") and (p.get("text") or "").strip())
        return Answer(self.cleaned(next(said, "")), use.get("promptTokenCount", 0), use.get("candidatesTokenCount", 0), x.get("modelVersion") or request.model), first.get("finishReason")


class BlocksClient(Client):
    """Messages whose answer is a list of blocks."""

    def extract(self, request):
        picture = {"type": "image", "source": {"type": "base64", "media_type": request.image.media_type or "image/jpeg", "data": self.data(request)}}
        body = {"model": request.model, "max_tokens": 4096, "messages": [{"role": "user", "content": [picture, {"type": "text", "text": request.prompt}]}]}
        x = self.ask(endpoint(self.base, "messages"), body | ({"temperature": request.temperature} if request.temperature > 0 else {}))
        said = [b for b in x.get("content") or [] if b.get("type") == "text"]
        if not said:
            raise ServiceError("invalid_response")
        use = x.get("usage") or {}
        return Answer(self.cleaned(said[0].get("text") or ""), use.get("input_tokens", 0), use.get("output_tokens", 0), x.get("model") or request.model)


class ReadClient(Client):
    """Submit, then poll up to thirty times; no token usage."""

    def extract(self, request):
        _, _, headers = self.post(endpoint(self.base, "vision", "v3.2", "read", "analyze"), request.image.data, "application/octet-stream")
        where = headers.get("operation-location")
        if not where:
            raise ServiceError("invalid_response")
        for _ in range(30):
            self.sleep(1.0)
            status, body, *_ = self.send(where, self.auth(), None, self.timeout, RESPONSE_BYTES)
            x = _json(body) if status == 200 else {}
            if x.get("status") == "succeeded":
                result = x.get("analyzeResult") or {}
                pages, name = (result["readResults"], "text") if "readResults" in result else (result.get("pages") or [], "content")
                return Answer("\n".join(line[name] for p in pages for line in p.get("lines") or [] if isinstance(line.get(name), str)))
            if x.get("status") == "failed":
                raise ServiceError("upstream")
        raise ServiceError("timeout", 0, True)


@dataclass
class GenerateClient(Client):
    """A local model's generate call; a hosted one is signed for with an identity token unless ``auth`` is given."""

    tokens: TokenCache | None = None

    def __post_init__(self):
        audience = audience_of(self.base)
        if audience and self.auth is dict:
            self.auth = bearer(lambda: (self.tokens or TOKENS).get(audience))

    def extract(self, request):
        model = "llava" if request.model in ("", "gpt-4o") else request.model
        x = self.ask(endpoint(self.base, "api", "generate"), {"model": model, "prompt": request.prompt, "images": [self.data(request)], "stream": False, "options": {"temperature": request.temperature}})
        if "response" not in x:
            raise ServiceError("invalid_response")
        return Answer(self.cleaned(x["response"]), x.get("prompt_eval_count", 0), x.get("eval_count", 0), x.get("model") or model)


class RemoteClient(Client):
    """A page service: segments of an image, and the text of one, by its own model unless one is named. Uploads are multipart."""

    needs_model = False

    def _upload(self, where: str, request: Request):
        if len(request.model.encode()) > REMOTE_MODEL_BYTES:
            raise ServiceError("invalid_request")
        edge = uuid.uuid4().hex
        while edge.encode() in request.image.data:
            edge = uuid.uuid4().hex
        name = UPLOAD_NAMES.get(request.image.media_type.lower(), "image.img")
        model = f'--{edge}\r\nContent-Disposition: form-data; name="model"\r\n\r\n{request.model}\r\n' if request.model else ""
        head = f'{model}--{edge}\r\nContent-Disposition: form-data; name="image"; filename="{name}"\r\nContent-Type: {request.image.media_type}\r\n\r\n'
        body = head.encode() + request.image.data + f"\r\n--{edge}--\r\n".encode()
        return _json(self.post(endpoint(self.base, "v1", where), body, f"multipart/form-data; boundary={edge}")[1])

    def segment(self, request: Request, most: int = 100_000) -> list[dict]:
        x = self._upload("segment", request)
        words = x.get("words") or []
        good = all(w["X"] >= 0 and w["Y"] >= 0 and w["Width"] > 0 and w["Height"] > 0 and 0 <= w.get("Confidence", 0) <= 1 for w in words)
        if not (x.get("provider") or "").strip() or len(words) > most or not good:
            raise ServiceError("invalid_response")
        return words

    def extract(self, request):
        x = self._upload("transcribe", request)
        if not (x.get("provider") or "").strip() or not isinstance(x.get("text"), str):
            raise ServiceError("invalid_response")
        return Answer(x["text"])


class Registry:
    """Clients' factories by name, whatever its case."""

    def __init__(self):
        self.made: dict[str, Callable[..., Client]] = {}

    def register(self, name: str, factory: Callable[..., Client]) -> None:
        self.made[name.lower()] = factory

    def has(self, name: str) -> bool:
        return name.lower() in self.made

    def get(self, name: str) -> Callable[..., Client]:
        if not self.has(name):
            raise KeyError(f"unknown provider {name}; there are {', '.join(self.names())}")
        return self.made[name.lower()]

    def names(self) -> list[str]:
        return sorted(self.made)


REGISTRY = Registry()
for _name, _client in (("openai", ChatClient), ("gemini", PartsClient), ("claude", BlocksClient), ("azure", ReadClient), ("ollama", GenerateClient), ("remote", RemoteClient)):
    REGISTRY.register(_name, _client)
# Model of a provider if none is named.
DEFAULT_MODELS = {"openai": "gpt-4o", "gemini": "gemini-pro", "claude": "claude-sonnet", "azure": "azure-ocr", "ollama": "llava"}


def transcribe(images: DataFrame, make: Callable[[], Client], model: str, prompt: str, temperature: float = 0.0, path: str = "path", content: str = "content", calls: Calls = Calls()) -> DataFrame:
    """(path, text, input_tokens, output_tokens, error) for each image. ``make`` builds a client, once for each thread of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(make, calls)

        def one(row: tuple) -> tuple:
            where, data = row[0], bytes(row[1] or b"")
            try:
                request = Request(model, prompt, Image(data, media_type(where or "", data), (where or "").rsplit("/", 1)[-1]), temperature)
                validate(request, needs_model=caller.client.needs_model)
                a = caller.extract(request)
                return where, a.text, a.input_tokens, a.output_tokens, None
            except Exception as e:  # one row's failure
                return where, None, 0, 0, mask(f"{getattr(e, 'kind', type(e).__name__)}: {e}")

        for batch in batches:
            out = list(caller.each(one, zip(batch[path], batch[content], strict=True)))
            yield pd.DataFrame(out, columns=["path", "text", "input_tokens", "output_tokens", "error"])

    return images.select(path, content).mapInPandas(run, "path string, text string, input_tokens int, output_tokens int, error string")


def segment(images: DataFrame, make: Callable[[], RemoteClient], model: str, path: str = "path", content: str = "content", calls: Calls = Calls()) -> DataFrame:
    """(path, number, x, y, w, h, text, confidence, error): the boxes that a page service finds in each image, in its order.

    A failed image gives one row with ``error`` and no box; one without boxes gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(make, calls)

        def one(row: tuple) -> list[tuple]:
            where, data = row[0], bytes(row[1] or b"")
            try:
                request = Request(model, "segment", Image(data, media_type(where or "", data)))
                validate(request, needs_model=caller.client.needs_model)
                return [(where, i, w["X"], w["Y"], w["Width"], w["Height"], w.get("Text") or "", float(w.get("Confidence", 0)), None) for i, w in enumerate(caller.segment(request), 1)]
            except Exception as e:  # one row's failure
                return [(where, None, None, None, None, None, None, None, mask(f"{getattr(e, 'kind', type(e).__name__)}: {e}"))]

        for batch in batches:
            out = [box for boxes in caller.each(one, zip(batch[path], batch[content], strict=True)) for box in boxes]
            names = ["path", "number", "x", "y", "w", "h", "text", "confidence", "error"]
            yield pd.DataFrame(out, columns=names).astype({c: "Int32" for c in names[1:6]})

    return images.select(path, content).mapInPandas(run, "path string, number int, x int, y int, w int, h int, text string, confidence double, error string")


WORD_PROMPT = "Transcribe the text in this picture. Give the text alone, with its capitals and punctuation; give a space if nothing can be read."
RETRY_PROMPT = "Give the characters that can be seen in this picture, even if they are unclear, and nothing else."
LINE_PROMPT = "Transcribe this line of text from left to right. Give the text alone."


def transcribe_word(client: Client, request: Request, attempts: int = 3) -> str:
    """Up to three attempts, the later ones with a simpler prompt; blank answers and apologies don't count. '' if all fail."""
    last: Exception | None = None
    for k in range(attempts):
        try:
            text = client.extract(Request(request.model, WORD_PROMPT if k == 0 else RETRY_PROMPT, request.image, request.temperature)).text.strip()
            last = None
            if text and not re.search("sorry|can't", text, re.IGNORECASE):
                return text
        except ServiceError as e:
            last = e
    if last:
        raise last
    return ""


def transcribe_line(client: Client, line: Request, words: list[Request]) -> list[str]:
    """Texts of a line's words: one call for the line, or one for each word if that fails or there is only one."""
    if len(words) > 1:
        try:
            said = client.extract(Request(line.model, LINE_PROMPT, line.image, line.temperature)).text.split()
            share, more = divmod(len(said), len(words))
            at = [i * share + min(i, more) for i in range(len(words) + 1)]
            return [" ".join(said[a:b]) for a, b in zip(at, at[1:])]
        except ServiceError:
            pass
    out = []
    for w in words:
        try:
            out.append(transcribe_word(client, w))
        except ServiceError:
            out.append("")
    return out

"""Pictures and vectors over HTTP: a guarded GET, and embedding backends with a JSON interface."""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin
from urllib.request import HTTPRedirectHandler, Request, build_opener

from samefold.sources.embedding import BATCH, EmbeddingError, ProviderInfo, check_url

MAX_BODY, MAX_HOPS, TIMEOUT = 10 << 20, 5, 10.0
BUSY, TRIES, WAIT = (429, 503), 3, 0.5


class _Stay(HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def _open(url: str, timeout: float, data: bytes | None = None, headers: dict | None = None):
    """Status, headers and a reader of the body; redirects aren't followed."""
    try:
        r = build_opener(_Stay).open(Request(url, data=data, headers=headers or {}), timeout=timeout)
    except HTTPError as e:
        r = e
    return r.status, r.headers, r.read


def fetch_picture(url: str, allowed_hosts: tuple[str, ...] = (), cap: int = MAX_BODY, timeout: float = TIMEOUT, opened: Callable = _open, checked: Callable = check_url) -> bytes:
    """The bytes behind a url. Every hop is checked anew, the body is read up to `cap`, and the answer
    must call itself a picture. ValueError for anything else. Urls from requests get no allowed hosts."""
    for _ in range(MAX_HOPS):
        checked(url, allowed_hosts)
        status, headers, read = opened(url, timeout)
        if status in (301, 302, 303, 307, 308) and headers.get("Location"):
            url = urljoin(url, headers["Location"])
            continue
        if status != 200:
            raise ValueError(f"HTTP {status}")
        if not (headers.get("Content-Type") or "").lower().startswith("image/"):
            raise ValueError("the answer isn't a picture")
        body = read(cap + 1)
        if len(body) > cap:
            raise ValueError(f"the picture is over {cap} bytes")
        return body
    raise ValueError("too many redirects")


class HostedProvider:
    """A backend that takes a list of pictures as JSON and answers {data: [{index, embedding}], model}.
    Settings: url, model, dim, api_key, timeout, allowed_hosts, concurrency, input (the body's field)."""

    def __init__(self, settings: dict, opened: Callable = _open, sleep: Callable = time.sleep):
        self.settings, self._opened, self._sleep = settings, opened, sleep
        self.model, self.dim = settings["model"], int(settings["dim"])

    def payload(self, images: list[bytes]) -> dict:
        inline = [f"data:image/png;base64,{base64.b64encode(x).decode()}" for x in images]
        return {"model": self.model, self.settings.get("input", "input"): inline}

    def _post(self, images: list[bytes]) -> dict:
        url, key = self.settings["url"], self.settings.get("api_key")
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        try:
            check_url(url, tuple(self.settings.get("allowed_hosts", ())))
            for k in range(TRIES):
                status, _, read = self._opened(url, float(self.settings.get("timeout", 30)), json.dumps(self.payload(images)).encode(), headers)
                if status == 200:
                    return json.loads(read())
                if status not in BUSY:
                    raise EmbeddingError(f"the backend answered HTTP {status}")
                if k + 1 < TRIES:
                    self._sleep(WAIT * 2**k)
        except (URLError, OSError, ValueError) as e:
            raise EmbeddingError(f"the backend can't be used: {e}") from e
        raise EmbeddingError(f"the backend was still busy after {TRIES} tries")

    @staticmethod
    def _ordered(body: dict) -> list[list[float]]:
        """By the index that each vector names; answers come in any order."""
        try:
            return [r["embedding"] for r in sorted(body["data"], key=lambda r: r.get("index", 0))]
        except (KeyError, TypeError, AttributeError) as e:
            raise EmbeddingError(f"the answer has another shape: {e}") from e

    def _batch(self, images: list[bytes]) -> list[list[float]]:
        vectors = self._ordered(self._post(images))
        if len(vectors) != len(images) or any(len(v) != self.dim for v in vectors):
            raise EmbeddingError("wrong number or length of vectors")
        return vectors

    def embed_images(self, images: list[bytes]) -> list[list[float]]:
        parts = [images[k : k + BATCH] for k in range(0, len(images), BATCH)]
        if len(parts) < 2:
            return self._batch(parts[0]) if parts else []
        with ThreadPoolExecutor(int(self.settings.get("concurrency", 2))) as pool:
            return [v for vectors in pool.map(self._batch, parts) for v in vectors]

    def info(self) -> ProviderInfo:
        """What the backend really answers to a tiny picture."""
        from samefold.operators.images import probe

        body = self._post([probe()])
        return ProviderInfo(body.get("model") or self.model, len(self._ordered(body)[0]))

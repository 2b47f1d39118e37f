"""The plug-in surface for picture embeddings, and the policy for remote pictures."""

from __future__ import annotations

import importlib
import ipaddress
import socket
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 64


class EmbeddingError(RuntimeError):
    """A backend failed; the rows stay without a vector."""


class EmbeddingDisabled(EmbeddingError):
    """There is no backend."""


@dataclass(frozen=True)
class ProviderInfo:
    model: str
    dim: int


class EmbeddingProvider(Protocol):
    def embed_images(self, images: list[bytes]) -> list[list[float]]: ...

    def info(self) -> ProviderInfo: ...


class NoProvider:
    def embed_images(self, images: list[bytes]) -> list[list[float]]:
        raise EmbeddingDisabled("no embedding backend is configured")

    def info(self) -> ProviderInfo:
        return ProviderInfo("none", 0)


def make_provider(settings: dict) -> EmbeddingProvider:
    """'none', 'hosted', or the dotted path of a class that takes the settings."""
    name = settings.get("provider", "none")
    if name == "none":
        return NoProvider()
    if name == "hosted":
        name = "samefold.sources.hosted.HostedProvider"
    module, _, attr = name.rpartition(".")
    try:
        return getattr(importlib.import_module(module), attr)(settings)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"unknown embedding provider {name!r}") from e


def dimension_problem(info: ProviderInfo, dim: int) -> str:
    return "" if info.dim in (0, dim) else f"the backend gives {info.dim} numbers, the table holds {dim}"


def embed(images: DataFrame, make: Callable[[], EmbeddingProvider], model_id: str, dim: int) -> DataFrame:
    """kind, ref, image_vec, vec_model from (kind, ref, content). A batch that fails, or vectors of
    another length, give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                try:
                    vectors = provider.embed_images(part.column(2).to_pylist())
                    if len(vectors) != part.num_rows or any(len(v) != dim for v in vectors):
                        raise EmbeddingError("wrong number or length of vectors")
                except EmbeddingError:
                    vectors = [None] * part.num_rows
                models = [model_id if v is not None else None for v in vectors]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(vectors, pa.list_(pa.float32())), pa.array(models, pa.string())], ["kind", "ref", "image_vec", "vec_model"])

    return images.select("kind", "ref", "content").mapInArrow(run, "kind string, ref string, image_vec array<float>, vec_model string")


def check_url(url: str, allowed_hosts: tuple[str, ...] = (), resolve: Callable[[str], list[str]] | None = None) -> str:
    """The url, if it is http(s), has a host, and the host is allowed or has public addresses only."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise ValueError(f"scheme {parts.scheme!r} isn't allowed")
    host = parts.hostname
    if not host:
        raise ValueError("the url has no host")
    if host in allowed_hosts:
        return url
    found = (resolve or (lambda h: [a[4][0] for a in socket.getaddrinfo(h, None)]))(host)
    if not found or any(not ipaddress.ip_address(a.split("%")[0]).is_global for a in found):
        raise ValueError(f"host {host!r} isn't public")
    return url

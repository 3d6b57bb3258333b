"""Providers: injectable models and fetchers, run batch by batch on the executors.

Each has a deterministic offline default. A provider is a factory called once for each task; what it returns maps a list
of inputs to a list of outputs. Failures are retried, then give a null and a reason, never a lost row.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list], list]
DIMENSION = 384


def hashed_embedder(dimension: int = DIMENSION) -> Callable[[], Provider]:
    """Counts of hashed words, of unit length: the offline stand-in for a sentence model."""

    def make() -> Provider:
        def embed(texts: list) -> list:
            out = np.zeros((len(texts), dimension), np.float32)
            for row, t in zip(out, texts, strict=True):
                for w in (t or "").lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                    row[h % dimension] += 1 if h >> 63 else -1
                n = float(np.linalg.norm(row))
                if n:
                    row /= n
            return out.tolist()

        return embed

    return make


def overlap_reranker() -> Provider:
    """Scores of (query, text) pairs: the share of the query's words that the text has."""

    def score(pairs: list) -> list:
        return [len(q & t) / max(1, len(q)) for q, t in ((set((a or "").lower().split()), set((b or "").lower().split())) for a, b in pairs)]

    return score


def retried(provider: Provider, attempts: int = 3, waits: tuple[float, ...] = (1.0, 2.0), sleep: Callable[[float], None] = time.sleep) -> Callable[[list], tuple[list, str | None]]:
    """The provider's outputs and None, or nulls and the last error."""

    def call(inputs: list) -> tuple[list, str | None]:
        error = None
        for i in range(attempts):
            try:
                out = provider(inputs)
                if len(out) != len(inputs):
                    raise ValueError(f"{len(out)} outputs for {len(inputs)} inputs")
                return out, None
            except Exception as e:  # noqa: BLE001  a provider is foreign code; its failure is a value here
                error = f"{type(e).__name__}: {e}"
                if i + 1 < attempts:
                    sleep(waits[min(i, len(waits) - 1)])
        return [None] * len(inputs), error

    return call


def provided(df: DataFrame, column: str, to: str, kind: str, factory: Callable[[], Provider], batch: int = 16, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """df with what a provider makes of a column, and the error where it failed (null: none)."""
    kept = [c for c in df.columns if c not in (to, f"{to}_error")]
    step = batch * max(1, 256 // batch)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retried(factory(), sleep=sleep)
        for frame in frames:
            for at in range(0, len(frame), step):
                # Outputs may be many times as large as inputs: a piece goes out before the next is asked for.
                f, values, errors = frame.iloc[at : at + step], [], []
                inputs = f[column].tolist()
                for i in range(0, len(inputs), batch):
                    out, error = call(inputs[i : i + batch])
                    values += out
                    errors += [error] * len(out)
                yield f[kept].assign(**{to: values, f"{to}_error": errors})

    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in df.select(*kept).schema]
    return df.mapInPandas(work, ", ".join([*fields, f"`{to}` {kind}", f"`{to}_error` string"]))


def public_destination(url: str | None, resolve: Callable[[str], list[str]] | None = None) -> bool:
    """http or https, default ports, no user in it, and only public addresses behind the host."""
    try:
        u = urlsplit(url or "")
        port = u.port
    except ValueError:
        return False
    if u.scheme not in ("http", "https") or not u.hostname or u.username or u.password or port not in (None, 80, 443):
        return False
    try:
        addresses = [str(ipaddress.ip_address(u.hostname))]
    except ValueError:
        if re.fullmatch(r"(?i)(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+))*\.?", u.hostname):
            return False  # another way to write an address
        addresses = resolve(u.hostname) if resolve else []
        if resolve and not addresses:
            return False
    return all(ipaddress.ip_address(a).is_global for a in addresses) and u.hostname != "localhost"


def fetcher(get: Callable[[str], bytes], resolve: Callable[[str], list[str]] | None = None, most_bytes: int = 2_000_000) -> Callable[[], Provider]:
    """(page, reason) of public destinations by an injected getter; without a page for others and beyond most_bytes."""

    def one(url: str | None) -> dict:
        if not public_destination(url, resolve):
            return {"page": None, "reason": "not a public destination"}
        body = get(url)
        if len(body) > most_bytes:
            return {"page": None, "reason": f"over {most_bytes} bytes"}
        return {"page": body.decode("utf-8", "replace"), "reason": None}

    def make() -> Provider:
        def fetch(urls: list) -> list:
            return [one(u) for u in urls]

        return fetch

    return make


def replies(df: DataFrame, prompt: str, factory: Callable[[], Provider], stage: str, price_in: float, price_out: float, batch: int = 16, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """df with a language model's reply to a prompt, and the call's telemetry: stage, tokens of both, cost and error.

    Tokens are counted as words where the provider tells none: what it returns is a text, or a dict of text and usage.
    """
    def make() -> Provider:
        ask = factory()

        def call(prompts: list) -> list:
            out = []
            for p, r in zip(prompts, ask(prompts), strict=True):
                r = r if isinstance(r, dict) else {"text": r}
                out.append({"text": r["text"], "tokens_in": int(r.get("tokens_in", len((p or "").split()))), "tokens_out": int(r.get("tokens_out", len((r["text"] or "").split())))})
            return out

        return call

    made = provided(df, prompt, "call", "struct<text: string, tokens_in: bigint, tokens_out: bigint>", make, batch, sleep)
    cost = (F.col("call.tokens_in") * price_in + F.col("call.tokens_out") * price_out) / 1e6
    return made.select(*[c for c in df.columns], F.lit(stage).alias("stage"), F.col("call.text").alias("reply"), F.col("call.tokens_in").alias("tokens_in"), F.col("call.tokens_out").alias("tokens_out"), cost.alias("cost"), F.col("call_error").alias("error"))

"""Monthly archives over HTTP: addresses, retries and ranged downloads as plain functions, and a Spark data source over them."""

from __future__ import annotations

import io
import random
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from http.client import HTTPException

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Bytes of the first request; what is larger is fetched in ranges.
RANGED_FROM = 16 << 10
RETRIED = frozenset({429, 500, 502, 503, 504})


@dataclass(frozen=True)
class Reply:
    status: int
    body: bytes = b""
    headers: dict | None = None


#: Fetches (url, headers); raises OSError when no reply comes.
Fetch = Callable[[str, dict], Reply]


def archive_url(base: str, symbol: str, kind: str, month: str, freq: str | None = None) -> str:
    """Address of a month's archive: kind is klines (with freq) or fundingRate."""
    middle = f"{symbol}/{freq}/{symbol}-{freq}-{month}" if freq else f"{symbol}/{symbol}-{kind}-{month}"
    return f"{base.rstrip('/')}/monthly/{kind}/{middle}.zip"


def months(first: str, last: str) -> list[str]:
    y, m = map(int, first.split("-"))
    out = []
    while f"{y:04d}-{m:02d}" <= last:
        out.append(f"{y:04d}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def header(reply: Reply, name: str) -> str | None:
    return next((str(v).strip() for k, v in (reply.headers or {}).items() if k.lower() == name.lower()), None)


def cut_short(reply: Reply) -> bool:
    """Fewer bytes than the reply said it had."""
    said = header(reply, "Content-Length")
    return reply.status in (200, 206) and said is not None and said.isdigit() and len(reply.body) < int(said)


def wait_seconds(attempt: int, reply: Reply | None, rng: random.Random, base: float = 0.5, most: float = 30.0) -> float:
    """Exponential with jitter; a server's Retry-After is kept up to ``most``."""
    try:
        asked = float(header(reply, "Retry-After") or "nan") if reply else float("nan")
    except ValueError:  # a date
        asked = float("nan")
    if asked == asked:
        return max(0.0, min(asked, most))
    return min(base * 2**attempt, most) * (0.5 + rng.random() / 2)


def get(fetch: Fetch, url: str, headers: dict | None = None, tries: int = 5, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> Reply:
    """A reply that is not worth another try; raises when all were in vain. No reply, one cut short and one of RETRIED are tried again."""
    rng, failure = random.Random(seed), None
    for attempt in range(tries):
        try:
            reply = fetch(url, headers or {})
        except (OSError, HTTPException) as e:
            reply, failure = None, e
        if reply is not None and cut_short(reply):
            reply, failure = None, OSError(f"{url}: {len(reply.body)} bytes of {header(reply, 'Content-Length')}")
        if reply is not None and reply.status not in RETRIED:
            return reply
        if attempt + 1 < tries:
            sleep(wait_seconds(attempt, reply, rng))
    raise OSError(f"{url}: no usable reply in {tries} tries") from failure


def download(fetch: Fetch, url: str, size: int | None = None, threads: int = 8, **options) -> bytes | None:
    """An archive's bytes, in ranges put together by place when it is large; None when there is none.

    Where the size isn't known, the first range's reply tells it; a server that has no ranges sends the whole.
    """
    head = b""
    if not size:
        reply = get(fetch, url, {"Range": f"bytes=0-{RANGED_FROM - 1}"}, **options)
        total = re.search(r"/(\d+)$", header(reply, "Content-Range") or "")
        if reply.status == 206 and total:
            head, size = reply.body, int(total[1])
            if len(head) != min(RANGED_FROM, size):
                raise OSError(f"{url}: the first bytes came back wrong")
        elif reply.status in (206, 416):
            reply = get(fetch, url, **options)
    elif size <= RANGED_FROM:
        reply = get(fetch, url, **options)
    if not head and (not size or size <= RANGED_FROM):
        if reply.status == 404:
            return None
        if reply.status != 200:
            raise OSError(f"{url}: status {reply.status}")
        return reply.body
    step = max(1, -(-(size - len(head)) // threads))
    spans = [(a, min(a + step, size) - 1) for a in range(len(head), size, step)]
    with ThreadPoolExecutor(threads) as pool:
        replies = list(pool.map(lambda s: get(fetch, url, {"Range": f"bytes={s[0]}-{s[1]}"}, **options), spans))
    for (a, b), reply in zip(spans, replies, strict=True):
        if reply.status != 206 or len(reply.body) != b - a + 1:
            raise OSError(f"{url}: bytes {a} to {b} came back wrong")
    return head + b"".join(r.body for r in replies)


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of a zip archive whose checksums hold; one that is damaged or has no files raises."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if not z.namelist():
                raise OSError("an archive without files")
            if (bad := z.testzip()) is not None:
                raise OSError(f"damaged member {bad}")
            for name in z.namelist():
                yield name, z.read(name)
    except zipfile.BadZipFile as e:
        raise OSError(f"no archive: {e}") from e


def http_fetch(url: str, headers: dict) -> Reply:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:  # noqa: S310
            return Reply(r.status, r.read(), dict(r.headers))
    except urllib.error.HTTPError as e:
        return Reply(e.code, b"", dict(e.headers))


class _Month(InputPartition):
    def __init__(self, symbol: str, month: str):
        super().__init__((symbol, month))


class ArchiveSource(DataSource):
    """``spark.read.format("bar_archive")``: lines of monthly archives, a partition for each symbol and month.

    Options: base, symbols (comma-joined), first, last, kind, freq. With pushdown=true, which needs
    spark.sql.python.filterPushdown.enabled, equalities and lists on symbol and month decide what is asked of the server.
    """

    fetch: Fetch = staticmethod(http_fetch)

    @classmethod
    def name(cls) -> str:
        return "bar_archive"

    def schema(self) -> str:
        return "symbol string, month string, file string, line_no long, line string"

    def reader(self, schema) -> DataSourceReader:
        chosen = _FilteredReader if self.options.get("pushdown") == "true" else _Reader
        return chosen(dict(self.options), type(self).fetch)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.options, self.fetch = options, fetch
        self.wanted: dict[str, set | None] = {"symbol": None, "month": None}

    def partitions(self) -> list[InputPartition]:
        inside = lambda column, value: self.wanted[column] is None or value in self.wanted[column]
        named = [s for s in self.options["symbols"].split(",") if inside("symbol", s)]
        return [_Month(s, m) for s in named for m in months(self.options["first"], self.options["last"]) if inside("month", m)] or [_Month("", "")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        symbol, month = partition.value
        if not symbol:
            return
        url = archive_url(self.options["base"], symbol, self.options.get("kind", "klines"), month, self.options.get("freq"))
        data = download(self.fetch, url)
        for name, content in members(data) if data is not None else ():
            for i, line in enumerate(content.decode("utf-8", "replace").splitlines()):
                yield symbol, month, name, i, line


class _FilteredReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in self.wanted:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = values if self.wanted[column] is None else self.wanted[column] & values

"""HTTP for data sources: retries with backoff, rate limits, range reads that resume."""

from __future__ import annotations

import io
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import BinaryIO

AGAIN = {401, 403, 429, *range(500, 600)}


class RateLimiter:
    """At most per_second calls pass in this process; give each task its share of a cluster's rate."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.lock, self.free = 1 / per_second, clock, sleep, threading.Lock(), 0.0

    def wait(self):
        with self.lock:
            now = self.clock()
            at = max(now, self.free)
            self.free = at + self.gap
        if at > now:
            self.sleep(at - now)


def request(url: str, headers: dict | None = None, method: str = "GET", retries: int = 6, limiter: RateLimiter | None = None, backoff: float = 10.0, timeout: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """An open response. Refusals that may pass (AGAIN) and broken connections are tried again, each time after twice the wait."""
    for k in range(1 + retries):
        if limiter is not None:
            limiter.wait()
        try:
            return urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}, method=method), timeout=timeout)
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or k == retries:
                raise
        except OSError:
            if k == retries:
                raise
        sleep(backoff * 2**k)


def get_range(url: str, first: int, end: int, **options) -> bytes:
    """Bytes [start, end)."""
    headers = {"Range": "bytes=%d-%d" % (first, end - 1)} | (options.pop("headers", None) or {})
    with request(url, headers, **options) as r:
        data = r.read()
        return data if r.status == 206 else data[first:end]


class RangeFile(io.RawIOBase):
    """A seekable remote file."""

    def __init__(self, url: str, **options):
        self.url, self.options, self.at = url, options, 0
        with request(url, method="HEAD", **options) as r:
            self.size = int(r.headers["Content-Length"])

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.at

    def seek(self, offset, whence=io.SEEK_SET):
        self.at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence])
        return self.at

    def readinto(self, into):
        end = min(self.size, self.at + len(into))
        if end <= self.at:
            return 0
        data = get_range(self.url, self.at, end, **self.options)
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


class ResumingStream(io.RawIOBase):
    """A remote file read once from front to back; a broken connection goes on at the last byte."""

    def __init__(self, url: str, retries: int = 6, backoff: float = 10.0, sleep: Callable[[float], None] = time.sleep, **options):
        self.url, self.retries, self.backoff, self.sleep, self.options = url, retries, backoff, sleep, options
        self.at, self.left, self.response = 0, retries, None
        self._open()

    def readable(self):
        return True

    def _open(self):
        headers = {"Range": f"bytes={self.at}-"} if self.at else {}
        self.response = request(self.url, headers, retries=self.retries, backoff=self.backoff, sleep=self.sleep, **self.options)
        if self.at and self.response.status != 206:
            self.response.read(self.at)
        length = self.response.headers.get("Content-Length")
        self.end = (self.at if self.response.status == 206 else 0) + int(length) if length else None

    def readinto(self, into):
        while True:
            try:
                data = self.response.read(len(into))
                if not data and self.end is not None and self.at < self.end:
                    raise ConnectionError("the body broke off")
            except OSError:
                if not self.left:
                    raise
                self.left -= 1
                self.sleep(self.backoff)
                self._open()
                continue
            into[: len(data)] = data
            self.at += len(data)
            return len(data)

    def close(self):
        if (held := self.response) is not None:
            held.close()
        super().close()


def open_any(path: str, **options) -> BinaryIO:
    """A local or mounted path, a file: URL, or an http(s) URL, for reading."""
    if re.match("https?://", path):
        return io.BufferedReader(ResumingStream(path, **options), 1 << 20)
    return open(path.removeprefix("file://"), "rb")

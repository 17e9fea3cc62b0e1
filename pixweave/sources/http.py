"""Pages and images over HTTP, as tables.

A fetch gives a row (url, final_url, status_code, content_type, content_disposition, body, error, attempts); snapshots
with these columns stand in for it, and everything downstream takes either.
"""

from __future__ import annotations

import email.utils
import http.client
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from http.cookiejar import CookieJar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESPONSES = "url string, final_url string, status_code int, content_type string, content_disposition string, body binary, error string, attempts int"
RETRIED = (408, 429, 500, 502, 503, 504)
ATTEMPTS, REDIRECTS, TIMEOUT, LONGEST_WAIT = 3, 10, 30.0, 10.0
MAX_IMAGE = 500 * 1024 * 1024
#: The reference run reads pages whole; this bounds what one answer may take on the driver.
MAX_PAGE = 1 << 30


def retried(status: Column) -> Column:
    """Statuses after which another attempt is made."""
    return status.isin(*RETRIED)


def retry_after(header: str | None, now: float | None = None) -> float | None:
    """Seconds to wait by a Retry-After header: a number from 0, or a date that lies ahead."""
    text = (header or "").strip()
    if text.isascii() and text.isdigit():
        return float(text)
    try:
        when = email.utils.parsedate_to_datetime(text).timestamp()
    except (TypeError, ValueError):
        return None
    wait = when - (time.time() if now is None else now)
    return wait if wait > 0 else None


def pause(attempt: int, header: str | None = None) -> float:
    """Seconds before the next attempt: what the server asks for, up to 10, else 200 and 400 ms with up to 100 ms more."""
    asked = retry_after(header)
    return min(asked, LONGEST_WAIT) if asked else 0.1 * 2**attempt + random.uniform(0, 0.1)


def escaped(url: str) -> str:
    """The URL as it goes over the wire: a host in its ASCII form, other characters outside ASCII and white space as escaped UTF-8."""
    parts = urllib.parse.urlsplit(url.strip())
    host = parts.netloc
    if not host.isascii():
        user, at, name = host.rpartition("@")
        host = user + at + name.encode("idna").decode()
    kept = "%/:?#[]@!$&'()*+,;=~"
    return urllib.parse.urlunsplit((parts.scheme, host, *(urllib.parse.quote(x, safe=kept) for x in parts[2:])))


@dataclass
class Client:
    """One session: cookies, headers, redirects. ``referer`` is the run's first page; ``cookies`` may come from an earlier session."""

    referer: str = ""
    timeout: float = TIMEOUT
    sleep: Callable[[float], None] = time.sleep
    agent: str = "Mozilla/5.0 (compatible; pixweave)"
    cookies: CookieJar = field(default_factory=CookieJar)

    def __post_init__(self):
        redirects = urllib.request.HTTPRedirectHandler()
        redirects.max_redirections = REDIRECTS
        self.opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(self.cookies), redirects)

    def get(self, url: str, image: bool = False, limit: int = MAX_IMAGE) -> tuple:
        """A row of ``RESPONSES``. A body longer than ``limit`` is an error; at most one byte more is read."""
        if not url.lower().startswith(("http://", "https://")):
            return url, None, None, None, None, None, "unsupported scheme", 0
        try:
            request_url = escaped(url)
        except (ValueError, UnicodeError) as e:
            return url, None, None, None, None, None, f"invalid URL: {e}", 0
        accept = "image/avif,image/webp,image/*,*/*;q=0.8" if image else "text/html,application/xhtml+xml,*/*;q=0.8"
        request = urllib.request.Request(request_url, headers={"User-Agent": self.agent, "Accept": accept} | ({"Referer": self.referer} if self.referer else {}))
        status, error = None, ""
        for attempt in range(1, ATTEMPTS + 1):
            header = None
            try:
                with self.opener.open(request, timeout=self.timeout) as r:
                    body = r.read(limit + 1)
                    if len(body) > limit:
                        return url, r.url, r.status, None, None, None, "body exceeds the size limit", attempt
                    return url, r.url, r.status, r.headers.get("Content-Type"), r.headers.get("Content-Disposition"), body, None, attempt
            except urllib.error.HTTPError as e:
                status, error, header = e.code, f"HTTP {e.code}", e.headers.get("Retry-After")
                e.close()
                if e.code not in RETRIED:
                    break
            except (OSError, ValueError, http.client.HTTPException) as e:
                status, error = None, str(e) or type(e).__name__
            if attempt < ATTEMPTS:
                self.sleep(pause(attempt, header))
        return url, None, status, None, None, None, error, attempt


def fetch(urls: DataFrame, image: bool = False, referer: str = "", limit: int = MAX_IMAGE, tasks: int | None = None, cookies: tuple = ()) -> DataFrame:
    """The answers to the distinct URLs in the first column. Each is fetched once; ``tasks`` bounds what runs at a time.

    Every task has a session of its own, which begins with ``cookies``.
    """
    url = urls.columns[0]
    wanted = urls.select(url).filter(F.col(url).isNotNull()).distinct()
    wanted = wanted.repartition(tasks) if tasks else wanted
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int32())
    names = [c.split()[0] for c in RESPONSES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(referer)
        for cookie in cookies:
            client.cookies.set_cookie(cookie)
        for batch in batches:
            for one in batch.column(0).to_pylist():  # a batch per body, as these are large
                row = client.get(one, image, limit)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return wanted.mapInArrow(run, RESPONSES)

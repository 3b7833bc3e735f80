"""Read-only object stores: local folders, HTTP, object stores by their HTTP interface, and replayed responses.

Every call gives a plain observation (status, body, headers or an error text); what it proves is
decided by ``observed``: a confirmed 404 is absence, any other failure is unknown.
"""

from __future__ import annotations

import bisect
import http.client
import itertools
import json
import os
import random
import re
import time
import urllib.parse
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree
from xml.sax.saxutils import escape

RETRIED = (408, 429, 500, 502, 503, 504)
RANGE = re.compile(r"\s*bytes (\d+)-(\d+)/(\d+|\*)\s*", re.IGNORECASE)
HREF = re.compile(r'href="([^"?][^"]*)"', re.IGNORECASE)


class Response:
    def __init__(self, status: int, body: bytes = b"", headers: dict | None = None):
        self.status, self.body = status, body
        self.headers = {k.lower(): v for k, v in (headers or {}).items()}


class StoreError(Exception):
    """A failed access; its text names the status or the kind of failure."""


def delay(attempt: int, base: float = 0.5, cap: float = 30.0, retry_after: str | None = None, now: float | None = None) -> float:
    """Seconds before the next try: Retry-After if given (seconds or a date), else doubling with jitter."""
    if retry_after:
        try:
            return min(cap, max(0.0, float(retry_after)))
        except ValueError:
            try:
                return min(cap, max(0.0, parsedate_to_datetime(retry_after).timestamp() - (time.time() if now is None else now)))
            except (TypeError, ValueError):
                pass
    return random.uniform(0, min(cap, base * 2**attempt))


def checked_range(r: Response, start: int, length: int) -> bytes:
    """The bytes asked for, or why they aren't: a 206 must name exactly the range."""
    if r.status == 200:
        part = r.body[start : start + length]
    elif r.status == 206:
        m = RANGE.fullmatch(r.headers.get("content-range", ""))
        if not m or int(m[1]) != start or int(m[2]) != start + length - 1 or (m[3] != "*" and int(m[3]) <= int(m[2])):
            raise StoreError("invalid Content-Range")
        part = r.body
    else:
        raise StoreError("404 Not Found" if r.status == 404 else f"HTTP {r.status}")
    if len(part) != length:
        raise StoreError("short ranged GET")
    return part


def checked_suffix(r: Response, length: int) -> bytes:
    """The last bytes; the total must be known, as the end can't be told otherwise."""
    if r.status == 200:
        part = r.body[-length:]
    elif r.status == 206:
        m = RANGE.fullmatch(r.headers.get("content-range", ""))
        if not m or m[3] == "*" or int(m[2]) != int(m[3]) - 1 or int(m[1]) != int(m[3]) - length:
            raise StoreError("invalid Content-Range")
        part = r.body
    else:
        raise StoreError("404 Not Found" if r.status == 404 else f"HTTP {r.status}")
    if len(part) != length:
        raise StoreError("short suffix GET")
    return part


class HttpStore:
    """Plain HTTP. A store keeps its connections: one for each host, opened again if the host closed it."""

    def __init__(self, base: str, timeout: float = 120.0, tries: int = 5, max_rps: float = 0.0):
        self.base, self.timeout, self.tries = base.rstrip("/"), timeout, tries
        self.pause, self.last = (1 / max_rps if max_rps else 0.0), 0.0
        self.open: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def send(self, method: str, url: str, headers: dict) -> Response:
        """One exchange; redirections are followed."""
        for _ in range(6):
            u = urllib.parse.urlsplit(url)
            host = (u.scheme, u.netloc)
            again = host in self.open
            if not again:
                kind = http.client.HTTPSConnection if u.scheme == "https" else http.client.HTTPConnection
                self.open[host] = kind(u.netloc, timeout=self.timeout)
            line = (u.path or "/") + ("?" + u.query if u.query else "")
            try:
                self.open[host].request(method, line, headers=headers)
                got = self.open[host].getresponse()
                body = got.read()
            except (http.client.HTTPException, OSError) as e:
                self.open.pop(host).close()
                # a kept connection that the host has closed meanwhile is no failure
                if again and isinstance(e, (http.client.RemoteDisconnected, ConnectionResetError, BrokenPipeError)):
                    continue
                if isinstance(e, http.client.HTTPException):
                    raise ConnectionError(f"{type(e).__name__}: {e}") from e
                raise
            if got.status not in (301, 302, 303, 307, 308) or not got.headers.get("Location"):
                return Response(got.status, body, dict(got.headers))
            url = urllib.parse.urljoin(url, got.headers["Location"])
        raise StoreError("too many redirections")

    def url(self, path: str, query: dict | None = None) -> str:
        return f"{self.base}/{urllib.parse.quote(path.lstrip('/'))}" + ("?" + urllib.parse.urlencode(query) if query else "")

    def request(self, method: str, path: str, headers: dict | None = None, query: dict | None = None) -> Response:
        for attempt in range(self.tries):
            time.sleep(max(0.0, self.last + self.pause - time.monotonic()) if self.pause else 0)
            self.last = time.monotonic()
            try:
                r = self.send(method, self.url(path, query), {"Accept-Encoding": "identity", "User-Agent": "plumbline", **(headers or {})})
                if r.status not in RETRIED or attempt + 1 == self.tries:
                    return r
                time.sleep(delay(attempt, retry_after=r.headers.get("retry-after")))
            except (TimeoutError, OSError) as e:
                if attempt + 1 == self.tries:
                    raise StoreError("timeout" if "timed out" in str(e) or isinstance(e, TimeoutError) else f"connection: {e}") from e
                time.sleep(delay(attempt))
        raise StoreError("no try left")

    def list(self, path: str) -> list[str]:
        r = self.request("GET", path.rstrip("/") + "/")
        if r.status != 200:
            raise StoreError("404 Not Found" if r.status == 404 else f"HTTP {r.status}")
        names = (urllib.parse.unquote(h) for h in HREF.findall(r.body.decode("utf-8", "replace")) if "#" not in h and not re.match(r"[a-zA-Z][\w+.-]*:|/|\.\.", h))
        return sorted(dict.fromkeys(names))


class ReplayStore(HttpStore):
    """Answers from a table of routes: path to {status, text, json, hex, headers or raise}, or to such
    answers by method, and these by the range asked for."""

    def __init__(self, routes: dict, default: int = 404):
        super().__init__("", tries=1)
        self.routes, self.default = routes, default

    def request(self, method: str, path: str, headers: dict | None = None, query: dict | None = None) -> Response:
        r = self.routes.get(path.strip("/"), self.routes.get(path, {"status": self.default}))
        r = r.get(method, r)
        r = r.get((headers or {}).get("Range"), r)
        if "raise" in r:
            raise StoreError(r["raise"])
        body = bytes.fromhex(r["hex"]) if "hex" in r else json.dumps(r["json"]).encode() if "json" in r else r.get("text", "").encode()
        return Response(r.get("status", 200), b"" if method == "HEAD" else body, {"Content-Length": str(len(body)), **r.get("headers", {})})


def asked(headers: dict | None, size: int) -> tuple[int, int] | None:
    """Start and end (exclusive) of the range that is asked for, within an object of ``size`` bytes."""
    m = re.fullmatch(r"bytes=(\d*)-(\d*)", (headers or {}).get("Range", ""))
    if not m:
        return None
    if not m[1]:
        return max(0, size - int(m[2])), size
    return int(m[1]), min(size, int(m[2]) + 1 if m[2] else size)


def ranged(body: bytes, span: tuple[int, int], size: int) -> Response:
    """What a server that knows ranges answers."""
    if span[0] >= span[1]:
        return Response(416, b"", {"Content-Range": f"bytes */{size}"})
    return Response(206, body, {"Content-Range": f"bytes {span[0]}-{span[1] - 1}/{size}", "Content-Length": str(len(body))})


class PlantedStore:
    """Objects given by path, answered like a server that knows ranges; ``faults`` gives a status
    instead. Without a suffix range (``suffixes=False``) it refuses those."""

    def __init__(self, objects: dict[str, bytes], faults: dict[str, int] | None = None, suffixes: bool = True):
        self.objects, self.faults, self.suffixes = objects, faults or {}, suffixes
        self.order: list[str] | None = None

    def request(self, method: str, path: str, headers: dict | None = None, query: dict | None = None) -> Response:
        path = path.strip("/")
        if query and query.get("list-type") == "2":
            return self.page(query)
        if path in self.faults:
            return Response(self.faults[path])
        body = self.objects.get(path)
        if body is None:
            return Response(404)
        if method == "HEAD":
            return Response(200, b"", {"Content-Length": str(len(body))})
        if not self.suffixes and (headers or {}).get("Range", "").startswith("bytes=-"):
            return Response(501)
        span = asked(headers, len(body))
        return Response(200, body, {"Content-Length": str(len(body))}) if span is None else ranged(body[span[0] : span[1]], span, len(body))

    def page(self, query: dict) -> Response:
        """A page of keys in order, as object stores give it. A fault at a prefix denies it where it is asked for."""
        prefix, mark, most = query.get("prefix", ""), query.get("delimiter", ""), int(query.get("max-keys", 1000))
        if prefix.rstrip("/") in self.faults:
            return Response(self.faults[prefix.rstrip("/")])
        after = query.get("continuation-token") or query.get("start-after", "")
        entries: dict[str, int | None] = {}
        if self.order is None or len(self.order) != len(self.objects):
            self.order = sorted(self.objects)
        first = max(bisect.bisect_left(self.order, prefix), bisect.bisect_right(self.order, after))
        for key in itertools.islice(self.order, first, None):
            if not key.startswith(prefix):
                break
            if mark and after.endswith(mark) and key.startswith(after):
                continue
            cut = key.find(mark, len(prefix)) if mark else -1
            entries.setdefault(key if cut < 0 else key[: cut + len(mark)], len(self.objects[key]) if cut < 0 else None)
            if len(entries) > most:
                break
        shown = list(entries.items())[:most]
        more = len(entries) > most
        quoted = lambda k: escape(urllib.parse.quote(k))
        body = "".join(f"<Contents><Key>{quoted(k)}</Key><Size>{n}</Size></Contents>" if n is not None else f"<CommonPrefixes><Prefix>{quoted(k)}</Prefix></CommonPrefixes>" for k, n in shown)
        token = f"<NextContinuationToken>{escape(shown[-1][0])}</NextContinuationToken>" if more else ""
        return Response(200, f'<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><IsTruncated>{str(more).lower()}</IsTruncated>{token}{body}</ListBucketResult>'.encode())

    def list(self, path: str) -> list[str]:
        path = path.strip("/")
        if path in self.faults:
            raise StoreError(f"HTTP {self.faults[path]}")
        under = path + "/" if path else ""
        names = {n[len(under) :] for n in self.objects if n.startswith(under)}
        if not names:
            raise StoreError("404 Not Found")
        return sorted({n.partition("/")[0] + "/" * ("/" in n) for n in names})


class LocalStore:
    """A folder; paths can't leave it. Hidden files are seen, unlike by Spark's file readers."""

    def __init__(self, base: str):
        self.base = os.path.realpath(base.removeprefix("file://"))

    def place(self, path: str) -> str:
        full = os.path.realpath(os.path.join(self.base, path.lstrip("/")))
        if full != self.base and not full.startswith(self.base + os.sep):
            raise StoreError("path leaves the store")
        return full

    def request(self, method: str, path: str, headers: dict | None = None) -> Response:
        try:
            full = self.place(path)
            if os.path.isdir(full):
                return Response(404)
            size = os.path.getsize(full)
            if method == "HEAD":
                return Response(200, b"", {"Content-Length": str(size)})
            with open(full, "rb") as f:
                span = asked(headers, size)
                if span is None:
                    return Response(200, f.read(), {"Content-Length": str(size)})
                f.seek(span[0])
                return ranged(f.read(span[1] - span[0]), span, size)
        except (FileNotFoundError, NotADirectoryError):
            return Response(404)
        except OSError as e:
            raise StoreError(f"connection: {e}") from e

    def list(self, path: str) -> list[str]:
        full = self.place(path)
        if not os.path.isdir(full):
            raise StoreError("404 Not Found")
        return sorted(n + "/" * os.path.isdir(os.path.join(full, n)) for n in os.listdir(full))


class RecordedStore(HttpStore):
    """A server's pages kept in a folder: ``index.html`` is a folder's listing, and a file ``.status``
    holds the status that the server gave for it instead."""

    def __init__(self, base: str):
        super().__init__("", tries=1)
        self.folder = LocalStore(base.removeprefix("recorded:"))

    def request(self, method: str, path: str, headers: dict | None = None, query: dict | None = None) -> Response:
        folder = self.folder.place(path)
        if os.path.isdir(folder):
            status = self.folder.request("GET", f"{path.strip('/')}/.status")
            if status.status == 200:
                return Response(int(status.body))
            path = f"{path.strip('/')}/index.html"
        return self.folder.request(method, path, headers)


class S3Store(HttpStore):
    """An object store by its plain HTTP interface, without an account: ``s3://bucket/prefix``. The
    endpoint is an option or ``AWS_ENDPOINT_URL_S3``."""

    def __init__(self, base: str, endpoint: str | None = None, **options):
        bucket, _, self.prefix = base.removeprefix("s3://").rstrip("/").partition("/")
        endpoint = (endpoint or os.environ.get("AWS_ENDPOINT_URL_S3") or "https://s3.amazonaws.com").rstrip("/")
        super().__init__(f"{endpoint}/{bucket}", **options)

    def url(self, path: str, query: dict | None = None) -> str:
        if query:  # a listing is asked of the bucket, below this store's prefix
            return super().url("", {k: f"{self.prefix}/{v}" if self.prefix and k in ("prefix", "start-after") and (v or k == "prefix") else v for k, v in query.items()})
        return super().url(f"{self.prefix}/{path.lstrip('/')}" if self.prefix else path)

    def list(self, path: str) -> list[str]:
        under = path.strip("/") + "/" if path.strip("/") else ""
        names = [name[len(under) :] for keys, folders, _ in listed_pages(self, under, delimiter="/") for name in [k for k, _ in keys] + folders]
        if not names:
            raise StoreError("404 Not Found")
        return sorted({n for n in names if n})


def listed_pages(store, prefix: str, after: str = "", delimiter: str = "", size: int = 1000, pages: int | None = None) -> Iterator[tuple[list[tuple[str, int]], list[str], bool]]:
    """(keys with sizes, common prefixes, whether more follows) page after page, in the order of keys."""
    own = f"{store.prefix}/" if getattr(store, "prefix", "") else ""
    token = None
    while pages is None or pages > 0:
        pages = None if pages is None else pages - 1
        query = {"list-type": "2", "prefix": prefix, "max-keys": str(size), "encoding-type": "url"}
        query |= {"delimiter": delimiter} if delimiter else {}
        query |= {"continuation-token": token} if token else {"start-after": after} if after else {}
        r = store.request("GET", "", None, query)
        if r.status != 200:
            raise StoreError("404 Not Found" if r.status == 404 else f"HTTP {r.status}")
        try:
            doc = ElementTree.fromstring(r.body)
        except ElementTree.ParseError as e:
            raise StoreError(f"listing is no XML: {e}") from e
        for node in doc.iter():
            node.tag = node.tag.rpartition("}")[2]
        name = lambda text: urllib.parse.unquote(text or "")[len(own) :]
        keys = [(name(c.findtext("Key")), int(c.findtext("Size") or 0)) for c in doc.findall("Contents")]
        more = doc.findtext("IsTruncated") == "true"
        token = doc.findtext("NextContinuationToken")
        if more and not token:
            raise StoreError("listing is cut without a token")
        yield keys, [name(c.findtext("Prefix")) for c in doc.findall("CommonPrefixes")], more
        if not more:
            return


def head(store, path: str) -> Response:
    """Whether an object is there, and its size. Where HEAD is refused or gives no length, a range of
    one byte tells both."""
    r = store.request("HEAD", path)
    if r.status != 405 and not (r.status == 200 and "content-length" not in r.headers):
        return r
    r = store.request("GET", path, {"Range": "bytes=0-0"})
    total = r.headers.get("content-range", "").rpartition("/")[2]
    return Response(r.status if r.status >= 400 else 200, b"", {"Content-Length": total} if total.isdigit() else {})


def trailing(store, path: str, length: int) -> bytes:
    """The last bytes of an object, such as a shard's index. A server that refuses suffix ranges is
    asked for the size and then for that range; an object smaller than that is named as such."""
    r = store.request("GET", path, {"Range": f"bytes=-{length}"})
    if r.status == 416:
        raise StoreError("object smaller than its index")
    if r.status not in (400, 405, 501):
        # a server answers a suffix that is longer than the object with all of it
        total = r.headers.get("content-range", "").rpartition("/")[2]
        if r.status == 206 and total.isdigit() and int(total) < length:
            raise StoreError("object smaller than its index")
        return checked_suffix(r, length)
    r = head(store, path)
    if r.status >= 400:
        raise StoreError("404 Not Found" if r.status == 404 else f"HTTP {r.status}")
    if "content-length" not in r.headers:
        raise StoreError("size unknown")
    start = int(r.headers["content-length"]) - length
    if start < 0:
        raise StoreError("object smaller than its index")
    return checked_range(store.request("GET", path, {"Range": f"bytes={start}-{start + length - 1}"}), start, length)


def open_store(base: str, replay: str | None = None, **options):
    """The store for a base: replayed routes, an object store, recorded pages, HTTP, or a folder."""
    if replay:
        return ReplayStore(json.loads(replay))
    if base.startswith("s3://"):
        return S3Store(base, **options)
    if base.startswith("recorded:"):
        return RecordedStore(base)
    return HttpStore(base, **options) if base.startswith(("http://", "https://")) else LocalStore(base)


def observe(store, op: str, path: str, start: int = 0, length: int = 0) -> dict:
    """One access as a row; failures are rows too."""
    row = {"path": path, "op": op, "state": "PRESENT", "reason": None, "status": None, "size": None, "body": None, "entries": None, "error": None}
    try:
        if op == "list":
            row["entries"] = store.list(path)
            return row
        if op == "suffix":
            row["body"] = trailing(store, path, length)
            return row
        headers = {"Range": f"bytes={start}-{start + length - 1}"} if op == "range" else {}
        r = head(store, path) if op == "head" else store.request("GET", path, headers)
        row["status"] = r.status
        row["size"] = int(r.headers["content-length"]) if "content-length" in r.headers and r.status < 400 else None
        if op == "range":
            row["body"] = checked_range(r, start, length)
        elif r.status >= 400:
            raise StoreError("404 Not Found" if r.status == 404 else f"HTTP {r.status}")
        elif op in ("get", "json"):
            row["body"] = r.body
            if op == "json":
                try:
                    json.loads(r.body)
                except ValueError:
                    row["reason"] = "METADATA_UNREADABLE"
    except StoreError as e:
        row["error"] = str(e)
        row["state"] = "ABSENT" if "404" in str(e) else "UNKNOWN"
    return row

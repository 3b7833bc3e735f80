"""Listings: pages of object stores, connections, and crawls that are resumed."""

import http.server
import random
import threading
from urllib.parse import parse_qs, unquote, urlsplit

import pytest

from plumbline.operators import crawl
from plumbline.sources import listing, transport
from plumbline.sources.transport import HttpStore, PlantedStore, S3Store, StoreError, listed_pages


def random_keys(seed, n=60):
    rnd = random.Random(seed)
    return {"/".join(rnd.choice(("a", "b", "a-", "a0", "b b", "é", "zz", "0", "&<")) for _ in range(rnd.randrange(1, 5))) for _ in range(n)}


@pytest.fixture(scope="module")
def server():
    """An object store with buckets of keys, and pages of links, on one port; it counts connections."""
    stores = {"bucket": PlantedStore({k: k.encode() for k in random_keys(1)} | {"deep/" + k: b"x" for k in random_keys(2)})}

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        connections, calls = set(), 0

        def answer(self):
            type(self).calls += 1
            self.connections.add(self.client_address)
            u = urlsplit(self.path)
            bucket, _, key = unquote(u.path).strip("/").partition("/")
            query = {k: v[0] for k, v in parse_qs(u.query).items()}
            if bucket == "moved":
                r = transport.Response(302, b"", {"Location": "/bucket/" + key})
            elif bucket == "close":
                r = transport.Response(200, b"bye", {})
                self.close_connection = True
            else:
                r = stores[bucket].request(self.command, key, dict(self.headers), query) if bucket in stores else transport.Response(404)
            self.send_response(r.status)
            for k, v in r.headers.items():
                if k != "content-length":
                    self.send_header(k, v)
            self.send_header("Content-Length", r.headers.get("content-length", str(len(r.body))))
            self.end_headers()
            self.wfile.write(r.body)

        do_GET = do_HEAD = answer

        def log_message(self, *_):
            pass

    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", stores, Handler
    httpd.shutdown()


def test_one_connection_serves_many_calls(server):
    base, stores, handler = server
    store = HttpStore(base + "/bucket", tries=1)
    handler.connections.clear()
    key = sorted(stores["bucket"].objects)[0]
    for _ in range(20):
        assert store.request("GET", key).body == stores["bucket"].objects[key]
    assert transport.checked_range(store.request("GET", key, {"Range": "bytes=0-0"}), 0, 1) == stores["bucket"].objects[key][:1]
    assert store.request("GET", "no such").status == 404 and store.request("HEAD", key).status == 200
    assert len(handler.connections) == 1
    assert HttpStore(base + "/moved", tries=1).request("GET", key).body == stores["bucket"].objects[key]
    closing = HttpStore(base + "/close", tries=1)
    assert [closing.request("GET", "").body for _ in range(3)] == [b"bye"] * 3  # opened again
    with pytest.raises(StoreError, match="connection"):
        HttpStore("http://127.0.0.1:9", tries=1).request("GET", "x")


def test_object_store_by_http(server):
    base, stores, _ = server
    keys = stores["bucket"].objects
    store = S3Store("s3://bucket", endpoint=base, tries=1)
    assert [k for page in listed_pages(store, "", size=7) for k, _ in page[0]] == sorted(keys)
    below = S3Store("s3://bucket/deep", endpoint=base, tries=1)
    assert [k for page in listed_pages(below, "a", size=3) for k, _ in page[0]] == sorted(k[5:] for k in keys if k.startswith("deep/a"))
    assert below.list("") == sorted({k[5:].partition("/")[0] + "/" * ("/" in k[5:]) for k in keys if k.startswith("deep/")})
    assert below.request("GET", "a").status in (200, 404) and store.request("HEAD", sorted(keys)[-1]).status == 200
    with pytest.raises(StoreError, match="404"):
        store.list("nothing here")
    with pytest.raises(StoreError):
        list(listed_pages(S3Store("s3://none", endpoint=base, tries=1), ""))


@pytest.mark.parametrize("seed", range(60))
def test_any_split_gives_the_same_keys(seed):
    rnd = random.Random(seed)
    keys = random_keys(seed, rnd.randrange(0, 80))
    store, size, pages = PlantedStore(dict.fromkeys(keys, b"x")), rnd.randrange(1, 6), rnd.randrange(1, 4)
    got, work = [], [("", "")]
    while work:
        for row in listing.listed_part(store, *work.pop(), size, pages):
            assert row["kind"] != "error"
            got.append(row["key"]) if row["kind"] == "key" else work.append((row["key"], row["after"]))
    assert sorted(got) == sorted(keys)


def test_rounds_in_spark(spark):
    rows = [(f"s{i}", "", dict.fromkeys(random_keys(i), b"yy"), {"a": 403} if i == 3 else {}) for i in range(5)]
    df = spark.createDataFrame(rows, "store string, key string, objects map<string, binary>, faults map<string, int>")
    found = listing.all_keys(df, size=2, pages=1).collect()
    for name, _, objects, faults in rows:
        got = sorted(r.key for r in found if r.store == name and r.kind == "key")
        errors = [r for r in found if r.store == name and r.kind == "error"]
        if not faults:
            assert got == sorted(objects) and not errors
        else:  # what was refused is said, and nothing else is missing
            assert errors and all(r.error == "HTTP 403" and r.key == "a/" for r in errors)
            assert set(objects) - set(got) == {k for k in objects if k.startswith("a/") and k not in got} and set(got) <= set(objects)
            assert {k for k in objects if not k.startswith("a/")} <= set(got)


def site(tmp_path, tree, refused=()):
    for path, names in tree.items():
        (tmp_path / path).mkdir(parents=True, exist_ok=True)
        (tmp_path / path / "index.html").write_text('<a href="../">up</a>' + "".join(f'<a href="{n}">{n}</a>' for n in names))
    for path, status in refused:
        (tmp_path / path / ".status").write_text(str(status))


TREE = {
    "": ["vol/", "paths/", ".git/", "12_3/", "readme.txt", "bad/", "half/"],
    "vol": ["one.zarr/", "plain/", "seg.tifxyz/"],
    "vol/plain": [".zgroup", "0/"],
    "paths": ["20240101-seg/", "named/"],
    "paths/20240101-seg": ["x.tif"],
    "paths/named": ["x.tif", "y.tif", "z.tif", "inner/"],
    "paths/named/inner": ["deep/"],
    "paths/named/inner/deep": ["deeper/"],
    "bad": ["hidden/"],
    "half": ["x.tif", "y.tif"],
}


def steps(found):
    return {r.path: (r.depth, r.step, r.state, r.reason) for r in found.collect()}


def test_crawl_and_what_becomes_of_folders(spark, tmp_path):
    site(tmp_path / "site", TREE, [("bad", 405)])
    base = f"recorded:{tmp_path}/site"
    got = steps(crawl.crawl_store(spark, base, str(tmp_path / "c"), max_depth=3))
    fine = ("PRESENT", None)
    assert got == {
        "": (0, "folder", *fine), "vol": (1, "folder", *fine), "paths": (1, "folder", *fine), ".git": (1, "skipped", *fine), "12_3": (1, "coordinate", *fine),
        "bad": (1, "unlisted", "UNKNOWN", "LISTING_UNSUPPORTED"), "half": (1, "folder", *fine),
        "vol/one.zarr": (2, "root", *fine), "vol/plain": (2, "root", *fine), "vol/seg.tifxyz": (2, "surface", *fine), "paths/20240101-seg": (2, "timestamp", *fine),
        "paths/named": (2, "surface", *fine), "paths/named/inner": (3, "folder", *fine), "paths/named/inner/deep": (4, "deep", *fine),
    }
    wider = steps(crawl.crawl_store(spark, base, str(tmp_path / "d"), segments=True, leaves=True, prefixes=("paths", "/vol/")))
    assert wider["paths/20240101-seg"][1] == "folder" and wider["vol/seg.tifxyz"] == (1, "unlisted", "ABSENT", "NOT_FOUND") and "" not in wider


def test_crawl_goes_on_where_it_was_killed(spark, tmp_path):
    site(tmp_path / "site", TREE)
    base, folder = f"recorded:{tmp_path}/site", str(tmp_path / "c")
    whole = steps(crawl.crawl_store(spark, base, str(tmp_path / "whole")))
    (tmp_path / "site" / "paths" / ".status").write_text("no number")  # the job of depth 1 dies
    with pytest.raises(Exception):
        crawl.crawl_store(spark, base, folder)
    (tmp_path / "site" / "paths" / ".status").unlink()
    (tmp_path / "site" / "index.html").write_text("changed: must not be read again")
    assert steps(crawl.crawl_store(spark, base, folder)) == whole

"""Readers, writers, archives, pools, ranges, HTTP."""

import gzip
import http.server
import json
import threading

import pytest
import zstandard
from pyspark.sql import functions as F

from corpusmill.sources import crawl, readers, warc, writers
from corpusmill.sources import http as web


def record(kind, content, **headers):
    lines = [f"WARC-Type: {kind}", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()], f"Content-Length: {len(content)}"]
    return gzip.compress(b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n")


def response(url, body, kind="text/html; charset=utf-8", extra="", ident="1", **headers):
    content = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n{extra}\r\n".encode() + (body if isinstance(body, bytes) else body.encode())
    return record("response", content, WARC_Target_URI=url, WARC_Record_ID=f"<urn:{ident}>", WARC_Date="2026-01-01T00:00:00Z", **headers)


def test_jsonl(spark, tmp_path):
    (tmp_path / "d").mkdir()
    lines = [{"id": 5, "url": "u", "text": "one"}, {"text": ""}, "{broken", {"text": "two", "score": 0.5}, {"id": "x"}]
    with gzip.open(tmp_path / "d" / "a.jsonl.gz", "wt") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n\n")
    docs, bad = readers.read_jsonl(spark, str(tmp_path), "text string, id string, url string, score double", defaults={"kind": "web"})
    got = {r.text: r for r in docs.collect()}
    assert set(got) == {"one", "two"} and got["one"].id == "5" and got["two"].id.startswith("d/a.jsonl.gz/") and got["two"].score == 0.5 and got["one"].kind == "web"
    assert [(r.file, r.line) for r in bad.collect()] == [("d/a.jsonl.gz", "{broken")]
    assert readers.read_jsonl(spark, str(tmp_path), "text string", limit=1)[0].count() == 1


def test_parquet(spark, tmp_path):
    rows = spark.createDataFrame([("a", "u0", {"k": "m"}), ("", "u1", {"k": "m"}), ("b", None, {"k": None})], "content string, url string, metadata struct<k:string>").coalesce(1)
    rows.write.parquet(str(tmp_path / "p"))
    docs = readers.read_parquet(spark, str(tmp_path / "p"), text="content", defaults={"k": "default", "z": 1})
    got = {r.text: r for r in docs.collect()}
    assert set(got) == {"a", "b"} and got["a"].id.endswith("/0") and got["b"].id.endswith("/2") and (got["a"].k, got["b"].k, got["b"].url, got["a"].z) == ("m", "default", None, 1)
    narrow = readers.read_parquet(spark, str(tmp_path / "p"), text="content", metadata=False)
    assert narrow.columns == ["text", "id"] and "url" not in narrow._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    both = readers.with_upstream(docs, spark.createDataFrame([("c", "9")], "text string, id string"))
    assert both.count() == 3 and readers.with_upstream(None, docs) is docs


def test_writers(spark, tmp_path):
    docs = spark.createDataFrame([("a", "1", "", "en", None), ("b", "2", "u", "de", 0.5)], "text string, id string, url string, language string, score double")
    writers.write_jsonl(docs, str(tmp_path / "j"), by=["language"])
    lines = [json.loads(x) for p in sorted((tmp_path / "j").glob("language=*/*.gz")) for x in gzip.open(p, "rt")]
    assert lines == [{"id": "2", "metadata": {"url": "u", "score": 0.5}, "text": "b"}, {"id": "1", "metadata": {}, "text": "a"}]
    writers.write_parquet(docs, str(tmp_path / "q"), schema={"text": "string", "id": "string", "url": "string", "language": "string", "score": "double", "more": "int"})
    assert spark.read.parquet(str(tmp_path / "q")).columns[-1] == "more"
    with pytest.raises(ValueError):
        writers.write_parquet(docs, str(tmp_path / "r"), schema={"text": "string"})
    mixed = tmp_path / "m"
    docs.write.parquet(str(mixed / "a"))
    writers.write_jsonl(docs, str(mixed / "b"))
    for p in (mixed / "b").glob("*.json.gz"):
        p.rename(p.with_name(p.name.replace(".json.gz", ".jsonl.gz")))
    assert readers.read_documents(spark, str(mixed)).count() == 4
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        readers.read_documents(spark, str(tmp_path / "none"))
    counts = writers.build_preview(docs, {"short": docs.limit(1).withColumn("filter_reason", F.lit("x"))}, str(tmp_path / "v"), "T")
    assert counts == {"kept": 2, "removed_short": 1} and "| kept | 2 |" in writers.card(counts, "T")
    row = spark.read.parquet(str(tmp_path / "v" / "kept")).orderBy("id").first()
    assert row.text == "a" and json.loads(row.metadata) == {}


def test_warc(spark, tmp_path):
    meta = json.dumps({"n": 2, "languages": [{"code": c} for c in ("te", "en")]})
    parts = [
        record("warcinfo", b"x"), response("http://a/1", "<p>é", ident="1", extra="X-Robots-Tag: noai\r\nServer: s\r\n"), record("metadata", f"languages-cld2: {meta}\r\n".encode(), WARC_Concurrent_To="<urn:1>"),
        response("http://a/2", b"\x89PNG", "image/png", ident="2"), response("http://a/3", "<p>\xe9t\xe9 caf\xe9 na\xefve".encode("latin-1"), ident="3"), response("http://a/4", "x", "text/plain", ident="4", WARC_Identified_Payload_Type="application/xhtml+xml"),
        response("http://a/5", b"5\r\n<p>ch\r\n2\r\nnk\r\n0\r\n\r\n", ident="5", extra="Transfer-Encoding: chunked\r\n"), response("http://a/6", gzip.compress(b"<p>zip"), ident="6", extra="Content-Encoding: gzip\r\n"),
    ]
    (tmp_path / "good.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(parts)[:-30])
    (tmp_path / "plain.warc").write_bytes(b"".join(map(gzip.decompress, parts)))
    paths = [str(p) for p in tmp_path.glob("*.warc*")]
    rows = warc.read_warc(spark, paths).collect()
    of = lambda name: {r.url: r for r in rows if r.file == name and not r.truncated}
    good = of("good.warc.gz")
    assert sorted(good) == [f"http://a/{k}" for k in (1, 3, 4, 5, 6)] == sorted(of("plain.warc")) and sorted(of("cut.warc.gz")) == sorted(good)[:-1]
    assert [r.file for r in rows if r.truncated] == ["cut.warc.gz"]
    assert good["http://a/1"].http_headers == {"x-robots-tag": "noai"} and good["http://a/5"].html == "<p>chnk" and good["http://a/6"].html == "<p>zip" and "t" in good["http://a/3"].html
    tagged = {r.url: r.cld2_languages for r in warc.read_warc(spark, [str(tmp_path / "good.warc.gz")], cld2=True).collect()}
    assert tagged["http://a/1"] == ["te", "en"] and tagged["http://a/3"] == []
    assert warc.read_warc_files(spark, str(tmp_path)).where("not truncated").count() == 14


def test_pool(spark, tmp_path):
    guess = lambda lang, p: {"lang": [lang, "x"], "prob": [p, 0.01]}
    metas = [{"u": "u0", "id": "i0", "openlid-v3": guess("tel_Telu", 0.9)}, {"u": "u1", "openlid-v3": guess("tel_Telu", 0.4)}, {"u": "u2", "openlid-v3": guess("eng_Latn", 0.9)}, {"u": "u3", "openlid-v3": guess("tel_Telu", 0.8), "allowed": False}, {"u": "u4", "ts": "d", "openlid-v3": guess("tel_Telu", 0.7)}]
    (tmp_path / "b1").mkdir()
    pack = lambda rows: zstandard.compress("".join(json.dumps(r) + "\n" for r in rows).encode())
    (tmp_path / "b1" / "metadata.zst").write_bytes(pack(metas))
    (tmp_path / "b1" / "text.zst").write_bytes(pack([{"text": f"t{k}"} for k in range(5)]))
    rows = crawl.read_pool(spark, ["b1"], str(tmp_path), "tel_Telu").collect()
    assert [(r.id, r.text, r.allowed) for r in rows] == [("i0", "t0", True), ("b1/3", "t3", False), ("b1/4", "t4", True)]
    assert [r.text for r in crawl.read_pool(spark, ["b1"], str(tmp_path), "tel_Telu", text=False).collect()] == [None] * 3
    (tmp_path / "b1" / "text.zst").write_bytes(pack([{"text": "short"}]))
    with pytest.raises(Exception, match="zip|shorter|argument"):
        crawl.read_pool(spark, ["b1"], str(tmp_path), "tel_Telu").collect()


def test_index_selection(spark):
    rows = [("c1", "h", "tel,eng", "text/html", "f1", 0, 5, "u"), ("c1", "h", "eng,tel", None, "f2", 5, 5, "u"), ("c1", "h", None, None, "f1", 0, 1, "u"), ("c2", "h", "tel", None, "f9", 0, 1, "u"), ("c2", "h", "eng", None, "f9", 0, 1, "u")]
    index = spark.createDataFrame(rows, "crawl string, url_host_name string, content_languages string, content_mime_detected string, warc_filename string, warc_record_offset long, warc_record_length long, url string")
    chosen = crawl.select_language(index, "tel")
    assert sorted(r.primary for r in chosen.collect()) == [False, True, True]
    summary = crawl.selection_summary(chosen)
    compared = {r.crawl: (r.matched, r.published, r.difference) for r in crawl.compare_counts(summary, spark.createDataFrame([("c1", 4)], "crawl string, count long")).collect()}
    assert compared == {"c1": (2, 4, -0.5), "c2": (1, None, None)}
    assert crawl.select_language(index, "zzz").count() == 0 and "primary" in crawl.select_language(index, "zzz").columns
    listing = gzip.compress(b"a/crawl=X/subset=warc/p1.parquet\na/crawl=X/subset=robotstxt/p2.parquet\n")
    assert crawl.index_files(listing) == ["a/crawl=X/subset=warc/p1.parquet"] and crawl.crawl_of(crawl.index_files(listing)[0]) == "X"


def test_ranges(spark, tmp_path):
    assert crawl.coalesce([(0, 10), (15, 5), (100, 10), (12, 2)], max_gap=5) == [(0, 20, [(0, 10), (12, 2), (15, 5)]), (100, 110, [(100, 10)])]
    assert [s[:2] for s in crawl.coalesce([(0, 10), (10, 10), (20, 10)], max_bytes=20)] == [(0, 20), (20, 30)] and crawl.coalesce([]) == []
    parts = [gzip.compress(f"record {k}".encode()) for k in range(4)]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(parts))
    at, rows = 0, []
    for p in parts:
        rows.append(("f.warc.gz", at, len(p)))
        at += len(p)
    selection = spark.createDataFrame([*rows, ("f.warc.gz", 1, 9), (None, 1, 2)], "warc_filename string, warc_record_offset long, warc_record_length long")
    requests = crawl.plan_requests(selection)
    assert requests.count() == 1
    got = crawl.fetch_records(requests, str(tmp_path), 1000, 2).collect()
    assert sorted(gzip.decompress(r.record) for r in got if r.ok) == [f"record {k}".encode() for k in range(4)] and sum(not r.ok for r in got) == 1
    islands = crawl.gap_islands(spark.createDataFrame([("f", 0, 10), ("f", 12, 2), ("f", 40, 1), ("g", 0, 1)], "f string, o long, n long"), "f", "o", "n", 5)
    assert sorted(map(tuple, islands.collect())) == [("f", 0, 14, 2), ("f", 40, 41, 1), ("g", 0, 1, 1)]


def test_robots_archive_and_lists(spark, tmp_path):
    robots = lambda body, status="200 OK": record("response", f"HTTP/1.1 {status}\r\n\r\n{body}".encode(), WARC_Target_URI="https://X.org/robots.txt")
    (tmp_path / "1.warc.gz").write_bytes(robots("old") + robots("new"))
    (tmp_path / "0.warc.gz").write_bytes(robots("older"))
    got = crawl.read_robots(spark, [str(tmp_path / f"{k}.warc.gz") for k in (1, 0)]).collect()
    assert [(r.origin, r.status, bytes(r.body)) for r in got] == [("https://x.org", 200, b"new")]
    (tmp_path / "list.txt").write_text("# note\nBad-Word\n\nother\n")
    assert sorted(r.entry for r in crawl.load_list(spark, str(tmp_path / "list.txt"), words=True).collect()) == ["badword", "other"]


class Server(http.server.BaseHTTPRequestHandler):
    data, fails, cut = bytes(range(256)) * 400, [], []

    def log_message(self, *_):
        pass

    def do_HEAD(self):
        self.begin(200, len(self.data))

    def begin(self, status, size):
        self.send_response(status)
        self.send_header("Content-Length", f"{size}")
        self.end_headers()

    def do_GET(self):
        if self.fails:
            self.send_error(self.fails.pop())
            return
        start, end, asked = 0, len(self.data), self.headers.get("Range")
        if asked:
            a, _, b = asked.removeprefix("bytes=").partition("-")
            start, end = int(a), int(b) + 1 if b else end
        body = self.data[start:end]
        self.begin(206 if asked else 200, len(body))
        self.wfile.write(body[: self.cut.pop()] if self.cut else body)


@pytest.fixture
def url():
    server = http.server.ThreadingHTTPServer(("localhost", 0), Server)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    yield f"http://localhost:{server.server_port}/x"
    server.shutdown()


def test_http(url):
    waits = []
    Server.fails[:] = [503, 429]
    assert web.get_range(url, 3, 9, sleep=waits.append, backoff=1) == Server.data[3:9] and waits == [1, 2]
    Server.fails[:] = [404]
    with pytest.raises(OSError):
        web.get_range(url, 0, 1, sleep=waits.append)
    Server.cut[:] = [1000]
    with web.ResumingStream(url, sleep=waits.append) as f:
        parts = []
        while part := f.read(5000):
            parts.append(part)
    assert b"".join(parts) == Server.data
    remote = web.RangeFile(url)
    remote.seek(-6, 2)
    assert remote.read() == Server.data[-6:] and remote.seek(10) == 10 and remote.read(4) == Server.data[10:14]
    now, slept = [0.0], []
    limiter = web.RateLimiter(2, clock=lambda: now[0], sleep=slept.append)
    for _ in range(3):
        limiter.wait()
    assert slept == [0.5, 1.0]
    with web.open_any(url) as f:
        assert f.read(4) == Server.data[:4]

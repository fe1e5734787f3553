"""A service on this machine with short, failing, refused and repeated pages."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, quote_plus, urlsplit

import pytest

from costfield.sources import paged


class Service(BaseHTTPRequestHandler):
    total, largest, seen, repeated, failing = 53, 8, Counter(), 0, ()

    def log_message(self, *_):
        pass

    def _say(self, code, body):
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        asked = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        if asked.get("returnCountOnly") or asked.get("resultType"):
            return self._say(200, {"count": self.total, "numberMatched": str(self.total)})
        start, size = (int(asked.get(a) or asked[b]) for a, b in (("resultOffset", "startIndex"), ("resultRecordCount", "count")))
        self.seen[start, size] += 1
        if start in self.failing and self.seen[start, size] < 3:
            return self._say(503, {})
        if size > self.largest:
            return self._say(400, {})
        names = [max(0, k - self.repeated) if k % 10 == 3 else k for k in range(start, min(start + min(size, 5), self.total))]
        return self._say(200, {"features": [{"type": "Feature", "properties": {"id": f"f{k}", "note": asked.get("token", "")}} for k in names]})


@pytest.fixture
def service():
    Service.seen, Service.total, Service.repeated, Service.failing = Counter(), 53, 0, ()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield {"url": f"http://127.0.0.1:{server.server_port}/q", "id": "id", "pagesize": "20", "waits": "[0.01, 0.01, 0.01]"}
    server.shutdown()


@pytest.mark.parametrize("kind", ["arcgis", "wfs"])
def test_short_failing_and_refused_pages(spark, service, kind):
    Service.failing = (0, 20, 25)
    got = paged.read_features(spark, **service, kind=kind).cache()
    assert sorted(x.id for x in paged.check_complete(got, **service, kind=kind).collect()) == sorted(f"f{k}" for k in range(53))
    assert max(size for _, size in Service.seen if Service.seen[_, size] < 4) <= 20 and any(size == 5 for _, size in Service.seen)  # halved to what is allowed


def test_repeated_features_count_once_and_are_missed(spark, service):
    Service.repeated = 1
    got = paged.read_features(spark, **service).cache()
    assert got.count() == 53 - 5 and got.select("id").distinct().count() == 48
    with pytest.raises(ValueError, match="48 different features of 53"):
        paged.check_complete(got, **service)


def test_the_key_is_in_no_row_and_no_message(spark, service):
    key = "s3cret/+key &x"
    rows = paged.read_features(spark, **service, key=key).collect()
    assert all(paged.HIDDEN in x.feature and "s3cret" not in x.feature for x in rows)
    assert paged.redacted(f"a {key} b {quote(key, safe='')} c {quote_plus(key)}", key) == f"a {paged.HIDDEN} b {paged.HIDDEN} c {paged.HIDDEN}"
    with pytest.raises(Exception, match="doesn't answer") as error:
        paged.read_features(spark, url="http://127.0.0.1:9/q", key=key, waits="[]").collect()
    assert "s3cret" not in str(error.value)


def test_a_service_without_features(spark, service):
    Service.total = 0
    assert paged.check_complete(paged.read_features(spark, **service), **service).collect() == []
    with pytest.raises(ValueError, match="unknown kind"):
        paged.check_complete(spark.range(1), **service, kind="ftp")

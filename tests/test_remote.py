"""A small HTTP server in this process stands for a remote one."""

import os
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rankloom.sources import remote


class Server:
    """Serves one file; ``fail``: how many answers break off after half of their bytes; ``ranges``: whether it knows ranges."""

    def __init__(self, data, fail=0, ranges=True):
        self.data, self.fail, self.ranges, self.asked = data, fail, ranges, []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def do_GET(self):
                span = re.fullmatch(r"bytes=(\d+)-(\d*)", self.headers.get("Range") or "")
                outer.asked.append(self.headers.get("Range"))
                n = len(outer.data)
                if self.path == "/gone":
                    self.send_error(404)
                    return
                first, last = (int(span[1]), int(span[2] or n - 1)) if span and outer.ranges else (0, n - 1)
                if span and outer.ranges and first >= n:
                    self.send_response(416)
                    self.send_header("Content-Range", f"bytes */{n}")
                    self.send_header("Content-Length", "0")
                    self.end_headers()
                    return
                body = outer.data[first : last + 1]
                self.send_response(206 if span and outer.ranges else 200)
                if span and outer.ranges:
                    self.send_header("Content-Range", f"bytes {first}-{min(last, n - 1)}/{n}")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                if outer.fail:
                    outer.fail -= 1
                    self.wfile.write(body[: len(body) // 2])
                    self.wfile.flush()
                    self.connection.close()
                    return
                self.wfile.write(body)

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/file.parquet"

    def __enter__(self):
        return self

    def __exit__(self, *args):
        self.server.shutdown()


DATA = os.urandom(300_000)
still = lambda seconds: None


@pytest.mark.parametrize("ranges", [True, False])
def test_a_copy_goes_on_where_it_broke_off(tmp_path, ranges):
    path = f"{tmp_path}/x"
    with Server(DATA, fail=2, ranges=ranges) as s:
        assert remote.download(s.url, path, sleep=still) == len(DATA)
        assert open(path, "rb").read() == DATA and not os.path.exists(path + ".part")
        assert len(s.asked) == 3 and s.asked[0] is None and s.asked[1].startswith("bytes=")


def test_a_copy_of_an_earlier_run(tmp_path):
    path = f"{tmp_path}/x"
    with Server(DATA) as s:
        for have in (100_000, len(DATA)):
            open(path + ".part", "wb").write(DATA[:have])
            assert remote.download(s.url, path, sleep=still) == len(DATA) and open(path, "rb").read() == DATA
        assert s.asked == ["bytes=100000-", f"bytes={len(DATA)}-"]
        open(path + ".part", "wb").write(DATA + b"more")
        assert remote.download(s.url, path, sleep=still) == len(DATA) and open(path, "rb").read() == DATA


def test_a_copy_that_fails_names_no_file(tmp_path):
    path, waited = f"{tmp_path}/x", []
    with Server(DATA, fail=99) as s:
        with pytest.raises(OSError):
            remote.download(s.url, path, tries=4, sleep=waited.append)
        assert waited == [1, 2, 4] and not os.path.exists(path)
        with pytest.raises(OSError, match="404"):
            remote.download(s.url.replace("file.parquet", "gone"), path, sleep=waited.append)
        assert len(waited) == 3


def test_parquet_by_ranges(spark, tmp_path):
    n = 20_000
    table = pa.table({"id": list(range(n)), "name": [f"n{k}" if k % 3 else None for k in range(n)], "wide": [os.urandom(60) for _ in range(n)], "v": [[k / 2, 1.0] for k in range(n)]})
    pq.write_table(table, f"{tmp_path}/t.parquet", row_group_size=1500)
    data = open(f"{tmp_path}/t.parquet", "rb").read()
    with Server(data, fail=1) as s:
        df = remote.read_parquet(spark, s.url, ["name", "id", "absent"])
        assert df.columns == ["name", "id"] and sorted(df.collect(), key=lambda r: r["id"]) == [(f"n{k}" if k % 3 else None, k) for k in range(n)]
        spans = [tuple(map(int, re.findall(r"\d+", x))) for x in s.asked if x]
        assert df.rdd.getNumPartitions() > 1 and sum(b - a + 1 for a, b in spans) < len(data) // 2
        whole = remote.read_parquet(spark, s.url)
        assert whole.columns == table.column_names and whole.where("id = 7").first()["v"] == [3.5, 1.0] and whole.count() == n
    assert remote.read_parquet(spark, f"file://{tmp_path}/t.parquet", ["id", "absent"]).columns == ["id"]
    with Server(data, ranges=False) as s, pytest.raises(ValueError, match="ranges"):
        remote.RangedFile(s.url)

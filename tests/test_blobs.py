"""Files and URLs by name: what is read, what is not, and odd names."""

import base64
import http.server
import threading

import pytest

from quillspark.sources import blobs as B
from quillspark.sources import manifest as M


def named(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def got(df):
    return {r["path"]: bytes(r["content"]) for r in df.collect()}


def test_only_named_files_are_read(spark, tmp_path):
    for k in range(10_000):
        (tmp_path / f"f{k}.txt").write_text(f"text {k}")
    want = {f"{tmp_path}/f{k}.txt": f"text {k}".encode() for k in range(7, 10_000, 1000)}
    df = B.file_contents(named(spark, *want, f"{tmp_path}/none.txt"), str(tmp_path))
    assert got(df) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(df.inputFiles()) == 10 and "ReadSchema: struct<path:string,content:binary>" in plan
    listed = B.listing(spark, str(tmp_path), named(spark, *want))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString() and listed.count() == 10_000


@pytest.mark.parametrize("block", [1, 2, 100])
def test_odd_names_blocks_and_other_folders(spark, tmp_path, block):
    names = ["a [1] b.txt", "q?*{x}\\w.txt", "é ü.txt", "deep/er/x.txt", "same.txt", "empty.txt", "also empty.txt"]
    for n in names:
        f = tmp_path / "in" / n
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"" if "empty" in n else n.encode())
    (tmp_path / "out").mkdir()
    (tmp_path / "out/o.txt").write_text("outside")
    inside = [f"{tmp_path}/in/{n}" for n in names]
    ask = [*inside, f"{tmp_path}/out/o.txt", f"{tmp_path}/out/none.txt", f"{tmp_path}/nowhere/x.txt", f"{tmp_path}/in/deep", inside[0], None, "http://127.0.0.1:1/x"]
    want = {p: b"" if "empty" in p else n.encode() for p, n in zip(inside, names, strict=True)} | {f"{tmp_path}/out/o.txt": b"outside"}
    assert got(B.file_contents(named(spark, *ask), f"{tmp_path}/in", block)) == want
    # no such folder; one file as the folder; nothing named
    assert got(B.file_contents(named(spark, *ask), f"{tmp_path}/none", block)) == {p: b for p, b in want.items() if "/deep/" not in p} | {inside[3]: b"deep/er/x.txt"}
    assert got(B.file_contents(named(spark, inside[4]), inside[4], block)) == {inside[4]: b"same.txt"}
    assert got(B.file_contents(named(spark).where("path is not null"), f"{tmp_path}/in", block)) == {}


def test_many_files_are_read_where_their_names_are(spark, tmp_path, monkeypatch):
    names = ["a b%41#?.txt", ".hidden", "_x", "_x=1", "d/_y/z.txt", "d/e.txt", "empty.txt", "large.txt", *map(str, range(50))]
    for n in names:
        f = tmp_path / "in" / n
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"" if n == "empty.txt" else n.encode() * (100_000 if n == "large.txt" else 1))
    ask = named(spark, *[f"{tmp_path}/in/{n}" for n in names], f"{tmp_path}/in/d", f"{tmp_path}/in/none", f"{tmp_path}/in/e/mpty.txt")
    want = got(B.file_contents(ask, f"{tmp_path}/in", 1000))
    assert len(want) == len(names) - 3
    monkeypatch.setattr(B, "_by_driver", None)  # neither listed nor named to the driver
    monkeypatch.setattr(B, "HANDED", 1000)
    assert got(B.file_contents(ask, f"{tmp_path}/in", 20)) == want


class Broken(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        body = {"/short": b"HTTP/1.1 200 OK\r\nContent-Length: 50\r\n\r\nhalf", "/line": b"no status at all\r\n\r\n", "/good": b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\ngood", "/gone": b"HTTP/1.1 404 Not Found\r\nContent-Length: 4\r\n\r\nnone"}
        self.wfile.write(body.get(self.path, b""))

    def log_message(self, *_):
        pass


def test_a_broken_answer_is_one_row(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Broken)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        (tmp_path / "t.txt").write_text("local")
        rows = spark.createDataFrame([(k, u) for k, u in enumerate([f"{at}/short", f"{at}/line", f"{at}/good", f"{at}/gone", f"{at}/silent", "http://[bad", "http://a b/", str(tmp_path / "t.txt")])], "row_idx bigint, transcript string")
        texts = M.texts_of(rows, str(tmp_path), "transcript")
        assert {r["row_idx"]: r["ref"] for r in M.with_texts(rows, texts, "transcript", "ref").collect()} == {2: "good", 3: "none", 7: "local"}
        assert sorted(r["row_idx"] for r in M.without_texts(rows, texts, "transcript").collect()) == [0, 1, 4, 5, 6]
    finally:
        server.shutdown()


def test_empty_transcript_is_scored(spark, tmp_path):
    (tmp_path / "gt.txt").write_text("")
    (tmp_path / "hyp.txt").write_text("words")
    (tmp_path / "m.csv").write_text(f"transcript,transcription\ngt.txt,hyp.txt\nfile:{tmp_path}/gt.txt,gt.txt\n")
    scored, bad = M.external_eval(spark, str(tmp_path / "m.csv"), str(tmp_path))
    assert [(r["m"]["char_accuracy"], r["m"]["word_error_rate"]) for r in scored.collect()] == [(1.0, 0.0)]
    assert bad.count() == 1  # the second cell isn't a path below the folder


def test_base64_is_one_line(spark, tmp_path):
    data = bytes(range(256)) * 3
    (tmp_path / "a.png").write_bytes(data)
    rows = spark.createDataFrame([(str(tmp_path / "a.png"),)], "image string")
    for df in (M.images_of(rows, str(tmp_path)), M.read_images(spark, str(tmp_path))):
        r = df.first()
        assert bytes(r["content"]) == data and r["base64"] == base64.b64encode(data).decode()

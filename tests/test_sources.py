import base64
import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.sources import manifest as M
from quillspark.sources import providers as P
from quillspark.sources import store as S


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


@pytest.fixture
def folder(tmp_path):
    texts = {"gt/abc.txt": "abc d efg", "gt/mark.txt": "one | three", "ex/abc.txt": "abc d efg", "ex/off.txt": "abX d efg", "ex/mark.txt": "one two three"}
    for name, text in texts.items():
        write(f"{tmp_path}/{name}", text)
    write(f"{tmp_path}/ext.csv", "transcript,transcription\ngt/abc.txt,ex/abc.txt\ngt/abc.txt, ex/off.txt\ngt/mark.txt,ex/mark.txt\ngt/none.txt,ex/abc.txt\n")
    return str(tmp_path)


def test_manifest_forms(spark, tmp_path):
    write(f"{tmp_path}/a.csv", 'Image,transcript,public\n"a\nb.jpg",t.txt,1\nc.jpg, d/../t.txt ,yes\n')
    rows = M.read_manifest(spark, f"{tmp_path}/a.csv").orderBy("row_idx").collect()
    assert [(r["row_idx"], r["fields"][0]) for r in rows] == [(0, "a\nb.jpg"), (1, "c.jpg")]
    parsed = M.eval_rows(M.read_manifest(spark, f"{tmp_path}/a.csv"), "base/").orderBy("row_idx").collect()
    assert [(r["public"], r["error"]) for r in parsed] == [(True, None), (None, "invalid boolean: yes")] and parsed[1]["image"] == "base/c.jpg"
    write(f"{tmp_path}/b.csv", "x,y\n1\n")
    assert M.read_manifest(spark, f"{tmp_path}/b.csv").first()["error"]
    write(f"{tmp_path}/c.csv", "\n\n")
    assert M.read_manifest(spark, f"{tmp_path}/c.csv").first()["error"]
    write(f"{tmp_path}/e.csv", "")
    assert M.read_manifest(spark, f"{tmp_path}/e.csv").count() == 0
    write(f"{tmp_path}/d.csv", "a.jpg,t\n")
    short = M.read_manifest(spark, f"{tmp_path}/d.csv")
    assert short.count() == 1 and M.eval_rows(short).count() == 0 and M.external_rows(short).count() == 1
    urls = spark.createDataFrame([("https://x//y/./z.jpg",)], "u string").select(M.cell_path("base", F.col("u"))).first()[0]
    assert urls == "https://x//y/./z.jpg"


def test_external(spark, folder):
    scored, bad = M.external_eval(spark, f"{folder}/ext.csv", folder, ignore=("|",))
    got = {r["row_idx"]: r["m"] for r in scored.collect()}
    assert set(got) == {0, 1, 2} and got[0]["char_distance"] == 0 and got[1]["char_distance"] == 1
    assert got[2]["word_similarity"] == 1.0 and got[2]["ignored_chars"] == 1
    assert [r["row_idx"] for r in bad.collect()] == [3]
    some, _ = M.external_eval(spark, f"{folder}/ext.csv", folder, rows=[1, 99])
    assert [r["row_idx"] for r in some.collect()] == [1]


OLD = """config:
    provider: x
    model: m:1
    prompt: p
    temperature: 0
    unknown: 3
results:
    - identifier: a
      transcriptpath: {0}/gt/abc.txt
      providerresponse: abX d efg
      charactersimilarity: 0.5
      wordsimilarity: 0.25
      inputtokens: 10
    - identifier: b
      providerresponse: ""
      wordsimilarity: 0.75
"""


def test_stores(spark, folder):
    write(f"{folder}/evals/m_1.yaml", OLD.format(folder))
    write(f"{folder}/evals/bad.yaml", "config: [")
    write(f"{folder}/evals/empty.yaml", "config: {model: e}\nresults: []\n")
    stores = S.read_stores(spark, f"{folder}/evals/*.yaml")
    assert {r["file"] for r in stores.where("error is not null").collect()} == {"bad.yaml"}
    rows = S.flat_results(stores).orderBy("identifier").collect()
    assert [(r["identifier"], r["input_tokens"], r["char_accuracy"], r["model"]) for r in rows] == [("a", 10, 0.0, "m:1"), ("b", 0, 0.0, "m:1")]
    assert S.store_path("x") == "evals/x.yaml" and S.store_path("d/x.yaml") == "d/x.yaml"
    config = S.reload_config(spark, f"{folder}/evals/m_1.yaml", "now")
    assert config["timeout"] == S.DEFAULT_TIMEOUT and config["timestamp"] == "now" and config["ignorepatterns"] == []
    S.write_results(S.flat_results(stores), f"{folder}/pq")
    assert spark.read.parquet(f"{folder}/pq").count() == 2


def run(spark, *argv, **more):
    a = cli.parser().parse_args(list(argv))
    return cli.COMMANDS[a.command](spark, a, **more)


def test_commands_over_stores(spark, folder):
    write(f"{folder}/evals/m_1.yaml", OLD.format(folder))
    store = ("--store", f"{folder}/evals")
    run(spark, "eval-external", "--csv", f"{folder}/ext.csv", "--dir", folder, "--name", "own", "--ignore", "|", *store)
    assert [r[0] for r in run(spark, "summary", *store).collect()] == ["m_1.yaml", "own.yaml"]
    assert run(spark, "summary", "own", *store).first()["total_evaluations"] == 3
    board = [r[0] for r in run(spark, "csv", "--dir", f"{folder}/gt", *store).collect()]
    assert board[0].startswith("Model\tTotalEvaluations") and [b.split("\t")[0] for b in board[1:]] == ["own", "m:1"]
    assert board[2].split("\t")[3] == f"{(8 / 9 + 0) / 2:.6f}"
    counts = run(spark, "backfill", "--dir", f"{folder}/gt", *store).first()
    assert (counts["updated"], counts["skipped"]) == (1, 1)
    again = run(spark, "backfill", "--dir", f"{folder}/gt", *store).first()
    assert (again["updated"], again["skipped"]) == (0, 2)
    stored = {r["identifier"]: r for r in S.flat_results(S.read_stores(spark, f"{folder}/evals/m_1.yaml")).collect()}
    assert stored["a"]["char_accuracy"] == pytest.approx(8 / 9) and stored["a"]["word_similarity"] == pytest.approx(2 / 3) and stored["b"]["word_similarity"] == 0.75
    lines = run(spark, "cost", "m_1", "--input-price", "2.5", "--output-price", "10", *store).first()["lines"]
    assert "Documents analyzed: 1" in lines and "Input cost: $0.000025" in lines


def test_page_costs(spark):
    from quillspark.operators.report import page_cost

    cases = [(1500, 750, 2.5, 10.0, 0.01125), (1500, 750, 0, 0, 0), (0, 750, 2.5, 10.0, 0.0075), (1500, 0, 2.5, 0, 0.00375)]
    for i, o, a, b, want in cases:
        assert spark.range(1).select(page_cost(F.lit(float(i)), F.lit(float(o)), a, b)).first()[0] == pytest.approx(want)


class Fake:
    """A transport that answers from a list."""

    def __init__(self, *answers):
        self.answers, self.sent = list(answers), []

    def __call__(self, url, headers, body, timeout, limit):
        self.sent.append((url, headers, body))
        status, data, *more = self.answers.pop(0)
        return status, data if isinstance(data, bytes) else json.dumps(data).encode(), more[0] if more else {}


IMAGE = P.Image(b"\x89PNG\r\n\x1a\n", "image/png")
REQUEST = P.Request("m", "read", IMAGE)


def test_clients():
    send = Fake((200, {"choices": [{"message": {"content": '"hi"'}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}))
    assert P.ChatClient("https://h/v1", send=send).extract(REQUEST) == P.Answer("hi", 3, 4, "m")
    assert send.sent[0][0] == "https://h/v1/chat/completions" and b"data:image/png;base64," in send.sent[0][2]
    cut = {"candidates": [{"content": {"parts": [{"text": "a"}]}, "finishReason": "MAX_TOKENS"}]}
    done = {"candidates": [{"content": {"parts": [{"text": "t", "thought": True}, {"text": "b"}]}, "finishReason": "STOP"}]}
    send = Fake((200, cut), (200, cut), (200, done))
    assert P.PartsClient("https://h", send=send, fallback=True).extract(REQUEST).text == "b"
    assert [json.loads(b)["generationConfig"].get("mediaResolution", "")[-4:] for _, _, b in send.sent] == ["FIED", "HIGH", "DIUM"]
    send = Fake((200, {"content": [{"type": "x"}, {"type": "text", "text": "c"}], "usage": {"input_tokens": 1}}))
    assert P.BlocksClient("https://h", send=send).extract(REQUEST).text == "c" and b"temperature" not in send.sent[0][2]
    send = Fake((202, b"", {"operation-location": "https://h/op"}), (500, b""), (200, {"status": "running"}), (200, {"status": "succeeded", "analyzeResult": {"readResults": [{"lines": [{"text": "d"}, {"text": "e"}]}]}}))
    assert P.ReadClient("https://h", send=send, sleep=lambda s: None).extract(REQUEST).text == "d\ne"
    send = Fake((200, {"response": "f", "eval_count": 2}))
    assert P.GenerateClient("http://h", send=send).extract(P.Request("gpt-4o", "p", IMAGE)).output_tokens == 2 and b'"llava"' in send.sent[0][2]
    word = {"X": 1, "Y": 1, "Width": 2, "Height": 2, "Text": "", "Confidence": 1}
    assert P.RemoteClient("http://h", send=Fake((200, {"provider": "p", "words": [word]}))).segment(REQUEST) == [word]
    with pytest.raises(P.ServiceError):
        P.RemoteClient("http://h", send=Fake((200, {"provider": "p", "words": [word, word | {"Width": 0}]}))).segment(REQUEST)
    for status, kind in ((401, "authentication"), (429, "rate_limited"), (503, "upstream")):
        with pytest.raises(P.ServiceError, match=kind):
            P.ChatClient("https://h", send=Fake((status, b""))).extract(REQUEST)
    with pytest.raises(P.ServiceError, match="invalid_response"):
        P.ChatClient("https://h", send=Fake((200, b"{broken"))).extract(REQUEST)


def test_validation_urls_and_tokens():
    for bad in (P.Request(" m", "p", IMAGE), P.Request("m", " ", IMAGE), P.Request("m", "p", IMAGE, -1.0), P.Request("m", "p", IMAGE, float("nan")), P.Request("m", "p", P.Image(b"", "image/png")), P.Request("m", "p", P.Image(b"x", "text/plain"))):
        with pytest.raises(P.ServiceError):
            P.validate(bad)
    P.validate(REQUEST)
    assert P.endpoint("https://h/v1/", "a b", "c") == "https://h/v1/a%20b/c"
    for bad in ("ftp://h", "https://u:p@h", "https://h?x=1", "https://h#f", "https://h/%2e", "https://h/\n", "https://h?"):
        with pytest.raises(P.ServiceError):
            P.endpoint(bad, "x")
    with pytest.raises(P.ServiceError):
        P.static_header("A", "b\r\nc")
    now, calls = [0.0], []
    cache = P.TokenCache(lambda a: (calls.append(a) or f"t{len(calls)}", now[0] + 1000), lambda: now[0])
    assert cache.get("x") == cache.get("x") == "t1"
    now[0] = 900
    assert cache.get("x") == "t2"
    registry = P.Registry()
    registry.register("AbC", P.ChatClient)
    assert registry.has("aBc") and registry.names() == ["abc"]


def test_words_and_lines():
    class Said(P.Client):
        def extract(self, request):
            answer = answers.pop(0)
            if isinstance(answer, Exception):
                raise answer
            return P.Answer(answer)

    client = Said("https://h")
    answers = ["Sorry, no", "", "word"]
    assert P.transcribe_word(client, REQUEST) == "word"
    answers = ["a b c d e"]
    assert P.transcribe_line(client, REQUEST, [REQUEST] * 3) == ["a b", "c d", "e"]
    answers = [P.ServiceError("upstream"), "x", P.ServiceError("timeout"), P.ServiceError("timeout"), P.ServiceError("timeout")]
    assert P.transcribe_line(client, REQUEST, [REQUEST] * 2) == ["x", ""]


def _stub():
    class Stub(P.Client):
        def extract(self, request):
            if b"bad" in request.image.data:
                raise ValueError("https://h?key=secret")
            return P.Answer("abc d efX", 5, 6)

    return Stub("https://h")


def test_eval_command(spark, folder):
    os.makedirs(f"{folder}/img")
    for name, data in (("a.png", b"good"), ("b.png", b"bad")):
        with open(f"{folder}/img/{name}", "wb") as f:
            f.write(data)
    write(f"{folder}/m.csv", "image,transcript,public\nimg/a.png,gt/abc.txt,true\nimg/b.png,gt/abc.txt,0\nimg/c.png,gt/abc.txt,maybe\n")
    rows = run(spark, "eval", "--csv", f"{folder}/m.csv", "--dir", folder, "--model", "z:2", "--store", f"{folder}/evals", make=_stub).collect()
    assert [(r["identifier"], r["public"], r["input_tokens"], r["substitutions"]) for r in rows] == [("a.png", True, 5, 1)]
    assert os.path.exists(f"{folder}/evals/z_2.yaml")
    said = {r["path"][-5:]: r["error"] for r in run(spark, "ocr", "--image", f"{folder}/img", make=_stub).collect()}
    assert said["a.png"] is None and "secret" not in said["b.png"]


def test_stream(spark, tmp_path):
    from quillspark import streaming

    spark.createDataFrame([("a b", "a b", "s"), ("a b", "a c", "s"), ("x", "y", "t")], "ref string, hyp string, store string").write.parquet(f"{tmp_path}/in")
    pairs = spark.readStream.schema("ref string, hyp string, store string").parquet(f"{tmp_path}/in")
    board = streaming.running_leaderboard(streaming.score_stream(pairs), ["store"])
    q = board.writeStream.outputMode("complete").format("memory").queryName("board").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["store"], r["total_evaluations"], r["avg_word_similarity"]) for r in spark.table("board").collect()} == {("s", 2, 0.75), ("t", 1, 0.0)}
    q = streaming.to_store(streaming.score_stream(pairs), f"{tmp_path}/out", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_paths(spark):
    cases = [("base", "a/../b.txt", "base/b.txt"), ("base/", "./c//d.txt", "base/c/d.txt"), ("", "../x/./y", "../x/y"), ("/r", "../../z", "/z"), ("a", "..", "."), ("a", "../../b", "../b"), ("", "", ""), ("d", "", "d"), ("d", " e ", "d/e")]
    for folder, cell, want in cases:
        assert spark.range(1).select(M.cell_path(folder, F.lit(cell))).first()[0] == want, (folder, cell)
    here = spark.range(1).select(M.resolved(spark, F.lit("a/../b")), M.resolved(spark, F.lit("/c")), M.resolved(spark, F.lit("http://h/../x"))).first()
    assert here[0] == f"{os.path.realpath(os.getcwd())}/b" and here[1:] == ("/c", "http://h/../x")


def test_relative_folder_through_the_command(spark, folder, capsys):
    write(f"{folder}/rel.csv", "transcript,transcription\ngt/abc.txt,ex/../ex/off.txt\ngt/../gt/mark.txt,ex/mark.txt\ngt/none.txt,ex/abc.txt\n")
    near = os.path.relpath(folder)
    rows = run(spark, "eval-external", "--csv", f"{near}/rel.csv", "--dir", near, "--name", "near", "--ignore", "|", "--store", f"{folder}/evals").collect()
    assert {(r["identifier"], r["substitutions"]) for r in rows} == {("abc.txt", 1), ("mark.txt", 0)}
    assert all(r["transcript"].startswith(near) for r in rows)
    assert "row 2: failed to read" in capsys.readouterr().err
    again = run(spark, "backfill", "--dir", near, "--store", f"{folder}/evals").first()
    assert (again["updated"], again["skipped"]) == (0, 1)


@pytest.fixture
def site():
    """A server on this machine; /missing answers 404 with a body, which counts."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if self.path == "/missing" else 200)
            self.end_headers()
            self.wfile.write(b"abX d efg" if self.path == "/off.txt" else b"not there")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_texts_by_http(spark, folder, site):
    write(f"{folder}/web.csv", f"gt/abc.txt,{site}/off.txt\ngt/abc.txt,{site}/missing\ngt/abc.txt,http://127.0.0.1:1/closed\n")
    scored, bad = M.external_eval(spark, f"{folder}/web.csv", folder)
    assert {r["row_idx"]: r["m"]["char_distance"] for r in scored.collect()} == {0: 1, 1: 7}
    assert [(r["row_idx"], r["error"]) for r in bad.collect()] == [(2, "failed to read http://127.0.0.1:1/closed")]
    with pytest.raises(OSError, match="more than 4 bytes"):
        M.http_get(f"{site}/off.txt", limit=4)


def test_backfill_writes_the_file_it_read(spark, folder):
    for name in ("run1", "run2"):
        write(f"{folder}/evals/{name}.yaml", OLD.format(folder))
    counts = run(spark, "backfill", "--dir", f"{folder}/gt", "--store", f"{folder}/evals").first()
    assert (counts["updated"], counts["skipped"]) == (2, 0)
    assert sorted(f for f in os.listdir(f"{folder}/evals") if f.endswith(".yaml")) == ["run1.yaml", "run2.yaml"]
    for name in ("run1", "run2"):
        stored = {r["identifier"]: r for r in S.flat_results(S.read_stores(spark, f"{folder}/evals/{name}.yaml")).collect()}
        assert len(stored) == 2 and stored["a"]["char_accuracy"] == pytest.approx(8 / 9)


def lines(spark, *argv, **more):
    a = cli.parser().parse_args(list(argv))
    return list(cli.printed(a, cli.COMMANDS[a.command](spark, a, **more)))


def test_printed_reports(spark, folder):
    store = ("--store", f"{folder}/evals")
    said = lines(spark, "eval-external", "--csv", f"{folder}/ext.csv", "--dir", folder, "--name", "own", "--ignore", "|", *store)
    assert said.count("=== Results for abc.txt ===") == 2 and said.count("Ignored Characters: 1") == 1 and "Character Similarity: 0.889" in said
    assert said[-6:][0] == "Total Evaluations: 3" and said[-1] == "Average Word Error Rate: 0.111"
    assert lines(spark, "summary", "own", *store)[1] == "Total Evaluations: 3"
    with pytest.raises(SystemExit, match="no token usage"):
        run(spark, "cost", "own", "--input-price", "1", "--output-price", "1", *store)
    os.makedirs(f"{folder}/img")
    for name in ("good", "bad"):
        with open(f"{folder}/img/{name}.png", "wb") as f:
            f.write(name.encode())
    assert lines(spark, "ocr", "--image", f"{folder}/img/good.png", make=_stub) == ["abc d efX"]
    with pytest.raises(SystemExit, match="MASKED"):
        lines(spark, "ocr", "--image", f"{folder}/img/bad.png", make=_stub)


def test_environment_file(tmp_path, monkeypatch):
    write(f"{tmp_path}/.env", "# no\nQS_ONE=1\nexport QS_TWO='two words'\nQS_THREE=x\nnonsense\n")
    monkeypatch.setenv("QS_THREE", "kept")
    for name in ("QS_ONE", "QS_TWO"):
        monkeypatch.delenv(name, raising=False)
    cli.load_env(f"{tmp_path}/.env")
    assert [os.environ[n] for n in ("QS_ONE", "QS_TWO", "QS_THREE")] == ["1", "two words", "kept"]
    cli.load_env(f"{tmp_path}/none")
    for name in ("QS_ONE", "QS_TWO"):
        monkeypatch.delenv(name)


def test_small_helpers(spark):
    assert P.pretty('{"a":[1]}') == '{\n  "a": [\n    1\n  ]\n}' and P.pretty("{no") == "{no" and P.pretty("12") == "12"
    row = spark.range(1).select(M.bounded_base64(F.lit("YWJj"), 3), M.bounded_base64(F.lit("YWJjZA=="), 3), M.bounded_base64(F.lit("?"), 3)).first()
    assert (bytes(row[0]), row[1], row[2]) == (b"abc", None, None)

    class Shout(P.ChatClient):
        def cleaned(self, text):
            return text.upper()

    assert Shout("https://h", send=Fake((200, {"choices": [{"message": {"content": '"hi"'}}]}))).extract(REQUEST).text == '"HI"'
    with pytest.raises(P.ServiceError, match="invalid_request"):
        P.RemoteClient("http://h", send=Fake()).segment(P.Request("m" * 257, "read", IMAGE))


def test_hosted_services_sign_in_with_an_identity_token():
    middle = base64.urlsafe_b64encode(json.dumps({"exp": 10_000}).encode()).rstrip(b"=")
    token = b"a." + middle + b".c"
    send = Fake((200, token))
    assert P.identity_token("https://x.run.app", send) == (token.decode(), 10_000.0)
    assert "audience=https%3A%2F%2Fx.run.app" in send.sent[0][0] and send.sent[0][1] == {"Metadata-Flavor": "Google"}
    for answer in ((200, b"nonsense"), (404, b""), (200, b"a.b.c")):
        with pytest.raises(P.ServiceError, match="authentication"):
            P.identity_token("x", Fake(answer))
    asked = []
    tokens = P.TokenCache(lambda a: (asked.append(a) or "tok", 10_000), lambda: 0.0)
    send = Fake((200, {"response": "f"}), (200, {"response": "g"}))
    client = P.GenerateClient("https://svc-1.run.app/x", send=send, tokens=tokens)
    assert client.extract(REQUEST).text == "f" and client.extract(REQUEST).text == "g"
    assert asked == ["https://svc-1.run.app"] and send.sent[1][1]["Authorization"] == "Bearer tok"
    assert P.audience_of("http://svc.run.app") == "" and P.audience_of("https://example.com") == ""


def _pages():
    class Pages(P.RemoteClient):
        def segment(self, request, most=100_000):
            if request.image.data == b"none":
                return []
            if request.image.data == b"bad":
                raise P.ServiceError("upstream", 500, True)
            return [{"X": 1, "Y": 2, "Width": 3, "Height": 4, "Text": "t", "Confidence": 1}, {"X": 5, "Y": 6, "Width": 7, "Height": 8}]

    return Pages("http://h")


def test_segmentation_source(spark):
    images = spark.createDataFrame([("a.png", b"x"), ("b.png", b"none"), ("c.png", b"bad")], "path string, content binary")
    got = sorted(tuple(r) for r in P.segment(images, _pages, "m").collect())
    assert got == [("a.png", 1, 1, 2, 3, 4, "t", 1.0, None), ("a.png", 2, 5, 6, 7, 8, "", 0.0, None), ("c.png", *[None] * 7, "upstream: upstream (status 500)")]


def test_options_come_back_from_a_saved_config(spark, folder):
    os.makedirs(f"{folder}/img")
    with open(f"{folder}/img/a.png", "wb") as f:
        f.write(b"good")
    write(f"{folder}/m.csv", "img/a.png,gt/abc.txt,true\n")
    store, made = f"{folder}/evals", []

    def factory(a):
        made.append((a.provider, a.timeout, a.gemini_max_resolution, a.gemini_max_resolution_fallback))
        return _stub

    first = cli.parser().parse_args(["eval", "--csv", f"{folder}/m.csv", "--dir", folder, "--provider", "gemini", "--model", "g", "--timeout", "90.5", "--gemini-max-resolution", cli.RESOLUTIONS[2], "--gemini-max-resolution-fallback", "--store", store])
    cli.run_eval(spark, first, factory(first)).count()
    saved = S.read_stores(spark, f"{store}/g.yaml").first()["config"]
    assert (saved["timeout"], saved["maxresolution"], saved["maxresolutionfallback"]) == ("1m30.5s", cli.RESOLUTIONS[2], True)
    again = cli.parser().parse_args(["eval", "--config", "g", "--dir", folder, "--store", store])
    cli.run_eval(spark, again, _stub).count()
    factory(again)
    assert made == [("gemini", 90.5, cli.RESOLUTIONS[2], True)] * 2
    client = cli._client(again)()
    assert (client.timeout, client.resolution, client.fallback) == (90.5, cli.RESOLUTIONS[2], True)
    assert S.read_stores(spark, f"{store}/g.yaml").first()["config"]["timeout"] == "1m30.5s"
    write(f"{store}/old.yaml", f"config: {{provider: gemini, model: old, prompt: p, csvpath: {folder}/m.csv}}\nresults: []\n")
    old = cli.parser().parse_args(["eval", "--config", "old", "--dir", folder, "--store", store])
    cli.run_eval(spark, old, _stub).count()
    assert (old.timeout, old.gemini_max_resolution, old.gemini_max_resolution_fallback) == (300.0, cli.RESOLUTIONS[0], False)
    write(f"{store}/odd.yaml", "config: {provider: gemini, model: odd, maxresolution: HUGE}\nresults: []\n")
    with pytest.raises(SystemExit, match="HUGE"):
        run(spark, "eval", "--config", "odd", "--store", store, make=_stub)


def test_durations():
    for seconds, text in ((300, "5m0s"), (45, "45s"), (3600, "1h0m0s"), (3723.5, "1h2m3.5s"), (0.3, "300ms"), (0, "0s"), (90, "1m30s")):
        assert S.duration_text(seconds) == text and S.duration_seconds(text) == pytest.approx(seconds)
    assert S.duration_seconds("") == 0 and S.duration_seconds("300000000000") == 300 and S.duration_seconds("-1.5h") == -5400
    for bad in ("5 m", "m", "5x", "s5"):
        with pytest.raises(ValueError, match="not a duration"):
            S.duration_seconds(bad)


def test_store_listing_says_so_if_there_is_none(spark, folder):
    os.makedirs(f"{folder}/evals")
    assert lines(spark, "summary", "--store", f"{folder}/evals") == [f"There is no result store in {folder}/evals."]
    write(f"{folder}/evals/m_1.yaml", OLD.format(folder))
    assert lines(spark, "summary", "--store", f"{folder}/evals")[1] == "  m_1.yaml"


def test_remote_service_chooses_its_model(spark):
    sent = []

    def send(url, headers, body, timeout, limit):
        sent.append((headers["Content-Type"], body))
        return 200, b'{"provider": "p", "text": "t"}', {}

    client = P.RemoteClient("http://h", send=send)
    picture = b"\x89PNG\r\n--quillspark-upload--\r\n"
    assert client.extract(P.Request("", "read", P.Image(picture, "image/png"))).text == "t" and client.extract(P.Request("m", "read", IMAGE)).text == "t"
    edges = [kind.partition("boundary=")[2] for kind, _ in sent]
    assert edges[0] != edges[1] and all(body.count(f"--{e}".encode()) == n for e, (_, body), n in zip(edges, sent, (2, 3), strict=True))
    assert b'name="model"' not in sent[0][1] and b'name="model"\r\n\r\nm\r\n' in sent[1][1]
    P.validate(P.Request("", "read", IMAGE), needs_model=False)
    for model in (" m", "a\nb"):
        with pytest.raises(P.ServiceError):
            P.validate(P.Request(model, "read", IMAGE), needs_model=False)
    images = spark.createDataFrame([("a.png", b"x")], "path string, content binary")
    assert P.segment(images, _pages, "").count() == 2

"""Calls of a partition: how many at once, how fast, how often, and never twice for one answer."""

import os
import threading
import time

import pytest

from quillspark.sources import providers as P
from quillspark.sources.calls import Caller, Calls, Journal, TokenBucket

IMAGE = P.Image(b"\x89PNG", "image/png", "a.png")
REQUEST = P.Request("m", "read", IMAGE)


class Said(P.Client):
    def __init__(self, *answers):
        super().__init__("https://h")
        self.answers, self.asked = list(answers), []

    def extract(self, request):
        self.asked.append(request)
        answer = self.answers.pop(0)
        if isinstance(answer, BaseException):
            raise answer
        return P.Answer(answer, 1, 2, "m")


def test_retries_by_kind_of_error():
    waits = []
    again = P.ServiceError("rate_limited", 429, True)
    client = Said(again, P.ServiceError("upstream", 503, True), "text")
    assert Caller(lambda: client, Calls(first_wait=1.0), waits.append).extract(REQUEST).text == "text"
    assert len(client.asked) == 3 and 0.5 <= waits[0] <= 1 <= waits[1] <= 2
    for first, n in ((P.ServiceError("authentication", 401), 1), (P.ServiceError("invalid_request"), 1), (ValueError("odd"), 1), (again, 4)):
        client = Said(*[first] * 4)
        with pytest.raises(type(first)):
            Caller(lambda client=client: client, Calls(longest_wait=2.0), waits.append).extract(REQUEST)
        assert len(client.asked) == n
    assert max(waits) <= 2


def test_rate():
    now, waited = [0.0], []

    def sleep(s):
        waited.append(s)
        now[0] += s

    bucket = TokenBucket(2.0, 3, lambda: now[0], sleep)
    for _ in range(7):
        bucket.take()
    assert len(waited) == 4 and now[0] == pytest.approx(2.0)  # three at once, then two a second
    now[0] += 10
    bucket.take()
    assert len(waited) == 4
    TokenBucket(0).take()


def test_at_once_and_in_order():
    lock, running, most = threading.Lock(), [0], [0]

    def slow(k):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.02 * (k % 3))
        with lock:
            running[0] -= 1
        return k

    for n in (1, 3):
        most[0] = 0
        assert list(Caller(P.Client, Calls(at_once=n)).each(slow, range(20))) == list(range(20)) and most[0] <= n
    assert most[0] > 1


def _counting(folder, fail=""):
    """A service that notes each request in a folder, and takes its executor down at one."""

    def make():
        class Counting(P.Client):
            def extract(self, request):
                if request.image.name == fail and not os.path.exists(f"{folder}/down"):
                    open(f"{folder}/down", "w").close()
                    os._exit(1)
                with open(f"{folder}/asked-{request.image.name}", "a") as f:
                    f.write("x")
                return P.Answer(f"text of {request.image.name}", 3, 4)

            def segment(self, request):
                with open(f"{folder}/asked-segment", "a") as f:
                    f.write("x")
                return [{"X": 1, "Y": 2, "Width": 3, "Height": 4, "Text": "t", "Confidence": 1}]

        return Counting("https://h")

    return make


def asked(folder):
    return {n: len(open(f"{folder}/{n}").read()) for n in os.listdir(folder) if n.startswith("asked")}


def test_each_image_is_asked_for_once(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    images = spark.createDataFrame([(f"i{k}.png", b"data") for k in range(12)], "path string, content binary").coalesce(1)
    calls = Calls(at_once=1, journal=f"file://{tmp_path}/journal")
    # the worker goes down at the eighth image
    with pytest.raises(Exception, match="crash|exited|EOF|Connection"):
        P.transcribe(images, _counting(str(notes), "i7.png"), "m", "read", calls=calls).collect()
    assert len(asked(notes)) == 7
    for _ in range(2):
        rows = P.transcribe(images, _counting(str(notes), "i7.png"), "m", "read", calls=calls).collect()
        assert [(r["path"], r["text"], r["input_tokens"], r["error"]) for r in rows] == [(f"i{k}.png", f"text of i{k}.png", 3, None) for k in range(12)]
    assert asked(notes) == {f"asked-i{k}.png": 1 for k in range(12)}
    # another prompt is another request
    P.transcribe(images, _counting(str(notes)), "m", "other", calls=calls).collect()
    assert set(asked(notes).values()) == {2}
    for _ in range(2):
        assert [tuple(r)[1:7] for r in P.segment(images.limit(1), _counting(str(notes)), "m", calls=calls).collect()] == [(1, 1, 2, 3, 4, "t")]
    assert asked(notes)["asked-segment"] == 1


def test_failures_are_not_kept(tmp_path):
    client = Said(P.ServiceError("authentication", 401), "text", "again")
    caller = Caller(lambda: client, Calls(journal=str(tmp_path / "j")))
    with pytest.raises(P.ServiceError):
        caller.extract(REQUEST)
    assert [caller.extract(REQUEST) for _ in range(3)] == [P.Answer("text", 1, 2, "m")] * 3 and len(client.asked) == 2
    assert Journal(str(tmp_path / "j")).find("00" * 32) is None

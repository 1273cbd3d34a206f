import pytest
from pyspark.sql import functions as F

from quillspark.functions import answers as A
from quillspark.functions import text as T
from quillspark.sources import providers as P

PREFIXED = ["text in image is", "The text in the image reads:", "image contains the following text:", "IMAGE CONTAINS TEXT", "heres text from image:", "Here's the text extracted from the image", "Text that says:", "i can see text reading:", "certainly! here's the text from image:", "Here the extracted text from image:"]
CLEAN = [
    # a prefix goes wherever case and spacing differ, with the space behind it
    *[(f"{p} \t{body}", body) for p in PREFIXED for body in ("1 < 2", "two\nlines")],
    # one after the other, in the order of the rules; the other way round the second stays
    ("text in image is: image contains text: z", "z"), ("image contains text: text in image is: z", "text in image is: z"),
    # only at the start
    ("so the text in the image is: z", "so the text in the image is: z"),
    # quotes of both kinds, any number, then one pair of fences; what stood inside them isn't looked at again
    ("'\"'mixed\"\"", "mixed"), ("it's", "it's"), ("``````", ""), ("```", ""), ("```py\nx\n```", "py\nx"), ("``` a ``` b", "``` a ``` b"), ("'```\n'q'\n```'", "'q'"), ("```text in image is: k```", "text in image is: k"),
    # Unicode white space at the ends, but not what only Python takes for space
    ("\u3000\u2003x\u00a0", "x"), ("\x1cx\x1c", "\x1cx\x1c"), ("text\u00a0in image is: x", "text\u00a0in image is: x"), ("\t\n ", ""),
]
HIDDEN = "***MASKED***"
SECRETS = [
    # parameters: first or later, three spellings, up to the next one, a space or a quote
    *[(f"{mark}{name}=v.-1{end}", f"{mark}{name}={HIDDEN}{end}") for mark in "?&" for name in ("key", "api_key", "api-key", "apiKey", "apikey") for end in ("", "&b=2", " t", '"', "\n")],
    ("?monkey=1&keys=2;key=3", "?monkey=1&keys=2;key=3"), ("?key=", "?key="), ("?key=a&key=b", f"?key={HIDDEN}&key={HIDDEN}"),
    # headers
    ("Bearer\t a_b-c.d, Bearer e", f"Bearer {HIDDEN}, Bearer {HIDDEN}"), ("bearer x", "bearer x"), ("Bearer /", "Bearer /"),
    ("Ocp-Apim-Subscription-Key:q,r s", f"Ocp-Apim-Subscription-Key: {HIDDEN} s"), ("a x-api-key:  é!\nx-api-key:", f"a x-api-key: {HIDDEN}\nx-api-key:"), ("X-API-KEY: t", "X-API-KEY: t"),
    ("nothing here", "nothing here"),
]


def apply(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_clean_and_mask(spark):
    assert apply(spark, T.clean_response, [a for a, _ in CLEAN]) == [b for _, b in CLEAN] == [P.clean(a) for a, _ in CLEAN]
    assert apply(spark, T.mask_secrets, [a for a, _ in SECRETS]) == [b for _, b in SECRETS] == [P.mask(a) for a, _ in SECRETS]


def test_entities_and_spans(spark):
    cases = [("A & B & C", "A &amp; B &amp; C"), ("&lt;&#39;&apos;", "&lt;&#39;&apos;"), ("&#12;&x;&#a;", "&#12;&amp;x;&amp;#a;"), ("a\n&", "a\n&amp;")]
    assert apply(spark, T.fix_ampersands, [a for a, _ in cases]) == [b for _, b in cases]
    spans = [("<span>a</span>", "<span>a</span>"), ("no < span", "no < span"), ("<span>x\n</span>", "<span>x\n</span>"), ("<span>a</span>b < c</span>", "<span>a</span>b < c</span>"), ("b</span><span>c</span> d", "b</span><span>c</span> d")]
    assert apply(spark, T.escape_spans, [a for a, _ in spans]) == [b for _, b in spans]


def test_small_functions(spark):
    assert apply(spark, T.parse_bool, ["1", "TRUE", "f", "yes", ""]) == [True, True, False, None, None]
    assert apply(spark, T.base_name, ["a/b.txt", "b", "", "/", "a/b/"]) == ["b.txt", "b", ".", "/", "b"]
    assert apply(spark, T.store_name, ["m:7b"]) == ["m_7b.yaml"]
    assert apply(spark, T.is_remote, ["http://x", "HTTPS://x", "/a/http", "ftp://x"]) == [True, True, False, False]
    assert apply(spark, lambda t: T.truncate_body(t, 4), ["abcd", "abcde"]) == ["abcd", "abcd... (truncated)"]
    assert apply(spark, T.normalize_single_line, ["a \n\t b", "     "]) == ["a b", " "]
    assert apply(spark, lambda t: F.to_json(T.tokenize(t)), [" a　b\x1cc "]) == ['["a","b\\u001Cc"]']


@pytest.mark.parametrize(("status", "kind", "again"), [(400, "invalid_request", False), (401, "authentication", False), (429, "rate_limited", True), (500, "upstream", True), (504, "timeout", True), (302, "upstream", False)])
def test_errors(spark, status, kind, again):
    e = P.error_for_status(status)
    row = spark.range(1).select(T.error_kind(F.lit(status)).alias("e")).first()["e"]
    assert (e.kind, e.retryable) == (row["kind"], row["retryable"]) == (kind, again)


def test_answers(spark):
    one = lambda f, body: apply(spark, lambda t: F.to_json(f(t)) if f is not A.read_lines else f(t), [body])[0]
    assert one(A.chat, '{"choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":3,"completion_tokens":4}}') == '{"text":"hi","input_tokens":3,"output_tokens":4}'
    assert one(A.parts, '{"candidates":[{"content":{"parts":[{"text":"t","thought":true},{"text":" "},{"text":"x"}]}}]}') == '{"text":"x","input_tokens":0,"output_tokens":0}'
    assert one(A.blocks, '{"content":[{"type":"tool"},{"type":"text","text":"y"}]}') == '{"text":"y","input_tokens":0,"output_tokens":0}'
    assert one(A.generate, '{"response":"z","eval_count":2}') == '{"text":"z","input_tokens":0,"output_tokens":2}'
    assert one(A.read_lines, '{"analyzeResult":{"readResults":[{"lines":[{"text":"a"},{"text":"b"}]}]}}') == "a\nb"
    assert one(A.read_lines, '{"analyzeResult":{"pages":[{"lines":[{"content":"c"}]},{}]}}') == "c"
    assert one(A.read_lines, "{broken") == ""
    bad = '{"provider":"p","words":[{"X":1,"Y":1,"Width":0,"Height":2,"Text":"","Confidence":0.5}]}'
    assert spark.range(1).select(A.segments(F.lit(bad)).valid, A.segments(F.lit(bad.replace('"Width":0', '"Width":3'))).valid).first()[:] == (False, True)
    assert apply(spark, A.token_expiry, ["a.eyJleHAiOjE3fQ.c", "a.b"]) == [17, None]


def test_truncation_inside_a_character(spark):
    texts = ["a\u00e9", "a\u00e9b", "\u65e5\u672c\u8a9e", "ab\U0001f600", "x" * 499 + "\u00e9", "x" * 498 + "\u00e9", None]
    for limit in (1, 2, 3, 4, 5, 500):
        want = [t if t is None or len(t.encode()) <= limit else t.encode()[:limit].decode("utf-8", "replace") + "... (truncated)" for t in texts]
        assert apply(spark, lambda t, n=limit: T.truncate_body(t, n), texts) == want

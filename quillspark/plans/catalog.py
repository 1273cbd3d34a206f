"""The registered queries of the library's own operators, and their SQL.

Pairs of texts come from whole tables: every conversation turn against a noised copy (``noise``), with words struck out
(``struck``), and every user turn against the answer that follows (``turns``). Boxes come from every line item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import answers as J
from ..functions import editdist as E
from ..functions import masking as M
from ..functions import text as T
from ..operators import hocr as H
from ..operators import layout as L
from ..operators import report as R
from ..operators.score import METRICS, score
from ..sources import manifest as S
from ..sources import store as Y
from ..sources.manifest import cell_path, select_rows

SIX = 6
#: Line items, and pictures, that one task has: with more rows there are more tasks, not larger ones.
BOXES, PICTURES = 250_000, 5_000


def _tasks(spark: SparkSession, rows: int, each: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _noised(text):
    return F.replace(F.replace(F.translate(text, "eo", "c0"), F.lit(" the "), F.lit(" ")), F.lit(". "), F.lit(". uh "))


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "role", F.col("text").alias("ref"), _noised(F.col("text")).alias("hyp"))


def struck(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "role", F.regexp_replace("text", " th[a-z]* |q", " | ").alias("ref"), F.col("text").alias("hyp"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations")
    asked = t.where("role = 'user'").select("conv_id", "turn", "role", F.col("text").alias("ref"))
    said = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return asked.join(said, ["conv_id", "turn"])


def _by_page(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` dealt by page to tasks of at most about ``BOXES`` line items, which windows, groups and joins by page then leave as they are."""
    return rows.repartition(_tasks(spark, _table(spark, sf_dir, "lineitem").count(), BOXES), "page")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    rows = t.select(
        F.col("l_orderkey").alias("page"), (F.pmod("l_partkey", F.lit(40)) * 9).cast("int").alias("x"), (F.pmod("l_suppkey", F.lit(9)) * 7).cast("int").alias("y"),
        (F.pmod(q, F.lit(31)) + 4).cast("int").alias("w"), (F.pmod(q, F.lit(17)) + F.col("l_linenumber") + 5).cast("int").alias("h"),
    )
    return _by_page(spark, sf_dir, rows).distinct()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _by_page(spark, sf_dir, L.fold_lines(boxes(spark, sf_dir)))
    return lines.select("*", F.lit(400).alias("page_w"), F.lit(90).alias("page_h"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, SIX).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _results(pairs: DataFrame) -> DataFrame:
    """Scored pairs as stored results: four stores, tokens from lengths, a few without any."""
    store = F.concat(F.lit("store-"), F.pmod("conv_id", F.lit(4)))
    m = score(pairs).select("conv_id", "turn", store.alias("store"), "m.*", F.col("hyp").alias("response"), "ref", "hyp")
    some = F.pmod("conv_id", F.lit(5)) != 0
    return m.withColumns({"input_tokens": F.when(some, F.length("ref")).otherwise(0), "output_tokens": F.when(some, F.length("hyp")).otherwise(0)})


def score_pairs(spark, sf_dir):
    return _rounded(score(noise(spark, sf_dir)).select("conv_id", "turn", "m.*"))


def score_turns(spark, sf_dir):
    return _rounded(score(turns(spark, sf_dir)).select("conv_id", "turn", "m.*"))


def score_masked(spark, sf_dir):
    return _rounded(score(struck(spark, sf_dir), ignore=("|",)).select("conv_id", "turn", "m.*"))


def score_single_line(spark, sf_dir):
    return _rounded(score(noise(spark, sf_dir), single_line=True).select("conv_id", "turn", "m.*"))


def char_distance(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", E.char_distance(F.col("ref"), F.col("hyp")).cast("bigint").alias("char_distance"))


def char_similarity(spark, sf_dir):
    d = E.char_distance(F.col("ref"), F.col("hyp"))
    return _rounded(turns(spark, sf_dir).select("conv_id", "turn", E.similarity(d, F.length("ref"), F.length("hyp")).alias("char_similarity"), E.char_accuracy(d, F.length("ref")).alias("char_accuracy")))


def word_distance(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", E.word_distance(T.tokenize(F.col("ref")), T.tokenize(F.col("hyp"))).cast("bigint").alias("word_distance"))


def word_error_rate(spark, sf_dir):
    a, b = T.tokenize(F.col("ref")), T.tokenize(F.col("hyp"))
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.size(a).alias("n"), F.size(b).alias("m"), E.word_distance(a, b).alias("w"))
    wer = E.word_error_rate(F.col("w"), F.col("n"))
    return _rounded(rows.select("conv_id", "turn", E.similarity(F.col("w"), F.col("n"), F.col("m")).alias("word_similarity"), wer.alias("word_error_rate"), (1 - wer).alias("word_accuracy")))


def align_words(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", E.align(T.tokenize(F.col("ref")), T.tokenize(F.col("hyp"))).alias("a"))
    return _rounded(rows.select("conv_id", "turn", "a.*"))


def normalize_single_line(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.normalize_single_line(F.col("text")).alias("line"))


def tokenize(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokenize(F.col("text")), "/").alias("words"), F.size(T.tokenize(F.col("text"))).cast("bigint").alias("n_words"))


def mask_ignore(spark, sf_dir):
    p = M.mask(F.col("ref"), F.col("hyp"), ["|"])
    return struck(spark, sf_dir).select("conv_id", "turn", p.alias("p")).select("conv_id", "turn", F.col("p.ref").alias("masked_ref"), F.col("p.hyp").alias("masked_hyp"), F.col("p.ignored").cast("bigint").alias("ignored"))


def mask_order(spark, sf_dir):
    """Patterns that begin alike: the first one in the list that fits is taken, and each is counted by itself."""
    p = M.mask(F.col("ref"), F.col("hyp"), ["th", "the", "an", "a"])
    return noise(spark, sf_dir).select("conv_id", "turn", p.alias("p")).select("conv_id", "turn", F.col("p.ref").alias("masked_ref"), F.col("p.hyp").alias("masked_hyp"), F.col("p.ignored").cast("bigint").alias("ignored"))


def ignored_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", M.ignored_count(F.col("text"), ["|", "the", ",", ""]).cast("bigint").alias("ignored"))


def eval_summary(spark, sf_dir):
    return _rounded(R.summary(_results(turns(spark, sf_dir))))


def leaderboard(spark, sf_dir):
    rows = R.leaderboard(_results(turns(spark, sf_dir)), ["store"])
    return _rounded(rows.drop("avg_input_tokens", "avg_output_tokens", "page_cost"))


def leaderboard_cost(spark, sf_dir):
    return _rounded(R.leaderboard(_results(turns(spark, sf_dir)), ["store"], 2.5, 10.0))


def leaderboard_tsv(spark, sf_dir):
    return R.leaderboard_tsv(R.leaderboard(_results(turns(spark, sf_dir)), ["store"]), "store")


def cost_projection(spark, sf_dir):
    return _rounded(R.cost_projection(_results(turns(spark, sf_dir)), 2.5, 10.0, 5000, ["store"]))


def _stored(spark, sf_dir):
    """Results whose stored accuracy is off or missing in some stores."""
    rows = _results(turns(spark, sf_dir)).withColumn("file", F.concat("store", F.lit("-"), F.pmod("conv_id", F.lit(7))))
    rows = rows.withColumn("m", F.struct(*METRICS))
    off = F.when(F.pmod("conv_id", F.lit(7)) == 3, 0.0).when(F.pmod("conv_id", F.lit(7)) == 5, F.col("char_accuracy") + 1).otherwise(F.col("char_accuracy"))
    return rows.withColumns({"char_accuracy": off, "recomputed_accuracy": F.when(F.col("turn") != 2, F.col("m.char_accuracy")), "m": F.when(F.col("turn") != 2, F.col("m"))})


def backfill_diff(spark, sf_dir):
    return _rounded(R.backfill(_stored(spark, sf_dir)).select("conv_id", "turn", "char_accuracy", "word_similarity", "changed"))


def backfill_counts(spark, sf_dir):
    return R.backfill_counts(R.backfill(_stored(spark, sf_dir)))


def legacy_accuracy(spark, sf_dir):
    return _rounded(R.fill_legacy_accuracy(_stored(spark, sf_dir)).select("conv_id", "turn", "char_accuracy"))


def row_selection(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return select_rows(docs.select(F.col("doc_id").alias("row_idx"), "lang", "source"), labels.where("toxic = 1 or quality = 0").select("doc_id"))


def bool_parse(spark, sf_dir):
    values = F.array(*map(F.lit, ("1", "t", "TRUE", "yes", "0", "False", "f", "no", "", "true ")))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.element_at(values, (F.pmod("doc_id", F.lit(10)) + 1).cast("int")).alias("v"))
    return rows.select("doc_id", T.parse_bool(F.col("v")).alias("public"), T.parse_bool(F.col("v")).isNull().alias("failed"))


def public_split(spark, sf_dir):
    flag = T.parse_bool(F.pmod("conv_id", F.lit(2)).cast("string"))
    return _rounded(_results(turns(spark, sf_dir)).groupBy(flag.alias("public")).agg(F.count("*").alias("n"), F.avg("word_similarity").alias("avg_word_similarity")))


def manifest_paths(spark, sf_dir):
    path = cell_path("data", F.concat(F.lit(" "), F.col("url")))
    local = cell_path("data/", F.concat("source", F.lit("//./"), "doc_id", F.lit(".txt ")))
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), path.alias("path"), T.base_name(path).alias("name"), T.is_remote(F.col("url")).alias("remote"))
    return pages.union(_table(spark, sf_dir, "documents").select("doc_id", local, T.base_name(local), T.is_remote(local)))


def clean_response(spark, sf_dir):
    heads = ("", "Here's the text extracted from the image: ", "Certainly! Here is the text from image:\n", '"', "The image contains the following text:", "```\n", "Text in the image reads ", "I can see text reading: ")
    tails = ("", " ", "\n", '"', " \t", "\n```", "", "''")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod("turn", F.lit(8)) + 1).cast("int"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_response(F.concat(pick(heads), F.col("text"), pick(tails))).alias("text"))


def mask_secrets(spark, sf_dir):
    line = F.concat(F.col("url"), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("api_key=ab"), F.col("page_id"), F.lit('" Bearer t.k-'), F.col("page_id"), F.lit(" x-api-key:  s3 Ocp-Apim-Subscription-Key: z"), F.col("page_id"))
    return _table(spark, sf_dir, "pages").select("page_id", T.mask_secrets(line).alias("line"))


def mask_secrets_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.mask_secrets(F.col("text")).alias("text"))


def fix_ampersands(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.fix_ampersands(F.col("html")).alias("html"))


def escape_spans(spark, sf_dir):
    line = F.concat(F.lit("<span id='a'><b>x</b> < "), F.col("url"), F.lit("</span>tail < "), F.col("page_id"), F.lit("</span>\nplain < line > "), F.col("page_id"))
    return _table(spark, sf_dir, "pages").select("page_id", T.escape_spans(line).alias("markup"))


def _chat_body():
    return F.to_json(F.struct(F.array(F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))).alias("choices"), F.struct(F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens")).alias("usage")))


def chat_usage(spark, sf_dir):
    body = F.when(F.pmod("conv_id", F.lit(9)) == 0, F.lit("{broken")).otherwise(_chat_body())
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", J.chat(body).alias("a"))
    return rows.select("conv_id", "turn", "a.text", F.col("a.input_tokens").cast("bigint").alias("input_tokens"), F.col("a.output_tokens").cast("bigint").alias("output_tokens"))


def event_keys(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


def read_lines(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations")
    old = F.to_json(F.struct(F.struct(F.array(F.struct(F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"))).alias("lines"))).alias("readResults")).alias("analyzeResult")))
    new = F.to_json(F.struct(F.struct(F.array(F.struct(F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("content"))).alias("lines"))).alias("pages")).alias("analyzeResult")))
    body = F.when(F.pmod("turn", F.lit(3)) == 0, old).when(F.pmod("turn", F.lit(3)) == 1, new).otherwise(F.lit('{"analyzeResult": 3}'))
    return t.select("conv_id", "turn", J.read_lines(body).alias("text"))


def error_kinds(spark, sf_dir):
    status = (F.lit(395) + F.pmod("event_id", F.lit(120))).cast("int")
    return _table(spark, sf_dir, "events").select("event_id", T.error_kind(status).alias("e")).select("event_id", "e.kind", F.col("e.status").cast("bigint").alias("status"), "e.retryable")


def upload_names(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("image/jpeg", "IMAGE/PNG; q=1", "image/webp", "image/jp2", "text/plain", "image/x-own", "")))
    return _table(spark, sf_dir, "events").select("event_id", F.element_at(kinds, (F.pmod("event_id", F.lit(7)) + 1).cast("int")).alias("k")).select("event_id", T.upload_name(F.col("k")).alias("name"), T.canonical_media_type(F.col("k")).alias("media_type"))


def truncate_body(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.truncate_body(F.col("text")).alias("body"))


def size_filter(spark, sf_dir):
    return boxes(spark, sf_dir).where(L.valid_word_size(F.col("w"), F.col("h"), F.lit(60), F.lit(101)))


def text_pixels(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_partkey", F.lit(256)).alias("r"), F.pmod("l_suppkey", F.lit(256)).alias("g"), F.col("l_quantity").cast("bigint").alias("b"))
    return t.groupBy(L.is_text_pixel(F.col("r"), F.col("g"), F.col("b")).alias("dark")).agg(F.count("*").alias("n"))


def merge_boxes(spark, sf_dir):
    return _rounded(L.merge_words(boxes(spark, sf_dir)))


def line_runs(spark, sf_dir):
    return _rounded(L.line_runs(boxes(spark, sf_dir)).select("page", "line", "x", "y", "w", "h"))


def box_envelope(spark, sf_dir):
    return _rounded(boxes(spark, sf_dir).groupBy("page").agg(*L.envelope("page")))


def line_fold(spark, sf_dir):
    return _rounded(L.fold_lines(boxes(spark, sf_dir)))


def crop_boxes(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("page", "x", "y", "w", "h", L.crop(F.col("x"), F.col("y"), F.col("w") - 10, F.col("h")).alias("c"))
    return rows.select("page", "x", "y", "w", "h", *[F.col(f"c.{k}").cast("bigint").alias(f"crop_{k}") for k in ("x", "y", "w", "h")])


def distribute_words(spark, sf_dir):
    slots = (F.pmod("conv_id", F.lit(13)) + 1).cast("int")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(L.distribute_words(F.col("text"), slots)).alias("slot", "words")).withColumn("slot", F.col("slot").cast("bigint"))


def hocr_pages(spark, sf_dir):
    words = L.merge_words(boxes(spark, sf_dir)).select("page", F.col("word").cast("int").alias("number"), "x", "y", "w", "h", F.when(F.col("n") == 2, "").otherwise(F.concat(F.lit("a & b <"), "n")).alias("text"))
    return H.pages(words)


def hocr_tree(spark, sf_dir):
    return _rounded(H.flatten(H.response(_lines(spark, sf_dir))))


def segment_check(spark, sf_dir):
    box = F.struct(F.col("x").alias("X"), F.col("y").alias("Y"), (F.col("w") - 5).alias("Width"), F.col("h").alias("Height"), F.lit("").alias("Text"), (F.col("h") / 26).alias("Confidence"))
    pages = boxes(spark, sf_dir).groupBy("page").agg(F.to_json(F.struct(F.lit("p").alias("provider"), F.collect_list(box).alias("words"))).alias("body"))
    return pages.select("page", J.segments(F.col("body")).alias("s")).select("page", F.size("s.words").cast("bigint").alias("n"), "s.valid")


def manifest_rows(spark, sf_dir):
    """Manifests of some hundred rows each, one in three with a header, booleans of all kinds, every ninth row quoted."""
    flags = F.array(*map(F.lit, ("true", "0", " T ", "maybe")))
    quoted = F.when(F.pmod("doc_id", F.lit(9)) == 0, F.concat(F.lit('"a ""b"",\n'), "doc_id", F.lit('.png"'))).otherwise(F.concat(F.lit("img/../"), "doc_id", F.lit(".png")))
    row = F.concat(quoted, F.lit(", t/"), "doc_id", F.lit(".txt ,"), F.element_at(flags, (F.pmod("doc_id", F.lit(4)) + 1).cast("int")))
    rows = _table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 200).alias("file"), "doc_id", row.alias("row"))
    files = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "row"))), lambda x: x.row), "\n").alias("value"))
    files = files.withColumn("value", F.when(F.pmod("file", F.lit(3)) == 0, F.concat(F.lit("Image,transcript,public\n"), "value")).otherwise(F.col("value")))
    return S.eval_rows(S.parse_manifests(files), "data")


def transcript_join(spark, sf_dir):
    """Every document's path against the texts that are there, which are those of one language less."""
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", S.cell_path("/t/x", F.concat(F.lit("../"), "doc_id", F.lit(".txt"))).alias("transcript"))
    return S.with_texts(rows, docs.where("lang <> 'fr'").select(F.concat(F.lit("/t/"), "doc_id", F.lit(".txt")).alias("path"), "text"), "transcript", "ref")


def transcript_missing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.concat(F.lit("/t/"), "doc_id", F.lit(".txt")).alias("transcript"))
    return S.without_texts(rows, docs.where("lang <> 'fr'").select(F.concat(F.lit("/t/"), "doc_id", F.lit(".txt")).alias("path"), "text"), "transcript")


def store_scan(spark, sf_dir):
    """A store for each conversation, every eleventh broken, with the keys that old files lack."""
    item = F.concat(F.lit("- {identifier: t"), "turn", F.lit(", charactersimilarity: 0."), F.pmod("turn", F.lit(10)), F.lit(", inputtokens: "), F.length("text"), F.lit(", extra: 1}"))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x.i), "\n").alias("items"))
    text = F.when(F.pmod("conv_id", F.lit(11)) == 0, "config: [").otherwise(F.concat(F.lit("config: {model: 'm:"), "conv_id", F.lit("', temperature: 0}\nresults:\n"), "items"))
    found = Y.flat_results(Y.parse_stores(rows.select(F.concat("conv_id", F.lit(".yaml")).alias("file"), text.alias("value"))))
    return _rounded(found.select("file", "model", "identifier", "char_similarity", "char_accuracy", "input_tokens", "output_tokens"))


def store_names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.store_name(F.col("url")).alias("file"))


def _usage(spark, sf_dir, read, body):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", read(F.to_json(body)).alias("a"))
    return rows.select("conv_id", "turn", "a.text", F.col("a.input_tokens").cast("bigint").alias("input_tokens"), F.col("a.output_tokens").cast("bigint").alias("output_tokens"))


def parts_usage(spark, sf_dir):
    """A thought and a blank before the text, which is missing in every third turn."""
    part = lambda text, thought: F.struct(text.alias("text"), F.lit(thought).alias("thought"))
    parts = F.array(part(F.lit("hm"), True), part(F.lit(" "), False), part(F.when(F.pmod("turn", F.lit(3)) != 0, F.col("text")), False))
    use = F.struct(F.length("text").alias("promptTokenCount"), F.col("turn").alias("candidatesTokenCount"))
    return _usage(spark, sf_dir, J.parts, F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"), use.alias("usageMetadata")))


def blocks_usage(spark, sf_dir):
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    return _usage(spark, sf_dir, J.blocks, F.struct(F.array(block("tool", F.lit("no")), block("text", F.col("text")), block("text", F.lit("later"))).alias("content"), F.struct(F.col("turn").alias("input_tokens")).alias("usage")))


def generate_usage(spark, sf_dir):
    return _usage(spark, sf_dir, J.generate, F.struct(F.col("text").alias("response"), F.length("text").alias("prompt_eval_count")))


def token_expiry(spark, sf_dir):
    body = F.to_json(F.struct((F.col("event_id") * 7).alias("exp"), F.col("event_type").alias("for")))
    middle = F.regexp_replace(F.translate(F.base64(F.encode(body, "UTF-8")), "+/", "-_"), "=+$", "")
    token = F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.lit("x."), F.col("event_type"))).otherwise(F.concat(F.lit("h."), middle, F.lit(".s")))
    return _table(spark, sf_dir, "events").select("event_id", J.token_expiry(token).alias("expires"))


def bounded_base64(spark, sf_dir):
    content = S.bounded_base64(F.base64(F.encode("text", "UTF-8")), 1000)
    return _table(spark, sf_dir, "documents").select("doc_id", F.decode(content, "UTF-8").alias("text"))


def basic_hocr(spark, sf_dir):
    return H.basic(H.response(_lines(spark, sf_dir)))


def components(spark, sf_dir):
    """A picture of 100 x 60 for each part: one dark bar, one mark too small and one that touches it by a corner alone."""
    x, y, w, h = (F.pmod("p_partkey", F.lit(40)) + 5), (F.pmod("p_partkey", F.lit(30)) + 4), (F.pmod("p_partkey", F.lit(39)) + 8), (F.pmod("p_partkey", F.lit(3)) + 9)
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), *[c.cast("int").alias(n) for n, c in zip("xywh", (x, y, w, h), strict=True)])
    # keys are few bytes and pictures many: the keys' files alone would make a few tasks
    rows = rows.repartition(_tasks(spark, rows.count(), PICTURES))
    blank, dark = (lambda n: F.repeat(F.lit("FF"), n.cast("int"))), (lambda n: F.repeat(F.lit("00"), n.cast("int")))
    x, y, w, h = map(F.col, "xywh")
    # a line of the bar so many times, then the corner's line, then the last pixel
    bar = F.repeat(F.concat(blank(x), dark(w), blank(100 - x - w)), h)
    data = F.unhex(F.concat(blank(100 * y), bar, blank(x + w), F.lit("00"), blank(5998 - (y + h) * 100 - x - w), F.lit("00")))
    data = F.coalesce(data, F.unhex(F.concat(F.repeat(F.lit("FF"), F.lit(5999)), F.lit("00"))))
    image = F.struct(F.col("part").cast("string").alias("origin"), F.lit(60).alias("height"), F.lit(100).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    found = L.detect_components(rows.select(image.alias("image")), preprocess=False)
    return _rounded(found.select(F.col("path").cast("bigint").alias("part"), "x", "y", "w", "h"))


def cost_report(spark, sf_dir):
    projection = R.cost_projection(_results(turns(spark, sf_dir)), 2.5, 10.0, 5000)
    return R.cost_lines(projection, 2.5, 10.0, 5000).select(F.posexplode("lines").alias("n", "line")).select(F.col("n").cast("bigint").alias("n"), "line")


def summary_report(spark, sf_dir):
    lines = R.summary_lines(R.summary(_results(turns(spark, sf_dir))))
    return lines.select(F.posexplode("lines").alias("n", "line")).select(F.col("n").cast("bigint").alias("n"), "line")


_NAMES = (
    score_pairs, score_turns, score_masked, score_single_line, char_distance, char_similarity, word_distance, word_error_rate, align_words,
    normalize_single_line, tokenize, mask_ignore, mask_order, ignored_count, eval_summary, leaderboard, leaderboard_cost, leaderboard_tsv, cost_projection,
    backfill_diff, backfill_counts, legacy_accuracy, row_selection, bool_parse, public_split, manifest_paths, clean_response, mask_secrets,
    mask_secrets_documents, fix_ampersands, escape_spans, chat_usage, event_keys, read_lines, error_kinds, upload_names, truncate_body, size_filter,
    text_pixels, merge_boxes, line_runs, box_envelope, line_fold, crop_boxes, distribute_words, hocr_pages, hocr_tree, segment_check,
    manifest_rows, transcript_join, transcript_missing, store_scan, store_names, parts_usage, blocks_usage, generate_usage, token_expiry, bounded_base64,
    basic_hocr, components, cost_report, summary_report,
)


def queries() -> dict:
    from .files import QUERIES

    return {f.__name__: f for f in (*_NAMES, *QUERIES)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return SQL

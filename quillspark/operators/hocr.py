"""hOCR markup: spans, documents, the nested response tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_markup

# Fixed value: the document around the spans.
DOCUMENT = (
    '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">\n'
    '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en">\n<head>\n<title></title>\n'
    '<meta http-equiv="Content-Type" content="text/html;charset=utf-8" />\n'
    "<meta name='ocr-system' content='htr' />\n</head>\n<body>\n<div class='ocr_page' id='page_1'>\n",
    "\n</div>\n</body>\n</html>",
)
# Fixed value: text of the response's annotation.
ANNOTATION = "Custom word detection with line grouping + LLM transcription"
POINT = "struct<x:int,y:int>"
POLY = f"struct<vertices:array<{POINT}>>"
SYMBOL = f"struct<boundingBox:{POLY},text:string>"
WORD = f"struct<boundingBox:{POLY},symbols:array<{SYMBOL}>>"
PARAGRAPH = f"struct<boundingBox:{POLY},words:array<{WORD}>>"
BLOCK = f"struct<boundingBox:{POLY},blockType:string,paragraphs:array<{PARAGRAPH}>>"
PAGE = f"struct<width:int,height:int,blocks:array<{BLOCK}>>"
RESPONSE = f"struct<responses:array<struct<fullTextAnnotation:struct<pages:array<{PAGE}>,text:string>>>>"


def span(number: Column, x: Column, y: Column, right: Column, bottom: Column, text: Column, strict: bool = False) -> Column:
    """A line with one word. ``strict`` also escapes ``<`` and ``>`` in the text."""
    box = F.concat_ws(" ", F.lit("bbox"), x, y, right, bottom)
    text = F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")) if strict else text
    return F.concat(
        F.lit("<span class='ocrx_line' id='line_"), number, F.lit("' title='"), box, F.lit("'><span class='ocrx_word' id='word_"), number,
        F.lit("' title='"), box, F.lit("'>"), text, F.lit("</span></span>"),
    )


def document(content: Column) -> Column:
    return F.concat(F.lit(DOCUMENT[0]), content, F.lit(DOCUMENT[1]))


def pages(words: DataFrame, page: str = "page", text: str = "text", strict: bool = False) -> DataFrame:
    """(page, hocr) from word rows (page, number, x, y, w, h, text); words without text are left out."""
    cell = span(F.col("number"), F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), clean_markup(F.col(text)), strict)
    some = F.when(F.col(text) != "", F.struct("number", cell.alias("s")))
    rows = words.groupBy(page).agg(F.array_sort(F.collect_list(some)).alias("spans"))
    return rows.select(page, document(F.array_join(F.transform("spans", lambda s: s.s), "\n")).alias("hocr"))


def _poly(x: Column, y: Column, right: Column, bottom: Column) -> Column:
    point = lambda a, b: F.struct(a.cast("int").alias("x"), b.cast("int").alias("y"))
    return F.struct(F.array(point(x, y), point(right, y), point(right, bottom), point(x, bottom)).alias("vertices"))


def response(lines: DataFrame, page: str = "page") -> DataFrame:
    """(page, response): each line a paragraph of one word; columns page, line, x, y, w, h, page_w, page_h."""
    poly = _poly(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    symbol = F.struct(poly.alias("boundingBox"), F.concat(F.lit("line_"), F.col("line")).alias("text"))
    word = F.struct(poly.alias("boundingBox"), F.array(symbol).alias("symbols"))
    paragraph = F.struct(poly.alias("boundingBox"), F.array(word).alias("words"))
    rows = lines.groupBy(page, "page_w", "page_h").agg(F.array_sort(F.collect_list(F.struct("line", paragraph.alias("p"))), lambda a, b: a.line.cast("int") - b.line.cast("int")).alias("ps"))
    zero = F.lit(0)
    block = F.struct(_poly(zero, zero, F.col("page_w"), F.col("page_h")).alias("boundingBox"), F.lit("TEXT").alias("blockType"), F.transform("ps", lambda p: p.p).alias("paragraphs"))
    tree = F.struct(F.col("page_w").cast("int").alias("width"), F.col("page_h").cast("int").alias("height"), F.array(block).alias("blocks"))
    full = F.struct(F.array(tree).alias("pages"), F.lit(ANNOTATION).alias("text"))
    return rows.select(page, F.struct(F.array(F.struct(full.alias("fullTextAnnotation"))).alias("responses")).alias("response"))


def flatten(responses: DataFrame, page: str = "page", column: str = "response") -> DataFrame:
    """(page, number, x, y, w, h, text) of the words with four corners, numbered from 1 in tree order; text of the first symbol."""
    first = F.get(F.col(f"{column}.responses"), F.lit(0)).fullTextAnnotation.pages
    words = F.flatten(F.flatten(F.flatten(F.transform(first, lambda p: F.transform(p.blocks, lambda b: F.transform(b.paragraphs, lambda q: q.words))))))
    good = F.filter(words, lambda w: (F.size(w.boundingBox.vertices) >= 4))
    rows = responses.select(page, F.posexplode(good).alias("i", "word"))
    a, c = F.get(F.col("word.boundingBox.vertices"), F.lit(0)), F.get(F.col("word.boundingBox.vertices"), F.lit(2))
    return rows.select(page, (F.col("i") + 1).alias("number"), a.x.alias("x"), a.y.alias("y"), (c.x - a.x).alias("w"), (c.y - a.y).alias("h"), F.get(F.col("word.symbols"), F.lit(0)).text.alias("text"))


def basic(responses: DataFrame, page: str = "page", column: str = "response") -> DataFrame:
    """(page, hocr) without transcription: the symbols' texts as they are; no annotation gives an empty document."""
    rows = flatten(responses, page, column).where("text is not null")
    rows = rows.withColumn("number", F.row_number().over(_page_order(page)))
    cell = span(F.col("number"), F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.col("text"))
    spans = rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("number", cell.alias("s")))).alias("spans"))
    joined = responses.select(page).join(spans, page, "left")
    return joined.select(page, document(F.coalesce(F.array_join(F.transform("spans", lambda s: s.s), "\n"), F.lit(""))).alias("hocr"))


def _page_order(page: str):
    from pyspark.sql import Window

    return Window.partitionBy(page).orderBy("number")

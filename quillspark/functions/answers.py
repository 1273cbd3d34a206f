"""Text and token usage out of recognition services' JSON answers; malformed JSON gives null or empty, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CHAT = "choices array<struct<message:struct<content:string>>>, usage struct<prompt_tokens:int,completion_tokens:int>"
PARTS = "candidates array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>, usageMetadata struct<promptTokenCount:int,candidatesTokenCount:int>, modelVersion string"
BLOCKS = "content array<struct<type:string,text:string>>, usage struct<input_tokens:int,output_tokens:int>"
GENERATE = "response string, prompt_eval_count int, eval_count int"
READ = "analyzeResult struct<readResults:array<struct<lines:array<struct<text:string>>>>,pages:array<struct<lines:array<struct<content:string>>>>>"
SEGMENTS = "provider string, words array<struct<X:int,Y:int,Width:int,Height:int,Text:string,Confidence:double>>"


def _answer(text: Column, tokens_in: Column | None = None, tokens_out: Column | None = None) -> Column:
    none = F.lit(0)
    return F.struct(
        text.alias("text"), F.coalesce(tokens_in if tokens_in is not None else none, none).alias("input_tokens"),
        F.coalesce(tokens_out if tokens_out is not None else none, none).alias("output_tokens"),
    )


def chat(body: Column) -> Column:
    x = F.from_json(body, CHAT)
    return _answer(F.get(x.choices, F.lit(0)).message.content, x.usage.prompt_tokens, x.usage.completion_tokens)


def parts(body: Column) -> Column:
    """The first part that is no thought and not blank."""
    x = F.from_json(body, PARTS)
    said = F.filter(F.get(x.candidates, F.lit(0)).content.parts, lambda p: ~F.coalesce(p.thought, F.lit(False)) & (F.trim(F.coalesce(p.text, F.lit(""))) != ""))
    return _answer(F.coalesce(F.get(said, F.lit(0)).text, F.lit("")), x.usageMetadata.promptTokenCount, x.usageMetadata.candidatesTokenCount)


def blocks(body: Column) -> Column:
    """The first block of type text."""
    x = F.from_json(body, BLOCKS)
    return _answer(F.get(F.filter(x.content, lambda b: b.type == "text"), F.lit(0)).text, x.usage.input_tokens, x.usage.output_tokens)


def generate(body: Column) -> Column:
    x = F.from_json(body, GENERATE)
    return _answer(x.response, x.prompt_eval_count, x.eval_count)


def read_lines(body: Column) -> Column:
    """Lines of the older layout, else of the newer one, joined by line breaks; '' if there is neither."""
    x = F.from_json(body, READ).analyzeResult
    old = F.flatten(F.transform(x.readResults, lambda p: F.transform(F.coalesce(p.lines, F.array()), lambda line: line.text)))
    new = F.flatten(F.transform(x.pages, lambda p: F.transform(F.coalesce(p.lines, F.array()), lambda line: line.content)))
    return F.coalesce(F.array_join(F.coalesce(old, new), "\n"), F.lit(""))


def segments(body: Column, most: int = 100_000) -> Column:
    """struct(words, valid): one bad box, a blank provider or too many boxes make the whole answer invalid."""
    x = F.from_json(body, SEGMENTS)
    good = F.forall(x.words, lambda b: (b.X >= 0) & (b.Y >= 0) & (b.Width > 0) & (b.Height > 0) & (b.Confidence >= 0) & (b.Confidence <= 1) & ~F.isnan(b.Confidence))
    valid = good & (F.trim(x.provider) != "") & (F.size(x.words) <= most)
    return F.struct(x.words.alias("words"), F.coalesce(valid, F.lit(False)).alias("valid"))


def token_expiry(token: Column) -> Column:
    """Seconds since the epoch from a token's middle part; null if it can't be read."""
    middle = F.translate(F.get(F.split(token, r"\."), F.lit(1)), "-_", "+/")
    padded = F.rpad(middle, F.ceil(F.length(middle) / 4).cast("int") * 4, F.lit("="))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "exp double").exp.cast("bigint")

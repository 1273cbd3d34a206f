"""Text columns: white space, response cleaning, masking of secrets, entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed value: Unicode white space, as a regex class body. Java's \s is ASCII only.
WS = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Prefixes of model answers, in the order in which they are removed.
ANSWER_PREFIXES = (
    r"(the\s+)?text\s+in\s+(the\s+)?image\s+(is|says|reads):?\s*",
    r"(the\s+)?image\s+contains\s+(the\s+following\s+)?text:?\s*",
    r"here'?s?\s+(the\s+)?text\s+(extracted\s+)?from\s+(the\s+)?image:?\s*",
    r"(i\s+can\s+see\s+)?text\s+(that\s+says|reading):?\s*",
    r"i\s+can\s+see\s+text\s+reading:\s*",
    r"certainly!\s+here'?s?\s+(the\s+)?text\s+(extracted\s+)?from\s+(the\s+)?image:?\s*",
    r"here'?s?\s+the\s+extracted\s+text\s+from\s+(the\s+)?image:?\s*",
)
MASK = "***MASKED***"
# Where secrets stand in URLs and headers.
SECRET_PLACES = (
    (r'([?&])(api[_\-]?[kK]ey|key)=([^&\s"]+)', rf"$1$2={MASK}"),
    (r"Bearer\s+([A-Za-z0-9_\-\.]+)", rf"Bearer {MASK}"),
    (r"Ocp-Apim-Subscription-Key:\s*([^\s]+)", rf"Ocp-Apim-Subscription-Key: {MASK}"),
    (r"x-api-key:\s*([^\s]+)", rf"x-api-key: {MASK}"),
)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: an expression used in a lambda is computed anew for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def normalize_single_line(text: Column) -> Column:
    """Line breaks and tabs become spaces, runs of spaces one; a space at either end stays."""
    return F.regexp_replace(text, "[\n\r\t ]+", " ")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+\\z", "")


def tokenize(text: Column) -> Column:
    """Words between Unicode white space, no empty ones."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def clean_response(text: Column) -> Column:
    """A model's answer without its preamble, its quotes and one pair of code fences."""

    def without(t: Column, prefix: str) -> Column:
        return trim_space(F.regexp_replace(t, f"(?i)^{prefix}", ""))

    bare = reduce(without, ANSWER_PREFIXES, trim_space(text))
    bare = F.regexp_replace(bare, "^[\"']+|[\"']+\\z", "")
    # one pair of fences; a text that is nothing but one fence loses it once
    inner = trim_space(F.regexp_replace(F.regexp_replace(bare, "^```", ""), "```\\z", ""))
    return F.when(bare.startswith("```") & bare.endswith("```"), inner).otherwise(bare)


def mask_secrets(text: Column) -> Column:
    return reduce(lambda t, place: F.regexp_replace(t, *place), SECRET_PLACES, text)


def fix_ampersands(text: Column) -> Column:
    """``&`` becomes ``&amp;`` unless it begins one of five named entities or a decimal reference."""
    return F.regexp_replace(text, "&(?!amp;|lt;|gt;|quot;|apos;|#[0-9]*;)", "&amp;")


def escape_spans(text: Column) -> Column:
    """In lines with a span, ``<`` and ``>`` after a part's last tag are escaped; parts end with ``</span>``."""

    def part(x: Column) -> Column:
        at = F.length(x) - F.instr(F.reverse(x), ">") + 1
        tail = F.substring(x, at + 1, F.length(x))
        escaped = F.replace(F.replace(tail, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.when(F.contains(x, F.lit(">")), F.concat(F.substring(x, F.lit(1), at), escaped)).otherwise(x)

    def line(x: Column) -> Column:
        parts = F.split(x, "</span>", -1)
        inner = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, part(p)).otherwise(p))
        return F.when(F.contains(x, F.lit("<span")) & F.contains(x, F.lit("</span>")), F.array_join(inner, "</span>")).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def clean_markup(text: Column) -> Column:
    return escape_spans(fix_ampersands(text))


def parse_bool(text: Column) -> Column:
    """Strict booleans; anything else is null, which callers treat as a row error."""
    return F.when(text.isin("1", "t", "T", "TRUE", "true", "True"), True).when(text.isin("0", "f", "F", "FALSE", "false", "False"), False)


def base_name(path: Column) -> Column:
    """The part after the last slash; slashes at the end don't count."""
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(path == "", ".").when(bare == "", "/").otherwise(F.element_at(F.split(bare, "/"), -1))


def store_name(model: Column) -> Column:
    return F.concat(F.replace(model, F.lit(":"), F.lit("_")), F.lit(".yaml"))


def is_remote(path: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).isin("http", "https"), F.lit(False))


def truncate_body(body: Column, limit: int = 500) -> Column:
    """At most ``limit`` bytes, with a note if there were more. A character cut through becomes U+FFFD."""
    short = F.concat(F.make_valid_utf8(F.substring(F.encode(body, "UTF-8"), 1, limit).cast("string")), F.lit("... (truncated)"))
    return F.when(F.octet_length(body) > limit, short).otherwise(body)


# Upload names by media type.
UPLOAD_NAMES = {
    "image/jpeg": "image.jpg", "image/png": "image.png", "image/gif": "image.gif",
    "image/webp": "image.webp", "image/tiff": "image.tiff", "image/jp2": "image.jp2",
}


def upload_name(media_type: Column) -> Column:
    kind = F.lower(F.trim(F.regexp_extract(media_type, "^([^;]*)", 1)))
    names = F.create_map(*[F.lit(x) for pair in UPLOAD_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, kind), F.lit("image.img"))


def canonical_media_type(raw: Column) -> Column:
    """Lower case, without parameters; null unless an image type."""
    bare = F.lower(F.trim(F.regexp_extract(raw, "^([^;]*)", 1)))
    return F.when(bare.rlike("^image/[a-z0-9!#$&^_.+-]+$"), bare)


def error_kind(status: Column) -> Column:
    """struct(kind, status, retryable) of an HTTP status."""
    kind = (
        F.when(status.isin(401, 403), "authentication").when(status.isin(408, 504), "timeout").when(status == 429, "rate_limited")
        .when(status.isin(400, 404, 405, 409, 413, 422), "invalid_request").otherwise("upstream")
    )
    retry = F.when(status.isin(408, 504, 429), True).when(status.isin(401, 403, 400, 404, 405, 409, 413, 422), False).otherwise(status >= 500)
    return F.struct(kind.alias("kind"), status.alias("status"), retry.alias("retryable"))

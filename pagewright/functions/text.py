"""Text and format expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.schemas import RESPONSE


def item_id(kind: Column, page: Column, number: Column) -> Column:
    """``fig_02_01`` and the like; numbers over 99 keep all their digits."""
    prefix = F.when(kind == "figure", "fig").when(kind == "table", "table").otherwise("cap")
    return F.format_string("%s_%02d_%02d", prefix, page, number)


def class_label(name: Column) -> Column:
    """``plain_text`` to ``Plain-Text``: each run of letters capitalised, underscores and spaces as dashes."""
    words = F.split(F.regexp_replace(name, "[_ ]", "-"), "-")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), "-")


def strip(text: Column) -> Column:
    """Without white space (ASCII) at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def media_type(path: Column) -> Column:
    """MIME type of an image by its suffix; PNG unless known."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("jpg", "jpeg"), "image/jpeg").when(suffix == "gif", "image/gif").when(suffix == "webp", "image/webp").otherwise("image/png")


def base64_image(content: Column) -> Column:
    """An image's bytes as base64 without line breaks, as models take them."""
    return F.translate(F.base64(content), "\r\n", "")


def iso_time(at: Column | None = None) -> Column:
    """A time, now unless given, as ``2024-01-31T12:00:00.000000``."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def point_id(pdf: Column, item: Column, page: Column) -> Column:
    """The id under which an item's description is stored: an MD5 of document, item and page."""
    return F.md5(F.concat_ws(":", pdf, item, page).cast("binary"))


def element_text(description: Column, caption: Column, fallback: Column) -> Column:
    """An element's description and caption as one text; the fallback if both are missing or empty."""
    none = lambda c: F.nullif(strip(c), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" ", none(description), none(caption)), F.lit("")), fallback)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a transform over an array of one element, which no rule folds back."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_object(raw: Column) -> Column:
    """The JSON object inside a model's answer: out of a code fence, from the first brace to the last, without commas
    that trail."""

    def unfenced(s: Column) -> Column:
        fence = lambda mark: F.split_part(F.split_part(s, F.lit(mark), F.lit(2)), F.lit("```"), F.lit(1))
        return F.when(F.contains(s, F.lit("```json")), fence("```json")).when(F.contains(s, F.lit("```")), fence("```")).otherwise(s)

    def braced(s: Column) -> Column:
        first, last = F.instr(s, "{"), F.length(s) - F.instr(F.reverse(s), "}") + 1
        return F.when((first > 0) & F.contains(s, F.lit("}")) & (last >= first), F.substring(s, first, last - first + 1)).otherwise(s)

    return let(strip(raw), lambda s: let(unfenced(s), lambda t: F.regexp_replace(braced(t), r",\s*([\]}])", "$1")))


#: Fixed value: what is said of an answer that holds no JSON object.
NO_JSON = "Failed to parse VLM response as JSON"


def parse_answer(raw: Column) -> Column:
    """``struct<success, error, body>`` of a model's answer; a body only if it is a JSON object."""

    def told(text: Column) -> Column:
        good = F.try_parse_json(text).isNotNull()
        return F.struct(good.alias("success"), F.when(~good, F.lit(NO_JSON)).alias("error"), F.when(good, F.from_json(text, RESPONSE)).alias("body"))

    return let(json_object(raw), told)


def short_error(error: Column) -> Column:
    """An error as a report's table shows it."""
    e = F.when(F.length(error) > 0, error).otherwise("Unknown error")
    return F.when(F.length(e) > 30, F.concat(F.left(e, F.lit(27)), F.lit("..."))).otherwise(e)


#: What errors of a model's API mean to a user.
API_ERRORS = {
    "RateLimitError": "Rate limit exceeded. Wait and retry, or reduce concurrency.",
    "AuthenticationError": "Invalid API key. Check VLM_API_KEY or provider-specific key.",
    "BadRequestError": "Invalid request: {detail}",
    "NotFoundError": "Model not found: {model}. Check model name.",
    "APIConnectionError": "Connection failed: {detail}. Check network or API base URL.",
    "Timeout": "Request timeout. Try increasing timeout or reducing image size.",
    "ServiceUnavailableError": "Service unavailable. The API server may be overloaded.",
    "InternalServerError": "Internal server error. Try again later.",
    "PermissionDeniedError": "Permission denied. Check API key permissions.",
    "UnprocessableEntityError": "Invalid request content: {detail}",
}


def friendly_error(kind: Column, message: Column, model: Column, provider: Column | None = None) -> Column:
    """An API error in plain words, with at most 200 characters of its message, which names the provider where that is told."""
    marks = F.contains(message, F.lit("Give Feedback")) | F.contains(message, F.lit("Get Help"))
    clean = F.when(marks, strip(F.split_part(F.split_part(message, F.lit("Give Feedback"), F.lit(1)), F.lit("Get Help"), F.lit(1)))).otherwise(message)
    if provider is not None:
        clean = F.when(F.length(provider) > 0, F.concat(F.lit("["), provider, F.lit("] "), clean)).otherwise(clean)
    known = F.create_map(*[F.lit(x) for pair in API_ERRORS.items() for x in pair])
    said = F.coalesce(F.try_element_at(known, kind), F.lit("API error: {detail}"))
    return F.replace(F.replace(said, F.lit("{detail}"), F.left(clean, F.lit(200))), F.lit("{model}"), model)


#: Beginnings of model names that need no provider before them.
PROVIDERS = ["openai/", "anthropic/", "ollama/", "azure/", "bedrock/", "vertex_ai/", "huggingface/", "together_ai/", "replicate/", "cohere/", "palm/"]
FAMILIES = ["gpt-", "claude-", "o1-", "o3-"]


def model_name(model: Column, api_base: Column) -> Column:
    """The name to call a model by: one with its own endpoint and without a known beginning gets the common protocol's."""
    known = F.lit(False)
    for p in FAMILIES + PROVIDERS:
        known = known | F.startswith(model, F.lit(p))
    return F.when((F.length(api_base) > 0) & ~known, F.concat(F.lit("openai/"), model)).otherwise(model)

"""Text expressions: code tokenizer, truncation, path and identifier parsing, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide results and equal those of the evaluated experiment.
CAMEL_LOWER_UPPER = r"([a-z0-9])([A-Z])"
CAMEL_ACRONYM = r"([A-Z])([A-Z][a-z])"
NON_ALNUM = r"[^A-Za-z0-9]+"
QUALIFIED_ID = r"^([A-Za-z][A-Za-z0-9]*)-([1-9][0-9]*)$"
PATCH_CAP = 12_000
TRUNCATION_MARKER = "\n...[truncated]...\n"
MISSING_SOURCE = "[source missing]"
HTTP_STATUS = r"(?i)HTTP\s+(\d{3})"
RETRY_AFTER = r"""(?i)Retry-After['"=\s:]+(\d+(?:\.\d+)?)"""
RETRYABLE = (429, 500, 502, 503, 529)


def tokenize(text: Column) -> Column:
    """Array of lower-cased code tokens longer than one character; null text gives an empty array.

    Boundaries become spaces first: regexp_replace keeps its compiled pattern, a split inside a lambda compiles one a word.
    """
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), CAMEL_LOWER_UPPER, "$1 $2")
    spaced = F.regexp_replace(spaced, CAMEL_ACRONYM, "$1 $2")
    return F.filter(F.transform(F.split(spaced, NON_ALNUM), F.lower), lambda t: F.length(t) > 1)


def truncate_middle(text: Column, cap: int = PATCH_CAP, marker: str = TRUNCATION_MARKER) -> Column:
    """Text of at most `cap` code points: a prefix, the marker and a suffix of the rest."""
    room = cap - len(marker)
    if room < 0:
        raise ValueError("cap must hold the marker")
    head, tail = room // 2, room - room // 2
    cut = F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.length(text) > cap, cut).otherwise(text)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def with_final_newline(text: Column) -> Column:
    return F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def lines(text: Column) -> Column:
    """LF-separated lines of the normalised text."""
    return F.split(normalize_newlines(text), "\n")


def outer_class(name: Column) -> Column:
    return F.substring_index(name, "$", 1)


def class_path(name: Column) -> Column:
    return F.concat(F.replace(outer_class(name), F.lit("."), F.lit("/")), F.lit(".java"))


def package_path(name: Column) -> Column:
    parts = F.split(outer_class(name), r"\.")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def simple_file_name(name: Column) -> Column:
    return F.concat(F.element_at(F.split(outer_class(name), r"\."), -1), F.lit(".java"))


def representation_file(name: Column) -> Column:
    return F.concat(F.replace(name, F.lit("$"), F.lit("__")), F.lit(".json"))


def parse_qualified_id(value: Column) -> Column:
    """Struct(project, bug_id) of `Project-N` or of the slug `Project_N`; nulls where neither fits."""
    dashed = value.rlike(QUALIFIED_ID)
    slug = ~dashed & value.contains("_")
    return F.struct(
        F.when(dashed, F.regexp_extract(value, QUALIFIED_ID, 1)).when(slug, F.substring_index(value, "_", 1)).alias("project"),
        F.when(dashed, F.regexp_extract(value, QUALIFIED_ID, 2)).when(slug, F.substring_index(value, "_", -1)).alias("bug_id"),
    )


def qualified_id(project: Column, bug: Column) -> Column:
    return F.concat_ws("-", project, bug.cast("string"))


def id_slug(project: Column, bug: Column) -> Column:
    return F.concat_ws("_", project, bug.cast("string"))


def method_slug(method: Column) -> Column:
    return F.lower(F.translate(method, " .-", "___"))


def trigger_parts(raw: Column) -> Column:
    """Struct(class_id, method, malformed) of a `class::method` line."""
    at = F.instr(raw, "::")
    left = F.substring_index(raw, "::", 1)
    method = F.when(at > 0, F.substr(raw, at + 2))
    bad = (at == 0) | (F.trim(left) == "") | (F.trim(method) == "")
    return F.struct(F.when(~bad, F.trim(left)).alias("class_id"), F.when(~bad, F.trim(method)).alias("method"), bad.alias("malformed"))


def relative_dir(raw: Column) -> Column:
    """The one relative path of an exported property, else null."""
    value = F.trim(raw)
    return F.when((value != "") & ~value.startswith("/") & ~value.contains("\n"), value)


def compose_document(class_id: Column, source: Column) -> Column:
    return F.concat_ws("\n", class_id, source)


def compose_sections(*sections: tuple[str, Column]) -> Column:
    """Labelled sections; a null body becomes the placeholder for missing source."""
    out = []
    for label, body in sections:
        out.append(F.concat(F.lit(label + ":\n"), F.coalesce(body, F.lit(MISSING_SOURCE))))
    return F.concat_ws("\n\n", *out)


def http_status(message: Column) -> Column:
    """The three digits behind `HTTP` and white space; null where there are none."""
    return F.regexp_extract(message, HTTP_STATUS, 1).try_cast("int")


def retry_after_seconds(message: Column) -> Column:
    return F.regexp_extract(message, RETRY_AFTER, 1).try_cast("double")


def is_timeout(message: Column) -> Column:
    return F.lower(message).rlike("timed out|timeout")


def is_retryable(message: Column) -> Column:
    """A retryable status, or a timeout of a message without any status."""
    status = http_status(message)
    return F.when(status.isNull(), is_timeout(message)).otherwise(status.isin(*RETRYABLE))


def backoff_seconds(attempt: Column, retry_after: Column) -> Column:
    """1, 2, 4 seconds and 4 from then on, or the server's wish if that is longer."""
    base = F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), (F.least(attempt, F.lit(2)) + 1).cast("int"))
    return F.greatest(base, F.coalesce(retry_after, base))


def redact(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Masks the given secrets wherever they stand, then the word of more than eight characters after `Bearer` and a space."""
    out = text
    for s in secrets:
        out = F.replace(out, F.lit(s), F.lit("[REDACTED]")) if s else out
    head = F.split(out, "Bearer ", -1)

    def masked(chunk: Column) -> Column:
        word = F.substring_index(chunk, " ", 1)
        return F.when(F.length(word) > 8, F.concat(F.lit("[REDACTED]"), F.substr(chunk, F.length(word) + 1))).otherwise(chunk)

    return F.array_join(F.transform(head, lambda x, i: F.when(i == 0, x).otherwise(masked(x))), "Bearer ")


def fixed(x: Column, digits: int) -> Column:
    """The double with so many decimals (1 or more), rounded as its exact binary value stands, ties to even; `nan`, `inf`, `-inf` as such.

    The fraction times 10^digits is taken as a rounded product and its exact error (both factors split in halves of 26 bits), so
    what is above or below a half is told exactly. From 2^53 on there is no fraction, and Java's formatting prints the number.
    """
    scale, a = 10.0**digits, F.abs(x)
    whole = F.floor(F.when(a < 2.0**53, a).otherwise(0.0))
    part = F.when(a < 2.0**53, a - whole.cast("double")).otherwise(0.0)
    high = part * 134217729.0 - (part * 134217729.0 - part)
    scale_high = 134217729.0 * scale - (134217729.0 * scale - scale)
    low, scale_low = part - high, scale - scale_high
    p = part * scale
    error = ((high * scale_high - p) + high * scale_low + low * scale_high) + low * scale_low
    floor = F.floor(p)
    above = (p - floor.cast("double") - 0.5) + error
    n = floor + F.when((above > 0) | ((above == 0) & (floor % 2 == 1)), 1).otherwise(0)
    full = n == 10**digits
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    text = F.concat(sign, (whole + full.cast("long")).cast("string"), F.lit("."), F.lpad(F.when(full, 0).otherwise(n).cast("string"), digits, "0"))
    return F.when(F.isnan(x), "nan").when(a == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(a >= 2.0**53, F.format_string(f"%.{digits}f", x)).otherwise(text)


def format_rate(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(fixed(x, 4))


def format_usd(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(fixed(x, 6))


def format_percent(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.concat(fixed(x * 100, 1), F.lit("%")))

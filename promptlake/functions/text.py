"""Column functions over prompt and document text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The cue patterns (flags, expression). They are read case-insensitively
#: or by lines as their flags say, and with Unicode classes in Spark.
PATTERNS = {
    "example": ("i", r"\b(e\.g\.|for example|for instance|example:|like this|such as)\b|==|```"),
    "constraint": ("i", r"\b(must|only|never|always|constraint|require[sd]?|max|min|limit|exactly|no more than|at least|stdlib only|do not|don't)\b"),
    "structured": ("i", r"\b(json|yaml|csv|markdown table|table with|as a table|bullet(?:ed)? list|numbered list|schema|output format|format:|return only|respond with only)\b"),
    "heading_list": ("m", r"^\s*(#{1,4}\s|\d+[.)]\s|[-*]\s|\w[\w /]{0,30}:\s)"),
    "fence_tag": ("", r"```|<[a-z_]+>"),
    "verify": ("i", r"\b(verify|check that|confirm|acceptance|test with)\b[:\s]"),
    "self_check": ("i", r"\b(re-read|double-check|self-check|before reporting|after writing)\b"),
    "reasoning": ("i", r"\b(think|no_think|reason(?:ing)? (?:step|through)|step by step)\b"),
    "sampling": ("i", r"\b(temperature|sampling|temp\s*[=≈:]|deterministic output)\b"),
    "contract": ("is", r"\b(output|return|respond with|produce)\b.{0,40}\b(only|exactly|format|json|table|file|signature)\b"),
    "machine": ("", r"^\s*(TASK\s*[:\d]|Task spec\s*:|One-shot task\s*:|HANDOFF\s*:)"),
    "harness": ("", r"^\s*<(task-notification|command-message|command-name|system-reminder|local-command-stdout|bash-(input|stdout|stderr))\b"),
    "broad_scope": ("i", r"\b(everything|all of|whole|revamp)\b"),
    "doc_heading": ("m", r"^#{1,6}\s"),
    "doc_list": ("m", r"^\s*([-*]|\d+[.)])\s"),
    "model_size": ("i", r"(\d+)b\b"),
    "reminder": ("s", r"<system-reminder>.*?</system-reminder>"),
    "ide_request": ("is", r"^.*?##\s*My request for Codex:\s*\n?"),
}
#: A text with one of these marks echoes a command.
ECHO_MARKS = ("<command-name>", "<local-command-stdout>", "<local-command-caveat>")
#: Names of project documents.
DOC_NAMES = ("CLAUDE.md", "AGENTS.md", "README.md")

LONG, STRUCTURE_FROM, SUBSTANTIVE = 800, 200, 40
LOW_DEMAND, HIGH_DEMAND, SMALL_B, MEDIUM_B = 200, 1200, 9, 39
LOW_N, GOOD, FAIR = 3, 0.7, 0.4
STUB_WORDS, SPARSE_WORDS, STALE_DAYS = 30, 150, 90


def pattern(name: str) -> str:
    """The pattern in Spark's dialect, with Unicode classes."""
    flags, body = PATTERNS[name]
    return f"(?{flags}U){body}"


def has(name: str, text: Column | str = "content") -> Column:
    return _col(text).rlike(pattern(name))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def content_hash(text: Column | str = "content") -> Column:
    return F.sha2(collapse(text), 256)


def flatten_content(raw: Column | str) -> Column:
    """A JSON value that is a string, or a list of blocks whose texts are joined by newlines; otherwise null."""
    raw = _col(raw)
    block = "array<struct<type:string,text:string>>"
    texts = F.transform(F.filter(F.from_json(raw, block), lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"])
    as_list = F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.array_join(texts, "\n"))
    as_text = F.when(F.startswith(F.ltrim(raw), F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))
    return F.coalesce(as_list, as_text)


def strip_reminders(text: Column | str) -> Column:
    """Without system reminders, stripped; null if nothing is left."""
    return F.nullif(strip(F.regexp_replace(_col(text), pattern("reminder"), "")), F.lit(""))


def echoes_command(text: Column | str) -> Column:
    text = _col(text)
    out = F.lit(False)
    for mark in ECHO_MARKS:
        out = out | F.contains(text, F.lit(mark))
    return out


def ide_request(text: Column | str) -> Column:
    """What follows the first request mark of the editor, stripped; the whole text where there is none."""
    return strip(F.regexp_replace(_col(text), pattern("ide_request"), ""))


def parse_time(iso: Column | str) -> Column:
    """ISO-8601 text to a timestamp; no zone means UTC; null if unreadable."""
    return F.try_to_timestamp(_col(iso))


def origin(text: Column | str = "content") -> Column:
    return F.when(has("machine", text), "machine").otherwise("human")


def machine_event(text: Column | str) -> Column:
    return has("harness", text) | has("machine", text)


def token_estimate(text: Column | str = "content") -> Column:
    return F.length(_col(text)).cast("double") / 4.0


def prompt_ref() -> Column:
    return F.concat_ws(":", "source", "session_id", "message_ref")


def tail(text: Column | str) -> Column:
    """The last fifth of a text, at least 200 characters."""
    text = _col(text)
    n = F.greatest(F.lit(200), F.floor(F.length(text) / 5).cast("int"))
    return F.substring(text, F.greatest(F.lit(1), F.length(text) - n + 1), n)


def score_band(value: Column | str) -> Column:
    value = _col(value)
    return F.when(value.isNull(), "n/a").when(value >= GOOD, "good").when(value >= FAIR, "fair").otherwise("weak")


def score_label(value: Column | str, coverage: Column | str) -> Column:
    value, coverage = _col(value), _col(coverage)
    low = F.when((coverage > 0) & (coverage < LOW_N), " (low n)").otherwise("")
    return F.when(value.isNull(), "n/a").otherwise(F.concat(F.format_string("%.2f", value), F.lit(" "), score_band(value), low))


def model_tier(model: Column | str = "model") -> Column:
    name = F.lower(_col(model))
    size = F.try_to_number(F.nullif(F.regexp_extract(name, pattern("model_size"), 1), F.lit("")), F.lit("999999")).cast("int")
    named = F.when(F.contains(name, F.lit("haiku")), "small").when(F.contains(name, F.lit("sonnet")), "medium").when(F.contains(name, F.lit("opus")), "large")
    sized = F.when(size <= SMALL_B, "small").when(size <= MEDIUM_B, "medium").when(size.isNotNull(), "large")
    return F.when(name.isNull() | name.isin("", "copilot/auto"), F.lit(None).cast("string")).otherwise(F.coalesce(named, sized))


def demand_tier(text: Column | str = "content") -> Column:
    n = F.length(_col(text))
    return F.when(n < LOW_DEMAND, "low").when(n >= HIGH_DEMAND, "high").otherwise("medium")


def word_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(r"(?U)\S+"))


def heading_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(pattern("doc_heading")))


def list_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(pattern("doc_list")))


def redirect_stub(text: Column | str) -> Column:
    """Short and naming a project document: it only points elsewhere."""
    names = F.lit(False)
    for name in DOC_NAMES:
        names = names | F.contains(_col(text), F.lit(name))
    # names first: they are found fast, and words are counted only where there is one
    return names & (word_count(text) <= STUB_WORDS)


def staleness_days(last: Column | str, now: Column) -> Column:
    """Days since last (a timestamp), not below zero; null if unknown."""
    seconds = F.unix_seconds(now) - F.unix_seconds(_col(last))
    return F.when(_col(last).isNotNull(), F.greatest(seconds, F.lit(0)) / F.lit(86400.0))


def doc_flags(text: Column | str, stale_days: Column | str) -> Column:
    # one chain: each test runs once and only where the one before leaves it open
    flat = (heading_count(text) == 0) & (list_count(text) == 0)
    kind = F.when(~redirect_stub(text), F.when(word_count(text) < SPARSE_WORDS, "sparse").when(flat, "unstructured"))
    return F.array_compact(F.array(kind, F.when(_col(stale_days) > STALE_DAYS, "stale")))


def display_path(path: Column | str, home: str) -> Column:
    path, root = _col(path), home.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.concat(F.lit("~/"), F.substring(path, len(root) + 1, 1 << 30))).otherwise(path)


def snippet(text: Column | str, width: int = 200) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("..."))).otherwise(flat)


def json_object(text: Column | str) -> Column:
    """The JSON object inside free text: the first fenced block, else from the first { to the last }; null if it is none."""
    text = _col(text)
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.coalesce(fenced, braced)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def since(text: str, now: int) -> int:
    """Epoch seconds of a relative time (7d, 4w, 3m of 30 days each) or an ISO date."""
    import re
    from datetime import UTC, datetime

    m = re.fullmatch(r"(\d+)([dwm])", text)
    if m:
        return now - int(m[1]) * {"d": 1, "w": 7, "m": 30}[m[2]] * 86400
    when = datetime.fromisoformat(text)
    return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp())

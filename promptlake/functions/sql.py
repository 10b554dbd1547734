"""The scalar families as functions of Spark SQL: bodies of built-in expressions that Spark inlines, so a query over them has no UDF."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as X


def _has(name: str) -> str:
    return f't rlike r"{X.pattern(name)}"'


def _replaced(name: str) -> str:
    return f'regexp_replace(t, r"{X.pattern(name)}", "")'


def _named(names: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(t, '{n}')" for n in names) + ")"


def _bodies() -> dict[str, tuple[str, str, str]]:
    """name: parameters, type, body. A function may call those above it."""
    text, flag = "t string", "boolean"
    return {
        "strip_text": (text, "string", r'''regexp_replace(t, r"(?U)^\s+|\s+$", "")'''),
        "collapse_text": (text, "string", r'''trim(regexp_replace(t, r"(?U)\s+", " "))'''),
        "content_hash": (text, "string", "sha2(collapse_text(t), 256)"),
        "flatten_content": (text, "string", """coalesce(case when startswith(ltrim(t), '[') then array_join(transform(filter(from_json(t, 'array<struct<type:string,text:string>>'), b -> b.type = 'text' and coalesce(b.text, '') <> ''), b -> b.text), '\\n') end,
            case when startswith(ltrim(t), '"') then get_json_object(concat('{"v":', t, '}'), '$.v') end)"""),
        "strip_reminders": (text, "string", f"nullif(strip_text({_replaced('reminder')}), '')"),
        "echoes_command": (text, flag, _named(X.ECHO_MARKS)),
        "ide_request": (text, "string", f"strip_text({_replaced('ide_request')})"),
        "parse_time": (text, "timestamp", "try_to_timestamp(t)"),
        "prompt_origin": (text, "string", f"case when {_has('machine')} then 'machine' else 'human' end"),
        "machine_event": (text, flag, f"{_has('harness')} or {_has('machine')}"),
        "token_estimate": (text, "double", "cast(length(t) as double) / 4.0D"),
        **{f"cue_{name}": (text, flag, _has(name)) for name in X.PATTERNS if name not in ("model_size", "reminder", "ide_request")},
        "prompt_tail": (text, "string", "substring(t, greatest(1, length(t) - greatest(200, cast(floor(length(t) / 5) as int)) + 1), greatest(200, cast(floor(length(t) / 5) as int)))"),
        "trigger_kind": (text, "string", f"case when machine_event(t) then null when length(t) >= {X.STRUCTURE_FROM} and not (cue_example(t) or cue_structured(t)) then 'shape' when length(t) < {X.STRUCTURE_FROM} and cue_broad_scope(t) and not cue_constraint(t) then 'scope' end"),
        "score_band": ("v double", "string", f"case when v is null then 'n/a' when v >= {X.GOOD}D then 'good' when v >= {X.FAIR}D then 'fair' else 'weak' end"),
        "score_label": ("v double, n bigint", "string", f"case when v is null then 'n/a' else concat(format_string('%.2f', v), ' ', score_band(v), case when n > 0 and n < {X.LOW_N} then ' (low n)' else '' end) end"),
        "model_size": (text, "int", f"""cast(try_to_number(nullif(regexp_extract(lower(t), r"{X.pattern('model_size')}", 1), ''), '999999') as int)"""),
        "model_tier": (text, "string", f"""case when t is null or lower(t) in ('', 'copilot/auto') then null when contains(lower(t), 'haiku') then 'small' when contains(lower(t), 'sonnet') then 'medium' when contains(lower(t), 'opus') then 'large'
            when model_size(t) <= {X.SMALL_B} then 'small' when model_size(t) <= {X.MEDIUM_B} then 'medium' when model_size(t) is not null then 'large' end"""),
        "demand_tier": (text, "string", f"case when length(t) < {X.LOW_DEMAND} then 'low' when length(t) >= {X.HIGH_DEMAND} then 'high' else 'medium' end"),
        "word_count": (text, "int", r'''case when strip_text(t) = '' then 0 else size(split(strip_text(t), r"(?U)\s+")) end'''),
        "heading_count": (text, "int", f'regexp_count(t, r"{X.pattern("doc_heading")}")'),
        "list_count": (text, "int", f'regexp_count(t, r"{X.pattern("doc_list")}")'),
        "redirect_stub": (text, flag, f"word_count(t) <= {X.STUB_WORDS} and {_named(X.DOC_NAMES)}"),
        "staleness_days": ("seen timestamp, now timestamp", "double", "case when seen is not null then greatest(unix_seconds(now) - unix_seconds(seen), 0) / 86400.0D end"),
        "doc_flags": ("t string, days double", "array<string>", f"""array_compact(array(case when not redirect_stub(t) and word_count(t) < {X.SPARSE_WORDS} then 'sparse' end,
            case when not redirect_stub(t) and word_count(t) >= {X.SPARSE_WORDS} and heading_count(t) = 0 and list_count(t) = 0 then 'unstructured' end, case when days > {X.STALE_DAYS} then 'stale' end))"""),
        "display_path": ("path string, home string", "string", "case when startswith(path, concat(rtrim('/', home), '/')) then concat('~/', substring(path, length(rtrim('/', home)) + 2)) else path end"),
        "snippet": (text, "string", "case when length(collapse_text(t)) > 200 then concat(substring(collapse_text(t), 1, 200), '...') else collapse_text(t) end"),
        "json_object_in": (text, "string", r'''case when try_parse_json(coalesce(nullif(regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), ''), nullif(regexp_extract(t, r"(?s)(\{.*\})", 1), ''))) is not null
            then coalesce(nullif(regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), ''), nullif(regexp_extract(t, r"(?s)(\{.*\})", 1), '')) end'''),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the scalar families known to the session's SQL as temporary functions; gives their names."""
    bodies = _bodies()
    for name, (parameters, kind, body) in bodies.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    return list(bodies)

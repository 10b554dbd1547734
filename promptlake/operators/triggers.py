"""Per-event triggers with a once-per-session gate: stateless decisions and batch twins of the stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..functions import text as X
from . import docs, infer

FROM = 200


def long_unstructured(text: Column | str = "content") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return (F.length(text) >= FROM) & ~(X.has("example", text) | X.has("structured", text))


def short_vague(text: Column | str = "content") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return (F.length(text) < FROM) & X.has("broad_scope", text) & ~X.has("constraint", text)


def trigger_kind(text: Column | str = "content") -> Column:
    """shape, scope, or null; machine events never trigger."""
    return F.when(X.machine_event(text), F.lit(None).cast("string")).when(long_unstructured(text), "shape").when(short_vague(text), "scope")


def resolve_mode(events: DataFrame, overrides: DataFrame, default: str) -> DataFrame:
    """events with mode: that of the longest override path that holds the event's cwd, else the default.

    The ancestors of each distinct cwd are joined by equality, so there is no range join.
    """
    parts = F.split(F.regexp_replace("cwd", "/+$", ""), "/")
    steps = events.select("cwd").where("cwd is not null").distinct().select("cwd", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path"))
    rules = overrides.select(F.regexp_replace("path", "/+$", "").alias("path"), "mode")
    best = steps.join(rules, "path").groupBy("cwd").agg(F.max_by("mode", F.length("path")).alias("mode"))
    return events.join(best, "cwd", "left").withColumn("mode", F.coalesce("mode", F.lit(default)))


def session_gate(events: DataFrame, order: list[str]) -> DataFrame:
    """Of the triggered events the first of each session. Events without session or text give nothing."""
    known = events.where("coalesce(session_id, '') <> '' and coalesce(content, '') <> ''").withColumn("kind", trigger_kind("content")).where("kind is not null")
    first = F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    return known.withColumn("_n", first).where("_n = 1").drop("_n")


def last_prompts(prompts: DataFrame, n: int) -> DataFrame:
    """The newest n human prompts of each session with their place, newest first."""
    by = Window.partitionBy("source", "session_id").orderBy(F.desc("timestamp"), F.desc("message_ref"))
    return prompts.where("origin = 'human'").withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def session_context(prompts: DataFrame, n: int = 3, width: int = 300) -> DataFrame:
    """For each session's newest human prompt the n newest other texts before it, cut to width."""
    human = prompts.where("origin = 'human'").select("source", "session_id", "message_ref", "timestamp", X.strip("content").alias("text"))
    key = F.struct("timestamp", "message_ref")
    last = human.groupBy("source", "session_id").agg(F.max_by("text", key).alias("now"))
    rest = human.join(last, ["source", "session_id"]).where("text <> now")
    by = Window.partitionBy("source", "session_id").orderBy(F.desc("timestamp"), F.desc("message_ref"))
    return rest.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).select("source", "session_id", "place", F.substring("text", 1, width).alias("text"))


CONTEXT_DOC, CONTEXT_TEXT, CONTEXT_BEFORE = 1500, 300, 3


def document_excerpts(cwds: DataFrame, documents: DataFrame, home: str, width: int = CONTEXT_DOC) -> DataFrame:
    """(cwd, name, excerpt): of the documents (dir, name, text; a path once) nearest to each cwd the first that is no empty text or stub, in the order of their fixed names."""
    usable = documents.select(F.concat_ws("/", "dir", "name").alias("path"), "name", X.strip("text").alias("text")).where((F.col("text") != "") & ~X.redirect_stub("text"))
    usable = usable.select("path", "name", F.substring("text", 1, width).alias("excerpt"), F.array_position(F.array(*map(F.lit, X.DOC_NAMES)), F.col("name")).alias("place"))
    hits = docs.nearest(cwds, documents, home).join(usable, "path")
    return hits.groupBy("cwd").agg(F.min_by(F.struct("name", "excerpt"), "place").alias("d")).select("cwd", "d.*")


def earlier_texts(prompts: DataFrame, n: int = CONTEXT_BEFORE, width: int = CONTEXT_TEXT) -> DataFrame:
    """(source, session_id, message_ref, earlier) of every human prompt: the texts of the n before it that differ from its own, newest first, cut to width.

    What is ordered inside a session is cut texts and hashes; the frame holds n rows, whatever the session's size.
    """
    text = X.strip("content")
    human = prompts.where("origin = 'human'").select("source", "session_id", "message_ref", "timestamp", F.struct(F.sha2(text, 256).alias("hash"), F.substring(text, 1, width).alias("text")).alias("t"))
    by = Window.partitionBy("source", "session_id").orderBy("timestamp", "message_ref").rowsBetween(-n, -1)
    seen = human.withColumn("before", F.reverse(F.collect_list("t").over(by)))
    other = F.filter("before", lambda x: x["hash"] != F.col("t.hash"))
    return seen.select("source", "session_id", "message_ref", F.transform(other, lambda x: x["text"]).alias("earlier"))


def rewrite_context(prompts: DataFrame, documents: DataFrame, home: str) -> DataFrame:
    """Every triggered prompt (source, session_id, message_ref, content, kind) with the context of its rewrite: directory, document excerpt, earlier prompts; null where there is none of them."""
    flagged = prompts.withColumn("kind", trigger_kind("content")).where("kind is not null").select("source", "session_id", "message_ref", "content", "cwd", "kind")
    excerpts = document_excerpts(flagged.where("cwd is not null"), documents, home)
    full = flagged.join(earlier_texts(prompts), ["source", "session_id", "message_ref"], "left").join(excerpts, "cwd", "left")
    place = F.when(F.coalesce("cwd", F.lit("")) != "", F.concat(F.lit("Working directory: "), "cwd"))
    doc = F.concat(F.lit("Project doc ("), "name", F.lit(", excerpt):\n"), "excerpt")
    before = F.when(F.size("earlier") > 0, F.concat(F.lit("Earlier prompts this session (newest first):\n- "), F.array_join("earlier", "\n- ")))
    return full.select("source", "session_id", "message_ref", "content", "kind", F.nullif(F.concat_ws("\n\n", place, doc, before), F.lit("")).alias("context"))


def rewrites(contexts: DataFrame, memo: DataFrame, judge: Callable[[list[str]], list[str | None]] | None, version: str = "rewrite-1") -> DataFrame:
    """(source, session_id, message_ref, kind, rewrite) of rewrite_context's rows: null where the model is silent, gives no text or is none at all.

    Equal prompts in equal contexts are asked once; what the memo (key, payload) holds is not asked.
    """
    block = F.when(F.col("context").isNull(), F.col("content")).otherwise(F.concat(F.lit("SESSION CONTEXT:\n"), "context", F.lit("\n\nPROMPT TO REWRITE:\n"), "content"))
    asked = contexts.withColumn("block", block).withColumn("key", F.sha2(F.concat("block", F.lit(version), F.lit(infer.MODEL)), 256))
    got = infer.through_memo(asked.select("key", "block").dropDuplicates(["key"]), memo, judge or (lambda blocks: [None] * len(blocks)))
    said = F.try_variant_get(F.try_parse_json("payload"), "$.rewritten_prompt", "variant")
    text = F.when(F.schema_of_variant(said) == "STRING", F.nullif(X.strip(F.get_json_object("payload", "$.rewritten_prompt")), F.lit("")))
    return asked.join(got.where("status = 'ok'").select("key", text.alias("rewrite")), "key", "left").select("source", "session_id", "message_ref", "kind", "rewrite")


def _rewrite_step(state: dict, kind: str, triggered: bool) -> str:
    """A triggered submit is blocked unless a pass is held, which it then uses up; a consume takes the pending block, once, and grants one pass."""
    if kind == "consume":
        got = state["pending"]
        state.update(pending=False, passing=state["passing"] or got)
        return "consumed" if got else "nothing"
    if state["passing"]:
        state["passing"] = False
        return "passed"
    if triggered:
        state["pending"] = True
        return "blocked"
    return "none"


def fold_rewrites(rows: pd.DataFrame) -> list[str]:
    """Outcomes of one session's ordered events. kind: submit (with a trigger flag) or consume."""
    state = {"pending": False, "passing": False}
    return [_rewrite_step(state, k, t) for k, t in zip(rows["kind"], rows["triggered"], strict=True)]


def _carried(events: DataFrame, fresh: Callable[[], dict], step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """Folds each session's events in order of seq: step(state, event) gives the event's result and changes the state.

    Sessions are dealt to partitions and sorted there; only the state of the present session is
    held, so a session of any length streams through.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state, names = None, {}, [c.split()[0] for c in schema.split(", ")]
        for f in frames:
            out = []
            for event in f.astype(object).where(f.notna(), None).to_dict("records"):
                if session is None or event["session_id"] != session:
                    session, state = event["session_id"], fresh()
                out.append({"session_id": session, "seq": event["seq"], **step(state, event)})
            yield pd.DataFrame(out, columns=names)

    known = events.where("coalesce(session_id, '') <> ''")
    return known.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(run, schema)


def skip_next(events: DataFrame) -> DataFrame:
    """(session_id, seq, kind, outcome) of events (session_id, seq, kind, triggered). Events without a session give nothing."""

    def step(state: dict, event: dict) -> dict:
        return {"kind": event["kind"], "outcome": _rewrite_step(state, event["kind"], event["triggered"])}

    return _carried(events.select("session_id", "seq", "kind", "triggered"), lambda: {"pending": False, "passing": False}, step, "session_id string, seq bigint, kind string, outcome string")


#: Outcomes: none; passed (the resend after a choice); blocked (held back, a rewrite is offered); message and
#: context (a tip beside the answer); released (the chosen text); nothing (no rewrite is pending).
DECISION = "session_id string, seq bigint, event string, outcome string, text string"


def fresh_session() -> dict:
    return {"nudged": False, "pending": None, "passing": False, "last": None}


def decide_step(state: dict, event: dict) -> dict:
    """The decision on one event of a session, by event, mode and what the session has seen.

    accept and original choose between the pending rewrite and its original, once, and let the
    next submit pass. Tips come once a session, whatever the event; mode always rewrites every
    human prompt that a rewrite exists for. A stop event without text judges the session's last
    human prompt that was not held back, of which the state keeps the trigger.
    """
    kind, mode, text = event["event"], event["mode"], event["content"]
    found, known = event["kind"], bool(text)
    if kind == "stop" and not known:
        found, known = state["last"], state["last"] is not None
    if kind in ("accept", "original"):
        if state["pending"] is None:
            return {"event": kind, "outcome": "nothing", "text": None}
        chosen = state["pending"][kind == "accept"]
        state.update(pending=None, passing=True)
        return {"event": kind, "outcome": "released", "text": chosen}
    outcome, said = "none", None
    if mode != "off" and known:
        triggered = found is not None and not state["nudged"]
        if kind == "pre_call" or (kind == "stop" and mode == "coach"):
            if triggered:
                state["nudged"] = True
                outcome, said = "context" if kind == "pre_call" else "message", found
        elif kind == "submit":
            if state["passing"]:
                state["passing"] = False
                outcome = "passed"
            elif (mode == "always" and not event["machine"]) or (mode == "coach" and triggered):
                state["nudged"] |= mode == "coach"
                if event["rewrite"] is not None:
                    state["pending"] = (text, event["rewrite"])
                    outcome, said = "blocked", event["rewrite"]
                elif mode == "coach":
                    outcome, said = "message", found
    if kind == "submit" and text and not event["machine"] and outcome != "blocked":
        state["last"] = event["kind"]
    return {"event": kind, "outcome": outcome, "text": said}


def _decidable(events: DataFrame, *keep: str) -> DataFrame:
    return events.select(*keep, "session_id", "seq", "event", "mode", "content", "rewrite", trigger_kind("content").alias("kind"), F.coalesce(X.machine_event("content"), F.lit(False)).alias("machine"))


def decide(events: DataFrame) -> DataFrame:
    """Decisions on events (session_id, seq, event, mode, content, rewrite), each session in order of seq. rewrite: the model's offer, or null."""
    return _carried(_decidable(events), fresh_session, decide_step, DECISION)


def decide_stream(events: DataFrame, time: str, idle: str = "30 days") -> DataFrame:
    """The same as a stream with an event time: a session's state lasts from micro-batch to micro-batch and ends after idle event time.

    State is a flag, both texts of a pending rewrite and the trigger of the last prompt; a session that has
    nothing of these keeps no state.
    """
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = fresh_session()
        if held.exists:
            nudged, passing, original, rewrite, last = held.get
            state = {"nudged": nudged, "passing": passing, "pending": None if rewrite is None else (original, rewrite), "last": last}
        rows = pd.concat(list(frames), ignore_index=True).sort_values("seq")
        newest = max(int(rows["_time"].max().timestamp() * 1000), held.getCurrentWatermarkMs())
        out = [{"session_id": key[0], "seq": e["seq"], **decide_step(state, e)} for e in rows.astype(object).where(rows.notna(), None).to_dict("records")]
        if state != fresh_session():
            held.update((state["nudged"], state["passing"], *(state["pending"] or (None, None)), state["last"]))
            held.setTimeoutTimestamp(newest + ms)
        elif held.exists:
            held.remove()
        yield pd.DataFrame(out, columns=["session_id", "seq", "event", "outcome", "text"])

    known = _decidable(events.where("coalesce(session_id, '') <> ''").withColumn("_time", F.col(time)).withWatermark("_time", idle), "_time")
    return known.groupBy("session_id").applyInPandasWithState(run, DECISION, "nudged boolean, passing boolean, original string, rewrite string, last string", "append", GroupStateTimeout.EventTimeTimeout)

"""Readers of chat and agent logs. Each parser takes lines (file, line_no, value) and gives prompts.

Wrong shapes are skipped, never an error: a value that is no JSON object, or has other
types than expected, parses to nulls and is filtered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.ingest import cut

TRANSCRIPT = "type string, promptSource string, origin struct<kind:string>, isSidechain string, uuid string, parentUuid string, timestamp string, sessionId string, cwd string, message string"
ROLLOUT = "type string, timestamp string, payload struct<type:string,kind:string,message:string,cwd:string,model:string>"
REQUEST = "requestId string, timestamp double, message string, modelId string"
SESSION = "session_id string, title string, timestamp string, messages array<string>"
CONVERSATION = "struct<conversation_id:string,id:string,create_time:double,mapping:map<string,string>>"
EXPORT = f"array<{CONVERSATION}>"


def read_lines(spark: SparkSession, glob: str) -> DataFrame:
    """(file, line_no, value) of text files. line_no orders the lines of a file; it is not contiguous."""
    raw = spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
    # Rows of one block come in order; blocks of a file are ordered by their start.
    place = F.col("_n") - F.min("_n").over(Window.partitionBy("file", "_block"))
    return raw.select("file", (F.col("_block") + place).alias("line_no"), "value")


def read_whole(spark: SparkSession, glob: str) -> DataFrame:
    """(file, value) with one row for each file."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def list_items(spark: SparkSession, glob: str) -> DataFrame:
    """(file, nth, value) of the elements of JSON lists, one list a file, read in blocks: a list of any size spreads over tasks.

    The files are cut behind each closing brace, so pieces are small and a block needs nothing of the
    others to be read. What is inside a string and how deep it is nested follows from running sums of
    quotes and brackets over the pieces, in each block and then over the blocks; only those numbers are ordered.
    The pieces up to the next end of an outermost object are put together and parsed: only an element is ever held
    whole. Files that are no complete list give nothing; an element that is no JSON is left out with the plain values before it.
    """
    pieces = spark.read.text(glob, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    outside = lambda c: F.regexp_replace(c, r'"[^"]*+("|$)', "")
    more = lambda c: F.length(F.translate(c, "]}", "")) - F.length(F.translate(c, "[{", ""))
    seen = pieces.withColumn("_bare", bare).withColumn("quotes", F.length("_bare") - F.length(F.translate("_bare", '"', "")))
    # Depth gained by a piece that begins outside and inside a string; the brace behind the piece counts where it ends outside.
    even = (F.col("quotes") % 2 == 0).cast("int")
    seen = seen.select("file", "block", "n", "quotes", (more(outside("_bare")) - even).alias("d0"), (more(outside(F.regexp_replace("_bare", r'^[^"]*+("|$)', ""))) - (1 - even)).alias("d1"), F.substring(F.ltrim("value"), 1, 1).alias("head"))
    here = Window.partitionBy("file", "block").orderBy("n")
    before, upto = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    odd = lambda *c: reduce(Column.__add__, (F.col(x) for x in c)) % 2 == 1
    seen = seen.withColumn("q", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    for name, a, b in (("e0", "d1", "d0"), ("e1", "d0", "d1")):
        seen = seen.withColumn(name, F.sum(F.when(odd("q"), F.col(a)).otherwise(F.col(b))).over(upto))
    # Blocks are few: their sums are chained file by file.
    blocks = seen.groupBy("file", "block").agg(F.sum("quotes").alias("bq"), F.max_by("e0", "n").alias("be0"), F.max_by("e1", "n").alias("be1"), F.min_by("head", "n").alias("head"))
    files = Window.partitionBy("file").orderBy("block")
    past = files.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("q0", F.coalesce(F.sum("bq").over(past), F.lit(0))).withColumn("be", F.when(odd("q0"), F.col("be1")).otherwise(F.col("be0")))
    whole = Window.partitionBy("file")
    blocks = blocks.withColumn("depth0", F.coalesce(F.sum("be").over(past), F.lit(0)))
    # A list ends at depth 0, and the brace that its last piece lacks makes that -1.
    is_list = (F.sum("be").over(whole) == -1) & (F.sum("bq").over(whole) % 2 == 0) & (F.min_by("head", "block").over(whole) == "[")
    blocks = blocks.withColumn("_list", is_list).where("_list").select("file", "block", "q0", "depth0")
    placed = seen.join(blocks, ["file", "block"]).withColumn("depth", F.col("depth0") + F.when(odd("q0"), F.col("e1")).otherwise(F.col("e0")))
    placed = placed.withColumn("ends", (~odd("q0", "q", "quotes") & (F.col("depth") == 1)).cast("int"))
    placed = placed.select("file", "block", "n", "ends", (F.col("depth") < 0).alias("last"), F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("g"))
    ends = placed.groupBy("file", "block").agg(F.sum("ends").alias("ends")).select("file", "block", F.coalesce(F.sum("ends").over(past), F.lit(0)).alias("g0"))
    placed = placed.join(ends, ["file", "block"]).select("file", "block", "n", "last", (F.col("g") + F.col("g0")).alias("g"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "value"))), lambda x: x["value"]), "}")
    groups = pieces.join(placed, ["file", "block", "n"]).groupBy("file", "g").agg(text.alias("text"), F.max("last").alias("last"))
    body = F.regexp_replace(F.when(F.col("last"), F.regexp_replace("text", r"\]\s*$", "")).otherwise(F.concat("text", F.lit("}"))), r"^\s*[\[,]", "")
    items = F.when(X.strip(body) != "", F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>"))
    got = groups.select("file", "g", items.alias("items")).where(F.size("items") > 0)
    got = cut(got)
    # Numbers go on from group to group, over ranges of groups first.
    size = got.select("file", "g", F.floor(F.col("g") / 10_000).alias("range"), F.size("items").alias("k"))
    size = size.withColumn("first", F.coalesce(F.sum("k").over(Window.partitionBy("file", "range").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = size.groupBy("file", "range").agg(F.sum("k").alias("k")).select("file", "range", F.coalesce(F.sum("k").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    first = size.join(ranges, ["file", "range"]).select("file", "g", (F.col("first") + F.col("base")).alias("first"))
    return got.join(first, ["file", "g"]).select("file", "first", F.posexplode("items").alias("i", "value")).select("file", (F.col("first") + F.col("i")).alias("nth"), "value")


def stem(file: Column | str = "file") -> Column:
    return F.regexp_extract(file, r"([^/]+)\.jsonl$", 1)


def _nonblank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _short_hash(content: str = "content") -> Column:
    return F.substring(X.content_hash(content), 1, 16)


def _prompt(source: str, **columns: Column) -> list[Column]:
    out = [F.lit(source).alias("source"), *(c.alias(n) for n, c in columns.items())]
    return [*out, X.content_hash("content").alias("content_hash"), X.origin("content").alias("origin")]


def transcript_events(lines: DataFrame, *keep: str) -> DataFrame:
    """(file, line_no, ref, content, timestamp, session, cwd, parent, model) of typed prompts (with ref) and of replies of a named model (with parent).

    A row by itself: works on streams too. keep: further columns of lines.
    """
    j = lines.select("file", "line_no", *keep, F.from_json("value", TRANSCRIPT).alias("j")).where("j is not null").select("file", "line_no", *keep, "j.*")
    flat = X.flatten_content(F.get_json_object("message", "$.content"))
    # get_json_object unquotes strings, so a content that was a string is used as it is.
    whole = F.get_json_object("message", "$.content")
    content = F.coalesce(flat, F.when(~F.startswith(F.ltrim(whole), F.lit("[")), whole))
    typed = (F.col("type") == "user") & (F.col("origin.kind") == "human") & (F.col("promptSource") == "typed") & ~F.coalesce(F.col("isSidechain"), F.lit("false")).isin("true", "1")
    rows = j.withColumn("content", F.when(typed & ~X.echoes_command(content), X.strip_reminders(content))).withColumn("timestamp", X.parse_time("timestamp"))
    rows = rows.withColumn("ref", F.when(F.col("content").isNotNull() & F.col("timestamp").isNotNull(), F.coalesce(F.nullif("uuid", F.lit("")), _short_hash())))
    model = F.when(F.col("type") == "assistant", F.nullif(F.get_json_object("message", "$.model"), F.lit("<synthetic>")))
    rows = rows.select("file", "line_no", *keep, "ref", "content", "timestamp", F.coalesce("sessionId", F.lit("unknown")).alias("session"), "cwd", F.when(model.isNotNull(), F.col("parentUuid")).alias("parent"), model.alias("model"))
    # The kept columns take part so that a stream's watermark sees all lines: a filter without its column would run before it.
    return rows.where(reduce(Column.__or__, (F.col(c).isNull() for c in keep), F.col("ref").isNotNull() | F.col("parent").isNotNull()))


def transcript_prompts(rows: DataFrame) -> DataFrame:
    """Prompts of the unified schema from rows (ref, content, timestamp, session, cwd, model)."""
    return rows.select(*_prompt("claude-code", session_id=F.col("session"), message_ref=F.col("ref"), content=F.col("content"), timestamp=F.col("timestamp"), cwd=F.col("cwd"), git_repo=F.col("cwd"), model=F.col("model")))


def transcripts(lines: DataFrame) -> DataFrame:
    """Agent transcripts: typed human lines outside side chains, with the model of the reply.

    The model is that of the first later assistant line of the same file, before the next
    accepted prompt, that answers the prompt and names a real model. Only references and
    models are ordered by line; the texts join their prompt's model back.
    """
    rows = transcript_events(lines)
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    narrow = rows.select("file", "line_no", "ref", "parent", "model")
    seen = narrow.withColumn("of_ref", F.last("ref", True).over(order)).withColumn("of_line", F.last(F.when(F.col("ref").isNotNull(), F.col("line_no")), True).over(order))
    replies = seen.where("parent = of_ref").groupBy("file", F.col("of_line").alias("line_no")).agg(F.min_by("model", "line_no").alias("model"))
    return transcript_prompts(rows.where("ref is not null").drop("model").join(replies, ["file", "line_no"], "left"))


def rollouts(lines: DataFrame) -> DataFrame:
    """Rollout event logs: plain user messages, with the last session's directory before and the next turn's model after.

    Only directories and models are ordered by line; the texts join theirs back.
    """
    j = lines.select("file", "line_no", F.from_json("value", ROLLOUT).alias("j")).where("j is not null").select("file", "line_no", "j.*")
    wanted = (F.col("type") == "event_msg") & (F.col("payload.type") == "user_message") & (F.col("payload.kind") == "plain")
    rows = j.withColumn("content", F.when(wanted, _nonblank(X.ide_request(F.col("payload.message"))))).withColumn("timestamp", X.parse_time("timestamp"))
    rows = rows.withColumn("hit", F.col("content").isNotNull() & F.col("timestamp").isNotNull())
    meta, turn = F.when(F.col("type") == "session_meta", F.col("payload.cwd")), F.when(F.col("type") == "turn_context", F.col("payload.model"))
    narrow = rows.select("file", "line_no", "hit", meta.alias("cwd"), turn.alias("model")).where("hit or cwd is not null or model is not null")
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = narrow.withColumn("seen_cwd", F.last("cwd", True).over(order)).withColumn("of_line", F.last(F.when(F.col("hit"), F.col("line_no")), True).over(order))
    # A prompt's own row gives its directory, the first later turn before the next prompt its model.
    context = seen.where("of_line is not null").groupBy("file", F.col("of_line").alias("line_no")).agg(F.max(F.when(F.col("hit"), F.col("seen_cwd"))).alias("seen_cwd"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line_no"))).alias("model"))
    kept = rows.where("hit").select("file", "line_no", "content", "timestamp").join(context, ["file", "line_no"], "left")
    return kept.select(*_prompt("codex", session_id=stem(), message_ref=_short_hash(), content=F.col("content"), timestamp=F.col("timestamp"), cwd=F.col("seen_cwd"), git_repo=F.col("seen_cwd"), model=F.col("model")))


def patch_logs(lines: DataFrame) -> DataFrame:
    """Patch logs: requests of full snapshots (kind 0) and of appended requests (kind 2). A time must be a number; a quoted one is skipped."""
    kind = F.get_json_object("value", "$.kind")
    body = F.when(kind == "0", F.get_json_object("value", "$.v.requests")).when((kind == "2") & (F.get_json_object("value", "$.k") == '["requests"]'), F.get_json_object("value", "$.v"))
    # A request is parsed by itself, so one of a wrong shape leaves the others.
    each = lines.select("file", F.explode(F.from_json(body, "array<string>")).alias("raw")).select("file", F.from_json("raw", REQUEST).alias("r"))
    text = F.get_json_object("r.message", "$.text")
    rows = each.select("file", "r.*", text.alias("content")).where((X.strip("content") != "") & F.col("timestamp").isNotNull())
    when = F.timestamp_micros((F.col("timestamp") * 1000).cast("bigint"))
    return rows.select(*_prompt("copilot", session_id=stem(), message_ref=F.coalesce(F.nullif("requestId", F.lit("")), _short_hash()), content=F.col("content"), timestamp=when, cwd=F.lit(None).cast("string"), git_repo=F.lit(None).cast("string"), model=F.col("modelId")))


def chat_tables(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Relational chat store: active, uncompacted user messages with their sessions."""
    m = messages.where("role = 'user' and active = 1 and coalesce(compacted, 0) = 0 and content is not null").where(X.strip("content") != "")
    rows = m.select(F.col("id").alias("message_id"), F.col("session_id").alias("sid"), "content", F.col("timestamp").alias("epoch")).join(sessions.select(F.col("id").alias("sid"), "cwd", "git_repo_root", "model"), "sid")
    when = F.timestamp_micros((F.col("epoch") * 1000000).cast("bigint"))
    return rows.select(*_prompt("hermes", session_id=F.col("sid"), message_ref=F.col("message_id").cast("string"), content=F.col("content"), timestamp=when, cwd=F.col("cwd"), git_repo=F.col("git_repo_root"), model=F.col("model")))


def session_titles(sessions: DataFrame, since: Column, k: int = 30) -> DataFrame:
    """(day, title) of titled sessions since a time, newest first."""
    titled = sessions.where((F.col("started_at") >= since) & (F.coalesce("title", F.lit("")) != ""))
    return titled.orderBy(F.desc("started_at"), "id").limit(k).select("id", F.date_format("started_at", "yyyy-MM-dd").alias("day"), "title")


def json_sessions(files: DataFrame) -> DataFrame:
    """Generic session lists (file, value): user messages numbered from 0 within their list entry.

    Entries without a session_id are of session "import". A numeric time counts seconds;
    a missing or unreadable one is 1970. Two entries of one session both count from 0.
    """
    return session_items(files.select(F.explode(F.from_json("value", "array<string>")).alias("value")))


def session_items(items: DataFrame) -> DataFrame:
    """The same of the lists' entries (value), such as list_items gives."""
    s = items.select(F.col("value").alias("raw")).select("raw", F.from_json("raw", SESSION).alias("s"), F.from_json("raw", "timestamp double").alias("t"))
    said = F.filter(F.transform("s.messages", lambda m: F.from_json(m, "role string, content string")), lambda m: (m["role"] == "user") & (X.strip(m["content"]) != ""))
    when = F.coalesce(F.timestamp_micros((F.col("t.timestamp") * 1_000_000).cast("bigint")), X.parse_time("s.timestamp"), F.timestamp_seconds(F.lit(0)))
    rows = s.select(F.coalesce("s.session_id", F.lit("import")).alias("sid"), when.alias("time"), F.posexplode(said).alias("nth", "m")).withColumn("content", F.col("m.content"))
    none = F.lit(None).cast("string")
    return rows.select(*_prompt("json-import", session_id=F.col("sid"), message_ref=F.concat("sid", F.lit(":"), F.col("nth").cast("string")), content=F.col("content"), timestamp=F.col("time"), cwd=none, git_repo=none, model=none))


def exports(files: DataFrame) -> DataFrame:
    """Conversation exports (file, value): visible user text nodes of each conversation's node map."""
    return _conversations(files.select("file", F.posexplode(F.from_json("value", EXPORT)).alias("i", "c")))


def export_items(items: DataFrame) -> DataFrame:
    """The same of the exports' conversations (nth, value), such as list_items gives."""
    return _conversations(items.select(F.col("nth").alias("i"), F.from_json("value", CONVERSATION).alias("c")))


def _conversations(c: DataFrame) -> DataFrame:
    name = F.coalesce("c.conversation_id", "c.id", F.concat(F.lit("conv-"), F.col("i").cast("string")))
    n = c.select(name.alias("conversation"), F.col("c.create_time").alias("started"), F.explode("c.mapping").alias("node", "raw"))
    get = lambda p: F.get_json_object("raw", "$.message." + p)
    parts = F.filter(F.from_json(get("content.parts"), "array<string>"), lambda x: ~F.startswith(F.ltrim(x), F.lit("{")))
    rows = n.select("conversation", "node", F.coalesce(get("create_time").cast("double"), F.col("started"), F.lit(0.0)).alias("epoch"), X.strip(F.array_join(parts, "\n")).alias("content"), get("author.role").alias("role"), get("content.content_type").alias("kind"), get("metadata.is_visually_hidden_from_conversation").alias("hidden"))
    rows = rows.where("role = 'user' and kind = 'text' and coalesce(hidden, 'false') <> 'true' and content <> ''")
    none = F.lit(None).cast("string")
    return rows.select(*_prompt("chatgpt", session_id=F.col("conversation"), message_ref=F.col("node"), content=F.col("content"), timestamp=F.timestamp_micros((F.col("epoch") * 1000000).cast("bigint")), cwd=none, git_repo=none, model=none))


def route(files: DataFrame) -> DataFrame:
    """Import files (file, value) with their kind: export, sessions, or other (no JSON list)."""
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    return files.withColumn("kind", F.when(is_list & F.get_json_object("value", "$[0].mapping").isNotNull(), "export").when(is_list, "sessions").otherwise("other"))


def route_items(items: DataFrame) -> DataFrame:
    """The entries of lists (file, nth, value) with the kind of their file, export or sessions, which its first entry tells."""
    kinds = items.where("nth = 0").select("file", F.when(F.get_json_object("value", "$.mapping").isNotNull(), "export").otherwise("sessions").alias("kind"))
    return items.join(kinds, "file")


def unzip(files: DataFrame, suffix: str = "conversations.json") -> DataFrame:
    """Zipped exports (path, content: binary) to (file, value); archives without such a member give no row."""

    def run(frames):
        import io
        import zipfile

        import pandas as pd

        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        member = next((n for n in z.namelist() if n.endswith(suffix)), None)
                        if member:
                            rows.append((path, z.read(member).decode("utf-8", "replace")))
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["file", "value"])

    return files.select("path", "content").mapInPandas(run, "file string, value string")


def line_counts(lines: DataFrame) -> DataFrame:
    """Lines, malformed lines (no JSON object) and types of each file."""
    ok = F.from_json("value", "type string").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull()
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("malformed"))


def inventory(prompts: DataFrame, kinds: list[str]) -> DataFrame:
    """One row for each kind of source: available, sessions and non-blank prompts."""
    spark = prompts.sparkSession
    seen = prompts.groupBy("source").agg(F.countDistinct("session_id").alias("sessions"), F.count_if(X.strip("content") != "").alias("prompts"))
    known = spark.createDataFrame([(k,) for k in kinds], "source string")
    return known.join(seen, "source", "left").select("source", F.col("prompts").isNotNull().alias("available"), F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("prompts", F.lit(0)).alias("prompts"))


def states(prompts: DataFrame, kinds: list[str], failed: dict[str, str]) -> DataFrame:
    """The inventory with the state of each source: read, failed (with its reason) or absent."""
    known = prompts.sparkSession.createDataFrame([(k, failed.get(k)) for k in kinds], "source string, reason string")
    state = F.when(F.col("reason").isNotNull(), "failed").when(F.col("available"), "read").otherwise("absent")
    return inventory(prompts, kinds).join(F.broadcast(known), "source").withColumn("state", state)  # a row for each kind of source


def health(states: DataFrame) -> DataFrame:
    """Sources that gave prompts and sources that failed: those keep their older rows, so they are stale."""
    return states.agg(F.count_if(F.col("prompts") > 0).alias("sources"), F.count_if(F.col("state") == "failed").alias("stale"))


def enabled(prompts: DataFrame, names: list[str], known: tuple[str, ...]) -> DataFrame:
    """Rows of the enabled sources; unknown names are an error."""
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return prompts.where(F.col("source").isin(names))


def union_sources(sources: list[tuple[str, object]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of sources given as (name, function); a source that fails is left out and its reason kept."""
    out, failed = None, {}
    for name, read in sources:
        try:
            rows = read()
            rows.schema  # noqa: B018  analysis errors of a missing path come up here
        except Exception as reason:  # any failure of one source must leave the others running
            failed[name] = str(reason).split("\n")[0]
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, failed


LANDED = "source string, state string, scanned bigint, reason string"


def land(spark: SparkSession, sources: list[tuple[str, object]], path: str) -> DataFrame:
    """Writes each source, given as (name, function), by a job of its own to path/source=<name>; (source, state, scanned, reason) of all.

    A source that fails, whether in its plan or while it runs, leaves no rows there; its reason is kept
    and the others land. Rows are counted as they are written.
    """
    states = []
    for name, read in sources:
        seen = Observation(f"landed {name}")
        to = f"{path}/source={name}"
        try:
            read().drop("source").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(to)
            states.append((name, "read", seen.get["n"], None))
        except Exception as reason:  # any failure of one source must leave the others running
            at = spark._jvm.org.apache.hadoop.fs.Path(to)
            at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)
            states.append((name, "failed", 0, str(reason).split("\n")[0]))
    return spark.createDataFrame(states, LANDED)

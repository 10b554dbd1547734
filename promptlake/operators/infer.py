"""Batch inference over tables: batching, memo keys, a pluggable judge, coercion of its answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..schema import JUDGED
from . import ingest

PROMPT_CUT, EXCERPT_CUT, BLOCK_CUT = 1500, 800, 32_000
VERSION, MODEL = "rubric-1", "stub"


def _cut(text: Column, n: int) -> Column:
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "...").otherwise(""))


def batches(sample: DataFrame, size: int) -> DataFrame:
    """The sample with its batch number and its place (from 1) in the batch; sample_pos counts from 1."""
    at = F.col("sample_pos") - 1
    return sample.withColumn("batch", F.floor(at / size)).withColumn("slot", (at % size + 1).cast("int"))


def batch_keys(batched: DataFrame, version: str = VERSION, model: str = MODEL) -> DataFrame:
    """The memo key of each batch: independent of the order inside it."""
    joined = F.array_join(F.array_sort(F.collect_list("content_hash")), "")
    return batched.groupBy("batch").agg(F.sha2(F.concat(joined, F.lit(version), F.lit(model)), 256).alias("key"), F.count("*").alias("n"))


def prompt_blocks(batched: DataFrame) -> DataFrame:
    """The numbered text block of each batch; texts are cut before they are gathered (a batch is small)."""
    line = F.concat(F.col("slot").cast("string"), F.lit('. """'), _cut(F.col("content"), PROMPT_CUT), F.lit('"""'))
    each = batched.select("batch", F.struct("slot", line.alias("line")).alias("x"))
    return each.groupBy("batch").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n\n"), 1, BLOCK_CUT).alias("block"))


def excerpt_blocks(hits: DataFrame) -> DataFrame:
    """hits (query, rank, ref, content) to one numbered block a query."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("ref").cast("string"), F.lit(") "), _cut(F.col("content"), EXCERPT_CUT))
    each = hits.select("query", F.struct("rank", line.alias("line")).alias("x"))
    return each.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("block"))


def memo_split(requests: DataFrame, memo: DataFrame) -> DataFrame:
    """Requests (key, ...) with the memo's payload; null payloads are the misses that go to inference."""
    return requests.join(memo.select("key", "payload"), "key", "left")


def infer(requests: DataFrame, judge: Callable[[list[str]], list[str | None]], tries: int = 2) -> DataFrame:
    """(key, payload, status) of requests (key, block): each block is asked again once if the answer is no JSON object."""
    import json

    def run(frames):
        for f in frames:
            out: list[str | None] = [None] * len(f)
            todo = list(range(len(f)))
            for _ in range(tries):
                got = judge([f["block"].iloc[i] for i in todo]) if todo else []
                for i, answer in zip(todo, got, strict=True):
                    try:
                        out[i] = answer if isinstance(json.loads(answer or ""), dict) else None
                    except ValueError:
                        out[i] = None
                todo = [i for i in todo if out[i] is None]
            yield pd.DataFrame({"key": f["key"], "payload": out, "status": ["failed" if x is None else "ok" for x in out]})

    return requests.select("key", "block").mapInPandas(run, "key string, payload string, status string")


def stub_judge(blocks: list[str]) -> list[str]:
    """A deterministic judge: the score of each numbered prompt is its length modulo 5, over 4."""
    import json

    return [json.dumps({n: {rule: (len(t) + i) % 5 / 4 for i, rule in enumerate(JUDGED)} for n, t in _numbered(block)}) for block in blocks]


def _numbered(block: str) -> list[tuple[str, str]]:
    import re

    return re.findall(r'(?s)(?:^|\n\n)(\d+)\. """(.*?)"""(?=\n\n\d+\. """|\Z)', block)


def stub_digest(blocks: list[str]) -> list[str]:
    """A deterministic model for patterns: text lengths modulo 4, and the share of texts of 200 characters or more."""
    import json

    texts = [[t for _, t in _numbered(b)] for b in blocks]
    return [json.dumps({"patterns": sorted({f"length {len(t) % 4}" for t in x}), "topics": [{"topic": "long", "share": sum(len(t) >= 200 for t in x) / max(len(x), 1)}]}) for x in texts]


def stub_answer(blocks: list[str]) -> list[str | None]:
    """A deterministic model for answers, by the number and the length of the excerpts: cites the second and the first, is silent, empty or unsure at times."""
    import json
    import re

    out: list[str | None] = []
    for block in blocks:
        excerpts = block[block.index("\n[1] (") + 1 :]
        n, size = int(re.findall(r"(?:^|\n\n)\[(\d+)\] \(", excerpts)[-1]), len(excerpts)
        said = "" if size % 5 == 1 else f"answer from {n} excerpts of {size} characters"
        refs = [2, "x", 99, 1, 0] if n > 1 else [1]
        out.append("no json" if size % 5 == 2 else json.dumps({"answer": said, "used_refs": refs, "confident": size % 2 == 0}))
    return out


def stub_rewrite(blocks: list[str]) -> list[str | None]:
    """A deterministic model for rewrites, by the length of what it is given: silent, without text or with a number at times."""
    import json

    said = lambda n: " " if n % 7 == 1 else n if n % 7 == 2 else f" rewritten from {n} characters "
    return [None if len(b) % 7 == 0 else json.dumps({"rewritten_prompt": said(len(b))}) for b in blocks]


def stub_reduce(blocks: list[str]) -> list[str]:
    """A deterministic model that merges digests: all their patterns, as strengths too, and the greatest share of each topic."""
    import json

    out = []
    for block in blocks:
        each = [json.loads(line) for line in block.split("\n")]
        shares: dict[str, float] = {}
        for t in (t for d in each for t in d["topics"]):
            shares[t["topic"]] = max(t["share"], shares.get(t["topic"], 0.0))
        said = sorted({p for d in each for p in d["patterns"]})
        out.append(json.dumps({"strengths": said, "patterns": said, "topics": [{"share": s, "topic": t} for t, s in shares.items()]}))
    return out


def through_memo(requests: DataFrame, memo: DataFrame, judge: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(key, payload, status) of requests (key, block): the memo's payload where there is one, else the model's."""
    split = memo_split(requests, memo)
    known = split.where("payload is not null").select("key", "payload", F.lit("ok").alias("status"))
    return known.unionByName(infer(split.where("payload is null"), judge))


def pattern_digests(batched: DataFrame, memo: DataFrame, judge: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(batch, key, status, patterns, topics: topic and share, payload) of each batch of prompts; failed batches have none of them."""
    keys = batch_keys(batched, "patterns-1")
    asked = prompt_blocks(batched).join(keys, "batch").select("key", "block").repartition("key")
    got = through_memo(asked, memo, judge).join(keys.select("batch", "key"), "key")
    topics = F.from_json(F.get_json_object("payload", "$.topics"), "array<struct<topic:string,share:double>>")
    share = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t["share"], F.lit(0.0))))
    return got.select("batch", "key", "status", pattern_items(F.get_json_object("payload", "$.patterns")).alias("patterns"), F.transform(topics, lambda t: F.struct(t["topic"].alias("topic"), share(t).alias("share"))).alias("topics"), "payload")


#: Blocks of digests ordered by one task in a round of the reduce.
ROUND_BLOCKS = 64


def _packed(digests: DataFrame, limit: int, version: str) -> DataFrame:
    """(key, block) of digests (digest): blocks of at most limit characters whose make-up depends on the digests alone, never on their order or partitions."""
    short = F.substring("digest", 1, limit // 8 - 1)
    n, whole, total = digests.agg(F.count("*"), F.sum(F.length("digest") + 1), F.sum(F.length(short) + 1)).first()
    if n == 1 or whole - 1 <= limit:
        placed = digests.select(F.substring("digest", 1, limit).alias("digest"), F.lit(0).alias("part"), F.lit(0).alias("place"))
    else:
        # Four digests or more start in each half of a block, and the last of them ends inside it: every round has fewer.
        cut_ = digests.select(short.alias("digest")).withColumn("hash", F.xxhash64("digest"))
        parts = -(-total // (limit // 2 * ROUND_BLOCKS))
        by = Window.partitionBy("part").orderBy("hash", "digest").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum(F.length("digest") + 1).over(by), F.lit(0))
        placed = cut_.withColumn("part", F.pmod("hash", F.lit(parts))).withColumn("place", F.floor(start / (limit // 2)))
    texts = placed.groupBy("part", "place").agg(F.array_join(F.array_sort(F.collect_list("digest")), "\n").alias("block"))
    return texts.select(F.sha2(F.concat("block", F.lit(version), F.lit(MODEL)), 256).alias("key"), "block")


def reduce_patterns(digests: DataFrame, memo: DataFrame, judge: Callable[[list[str]], list[str | None]], limit: int = BLOCK_CUT, version: str = "patterns-reduce-1") -> tuple[DataFrame, DataFrame]:
    """(status, payload) of one row that merges all digests (payload, status), and the answers (key, payload) for the memo.

    Digests that fit one block are merged by one call. More go in rounds: each block's answer is a
    digest of the next round, so none is left out; there a digest's text is cut to an eighth of a
    block. Each block's key covers its digests, so what did not change is not asked again. status:
    ok; failed, without payload, if a digest or an answer failed; none without digests.
    """
    spark = digests.sparkSession
    ended = lambda status: spark.range(1).select(F.lit(status).alias("status"), F.lit(None).cast("string").alias("payload"))
    ordered = lambda df: ingest.cut(df.select(F.to_json(F.try_parse_json("payload")).alias("digest"), "status"))
    level, said = ordered(digests), memo.select("key", "payload").limit(0)
    if level.isEmpty():
        return ended("none"), said
    while True:
        if not level.where("status <> 'ok' or digest is null").isEmpty():
            return ended("failed"), said
        asked = ingest.cut(_packed(level.select("digest"), limit, version))
        got = ingest.cut(through_memo(asked.dropDuplicates(["key"]).repartition("key"), memo, judge))
        said = said.unionByName(got.where("status = 'ok'").select("key", "payload"))
        # Equal blocks share a key and count once: the same digests say the same.
        if got.limit(2).count() == 1:
            return got.select("status", "payload"), said
        level = ordered(got)


def pattern_report(merged: DataFrame) -> DataFrame:
    """(part, rank, item, share) of a merged digest (payload): the first five strengths, growth areas and notable patterns, the ten greatest topics."""
    lists = [merged.select(F.lit(part).alias("part"), F.posexplode(pattern_items(F.get_json_object("payload", f"$.{part}"))).alias("rank", "item")) for part in ("strengths", "growth_areas", "notable_patterns")]
    said = reduce(DataFrame.unionByName, lists).select("part", (F.col("rank") + 1).alias("rank"), "item", F.lit(None).cast("double").alias("share"))
    topics = topic_shares(merged.select(F.lit("topics").alias("part"), F.get_json_object("payload", "$.topics").alias("raw")), "part", "raw")
    return said.unionByName(topics.select("part", "rank", F.col("topic").alias("item"), "share"))


def merge_topics(digests: DataFrame) -> DataFrame:
    """(topic, batches, share): each topic's mean share over the digests that name it."""
    return digests.select(F.explode("topics").alias("t")).groupBy("t.topic").agg(F.count("*").alias("batches"), F.avg("t.share").alias("share"))


PARTIAL = "(partial: the excerpts answer this only in part)"


def answers(questions: DataFrame, hits: DataFrame, memo: DataFrame, judge: Callable[[list[str]], list[str | None]] | None, version: str = "answer-1") -> DataFrame:
    """(query, key, status, answer, used_refs, confident) of questions (query, question) from hits (query, rank, ref, content, content_hash).

    The key covers the question and the whole texts of its hits by their hashes, in order of rank. status:
    ok; failed (no usable answer twice, an empty one, or no judge); none (nothing found, so
    the model is not asked). Numbers that are no excerpt's are dropped.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content_hash"))), lambda x: x["content_hash"])
    by_hit = hits.groupBy("query").agg(F.max("rank").alias("n"), F.array_join(ordered, "").alias("hashes"))
    asked = questions.join(excerpt_blocks(hits), "query").join(by_hit, "query").withColumn("key", F.sha2(F.concat("question", "hashes", F.lit(version), F.lit(MODEL)), 256))
    asked = asked.select("query", "key", "n", F.concat("question", F.lit("\n"), "block").alias("block"))
    got = through_memo(asked.select("key", "block").dropDuplicates(["key"]), memo, judge or (lambda blocks: [None] * len(blocks)))
    out = questions.select("query").join(asked.select("query", "key", "n").join(got, "key"), "query", "left")
    refs = F.transform(F.from_json(F.get_json_object("payload", "$.used_refs"), "array<string>"), lambda r: F.when(r.rlike(r"^-?\d{1,9}$"), r.cast("int")))
    kept = F.filter(F.coalesce(refs, F.array().cast("array<int>")), lambda r: (r >= 1) & (r <= F.col("n")))
    text = X.strip(F.get_json_object("payload", "$.answer"))
    good = (F.col("status") == "ok") & (F.coalesce(text, F.lit("")) != "")
    state = F.when(F.col("key").isNull(), "none").when(good, "ok").otherwise("failed")
    return out.select("query", "key", state.alias("status"), F.when(good, text).alias("answer"), F.when(good, kept).otherwise(F.array().cast("array<int>")).alias("used_refs"), F.when(good, F.coalesce(F.get_json_object("payload", "$.confident") != "false", F.lit(True))).alias("confident"))


def answer_texts(answers_: DataFrame, sources: DataFrame, fallback: DataFrame) -> DataFrame:
    """(query, status, text): the answer with its dated sources and a note where it is partial; where there is none, the fallback.

    sources: query, rank, ref, day of the hits. fallback: query, answer.
    """
    used = answers_.select("query", F.posexplode("used_refs").alias("place", "rank")).join(sources, ["query", "rank"])
    line = F.concat(F.lit("\n- ["), F.col("day"), F.lit("] "), F.col("ref").cast("string"))
    cited = used.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    out = answers_.join(cited, "query", "left").join(fallback.select("query", F.col("answer").alias("instead")), "query", "left")
    text = F.concat("answer", F.coalesce(F.concat(F.lit("\n\nSources:"), "lines"), F.lit("")), F.when(F.col("confident"), "").otherwise("\n\n" + PARTIAL))
    return out.select("query", "status", F.when(F.col("status") == "ok", text).otherwise(F.col("instead")).alias("text"))


def judge_scores(batched: DataFrame, keys: DataFrame, answers: DataFrame) -> DataFrame:
    """(prompt_ref, origin, timestamp, rule, score) of the judged rules, none at all if any batch failed.

    Scores are clamped to 0..1; booleans count as 0 and 1; what is no number is left out.
    """
    kind = "map<string,map<string,string>>"
    state = answers.agg(F.coalesce(F.max((F.col("status") != "ok").cast("int")), F.lit(0)).alias("failed"))
    long = answers.join(keys.select("batch", "key"), "key").select("batch", F.explode(F.from_json("payload", kind)).alias("slot", "by_rule"))
    long = long.select("batch", F.expr("try_cast(slot as int)").alias("slot"), F.explode("by_rule").alias("rule", "raw")).where(F.col("rule").isin(*JUDGED))
    number = F.when(F.col("raw") == "true", 1.0).when(F.col("raw") == "false", 0.0).otherwise(F.expr("try_cast(raw as double)"))
    long = long.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).where("score is not null")
    rows = batched.select("batch", "slot", X.prompt_ref().alias("prompt_ref"), "origin", "timestamp")
    good = rows.join(long, ["batch", "slot"]).crossJoin(F.broadcast(state)).where("failed = 0")  # one row
    return good.select("prompt_ref", "origin", "timestamp", "rule", "score")


def judged_prompts(scores: DataFrame) -> DataFrame:
    """How many different prompts of each origin have a judged score."""
    return scores.groupBy("origin").agg(F.count_distinct("prompt_ref").alias("prompts"))


def pattern_items(raw: Column | str, limit: int = 5) -> Column:
    """JSON list items: strings kept, objects by their pattern, others dropped, the first few."""
    items = F.from_json(raw, "array<string>")
    text = F.transform(items, lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), F.get_json_object(x, "$.pattern")).otherwise(x))
    return F.slice(F.filter(text, lambda x: x.isNotNull() & ~x.rlike(r"^(\[.*|-?[0-9.eE+]+|true|false|null)$")), 1, limit)


def topic_shares(rows: DataFrame, key: str, raw: str, limit: int = 10) -> DataFrame:
    """(key, rank, topic, share) from JSON lists of {topic, share}: bad shares are 0, shares clamped, the largest first."""
    each = rows.select(key, F.posexplode(F.from_json(raw, "array<struct<topic:string,share:string>>")).alias("pos", "t"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("try_cast(t.share as double)"), F.lit(0.0))))
    each = each.where("t.topic is not null").select(key, "pos", F.col("t.topic").alias("topic"), share.alias("share"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("share"), "pos")))
    return ranked.where(F.col("rank") <= limit).select(key, "rank", "topic", "share")


def merge_patterns(digests: DataFrame) -> DataFrame:
    """Patterns with their support over digests (batch, patterns): the scalable reduce that needs no model."""
    each = digests.select("batch", F.explode("patterns").alias("pattern"))
    return each.groupBy("pattern").agg(F.count_distinct("batch").alias("support"))

"""Full-text retrieval over postings: phrase search, all-terms fallback, BM25, batch answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ingest import cut

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
TERMS_BOUND = 100_000
#: Keys of a broadcast at most (about 30 MB).
ROWS_BOUND = 500_000
NOTHING = "nothing matches this question"
#: Letters with diacritics and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def terms(text: Column | str) -> Column:
    """Words of letters and digits, lower-cased, without diacritics."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), 0)


def postings(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(term, doc, doc_len, positions, tf); positions count from 0.

    A row holds its whole document, so its words are grouped where they lie, without a shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def group(batches):
        for b in batches:
            words = b.column(1)
            size = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = words.flatten().dictionary_encode()
            owner = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            code = flat.indices.to_numpy()
            order = np.lexsort((place, code, owner))
            c, o = code[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (o[1:] != o[:-1])])) if len(c) else np.zeros(0, dtype=np.int64)
            edge = np.append(first, len(c)).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(edge), pa.array(place[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(c[first])), b.column(0).take(pa.array(o[first])), pa.array(size[o[first]].astype(np.int32)), positions, pa.array(np.diff(edge))], names=["term", "doc", "doc_len", "positions", "tf"])

    return docs.select(F.col(key).alias("doc"), terms(text).alias("w")).mapInArrow(group, f"term string, doc {kind}, doc_len int, positions array<int>, tf int")


def _bm25(tf, doc_len, df, stats_n, avg_len) -> Column:
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((stats_n - df + 0.5) / (df + 0.5)))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.size(terms(text)).alias("n")).agg(F.count("*").alias("stats_n"), F.avg("n").alias("avg_len"))


def _query_terms(queries: DataFrame) -> DataFrame:
    """(query, slot, term, m) of questions (query, question)."""
    words = queries.select("query", terms("question").alias("w"))
    return words.select("query", F.size("w").alias("m"), F.posexplode("w").alias("slot", "term"))


def _rank(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query", "rank", "doc", "score")


def small(rows: DataFrame, bound: int = ROWS_BOUND) -> DataFrame:
    """Marked for a broadcast if they are so few, counted."""
    return F.broadcast(rows) if rows.limit(bound + 1).count() <= bound else rows


def _candidates(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, term, df, doc, doc_len, positions, tf) of asked (query, term), for documents that hold a question's rarest term.

    Three readings of the asked terms' rows, of which the first two need no positions: counts of
    the terms, documents of the rarest ones, and the rows of these documents, which alone are
    shuffled and joined. A stored index reads only the columns asked for; other postings are best cut first.
    """
    held = index.join(small(asked.select("term").distinct(), TERMS_BOUND), "term", "left_semi")
    pairs = asked.select("query", "term").distinct()
    known = cut(pairs.join(held.groupBy("term").agg(F.count("*").alias("df")), "term", "left").withColumn("df", F.coalesce("df", F.lit(0))))
    rarest = known.groupBy("query").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    docs = cut(held.select("term", "doc").join(small(rarest, TERMS_BOUND), "term").select("query", "doc"))
    few = held.join(small(docs.select("doc").distinct()), "doc", "left_semi")
    return docs.join(small(known, TERMS_BOUND), "query").join(few, ["term", "doc"])


def phrase_search(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Hits of each whole question as one phrase, best first."""
    asked = _query_terms(queries)
    at = _candidates(index, asked).join(asked, ["query", "term"])
    # A row holds a term's places in a document, moved to where the phrase would begin; a question has few rows a document.
    begins = F.transform("positions", lambda p: p - F.col("slot"))
    found = at.groupBy("query", "m", "doc", "doc_len").agg(F.collect_list(begins).alias("x")).where(F.size("x") == F.col("m"))
    starts = F.aggregate(F.slice("x", F.lit(2), F.greatest(F.col("m") - 1, F.lit(0))), F.col("x")[0], F.array_intersect)
    hits = found.select("query", "doc", "doc_len", F.size(starts).alias("tf")).where("tf > 0")
    df = hits.groupBy("query").agg(F.count("*").alias("df"))
    scored = hits.join(df, "query").crossJoin(F.broadcast(stats))  # one row
    return _rank(scored.withColumn("score", _bm25(F.col("tf"), F.col("doc_len"), F.col("df"), F.col("stats_n"), F.col("avg_len"))), k)


def all_terms_search(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Hits that hold every fully alphanumeric word of the question."""
    words = queries.select("query", F.explode(F.array_distinct(F.split(F.trim("question"), r"\s+"))).alias("word")).where(F.col("word").rlike(r"^[\p{L}\p{N}]+$"))
    asked = words.select("query", F.explode(terms("word")).alias("term")).distinct()
    need = asked.groupBy("query").agg(F.count("*").alias("m"))
    hits = _candidates(index, asked).crossJoin(F.broadcast(stats))  # one row
    each = hits.withColumn("s", _bm25(F.col("tf"), F.col("doc_len"), F.col("df"), F.col("stats_n"), F.col("avg_len")))
    full = each.groupBy("query", "doc").agg(F.sum("s").alias("score"), F.count("*").alias("got")).join(need, "query").where("got = m")
    return _rank(full, k)


def search(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Phrase hits; questions without any fall back to all terms."""
    phrase = cut(phrase_search(index, stats, queries, k))  # k rows a question, for two readers
    rest = queries.join(phrase.select("query").distinct(), "query", "left_anti")
    return phrase.withColumn("way", F.lit("phrase")).unionByName(all_terms_search(index, stats, rest, k).withColumn("way", F.lit("terms")))


def of_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of docs that are hits. Their ids, k a question, are few: no text is shuffled, and what follows is computed of these alone."""
    return docs.join(small(hits.select("doc").distinct()), "doc", "left_semi")


def fallback_answers(queries: DataFrame, hits: DataFrame, snippets: DataFrame) -> DataFrame:
    """Answers without a model: the ranked snippets with their dates, or a fixed line where nothing was found. snippets: doc, day, snippet."""
    lines = hits.join(of_hits(snippets, hits), "doc").select("query", "rank", F.concat(F.lit("- ["), F.col("day"), F.lit("] ("), F.col("doc").cast("string"), F.lit(") "), F.col("snippet")).alias("line"))
    text = lines.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("answer"), F.count("*").alias("n_hits"))
    out = queries.select("query").join(text, "query", "left")
    return out.select("query", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("answer", F.lit(NOTHING)).alias("answer"))


def cited(used: DataFrame, hits: DataFrame) -> DataFrame:
    """used (query, used_refs): the cited hits in citation order, repeats kept, numbers outside 1..k dropped."""
    each = used.select("query", F.posexplode("used_refs").alias("place", "rank"))
    return each.join(hits.select("query", "rank", "doc"), ["query", "rank"]).select("query", "place", "rank", "doc")

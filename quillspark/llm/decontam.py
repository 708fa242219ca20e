"""Benchmark decontamination: exact containment of item-sized windows by a prefix-filtered join.

A benchmark item gives windows of ``WINDOW`` consecutive words. Each window is a set of word
shingles (``SHINGLE`` words; fewer where the window has fewer). For exact containment one token
per window suffices as its join prefix, and the rarest in the documents costs least. So:

1. documents give the positions of shingles that occur in any window (one pass over the texts);
2. those counts order the shingles of each window by rarity, the rarest is its necessary token;
3. positions join on the necessary tokens; length and positional bounds, then the words
   themselves, decide.

DataFrame functions only. What is broadcast is counted first, each table by its own rows, and stays
under ``BROADCAST_TOKENS`` (about 40 bytes each in memory) or ``BROADCAST_WINDOWS`` rows. A benchmark with more
shingles joins by shuffle: then a row in the exchange is a document's key, a position and a hash,
never its words, and the texts of documents with a candidate are read again to decide it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.basic import bound
from quillspark.llm.shared import ascii_lower, written

WINDOW = 10
SHINGLE = 3
BROADCAST_TOKENS, BROADCAST_WINDOWS = 4_000_000, 200_000
BETWEEN_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; a null text has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN_WORDS), ""), F.array().cast("array<string>"))


def _shingles(words: Column, q: int) -> Column:
    """64-bit hashes of all runs of q words."""
    at = lambda i, k: F.get(words, i + F.lit(k))
    return F.when(F.size(words) >= q, F.transform(F.sequence(F.lit(0), F.size(words) - q), lambda i: F.xxhash64(F.lit(q), *[at(i, k) for k in range(q)]))).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id and the words of each of its windows; an item of fewer words is one window."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(1))), lambda i: F.slice(w, i, F.lit(window)))
    windows = F.explode(bound(words_of(F.col("text")), cut))
    return benchmark.select("item_id", windows.alias("window")).where(F.size("window") > 0).distinct()


def _read_again(documents: DataFrame, near: DataFrame, key: list[Column]) -> DataFrame:
    """The candidates ``near`` whose words are the window's, decided by the documents' texts.

    Texts of documents without a candidate stay out of the exchange. A document's candidates are
    joined as rows, so none of its tasks holds more than the text and one candidate.
    """
    named = near.select(F.col("doc_id").alias("n_id"), F.col("text_key").alias("n_key"), F.struct("first", "length", "win", "window").alias("near"))
    same = F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("text_key") == F.col("n_key"))
    spots = named.groupBy("n_id", "n_key").agg(F.collect_set(F.struct("near.first", "near.length")).alias("spots"))
    own = documents.select(*key, "text").join(spots.select("n_id", "n_key"), same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    cut = own.join(spots, same).select("n_id", "n_key", words_of(F.col("text")).alias("words"), F.explode("spots").alias("x"))
    cut = cut.select("n_id", "n_key", F.struct("x.first", F.slice("words", F.col("x.first") + 1, F.col("x.length")).alias("words")).alias("x"))
    cut = cut.select(F.col("n_id").alias("c_id"), F.col("n_key").alias("c_key"), "x.first", "x.words")
    on = F.col("n_id").eqNullSafe(F.col("c_id")) & (F.col("n_key") == F.col("c_key")) & (F.col("near.first") == F.col("first")) & (F.col("near.window") == F.col("words"))
    return named.join(cut, on).select(F.col("n_id").alias("doc_id"), F.col("n_key").alias("text_key"), "near.*")


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): what of the benchmark (item_id, text) it holds.

    Returns doc_id, text_key (hash of the text), n_words, n_hit (words inside any occurrence of a
    window), n_items (items with an occurring window), items_sha256 (of those item_ids, sorted as
    strings, comma-joined) and contaminated (n_hit > 0). Null and empty texts have no words, an
    item without words has no window, an item without an id is named by the empty string, equal
    rows get equal results, an empty table gives an empty result. Texts are read whole, whatever
    their length: a document's row is split into its words in one task, its positions are rows.
    """
    items = written(item_windows(benchmark, window), "bench-items")
    windows = items.select("window").distinct().withColumn("win", F.xxhash64("window")).withColumn("q", F.least(F.size("window"), F.lit(shingle)))
    lengths = sorted(r["q"] for r in windows.select("q").distinct().collect())
    hashes = F.lit(None)
    for q in lengths:
        hashes = F.when(F.col("q") == q, _shingles(F.col("window"), q)).otherwise(hashes)
    tokens = windows.select("window", "win", F.size("window").alias("length"), F.posexplode(hashes.cast("array<bigint>")).alias("offset", "token")) if lengths else windows.selectExpr("window", "win", "size(window) as length", "0 as offset", "win as token")
    tokens = written(tokens, "bench-tokens")
    wanted = written(tokens.select("token").distinct(), "bench-wanted")
    small = wanted.count() <= BROADCAST_TOKENS
    few = lambda x, most: F.broadcast(x) if x.count() <= most else x

    parsed = bound(words_of(F.col("text")), lambda w: F.struct(w.alias("words"), F.concat(*([_shingles(w, q) for q in lengths] or [F.array().cast("array<bigint>")])).alias("tokens")))
    key = [F.col("doc_id"), F.xxhash64("text", F.octet_length("text")).alias("text_key")]
    start, counts = F.lit(None).cast("int"), [F.greatest(F.col("n_words") - q + 1, F.lit(0)) for q in lengths]
    for k in range(len(lengths)):
        first = sum(counts[:k], F.lit(0))
        start = F.when(F.col("pos") >= first, F.col("pos") - first).otherwise(start)
    docs = documents.select(*key, F.explode(F.array(parsed)).alias("parsed"))
    if small:
        # a document's own row goes along as the position of no shingle, so texts are parsed once
        head = F.array(F.xxhash64(F.lit("head")))
        docs = docs.select("doc_id", "text_key", F.col("parsed.words").alias("words"), F.size("parsed.words").alias("n_words"), F.posexplode(F.concat("parsed.tokens", head)).alias("pos", "token"))
        last = sum(counts, F.lit(0))
        kept = wanted.union(docs.sparkSession.range(1).select(F.xxhash64(F.lit("head"))))
        placed = docs.join(F.broadcast(kept), "token").withColumn("start", F.when(F.col("pos") < last, start))
        left = F.greatest(F.col("start") - (window - 1), F.lit(0))
        around = F.when(F.col("start").isNotNull(), F.slice("words", left + 1, F.lit(2 * window - 1)))
        found = written(placed.select("doc_id", "text_key", "n_words", "token", "start", left.alias("left"), around.alias("around")), "bench-found")
        rows = found.where("start is null").select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"))
        found = found.where("start is not null")
    else:
        sized = docs.select("doc_id", "text_key", F.size("parsed.words").alias("n_words"), F.col("parsed.tokens").alias("tokens"))
        placed = sized.select("doc_id", "text_key", "n_words", F.posexplode("tokens").alias("pos", "token")).withColumn("start", start)
        found = written(placed.select("doc_id", "text_key", "n_words", "token", "start").join(wanted, "token"), "bench-found")
        rows = documents.select(*key, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))

    rarity = found.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    by_rarity = Window.partitionBy("win", "window").orderBy(F.col("count").asc_nulls_first(), "token", "offset")
    ranked = tokens.join(F.broadcast(rarity) if small else rarity, "token", "left").withColumn("rank", F.row_number().over(by_rarity))
    needed = written(ranked.where("rank = 1 and count is not null").select("token", "offset", "length", "window", "win"), "bench-needed")
    first = F.col("start") - F.col("offset")
    near = found.join(few(needed, BROADCAST_WINDOWS), "token").where((first >= 0) & (first + F.col("length") <= F.col("n_words")))
    if small:
        near = near.where(F.expr("slice(around, start - offset - left + 1, length)") == F.col("window"))
    else:
        near = _read_again(documents, written(near.select("doc_id", "text_key", first.alias("first"), "length", "win", "window").distinct(), "bench-near"), key)
    matches = near.select("doc_id", "text_key", (first if small else F.col("first")).alias("first"), "length", "win", "window").distinct()
    matches = written(matches, "bench-matches")
    spans = matches.groupBy("doc_id", "text_key", "first").agg(F.max(F.col("first") + F.col("length")).alias("end"))
    reach = F.max("end").over(Window.partitionBy("doc_id", "text_key").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    hits = spans.withColumn("from", F.greatest("first", F.coalesce(reach, F.lit(0)))).groupBy("doc_id", "text_key").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("n_hit"))
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.xxhash64("window").alias("win"), "window")
    per_doc = matches.select("doc_id", "text_key", "win", "window").distinct().join(F.broadcast(named) if items.count() <= BROADCAST_WINDOWS else named, ["win", "window"]).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.text_key").eqNullSafe(F.col(f"{b}.text_key"))
    both = hits.alias("x").join(per_doc.alias("y"), same("x", "y")).select("x.doc_id", "x.text_key", "x.n_hit", "y.items")
    out = rows.alias("r").join(both.alias("b"), same("r", "b"), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        "r.doc_id",
        "r.text_key",
        "r.n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``documents`` that hold no window of the benchmark, with all their columns."""
    bad = contaminated(documents, benchmark, window, shingle).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text", F.octet_length("text")).alias("own_key"))
    return rows.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("bad_key")), "left_anti").select("row.*")

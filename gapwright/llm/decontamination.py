"""Documents that hold benchmark items, by SimHash windows of the items' sizes, DataFrame operations only (operator 5).

Every item has a few anchors: the rarest long words of its parts, by counts over all documents. Windows of the item's size
that hold an anchor at any place, and enough of its other words, are fingerprinted. Windows and items meet in a multi-index:
RADIUS + 1 blocks of the fingerprint's bits, of which two fingerprints within RADIUS share one at least. Candidates
within the radius are verified by the weighted Jaccard similarity of their five-word shingles, weights being counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fingerprints
from ._workspace import materialise

SHINGLE = 5
SIMILARITY = 0.8
#: Largest Hamming distance of a window and its item: similarity 0.8 gives 8 to 10 bits on average, 24 at most in 80,000
#: borderline copies of the sf0.1 items and 28 at most in 60,000 of items of 22 random words.
RADIUS = 32
#: Least parts of an item with an anchor each, and words of a part that are counted to find its rarest.
PARTS, TRIED = 6, 2
#: Bytes of a table of words in an expression, at most.
TABLE = 1 << 19


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets))


def _member_test(words: DataFrame):
    """word -> condition that holds for all of words(word) and few others, by a table of bits that stands in the plan.

    It has 35 bits a word or more as long as that is within TABLE bytes; beyond 100,000 words more others pass, one in
    four at a million, and all that pass are joined with the words themselves. Seven bits make a byte, so that it is text.
    """
    size = 1 << max(6, min(TABLE.bit_length() - 1, (5 * words.count()).bit_length()))
    at = words.select(_bucket(F.col("word"), 7 * size).alias("b"))
    told = at.groupBy(F.floor(F.col("b") / 4096).cast("long").alias("k")).agg(F.collect_set((F.col("b") % 4096).cast("int")).alias("own")).collect()  # 7 TABLE numbers at most
    table = bytearray(size)
    for k, own in told:
        for i in own:
            byte, bit = divmod(4096 * k + i, 7)
            table[byte] |= 1 << bit
    bits = F.lit(bytes(table))

    def test(word: Column) -> Column:
        bucket = _bucket(word, 7 * size)
        byte = F.ascii(F.substring(bits, F.floor(bucket / 7).cast("int") + 1, F.lit(1)).cast("string"))
        return F.call_function("shiftright", byte, (bucket % 7).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def bound(value: Column, use) -> Column:
    """use(value), where value is worked out once: a lambda that names a column may work out its expression at each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(words: Column) -> Column:
    """The five-word shingles of an array of words."""
    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        plain = F.transform(at, lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " "))
        return F.when(F.size(w) < SHINGLE, F.array().cast("array<string>")).otherwise(plain)

    return bound(words, of)


def numbered(plain: Column) -> Column:
    """The same with the number of each copy of a shingle, where one has copies, so that sets of them count copies."""
    def of(p: Column) -> Column:
        each = F.transform(p, lambda x, i: F.concat_ws("#", x, F.size(F.filter(F.slice(p, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
        return F.when(F.size(F.array_distinct(p)) == F.size(p), F.transform(p, lambda x: F.concat(x, F.lit("#1")))).otherwise(each)

    return bound(plain, of)


def places(words: Column, wanted) -> Column:
    """Indices (from 0) of the words that wanted holds for."""
    return F.filter(F.transform(words, lambda w, i: F.when(wanted(w), i)), lambda i: i.isNotNull())


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words, n): items of SHINGLE words or more; shorter ones have no shingle and match nothing."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).withColumn("n", F.size("words"))
    return items.where(F.col("n") >= SHINGLE)


def part_words(similarity: float) -> int:
    """Most words of a part, so that a window without any anchor cannot reach the similarity s: the anchors of two parts
    that follow each other take 6 shingles, which is more than (1 - s) of those of the two parts; ends take fewer."""
    return max(1, int(2 / (1 - similarity) + 1e-9)) if similarity < 1 else 1 << 30


def anchors(items: DataFrame, docs_words: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(item_id, words, n, anchors ARRAY<off, word>): of the longest words of each part of an item the one that is rarest
    in the documents. docs_words(words) are counted over all documents, by word, map-side first."""
    parts = F.greatest(F.lit(PARTS), F.ceil(F.col("n") / part_words(similarity)))
    at = items.select("item_id", "n", F.posexplode("words").alias("off", "word")).withColumn("part", F.floor(F.col("off") * parts / F.col("n")))
    longest = F.row_number().over(_by("item_id", "part", order=[F.char_length("word").desc(), "off"]))
    tried = materialise(at.withColumn("r", longest).where(f"r <= {TRIED}").select("item_id", "part", "off", "word"), "tried-words")
    wanted = _member_test(tried.select("word").distinct())
    counts = docs_words.select(F.explode(F.filter("words", wanted)).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    ranked = tried.join(counts, "word", "left").withColumn("r", F.row_number().over(_by("item_id", "part", order=[F.coalesce("count", F.lit(0)), F.char_length("word").desc(), "off"])))
    chosen = ranked.where("r = 1").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("off", "word"))).alias("anchors"))
    return items.join(chosen, "item_id")


def _by(*keys: str, order: list):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def windows(docs_words: DataFrame, anchored: DataFrame, id_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """(id, item_id, start, window): every window of an item's size that lacks few enough of its words, once.

    Of m shingles of the item and k of a window c must be common for the similarity s = c / (m + k - c), so m - c at most
    are missing, and each can take one word with it at most: windows that lack more words than that end here. The others
    hold an anchor, wherever in them it stands. So windows around each anchor are looked at, if the words around it do not
    lack too many themselves, and a window belongs to the first anchor in it. None that could reach s is lost.

    start counts words from 0; windows end at the ends of the text. A hit carries the words around it, twice the longest
    item at most, so that nothing is joined back to the documents.
    """
    longest = anchored.agg(F.max("n")).first()[0] or SHINGLE
    single = anchored.select("item_id", "n", F.array_distinct("words").alias("item_words"), F.array_distinct(F.transform("anchors", lambda a: a["word"])).alias("marks"))
    single = materialise(single.select("*", F.explode("marks").alias("word")), "anchors")
    wanted = _member_test(single.select("word").distinct())
    hits = docs_words.select(id_col, "words", F.explode(places(F.col("words"), wanted)).alias("pos"))
    left = F.greatest(F.col("pos") - longest + 1, F.lit(0))
    hits = hits.select(id_col, "pos", left.alias("left"), F.get("words", F.col("pos")).alias("word"), F.slice("words", left + 1, F.lit(2 * longest)).alias("around"))

    def lacking(words: Column) -> Column:
        m, k = F.col("n") - SHINGLE + 1, F.size(words) - SHINGLE + 1
        return F.floor(m - (m + F.least(m, k)) * F.lit(similarity / (1 + similarity)) + F.lit(1e-6))

    met = hits.join(single, "word").withColumn("at", F.least(F.col("pos"), F.col("n") - 1))  # place of the anchor in own
    met = met.withColumn("own", F.slice("around", F.col("pos") - F.col("at") - F.col("left") + 1, F.col("at") + F.col("n"))).drop("around")
    # Near an end of the text windows may be shorter, and lack more then
    clipped = F.size("own") < 2 * F.col("n") - 1
    most = F.when(clipped, F.floor(F.lit(1 - similarity + 1e-6) * (F.col("n") - SHINGLE + 1))).otherwise(lacking(F.col("own")))
    met = met.where(F.size(F.array_except("item_words", "own")) <= most)
    before = F.coalesce(F.array_max(places(F.slice("own", F.lit(1), F.col("at")), lambda w: F.array_contains("marks", w))), F.lit(-(1 << 30)))
    met = met.select(id_col, "item_id", "n", "item_words", "own", (F.col("pos") - F.col("at")).alias("base"), F.explode(F.sequence(F.greatest(before + 1, F.col("at") - F.col("n") + 1), F.col("at"))).alias("s"))
    met = met.withColumn("window", F.slice("own", F.greatest(F.col("s"), F.lit(0)) + 1, F.col("n") + F.least(F.col("s"), F.lit(0))))
    return met.where(F.size(F.array_except("item_words", "window")) <= lacking(F.col("window"))).select(id_col, "item_id", (F.col("base") + F.col("s")).alias("start"), "window")


_EDGES = [round(64 * i / (RADIUS + 1)) for i in range(RADIUS + 2)]


def _blocks(fp: Column) -> Column:
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))]
    return F.explode(F.array(*parts))


def _first_shared(differing: Column) -> Column:
    """The first block without differing bits, so that a pair that shares several blocks is taken once."""
    shared = [F.when(F.shiftrightunsigned(differing, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) == 0, F.lit(i)) for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))]
    return F.coalesce(*shared)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item_id, start, n_words, similarity): for each document and item the best window that reaches the similarity.

    Null and empty texts match nothing, nor do items of fewer than SHINGLE words; repeated rows of an id give one row a
    pair, ties go to the first window; other columns are not read; an empty table on either side gives no rows.
    """
    docs_words = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("words"))
    items = materialise(benchmark_items(benchmark, item_col, item_text_col), "items")
    anchored = materialise(anchors(items, docs_words, similarity), "anchored")
    texts = windows(docs_words, anchored, id_col, similarity).select(id_col, "item_id", "start", F.array_join("window", " ").alias("text"))
    prints = fingerprints.simhash(texts.withColumn("own", F.col("text")), [id_col, "item_id", "start", "own"])
    prints = prints.withColumnRenamed("own", "text")
    item_prints = fingerprints.simhash(items.select("item_id", F.array_join("words", " ").alias("text")), ["item_id", "text"]).withColumnRenamed("fp", "item_fp")
    item_blocks = materialise(item_prints.select("*", _blocks(F.col("item_fp")).alias("b")).select("item_id", "item_fp", "b.*"), "item-blocks")
    probes = prints.select("*", _blocks(F.col("fp")).alias("b")).select(id_col, "item_id", "start", "text", "fp", "b.*")
    differing = F.col("fp").bitwiseXOR(F.col("item_fp"))
    met = probes.join(item_blocks, ["item_id", "block", "bits"]).where((F.bit_count(differing) <= RADIUS) & (F.col("block") == _first_shared(differing)))
    met = met.select(id_col, "item_id", "start", "text").join(items.select("item_id", numbered(shingles(F.col("words"))).alias("own")), "item_id")

    def likeness(a: Column) -> Column:
        return bound(F.size(F.array_intersect(a, F.col("own"))), lambda c: F.coalesce(c / F.nullif(F.size(a) + F.size("own") - c, F.lit(0)), F.lit(0.0)))

    scored = met.select(id_col, "item_id", "start", F.size(F.split("text", " ")).cast("long").alias("n_words"), bound(numbered(shingles(F.split("text", " "))), likeness).alias("similarity"))
    best = scored.groupBy(id_col, "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("m")).where(F.col("m.similarity") >= similarity)
    return best.select(id_col, "item_id", F.greatest(-F.col("m.back"), F.lit(0)).cast("long").alias("start"), F.col("m.n_words").alias("n_words"), F.col("m.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without those that contaminated() names."""
    found = contaminated(docs, benchmark, id_col, text_col, item_col, item_text_col).select(F.col(id_col).alias("_found")).distinct()
    return docs.join(found, docs[id_col] == found["_found"], "left_anti")

"""SimHash document fingerprints and their search by permuted block tables, DataFrame operations only (operator 9).

The 64 bits of a term's hash vote with the term's weight. Votes are counted in 32 running sums, each of which holds
the counters of two bits (bit j in the low, bit j + 32 in the high half), so a text costs one aggregation row of 33
numbers whatever its length, map-side.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._workspace import materialise
from .components import connected_components

#: Heaviest weight of a term: weights are the term's characters up to this, so function words count less.
HEAVIEST = 8
_PAIR = 0x0000000100000001
_LOW = 0xFFFFFFFF
#: Quantiles between which ids are cut into ranges.
SEGMENTS = 1024
#: Above so many distinct fingerprints under one table key, links go through neighbours one bit away, not through pairs.
PAIRWISE = 32


def _terms(text: Column) -> Column:
    """Words in lower case; parts between white space, as they are."""
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def _votes(term: Column, weight: Column) -> list[Column]:
    h = F.xxhash64(term)
    lanes = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_PAIR)) * weight).alias(f"v{j}") for j in range(32)]
    return [*lanes, F.sum(weight).alias("total")]


def _decide() -> Column:
    """Bits whose votes exceed half of the total weight."""
    out = F.lit(0).cast("long")
    for j in range(32):
        lane = F.col(f"v{j}")
        low, high = lane.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(lane, 32)
        out = out.bitwiseOR(F.when(low * 2 > F.col("total"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
        top = (1 << (j + 32)) if j < 31 else -(1 << 63)
        out = out.bitwiseOR(F.when(high * 2 > F.col("total"), F.lit(top)).otherwise(F.lit(0)).cast("long"))
    return out


def simhash(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(*keys, fp LONG): one row for each distinct keys; equal texts under different keys have equal fingerprints.

    A text without terms (null and empty too) has fingerprint 0. keys must identify a text: texts under equal keys
    count as one. Counters hold texts of up to 2^31 / HEAVIEST terms.
    """
    words = texts.select(*keys, F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("_term"))
    weight = F.least(F.length("_term"), F.lit(HEAVIEST)).cast("long")
    return words.groupBy(*keys).agg(*_votes(F.col("_term"), weight)).select(*keys, _decide().alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _blocks(count: int) -> list[int]:
    edges = [round(64 * i / count) for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_tables(fps: DataFrame, radius: int, kept: int = 3) -> DataFrame:
    """(key, fp): for each choice of kept of radius + kept blocks a table sorted by these blocks. Two fingerprints within
    the radius differ in at most radius blocks, so they share the key of a table."""
    masks = [_signed(sum(c)) for c in combinations(_blocks(radius + kept), kept)]
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints within the radius (0 to 2), enough to join all that links join.

    Pairs under a key that few share are verified by their distance. Where many share a key, each of them meets the
    others at the points one bit away that both have (within radius 2 there is one), so a group costs its size.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be from 0 to 2")
    table = block_tables(fps, radius)
    sizes = table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(table.join(sizes, "key"), "shared-keys")
    small = shared.where(F.col("n") <= PAIRWISE)
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.fp").alias("b"), F.col("b.fp").alias("a"))
    if radius == 0:
        return pairs
    crowd = shared.where(F.col("n") > PAIRWISE).select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << j))) for j in range(64)]
    points = crowd.select("fp", F.explode(F.array(*flips)).alias("point"))
    if radius == 1:
        points = points.where("point <> fp")
        heads = crowd.select(F.col("fp").alias("head"), F.col("fp").alias("point"))
    else:
        heads = points.groupBy("point").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(heads, "point").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    return pairs.select("a", "b").unionAll(stars).distinct()


def fingerprint_classes(prints: DataFrame, id_col: str, radius: int = 2) -> DataFrame:
    """(fp, class_id): the smallest id of each class of fingerprints that links within the radius join."""
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("_least")), "fingerprints")
    reach = connected_components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    labelled = nodes.join(reach, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("_least").alias("class_id"))
    return labelled.join(least, "component").select("fp", "class_id")


def _ranged(docs: DataFrame, id_col: str, rows: int, text_col: str = "text") -> Column:
    """A range of ids of about the given number of rows: ids are cut at 1,024 quantiles, and between two of these into
    equal widths, so that ids far from the others leave the others' ranges as they are. Only the work's balance hangs
    on the quantiles. Null ids are dealt by their texts to ranges from -1 down."""
    whole = F.col(id_col).cast("decimal(20,0)")
    cuts, n, every = docs.agg(F.percentile_approx(id_col, [i / SEGMENTS for i in range(SEGMENTS + 1)], 10 * SEGMENTS), F.count(id_col), F.count("*")).first()
    nulls = -(-(every - n) // rows)  # ranges of null ids
    unknown = F.lit(-1).cast("long")
    if nulls > 1:
        unknown = -1 - F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(nulls))
    if not cuts:
        return unknown
    edges = sorted({int(c) for c in cuts})
    per = max(1, -(-n // (SEGMENTS * rows)))  # ranges in a segment
    groups = [edges[i : i + 32] for i in range(0, len(edges), 32)]

    def at_most(values: Column) -> Column:
        return F.greatest(F.size(F.filter(values, lambda e: e <= F.col(id_col))), F.lit(1))

    outer = at_most(F.array(*(F.lit(g[0]).cast("long") for g in groups)))
    inner = F.element_at(F.array(*(F.array(*(F.lit(e).cast("long") for e in g)) for g in groups)), outer)
    place = (outer - 1) * 32 + at_most(inner) - 1
    widths = [max(1, -(-(b - a) // per)) for a, b in zip(edges, [*edges[1:], edges[-1] + 1], strict=True)]
    low = F.element_at(F.array(*(F.lit(e).cast("long") for e in edges)), (place + 1).cast("int"))
    width = F.element_at(F.array(*(F.lit(w).cast("long") for w in widths)), (place + 1).cast("int"))
    step = F.floor((whole - low.cast("decimal(20,0)")) / width.cast("decimal(20,0)")).cast("long")
    return F.when(F.col(id_col).isNull(), unknown).otherwise(place.cast("long") * per + F.least(F.greatest(step, F.lit(0)), F.lit(per - 1)))


def _turns(tops: DataFrame, fan: int = 1500) -> DataFrame:
    """(rng, after_rng) for each rng of tops: the next smaller one, and the greatest after the smallest.

    Ranges are ordered within groups of fan neighbouring numbers, the groups among each other; one window holds a row
    for each group, which is a row for fan times a range's documents.
    """
    grouped = tops.select("rng", F.floor(F.col("rng") / F.lit(fan)).cast("long").alias("grp"))
    inside = grouped.select("*", F.lead("rng").over(Window.partitionBy("grp").orderBy(F.col("rng").desc())).alias("next_rng"))
    order = Window.orderBy(F.col("grp").desc())
    firsts = grouped.groupBy("grp").agg(F.max("rng").alias("top")).select("grp", F.coalesce(F.lead("top").over(order), F.first("top").over(order)).alias("after_grp"))
    return inside.join(firsts, "grp").select("rng", F.coalesce("next_rng", "after_grp").alias("after_rng"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 1500) -> DataFrame:
    """(id, text, next_id, next_text): each document's successor by descending id; the first follows the last.

    One shuffle deals documents to ranges of ids; a range's last document takes the head of the next range that has
    any, from a table of one row a range. Rows of one id follow one another by descending text; null ids come last,
    where they are many by a hash of the text first. A document alone follows itself.
    """
    rng = _ranged(docs, id_col, rows, text_col)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rng.alias("rng"))
    by = Window.partitionBy("rng").orderBy(F.col("id").desc(), F.col("text").desc())
    lead = base.select("*", F.lead("id").over(by).alias("next_id"), F.lead("text").over(by).alias("next_text"))
    tops = materialise(docs.select(F.col(id_col).alias("id"), rng.alias("rng")).groupBy("rng").agg(F.max("id").alias("head")), "ranges")
    turn = _turns(tops)
    known = base.where("rng >= 0").join(tops.select(F.col("rng").alias("top_rng"), F.col("head").alias("id")), "id").select("rng", F.col("id").alias("head"), "text")
    heads = known.unionAll(base.where("rng < 0").select("rng", F.col("id").alias("head"), "text")).groupBy("rng", "head").agg(F.max("text").alias("after_text"))
    ends = turn.join(heads.select(F.col("rng").alias("after_rng"), "head", "after_text"), "after_rng").select(F.col("rng").alias("end_rng"), "head", "after_text")
    last = F.col("next_text").isNull()
    joined = lead.join(ends, (F.col("rng") == F.col("end_rng")) & last, "left")
    return joined.select(F.col("id").alias(id_col), "text", F.when(last, F.col("head")).otherwise(F.col("next_id")).alias("next_id"), F.coalesce("next_text", "after_text").alias("next_text"))


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row a row of docs: (id, n_chars, edited_sha256, fp, edited_fp, next_fp, class_id).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's. class_id is the smallest id whose fingerprint links within the radius reach. Null and empty texts have
    fingerprint 0; null ids come last in the order; repeated rows stay; other columns are not read; no rows give none.
    Where several rows have one id, next_fp is that of the row whose text the edited text took from.
    """
    follow = with_next(docs, id_col, text_col)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = follow.withColumn("n_chars", F.char_length("text").cast("long")).select(F.monotonically_increasing_id().alias("_row"), id_col, "n_chars", "next_id", F.xxhash64("text").alias("own_hash"), F.xxhash64("next_text").alias("next_hash"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["_row", id_col, "n_chars", "next_id", "own_hash", "next_hash", "edited_sha256"]
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x")).select("*", "x.kind", "x.text").drop("x")
    prints = simhash(both, [*keys, "kind"]).groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    prints = materialise(prints, "prints")
    by_id = prints.groupBy(F.col(id_col).alias("_next"), F.col("own_hash").alias("_hash")).agg(F.min("fp").alias("next_fp"))
    classes = fingerprint_classes(prints, id_col, radius)
    told = prints.join(by_id, F.col("next_id").eqNullSafe(F.col("_next")) & (F.col("next_hash") == F.col("_hash")), "left").join(classes, "fp")
    return told.select(id_col, "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp", "class_id")

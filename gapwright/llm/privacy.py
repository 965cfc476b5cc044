"""Personal data by pattern and terms that disclose it by corpus co-occurrence, DataFrame operations only (operator 3).

Entities are the values that the patterns find. A term in a text with an entity reveals it as far as seeing the term removes
the surprise at the entity: disclosure(t; e) = PMI(t; e) / IC(e), with IC(e) = log(N / n_e) and
PMI(t; e) = log(n_te N / (n_t n_e)), counted over the N distinct texts of the corpus, so copies count once. It is 1 where
the term occurs with the entity only. Terms at GENERALISE or above are replaced by their class, at REMOVE or above they go,
where they occur together more than chance explains; one text is enough for that, unless the corpus has few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._workspace import materialise
from .decontamination import _member_test, places

#: Fixed kinds and patterns. Possessive forms match what the plain ones match and never backtrack; the look-behind skips
#: starts inside a run, where the match would have begun earlier, so runs of any length cost linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no match of the kind: cheap tests before the patterns.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: Classes of words that a term is generalised to.
CLASSES = {"code": "[CODE]", "name": "[NAME]", "word": "[WORD]"}
#: Disclosures from which terms are generalised and removed, and the least likelihood ratio statistic of a term and an
#: entity (chi square with one degree of freedom, p = 0.001).
GENERALISE, REMOVE, SIGNIFICANT = 0.95, 0.99, 10.83
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digits from the right, every second one doubled and reduced by 9 above 9; the sum divides by 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """ARRAY<start, end, value> of one kind: code points, end exclusive, leftmost and non-overlapping.

    Matches and the pieces between them come from the same pattern, so a match starts where the lengths before it add up to.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pieces = F.split(text, PATTERNS[kind], -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["value"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(_valid(kind, x["value"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    joined = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda v, p: F.struct(v.alias("value"), p.alias("piece")))
    spans = F.aggregate(joined, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(_SPAN))


def with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_id, email, ip, card, phone, terms): the spans of each row, and all terms of a text that has any; no texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = docs.select(F.col(id_col), text.alias("_text")).select(id_col, F.xxhash64("_text").alias("text_id"), "_text", *(base_spans(F.col("_text"), k).alias(k) for k in KINDS))
    words = F.array_distinct(F.filter(F.transform(F.split("_text", _SPACE), _term), _is_term))
    some = reduce(lambda a, b: a | b, (F.size(k) > 0 for k in KINDS))
    return spans.select(id_col, "text_id", *KINDS, F.when(some, words).otherwise(F.array().cast("array<string>")).alias("terms"))


def _term(token: Column) -> Column:
    """A token's word: lower case, without punctuation at its ends."""
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _is_term(term: Column) -> Column:
    return term.rlike(r"\p{L}") & ~term.contains("@") & (F.char_length(term) > 2)


_SPACE = r"[\x20\x09-\x0D]"


def _together(n_te: Column, n_t: Column, n_e: Column, total: float) -> Column:
    """Likelihood ratio statistic (G squared) of the two by two table of a term and an entity over texts."""
    every = F.lit(total)
    cells = [(n_te, n_t, n_e), (n_t - n_te, n_t, every - n_e), (n_e - n_te, every - n_t, n_e), (every - n_t - n_e + n_te, every - n_t, every - n_e)]
    return 2 * reduce(lambda a, b: a + b, (F.when(o > 0, o * F.log(o * every / (r * c))).otherwise(F.lit(0.0)) for o, r, c in cells))


def disclosing_terms(docs: DataFrame, base: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, disclosure): terms that reveal an entity, with the largest disclosure over the entities they occur with.

    base is with_base(docs), written. A term and an entity occur together where they are in one text, at any distance.
    Counts are over all distinct texts.
    """
    total = float(base.select("text_id").distinct().count())
    groups = materialise(_groups(base), "entity-groups")
    terms = base.where(F.size("terms") > 0).select("text_id", "terms").dropDuplicates(["text_id"]).select("text_id", F.explode("terms").alias("term"))
    terms = materialise(terms, "entity-terms")
    counted = groups.join(terms, "text_id").groupBy("group", "n_e", "term").agg(F.count("*").alias("n_te"))
    ic = F.log(F.lit(total) / F.col("n_e"))
    # PMI is IC + log(n_te / n_t), and n_t is at least the term's count in texts with entities: none is lost by this test
    least = terms.groupBy("term").agg(F.count("*").alias("least"))
    pairs = counted.join(least, "term").where((ic > 0) & (F.log(F.col("n_te") / F.col("least")) >= (GENERALISE - 1) * ic - 1e-9))
    pairs = materialise(pairs.groupBy("term", "n_e", "n_te").agg(F.count("*").alias("entities")), "pairs")
    wanted = _member_test(pairs.select(F.col("term").alias("word")).distinct())
    text = F.coalesce(F.col(text_col), F.lit(""))
    in_texts = docs.select(F.xxhash64(text).alias("text_id"), F.explode(F.array_distinct(F.filter(F.transform(F.split(text, _SPACE), _term), wanted))).alias("term"))
    n_t = in_texts.distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    pmi = F.log(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e")))
    told = pairs.join(n_t, "term").withColumn("disclosure", pmi / ic).where(_together(F.col("n_te"), F.col("n_t"), F.col("n_e"), total) >= SIGNIFICANT)
    return told.where(F.col("disclosure") >= GENERALISE).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def _groups(base: DataFrame) -> DataFrame:
    """(group, n_e, text_id): entities that occur in the same n_e texts are one group, as their counts are equal.

    An entity is a kind and its value in lower case, numbers by their digits.
    """
    def of_kind(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), _digits(s["value"]) if kind in ("card", "phone") else F.lower(s["value"])))

    entities = materialise(base.select("text_id", F.explode(F.concat(*map(of_kind, KINDS))).alias("entity")).distinct(), "entities")
    each = [F.bit_xor(F.xxhash64(F.col("text_id"), F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    named = entities.groupBy("entity").agg(F.count("*").alias("n_e"), *each).select("entity", "n_e", F.xxhash64("n_e", "x1", "x2").alias("group"))
    return entities.join(named, "entity").select("group", "n_e", "text_id").distinct()


def _offsets(tokens: Column, at: Column) -> Column:
    """ARRAY<token, offset> of the tokens at ascending indices; tokens are one separator apart, and each is passed once."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("offset"), F.array().cast("array<struct<token:string,offset:int>>").alias("out"))

    def all_of(own: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            offset = F.aggregate(F.slice(own["tokens"], acc["i"] + 1, i - acc["i"]), acc["offset"], lambda a, x: a + F.char_length(x) + 1)
            return F.struct(i.alias("i"), offset.alias("offset"), F.concat(acc["out"], F.array(F.struct(F.get(own["tokens"], i).alias("token"), offset.alias("offset")))).alias("out"))

        return F.aggregate(own["at"], zero, step, lambda acc: acc["out"])

    return F.get(F.transform(F.array(F.struct(tokens.alias("tokens"), at.alias("at"))), all_of), F.lit(0))


def _class(word: Column) -> Column:
    """What a word is generalised to: a code if it has digits, a name if it starts with a capital letter, else a word."""
    return F.when(word.rlike(r"\p{Nd}"), "code").when(word.rlike(r"^\p{Lu}"), "name").otherwise("word")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_id, email, ip, card, phone, term): spans of each kind, for every row of docs.

    A null text is empty; a null id keeps its row; repeated rows stay and have equal spans; an empty table gives no rows;
    other columns are not read. term spans are the words that disclose an entity, wherever they occur, outside of base spans
    or not; their value is 'remove' or the class that they are generalised to: 'code', 'name' or 'word'.
    """
    plain = materialise(with_base(docs, id_col, text_col), "base-spans")
    terms = materialise(disclosing_terms(docs, plain, text_col), "terms")
    plain = plain.drop("terms")
    wanted = _member_test(terms.select(F.col("term").alias("word")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = docs.select(F.col(id_col), F.xxhash64(text).alias("text_id"), F.split(text, _SPACE).alias("tokens"))
    hits = tokens.select(id_col, "text_id", "tokens", places(F.col("tokens"), lambda t: wanted(_term(t))).alias("at"))
    hits = hits.select(id_col, "text_id", F.explode(_offsets(F.col("tokens"), F.col("at"))).alias("x")).select(id_col, "text_id", "x.token", "x.offset")
    word = F.regexp_replace("token", r"^[^\p{L}\p{N}]+", "")
    start = F.col("offset") + F.char_length("token") - F.char_length(word)
    hits = hits.select(id_col, "text_id", _term(F.col("token")).alias("term"), start.alias("start"), _class(word).alias("class"))
    span = F.struct("start", (F.col("start") + F.char_length("term")).alias("end"), F.when(F.col("disclosure") >= REMOVE, "remove").otherwise(F.col("class")).alias("value"))
    found = hits.join(terms, "term").groupBy(F.col(id_col).alias("_id"), F.col("text_id").alias("_text_id")).agg(F.array_sort(F.collect_set(span)).alias("term"))
    joined = plain.join(found, plain[id_col].eqNullSafe(found["_id"]) & (plain["text_id"] == found["_text_id"]), "left")
    return joined.select(id_col, "text_id", *KINDS, F.coalesce("term", F.array().cast(_SPAN)).alias("term"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def listed(*kinds: str) -> Column:
    """kind:start:end of the kinds' spans, comma-joined, by kind as given and then start."""
    def of_kind(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.concat_ws(",", *map(of_kind, kinds))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text sanitised: base spans give way to their kind's label, disclosing terms to that of their class
    or nothing.

    Of overlapping spans the first is replaced, the longer one at a tie. Null texts stay null, null ids keep their rows,
    repeated rows are treated alike; other columns stay, whatever their names; an empty table gives no rows.
    """
    key, mark, every_span = (_free(docs, n) for n in ("_id", "_text_id", "_spans"))
    spans = personal_spans(docs, id_col, text_col).dropDuplicates([id_col, "text_id"])
    def of_kind(kind: str) -> Column:
        def labelled(s: Column) -> Column:
            of_class = F.coalesce(*(F.when(s["value"] == c, label) for c, label in CLASSES.items()), F.lit(""))
            label = of_class if kind == "term" else F.lit(LABELS[kind])
            return F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), label.alias("label"))

        return F.transform(F.col(kind), labelled)

    every = reduce(F.concat, map(of_kind, (*KINDS, "term")))
    spans = spans.select(F.col(id_col).alias(key), F.col("text_id").alias(mark), F.array_sort(every).alias(every_span))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(spans, docs[id_col].eqNullSafe(spans[key]) & (F.xxhash64(text) == spans[mark]), "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["label"])
        ahead = s["start"] >= acc["at"]
        return F.struct(F.when(ahead, -s["back"]).otherwise(acc["at"]).alias("at"), F.when(ahead, more).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(F.col(every_span), zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return joined.withColumn(text_col, F.when(F.col(text_col).isNotNull(), whole)).select(*docs.columns)

"""Cases that earlier versions of the operators left out."""

import random
from collections import Counter

from gapwright.llm import decontamination, line_dedup, privacy
from gapwright.operators import graph

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def test_short_lines_collapse_on_equal_sets(spark):
    """One to three distinct words, however long the line; blank lines stay, and so do sets that differ."""
    unspaced, chant = "\u6f22" * 300, "row the boat " * 12
    rows = [(1, f"Read more\n\n{unspaced}\n{chant}\nsign in now"), (2, f"own\n\nread MORE\n{unspaced}\n{chant}\nread less\nsign in"), (3, "more read\n \nown\nown")]
    seen, expected = [], set()
    for d, t in rows:
        for i, line in enumerate(t.split("\n")):
            words = set(line.lower().split())
            if words and any(5 * len(words & y) >= 4 * len(words | y) for y in seen):
                expected.add((d, i))
            seen.append(words)
    docs = docs_of(spark, rows)
    assert {(r.doc_id, r.line_no) for r in line_dedup.repeated_lines(docs).collect()} == expected and len(expected) == 6
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "own\n\nread less\nsign in", 3: " "}


def test_copies_of_lines_are_gone_by_their_keys_alone(spark):
    """Copies that several tasks see are told once, not verified; only similar lines are pairs."""
    import pyarrow as pa

    lines = [" ".join(f"w{random.Random(k).randrange(10**6)}x{i}" for i in range(10)) for k in range(40)]
    docs = docs_of(spark, [(d, "\n".join(lines) + f"\n{lines[0]} own{d}") for d in range(6)]).repartition(6, "doc_id")
    packed = line_dedup.packed_lines(docs, "doc_id", "text", line_dedup.word_counts(docs, "text"), 512)
    found = line_dedup.found_pairs(packed, 512, "bigint", pa.int64()).collect()
    copies = {(r.xi, r.xl) for r in found if r.yi is None and r.cell is None}
    assert copies == {(d, i) for d in range(1, 6) for i in range(40)} and not [r for r in found if r.cell is not None]
    pairs = {(r.xi, r.xl, r.yi, r.yl) for r in found if r.yi is not None}
    assert pairs and all(40 in (r[1], r[3]) and not {r[:2], r[2:]} & copies for r in pairs)
    assert {(r.doc_id, r.line_no) for r in line_dedup.repeated_lines(docs).collect()} == copies | {(d, 40) for d in range(6)}


def test_lines_in_question_travel_without_their_texts(spark):
    """The filter lets all wanted lines pass, whatever the ids, and few others; texts are not joined."""
    texts = {d: "\n".join(f"line {i} \u00e9 of {d}" if (d + i) % 5 else "" for i in range(d % 40)) for d in range(300)}
    for kind, name in (("long", int), ("string", str)):
        docs = spark.createDataFrame([(name(d), t) for d, t in texts.items()] + [(None, "a\nb")], f"doc_id {kind}, text string").where("doc_id is not null")
        wanted = {(name(d), i): line for d, t in texts.items() for i, line in enumerate(t.split("\n")) if (3 * d + i) % 50 == 0}
        rows = spark.createDataFrame(list(wanted), f"id {kind}, line_no long")
        lines = line_dedup._lines_of(docs, rows, len(wanted), "doc_id", "text", docs.schema["doc_id"].dataType.simpleString())
        assert "Join" not in lines._jdf.queryExecution().toString()
        got = {(r.id, r.line_no): r.line.removesuffix("\n") for r in lines.collect()}
        assert {k: got.get(k) for k in wanted} == wanted and len(got) < 2 * len(wanted) < sum(map(len, (t.split("\n") for t in texts.values()))) / 10
        assert all(line == texts[int(d)].split("\n")[i] for (d, i), line in got.items())


def test_benchmark_copies_far_in_bits_are_found(spark):
    """A copy at similarity 0.8 whose fingerprint differs from the item's in 28 bits."""
    kept = "qu ztl rkhcsj yfpadzflp jqqb eje dtr olpb cn nwpw bzd npygxktbv fluo opjz tbz bbfn sk klg xcmzxbohh ula"
    items = spark.createDataFrame([(1, f"bgxgipnbl znijrism {kept}")], "item_id long, text string")
    got = decontamination.contaminated(docs_of(spark, [(1, f"if ubooqvytq {kept}"), (2, f"if ubooqvytq {kept} rr ss")]), items).collect()
    assert {(r.doc_id, r.item_id, r.start, r.similarity) for r in got} == {(1, 1, 2, 16 / 18), (2, 1, 0, 0.8)}  # the best window of 1 ends with the text


def test_long_benchmark_items_have_anchors_enough(spark):
    """An item of 280 words and a copy that lacks the rarest long word of each sixth of it."""
    item = [f"w{i}" for i in range(280)]
    for k in range(6):
        item[20 + 280 * k // 6] = f"extraordinarily{k}"
    copy = " ".join("x" if w.startswith("extra") else w for w in item)
    got = decontamination.contaminated(docs_of(spark, [(1, copy)]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)] and abs(got[0].similarity - 246 / 306) < 1e-9


def test_anchors_of_all_parts_take_more_than_the_similarity_allows():
    for n in range(5, 320):
        parts, last = max(decontamination.PARTS, -(-n // decontamination.part_words(0.8))), n - decontamination.SHINGLE
        least = None  # fewest shingles that anchors of the parts so far take, by the offset of the last anchor
        for part in range(parts):
            offs = [o for o in range(n) if o * parts // n == part]
            if offs:
                taken = {o: (max(0, o - 4), min(o, last)) for o in offs}
                least = {o: b - a + 1 if least is None else min(v + max(0, b - max(a, min(q, last) + 1) + 1) for q, v in least.items()) for o, (a, b) in taken.items()}
        assert 5 * min(least.values()) > last + 1, n


def test_equal_vectors_are_ranked_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i else [3.0, 2.0, 1.0]) for i in range(60, -1, -1)]
    vectors = spark.createDataFrame(rows, "id long, v array<float>").coalesce(1)
    got = graph.cosine_search(vectors.where("id in (0, 7)"), vectors, "id", "v", 3).collect()
    assert {(r.query_id, r.rank, r.id) for r in got} == {(0, 1, 1), (0, 2, 2), (0, 3, 3), (7, 1, 1), (7, 2, 2), (7, 3, 3)}


def test_terms_disclose_from_the_first_text_and_at_any_distance(spark):
    """One entity in one text and two in two texts, their terms hundreds of characters away; common words stay."""
    filler = "the clinic wrote about the usual matters of the week " * 8
    rows = [(0, f"Qumquat spoke first. {filler} mail to one@q.example.com"), (1, f"call +49 30 1234567 {filler} said Vexler"), (2, f"call +49 (30) 123 4567 {filler} and Vexler again"), (3, f"mail to two@q.example.com {filler} without names")]
    rows += [(10 + i, f"{filler} mail call said spoke first and again without names number {i}") for i in range(120)]
    docs = docs_of(spark, rows)
    found = {r.doc_id: [rows[r.doc_id][1][s.start : s.end] for s in r.term] for r in privacy.personal_spans(docs).collect() if r.term}
    assert found == {0: ["Qumquat"], 1: ["Vexler"], 2: ["Vexler"]}


def test_benchmark_copies_with_moved_parts_equal_brute_force(spark):
    """Halves changed over, parts moved, words put in at the front: windows that no single word is aligned in."""
    rnd = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "rt", "lm", "st", "x")]
    items = [(i, [rnd.choice(words) for _ in range(n)]) for i, n in enumerate((30, 48, 60, 130))]
    texts = []
    for d in range(48):
        w = items[d % 4][1]
        cut, gap = rnd.randrange(3, len(w) - 3), [rnd.choice(words) for _ in range(d % 3)]
        lead = [rnd.choice(words) for _ in range(d % 5 * 7)]
        texts.append((d, lead + w[cut:] + gap + w[:cut] + [rnd.choice(words) for _ in range(d % 4 * 9)]))

    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    expected = {}
    for d, w in texts:
        for i, item in items:
            own, n = shingles(item), len(item)
            for k in range(1 - n, len(w)):
                s = shingles(w[max(k, 0) : k + n])
                if 5 * sum((s & own).values()) >= 4 * sum((s | own).values()):
                    expected[d, i] = max(expected.get((d, i), 0), sum((s & own).values()) / sum((s | own).values()))
    got = decontamination.contaminated(docs_of(spark, [(d, " ".join(w)) for d, w in texts]), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    assert found.keys() == expected.keys() and len(found) > 20 and all(abs(found[k] - v) < 1e-9 for k, v in expected.items())

"""Operators of the llm subpackage: plain versions, planted cases, and nulls, empty tables and clashing columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gapwright.llm import chat, decontamination, fingerprints, language, line_dedup, packing, privacy, quality, simhash_dedup, warc
from gapwright.llm._workspace import new_path
from gapwright.llm.queries_text import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, n long, kind string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 7, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, extra columns that clash."""
    long = " ".join(f"word{i % 997} other{i % 13}" for i in range(60000))
    return docs_of(spark, [(1, None), (2, ""), (3, "a"), (4, long), (5, "same text of some words here"), (6, "same text of some words here"), (6, "same text of some words here"), (7, " \n\t "), (None, "no id at all in this row")]).cache()


# The four base patterns of the task.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def luhn(d):
        return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if good(k, m[0])]


def test_personal_spans_equal_the_plain_patterns(spark, odd):
    texts = ["a@b.c_x@d.e", "x@y", "a.b@c..d e@f.g.h.", "1.2.3.4.5 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +1 2 +49 30 1234567 ext", "é😀 a@b.co 😀 4111111111111111", "9" * 30000, "a" * 60000 + "@b.c", "+" + "1 " * 9000, "mail: <q+w%e@x-y.z>;10.0.0.1,", "12 34-56 78 90 12 34 5"]
    df = docs_of(spark, list(enumerate(texts)))
    found = privacy.personal_spans(df).select("doc_id", privacy.listed(*privacy.KINDS).alias("s")).collect()
    assert {r.doc_id: r.s for r in found} == {i: ",".join(brute_spans(t)) for i, t in enumerate(texts)}
    assert privacy.personal_spans(odd).count() == 9 and privacy.personal_spans(odd.limit(0)).count() == 0


def test_terms_that_disclose_an_entity_are_hidden(spark):
    rows = [(i, f"The patient Zorblatt wrote number {i} from zed@q.example.com to the clinic") for i in range(6)] + [(100 + i, f"The patient wrote from home to the clinic about item number {i}") for i in range(60)]
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs_of(spark, rows)).collect()}
    assert "Zorblatt" not in clean[0] and "zed@q" not in clean[0] and "[EMAIL]" in clean[0] and "patient" in clean[0]
    assert all(clean[100 + i] == rows[6 + i][1] for i in range(60))
    spans = {r.doc_id: r.term for r in privacy.personal_spans(docs_of(spark, rows)).collect()}
    assert [(s.start, s.end) for s in spans[3]] == [(12, 20)] and not spans[100]


def test_conversations(spark):
    schema = "id long, turn long, role string, text string, part string"
    a = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", ""), (2, 0, "user", "x<|im_end|>", ""), (2, 1, "assistant", "same", ""), (3, 0, "user", None, ""), (None, 0, "user", "q", "")]
    b = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "no!", ""), (1, 2, "user", "why", ""), (2, 0, "user", "x<|im_end|>", ""), (2, 1, "assistant", "same", ""), (3, 0, "user", "other", "")]
    segments = chat.preference_segments(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    got = {r.id: r for r in chat.assemble(segments).collect()}
    assert got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n" and got[1].chosen == "<|im_start|>assistant\nyes<|im_end|>\n"
    assert [got[1].chosen[s.start : s.end] for s in got[1].chosen_loss] == ["yes<|im_end|>"]
    assert [got[1].rejected[s.start : s.end] for s in got[1].rejected_loss] == ["no!<|im_end|>"] and got[1].rejected.endswith("why<|im_end|>\n")
    assert not got[2].chosen and not got[2].rejected and got[2].prompt.count("<|im_end|>") == 2
    assert got[3].prompt == "" and None not in got
    empty = spark.createDataFrame([], schema)
    assert chat.preference_segments(empty, empty).count() == 0


def test_languages(spark, odd):
    docs = spark.createDataFrame([("the cat and the dog went to the house " * 5, "en"), ("der hund und die katze gingen nach hause " * 5, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = language.fit(docs)
    pages = spark.createDataFrame([(1, "http://a.x.org/1", "<html lang='de'><p>der hund und die katze</p></html>", 1), (2, "http://a.x.org/2", "<html><script>der die</script><p>the dog and the cat</p></html>", 1), (3, None, None, 1), (4, "not a url%%", "", 1), (4, "not a url%%", "", 1)], "page_id long, url string, html string, host long")
    got = {r.page_id: r for r in language.identify(pages, model).collect()}
    assert model.languages == ("de", "en") and got[1].lang == "de" and got[2].lang == "en" and len(got) == 4
    assert language.identify(pages, model).count() == 5 and language.identify(pages.limit(0), model).count() == 0
    assert {r.lang for r in language.identify(pages, language.fit(docs.limit(0))).collect()} == {None}


def test_simhash_components_equal_brute_force(spark, odd):
    import random

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(90)) for _ in range(12)]
    rows = [(10 * i + k, t if k == 0 else " ".join([*t.split()[:-k], *["end"] * k])) for i, t in enumerate(base) for k in range(4)] + [(999, base[0]), (1000, None), (1001, "")]
    found = simhash_dedup.simhash_components(docs_of(spark, rows)).collect()
    fps, lead = {r.doc_id: r.fp & (1 << 64) - 1 for r in found}, {r.doc_id: r.doc_id for r in found}
    for _ in range(len(rows)):
        for x in fps:
            lead[x] = min(lead[y] for y in fps if (fps[x] ^ fps[y]).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in found} == lead and lead[1001] == 1000
    assert simhash_dedup.simhash_components(odd).count() == 9 and simhash_dedup.simhash_components(odd.limit(0)).count() == 0


def test_packing_is_whole(spark, odd):
    pieces = packing.pack(odd, tokenizer_path(), 2048).collect()
    by, tokens = {}, sum(r.length for r in pieces)
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert tokens == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert packing.pack(odd.limit(0), tokenizer_path()).count() == 0


def test_archives_come_back(spark):
    body = "<p>" + "same " * 40
    rows = [(3, "http://h/3", body), (1, None, body), (2, "http://h/2", None), (5, "http://h/5", ""), (9, "http://h/9", "é" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    warc.write_warc(pages, path)
    got = {int(r.page_id): r for r in warc.read_warc(spark, path, with_payload=False).collect()}
    assert {k: (r.payload_bytes, r.payload_digest) for k, r in got.items()} == {i: (len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows}
    assert got[3].record_type == "revisit" and int(got[3].refers_to) == 1 and got[1].record_type == got[2].record_type == got[5].record_type == "response"


def test_benchmark_passages_are_found(spark, odd):
    item = "seven brave sailors crossed the frozen harbour before dawn carrying lanterns and bread for the hungry"
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "unrelated passage about gardens full of roses tulips and daisies in spring")], "item_id long, text string")
    rows = [(1, f"Some words first. {item.title()}! And more after it."), (2, "nothing to see here at all today, only plain words"), (3, None), (4, item.replace("bread", "cheese", 1))]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(docs_of(spark, rows), items).collect()}
    assert got[1, 1] == 1.0 and {d for d, _ in got} <= {1, 4}
    assert [r.doc_id for r in decontamination.decontaminate(docs_of(spark, rows), items).where("doc_id in (1, 2, 3)").orderBy("doc_id").collect()] == [2, 3]
    assert decontamination.contaminated(odd, items).count() == 0 and decontamination.contaminated(odd, items.limit(0)).count() == 0
    assert decontamination.contaminated(odd.limit(0), items).count() == 0


def test_repeated_lines_go(spark, odd):
    line = "this line is repeated in several documents of the corpus word for word and is long"
    rows = [(1, f"first own text\n{line}\nmore"), (2, f"second own words\n{line}\n"), (3, None), (4, line.replace("several", "many") + " indeed")]
    got = {r.doc_id: r for r in line_dedup.remove_repeated_lines(docs_of(spark, rows)).collect()}
    assert line in got[1].text and line not in got[2].text and got[2].n_removed == 1 and got[3].text is None
    assert line_dedup.remove_repeated_lines(odd).count() == 9 and line_dedup.remove_repeated_lines(odd.limit(0)).count() == 0


def test_repeated_lines_equal_brute_force(spark):
    """Sets of all sizes and degrees of likeness, with words that far more sets share than meet pairwise at once."""
    import random

    rnd = random.Random(11)
    stems = [[f"w{rnd.randrange(400)}" for _ in range(rnd.choice([4, 5, 9, 10, 20, 45, 90]))] for _ in range(30)]
    lines = [[w if rnd.random() > 0.06 else f"x{rnd.randrange(9)}" for w in rnd.choice(stems)] for _ in range(500)]
    lines += [["rare1", "rare2", "rare3", "rare4", *(f"y{rnd.randrange(14)}" for _ in range(7))] for _ in range(200)]
    rnd.shuffle(lines)
    texts = ["\n".join(" ".join(x) for x in lines[i : i + 7]) for i in range(0, len(lines), 7)]
    sets, expected = [], set()
    for d, t in enumerate(texts):
        for i, x in enumerate(t.split("\n")):
            words = set(x.split())
            if len(words) >= line_dedup.LEAST_WORDS:
                if any(5 * len(words & y) >= 4 * len(words | y) for y in sets):
                    expected.add((d, i))
                sets.append(words)
    found = {(r.doc_id, r.line_no) for r in line_dedup.repeated_lines(docs_of(spark, list(enumerate(texts)))).collect()}
    assert found == expected and 100 < len(expected) < len(lines)


def test_fingerprints(spark, odd):
    whole = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_edits(whole).collect()}
    texts = {r.doc_id: r.text or "" for r in whole.collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, after = texts[d], texts[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), d
    assert got[5].fp == got[6].fp


def test_quality(spark, odd):
    good, bad = "calm clear prose about the history of rivers", "buy cheap pills now click here winner"
    rows = [(i, (good if i % 2 else bad) + f" {i} " * 3) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i in range(120) if i % 2}
    model = quality.fit(docs, labels)
    assert quality.classify(odd, model).count() == 9 and quality.classify(odd.limit(0), model).count() == 0
    assert quality.keep_good(odd, labels.limit(0)).count() == 9


def test_terms_are_generalised_by_class(spark):
    """Disclosure between the two thresholds: the term is also in a text without the entity."""
    rows = [(i, f"write to zed@q.example.com about Zorblatt and unit77 today number {i}") for i in range(60)] + [(100 + i, f"plain text {i} about the weather today") for i in range(3000)] + [(9000 + i, f"about Zorblatt and unit77 alone {i}") for i in range(6)]
    docs = docs_of(spark, rows).withColumn("_spans", F.lit(1)).withColumn("_id", F.lit("x"))
    clean = {r.doc_id: r for r in privacy.sanitise(docs).collect()}
    assert clean[0]["_spans"] == 1 and clean[0]["_id"] == "x" and clean[100].text == "plain text 0 about the weather today"
    assert clean[9003].text == "about [NAME] [WORD] [CODE] alone 3"  # log(3066 / 66) / log(3066 / 60) = 0.976


def test_packed_ids_equal_the_tokenizer(spark):
    import random
    import struct
    import zlib

    import tokenizers

    rnd, model = random.Random(3), tokenizers.Tokenizer.from_file(tokenizer_path())
    rows = [(i, "".join(rnd.choice("ab \n\té😀漢,.1Z'") for _ in range(rnd.choice([0, 1, 40, 900, 20000])))) for i in range(60)] + [(77, None)]
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    cover = {i: [] for i in ids}
    for r in packing.pack(docs_of(spark, rows), tokenizer_path(), 2048).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        cover[r.doc_id] += range(r.start, r.start + r.length)
    assert all(sorted(c) == list(range(len(ids[i]))) for i, c in cover.items())


def test_fingerprints_equal_brute_force(spark):
    import random

    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(8)]
    rows = [(10 * i + k, t if k == 0 else t.replace("w1 ", f"v{k} ", 1)) for i, t in enumerate(texts) for k in range(3)] + [(999, texts[0]), (1000, None), (1001, "")]
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_edits(docs_of(spark, rows)).collect()}
    order = sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    edited = {}
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        half = len(text[a]) // 2
        edited[a] = text[a][: len(text[a]) - half] + text[b][:half]
        assert got[a].edited_sha256 == hashlib.sha256(edited[a].encode()).hexdigest() and got[a].next_fp == got[b].fp
    plain = fingerprints.simhash(docs_of(spark, [(i, edited[i]) for i in order]).select("doc_id", "text"), ["doc_id"]).collect()
    assert {r.doc_id: r.fp for r in plain} == {i: got[i].edited_fp for i in order}
    fps = {i: got[i].fp & (1 << 64) - 1 for i in order}
    lead = {i: i for i in order}
    for _ in order:
        lead = {x: min(lead[y] for y in order if (fps[x] ^ fps[y]).bit_count() <= 2) for x in order}
    assert {i: got[i].class_id for i in order} == lead


def test_edited_benchmark_copies_equal_brute_force(spark):
    """Copies with words replaced, put in and left out, of items short and long, the long one with six words replaced."""
    import random
    from collections import Counter

    rnd = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "rt", "lm", "st", "x")]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(n))) for i, n in enumerate((15, 25, 40, 59, 150, 420))]
    docs = []
    for d in range(120):
        _, text = items[d % len(items)]
        w = text.split()
        for _ in range(rnd.randint(0, max(1, len(w) // 60))):
            k = rnd.randrange(len(w))
            w[k : k + 1] = [[rnd.choice(vocabulary)], [], [w[k], rnd.choice(vocabulary)]][rnd.randrange(3)]
        docs.append((d, " ".join([rnd.choice(vocabulary) for _ in range(30)] + w + [rnd.choice(vocabulary) for _ in range(20)])))
    long = items[-1][1].split()
    for k in range(6):
        long[35 + 70 * k] = "replaced"
    docs.append((500, " ".join(["lead"] * 9 + long + ["tail"] * 9)))

    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    expected = set()
    for d, t in docs:
        words = t.split()
        for i, text in items:
            item, n = shingles(text.split()), len(text.split())
            if any(5 * sum((s & item).values()) >= 4 * sum((s | item).values()) for s in (shingles(words[k : k + n]) for k in range(len(words)))):
                expected.add((d, i))
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == expected and (500, 5) in found and len(found) > 60


def test_quality_shrinks_sparse_sites(spark):
    """Equal texts: the site decides, and a site of one label less than one of many."""
    rows, labels = [], []
    for i in range(400):
        good = i % 2 == 0
        words = "clear useful guide to the tools" if good else "click buy cheap pills now now"
        rows.append((i, f"{words} {i} " * 6, "en", "good.site" if good else "bad.site", 100, 7, 7, "x"))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, t, "en", s, 1, 7, 7, "x") for i, (t, s) in enumerate((("neutral words", "good.site"), ("neutral words", "bad.site"), ("neutral words", "new.site"), (None, None)))]
    docs = spark.createDataFrame(rows, DOCS)
    told = {r.doc_id: r for r in quality.classify(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=quality.SAMPLE)).collect()}
    assert told[1000].p_low < told[1002].p_low < told[1001].p_low and len(told) == len(rows)
    assert sum((told[i].p_low < 0.5) == (i % 2 == 0) for i in range(400)) >= 396

"""Stages of the corpus pipeline on planted documents, each held against a plain version on what the stage before gave."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gapwright.llm._workspace import materialise
from gapwright.llm import _kernels as K
from gapwright.llm.queries_text import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "seven brave sailors crossed the frozen harbour before dawn carrying lanterns and bread for the hungry"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Good prose, bad documents, shared lines, near and exact copies, benchmark passages and a text of many sequences."""
    rnd, at = random.Random(3), tmp_path_factory.mktemp("planted")
    words = [f"{a}{b}" for a in ("river", "stone", "field", "cloud", "grain", "tower") for b in ("s", "en", "ly", "ish", "er", "ward", "less", "ing")]
    texts = ["\n".join(" ".join(rnd.choice(words) for _ in range(rnd.choice([2, 9, 30]))) for _ in range(4)) for _ in range(60)]
    texts[7] += "\nread more\n" + texts[3].split("\n")[1]
    texts[8] += "\nRead MORE\n"
    texts[20] = texts[19]
    base = " ".join(rnd.choice(words) for _ in range(700)).split()
    texts[21], texts[22] = " ".join(base), " ".join(base[:1] + [w for x in base[1:] for w in (x, x)][:900])
    texts[30], texts[31] = f"{texts[30]} {ITEM}", f"{ITEM.title()}! {texts[31]}"
    texts[32] = f"{texts[32]} {ITEM.replace('seven', 'eight')}"
    texts[42] = " ".join(words * 120)
    bad = {i for i in range(60) if i % 3 == 0 and i not in (21, 30, 42)}
    texts = [("buy cheap pills now click here winner " * 3 + str(i)) if i in bad else t for i, t in enumerate(texts)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), bad


def plain_lines(rows):
    sets, out = [], {}
    for d in sorted(rows):
        kept = []
        for line in (rows[d].text or "").split("\n"):
            words = set(line.lower().split())
            if not words or not any(5 * len(words & y) >= 4 * len(words | y) for y in sets):
                kept.append(line)
            if words:
                sets.append(words)
        text = rows[d].text if rows[d].text is None else "\n".join(kept)
        out[d] = (text, rows[d].n_chars if text == rows[d].text else len(text))
    return out


def plain_print(text):
    words = (text or "").lower().split()
    shingles = [" ".join(words[i : i + 3]).encode() for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [int(K.xxh64(np.frombuffer(s + bytes(8), np.uint8), np.array([0]), np.array([len(s)]))[0]) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_first_of_class(rows):
    prints = {d: plain_print(r.text) for d, r in rows.items()}
    lead = {d: d for d in rows}
    for _ in rows:
        lead = {x: min(lead[y] for y in rows if (prints[x] ^ prints[y]).bit_count() <= 2) for x in rows}
    return {d for d in rows if lead[d] == d}


def plain_clean(rows):
    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    item, clean = ITEM.split(), set()
    for d, r in rows.items():
        words = re.findall(r"[a-z0-9]+", (r.text or "").lower())
        near = (shingles(words[i : i + len(item)]) for i in range(len(words)))
        if not any(5 * sum((w & shingles(item)).values()) >= 4 * sum((w | shingles(item)).values()) for w in near):
            clean.add(d)
    return clean


def test_stages_equal_plain_versions(spark, planted):
    import tokenizers

    sf_dir, bad = planted
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "line_dedup":
            assert {d: (r.text, r.n_chars) for d, r in after.items()} == plain_lines(before)
            assert any(after[d].text != before[d].text for d in after)
        else:
            expected = {"quality_classifier": lambda b: set(b) - bad, "simhash_dedup": plain_first_of_class, "benchmark_decontamination": plain_clean}[name](before)
            assert set(after) == expected and len(after) < len(before), name
            assert all(after[d] == before[d] for d in after), name
        seen.append(name)
        before = after
    name, stage = corpus_pipeline.STAGES[-1]
    assert [*seen, name] == ["quality_classifier", "line_dedup", "simhash_dedup", "benchmark_decontamination", "packing"]
    model = tokenizers.Tokenizer.from_file(tokenizer_path())
    counts = {d: len(model.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in before.items()}  # and the end id
    pieces = stage(spark, docs, sf_dir).collect()
    for d, n in counts.items():
        own = sorted((r.start, r.length) for r in pieces if r.doc_id == d)
        assert sum(k for _, k in own) == n, d
        assert all(s + k == t for (s, k), (t, _) in zip(own, own[1:], strict=False)), d
    used = {}
    for r in pieces:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(k for _, k in x) <= 2048 and all(o + k == p for (o, k), (p, _) in zip(sorted(x), sorted(x)[1:], strict=False)) for x in used.values())

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in whole) == sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in pieces)

"""The paths that large inputs take, sent through with small numbers and held against plain versions."""

import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapwright.llm import fingerprints, language, packing, simhash_dedup, warc
from gapwright.llm._workspace import new_path
from gapwright.llm.queries_text import tokenizer_path

DOCS = "doc_id long, text string"


def _plain_components(fps, radius):
    lead = {x: x for x in fps}
    for _ in fps:
        now = {x: min(lead[y] for y in fps if (x ^ y).bit_count() <= radius) for x in fps}
        if now == lead:
            break
        lead = now
    return lead


def _near(seed, n, bits):
    rnd = random.Random(seed)
    stems = [rnd.getrandbits(62) for _ in range(4)]
    return sorted({rnd.choice(stems) ^ sum({1 << rnd.randrange(62) for _ in range(rnd.randrange(bits))}) for _ in range(n)})


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_crowded_keys_link_through_points(spark, radius):
    fps = _near(radius, 150, 5)
    got = {r.node: r.component for r in simhash_dedup.fingerprint_components(spark.createDataFrame([(x,) for x in fps], "fp long"), radius, pairwise=3).collect()}
    expected = _plain_components(fps, radius)
    alike = {x for x in fps if sum((x ^ y).bit_count() <= radius for y in fps) > 1}
    assert alike and {x: got.get(x, x) for x in fps} == expected and set(got) == alike


def test_link_batches_do_not_depend_on_batch_borders():
    rnd = random.Random(1)
    keys = sorted(rnd.randrange(40) for _ in range(600))
    rows = [(k, x) for k, x in zip(keys, (rnd.getrandbits(4) for _ in keys), strict=True)]

    def outcome(size):
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + size]]), pa.array([x for _, x in rows[i : i + size]]), pa.array([True] * len(rows[i : i + size]))], names=["key", "fp", "own"]) for i in range(0, len(rows), size)]
        return {tuple(r.values()) for b in simhash_dedup.link_batches(2, 15)(iter(batches)) for r in b.to_pylist()}

    sizes = {k: keys.count(k) for k in keys}
    crowd = {(x, None) for k, x in rows if sizes[k] > 15}
    pairs = {(max(x, y), min(x, y)) for k, x in rows for j, y in rows if k == j and sizes[k] <= 15 and 0 < (x ^ y).bit_count() <= 2}
    assert crowd and pairs and all(outcome(size) == crowd | pairs for size in (1, 7, 16, 1000))
    assert not list(simhash_dedup.link_batches(2)(iter([])))


def test_documents_follow_one_another_whatever_the_ids(spark):
    """Ids far away, below zero, repeated and null."""
    rnd = random.Random(4)
    ids = [*rnd.sample(range(5000), 700), -(1 << 62), 1 << 62, -3, 17, 17, 17]
    rows = [(i, f"text {n} of {i}") for n, i in enumerate(ids)] + [(None, "b"), (None, "a")]
    got = fingerprints.with_next(spark.createDataFrame(rows, DOCS), rows=2).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    after = {row: order[(i + 1) % len(order)] for i, row in enumerate(order)}
    assert len(got) == len(rows) and {(r.doc_id, r.text): (r.next_id, r.next_text) for r in got} == after
    tops = spark.createDataFrame([(x,) for x in sorted({i // 5 for i in ids[:700]})], "rng long")
    turns = {r.rng: r.after_rng for r in fingerprints._turns(tops, fan=7).collect()}
    known = sorted(turns, reverse=True)
    assert turns == {x: known[(i + 1) % len(known)] for i, x in enumerate(known)}


def test_ranges_hold_few_documents_beside_far_ids(spark):
    rows = [(i, "x") for i in range(6000)] + [(1 << 62, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    most = docs.groupBy(fingerprints._ranged(docs, "doc_id", 50).alias("r")).count().agg(F.max("count")).first()[0]
    assert most <= 100


def test_next_fingerprint_is_that_of_the_very_row(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "one two three four five"), (2, "some other words here"), (3, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.edited_sha256): r for r in fingerprints.fingerprint_with_edits(docs).collect()}
    plain = {r.text: r.fp for r in fingerprints.simhash(docs.where("text is not null"), ["text"]).collect()}
    for (i, text), (_, after) in {(2, rows[2][1]): rows[1], (1, rows[1][1]): rows[0]}.items():
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i, hashlib.sha256(edited.encode()).hexdigest()].next_fp == plain[after]


def _record(kind, name, block, more=""):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_streamed_archives_equal_whole_ones(spark, tmp_path):
    """Blocks with blank lines at any place, empty ones and bytes that are no text; files of several gzip members."""
    rnd = random.Random(8)
    blocks = [b"", b"\r\n", b"\r\n\r\n", b"a\r\n\r\n\r\nb\r\n", b"\r\n\r\r\n\r\n\r\n", b"\xff\xfe\x00", b"WARC/1.1\r\n\r\n"]
    blocks += [b"".join(rnd.choice([b"\r", b"\n", b"\r\n", b"\r\n\r\n", b"x", b"\x80"]) for _ in range(rnd.randrange(60))) for _ in range(120)]
    blocks += [bytes(np.random.default_rng(1).choice([13, 10, 65], 300_000).astype(np.uint8))]
    archive = [_record("resource", f"urn:r:{i}", b) for i, b in enumerate(blocks)]
    assert [b for _, b in warc.parse_lines(iter(b"".join(archive).split(b"\r\n\r\n")))] == blocks
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in archive))
    (tmp_path / "b.warc").write_bytes(b"".join(archive))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(archive).rstrip(b"\r\n") if blocks[-1][-1] == 65 else b"".join(archive)))
    got = warc.read_segments(spark, str(tmp_path)).collect()
    assert sorted((r.origin, bytes(r.block)) for r in got) == sorted((f"urn:r:{i}", b) for i, b in enumerate(blocks) for _ in range(3))


def test_broken_archives_are_refused():
    whole = _record("resource", "urn:r", b"abc\r\n\r\ndef")
    for broken in (whole[:-8], b"junk\r\n\r\n" + whole, whole[:-4].replace(b"Length: 10", b"Length: 40")):
        with pytest.raises(ValueError):
            list(warc.parse_lines(iter(broken.split(b"\r\n\r\n"))))


def test_empty_tables_and_names_that_clash(spark):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>x</p>", "q", 1), (1, "http://a/1", "<p>x</p>", "q", 1), (None, None, "y" * 200, "q", 2), (4, "u", "y" * 200, None, 3)], "page_id long, url string, html string, digest string, n int")
    for table, n in ((pages, 4), (pages.limit(0), 0)):
        path = new_path(spark, "warc-odd")
        warc.write_warc(table, path)
        found = warc.read_warc(spark, path).collect()
        assert len(found) == n and all(r.problem is None for r in found)


def test_many_null_ids_follow_one_another_in_ranges(spark):
    rows = [(None, f"text {n}") for n in range(60)] + [(None, None), (3, "c"), (5, "e")]
    docs = spark.createDataFrame(rows, DOCS)
    assert docs.groupBy(fingerprints._ranged(docs, "doc_id", 2)).count().count() > 10
    after = {(r.doc_id, r.text): (r.next_id, r.next_text) for r in fingerprints.with_next(docs, rows=2).collect()}
    assert len(after) == 63 and after[5, "e"] == (3, "c") and after[3, "c"][0] is None
    at, seen = (5, "e"), []
    while at not in seen:
        seen.append(at)
        at = after[at]
    assert at == (5, "e") and len(seen) == 63
    alone = spark.createDataFrame(rows[:9], DOCS)
    assert {r.next_text for r in fingerprints.with_next(alone, rows=2).collect()} == {t for _, t in rows[:9]}


def test_sequences_of_large_capacities_do_not_mix(spark):
    """Classes of very short pieces need more bits of the sequence id than those of 2,048 tokens."""
    docs = spark.createDataFrame([(i, "" if i % 2 else "some words of a text " * (i % 900)) for i in range(20000)], DOCS).repartition(3)
    used = {}
    for r in packing.pack(docs, tokenizer_path(), capacity=8192).select("sequence_id", "offset", "length").collect():
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(k for _, k in x) <= 8192 and all(o + k == p for (o, k), (p, _) in zip(sorted(x), sorted(x)[1:], strict=False)) for x in used.values())


def test_too_many_languages_are_refused(spark):
    docs = spark.createDataFrame([(f"some text {i}", f"l{i}") for i in range(language.MOST_LANGUAGES + 1)], "text string, lang string")
    with pytest.raises(ValueError):
        language.fit(docs)

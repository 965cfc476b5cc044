"""Harmonic packing of tokenised documents into sequences of fixed capacity (operator 4).

A piece of length n belongs to class k = capacity // n, the reciprocal classes of the harmonic algorithm; k pieces of
class k always fit in a sequence, so every worker fills its bins by counting to k, without looking at other workers.
A document is cut where that saves padding: into whole sequences, and its rest at the next reciprocal length if k of
them would leave more than SLACK of a sequence empty. Bins that a worker can't fill are merged over groups of FAN
workers, then over groups of groups; what no class can fill in the end (fewer than k pieces a class, a bound that
doesn't depend on the input) is packed best fit, longest first, in one task.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._workspace import materialise

CAPACITY = 2048
END = 1
#: A sequence of pieces of one class may leave this share empty before a piece is cut further.
SLACK = 0.02
#: From this class on pieces stay whole: their sequences are filled to WHOLE / (WHOLE + 1) at least.
WHOLE = 24
#: Workers whose unfilled bins meet in one group of the merge.
FAN = 256


@lru_cache(maxsize=2)
def _encoder(path: str):
    """text -> ids of the byte-level BPE file of the tokenizers library.

    Where the file's merges have their ids' order, tiktoken gives the same ids at four times the speed; else the
    library itself is used.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    ids = [vocab[x] for x in joined]
    if ids != sorted(ids) or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("add_prefix_space"):
        slow = Tokenizer.from_file(path)
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    allowed = set(added)
    return lambda text: np.array(fast.encode(text, allowed_special=allowed), np.uint32)


def cut_lengths(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces in order."""
    out, rest = [capacity] * (tokens // capacity), tokens % capacity
    while rest:
        k = capacity // rest
        if k >= WHOLE or k * rest >= (1 - SLACK) * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def piece_batches(path: str, id_col: str, text_col: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cuts, worker, count = _encoder(path), lru_cache(maxsize=1 << 16)(cut_lengths), TaskContext.get().partitionId(), 0
        for batch in batches:
            own, texts = batch.column(id_col), batch.column(text_col)
            for at in range(0, batch.num_rows, 500):
                index, start, length, crc, total, ids_out = [], [], [], [], [], []
                for i in range(at, min(at + 500, batch.num_rows)):
                    ids = np.append(encode(texts[i].as_py() or ""), np.uint32(END)).astype("<u4")
                    pos = 0
                    for n in cuts(len(ids), capacity):
                        part = ids[pos : pos + n]
                        index.append(i)
                        start.append(pos)
                        length.append(n)
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(ids))
                        if keep_ids:
                            ids_out.append(part.astype(np.int32))
                        pos += n
                n = len(index)
                k = capacity // np.array(length, np.int64)
                arrays = [own.take(pa.array(index, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, k, np.full(n, worker), np.arange(count, count + n)))]
                count += n
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "k", "worker", "ord"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _best_fit(capacity: int, first: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "worker", "ord"], ascending=[False, True, True], ignore_index=True)
        room: list[tuple[int, int]] = []
        used: list[int] = []
        where, offset = [], []
        for n in pdf["length"]:
            at = bisect.bisect_left(room, (n, -1))
            if at < len(room):
                _, b = room.pop(at)
            else:
                b = len(used)
                used.append(0)
            where.append(b)
            offset.append(used[b])
            used[b] += n
            if used[b] < capacity:
                bisect.insort(room, (capacity - used[b], b))
        return pdf[["worker", "ord"]].assign(sequence_id=np.array(where, np.int64) + first, offset=np.array(offset, np.int64))

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of all documents.

    Null and empty texts are one piece, the end id. Repeated rows and null ids are packed as they are. Other columns
    are not read. An empty table gives no rows. Sequence ids are unique, not gapless. The pieces are written to the
    shared folder once; where they go follows from that table alone, so a repeated task changes nothing.
    """
    if not 1 <= capacity < 1 << 20:
        raise ValueError("capacity must be from 1 to 2^20 - 1")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, k long, worker long, ord long" + ", ids array<int>" * keep_ids
    pieces = materialise(docs.select(id_col, text_col).mapInArrow(piece_batches(tokenizer_path, id_col, text_col, capacity, keep_ids), schema), "pieces")
    columns = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    slim = [c for c in pieces.columns if c != "ids"]
    whole = pieces.where("k = 1").withColumn("sequence_id", _sequence(capacity, 0, F.lit(1), F.col("worker"), F.col("ord"))).withColumn("offset", F.lit(0).cast("long"))
    out, left = [whole.select("worker", "ord", "sequence_id", "offset")], pieces.where("k > 1").select(*slim).withColumn("grp", F.col("worker"))
    last, most = pieces.agg(F.max("worker"), F.max("ord")).first()
    workers, level = (last or 0) + 1, 0
    if workers > 1 << (36 - capacity.bit_length()) or (most or 0) >= 1 << 24:
        raise ValueError("a sequence id has no room for so many tasks, or so many pieces of a task")
    while True:
        by = Window.partitionBy("k", "grp")
        ranked = left.withColumn("bin", F.expr("(row_number() over (partition by k, grp order by worker, ord) - 1) div k")).withColumn("full", F.col("bin") < F.expr("(count(*) over (partition by k, grp)) div k"))
        in_bin = by.partitionBy("k", "grp", "bin").orderBy("worker", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        done = ranked.where("full").withColumn("offset", F.sum("length").over(in_bin) - F.col("length")).withColumn("sequence_id", _sequence(capacity, level, F.col("k"), F.col("grp"), F.col("bin")))
        out.append(done.select("worker", "ord", "sequence_id", "offset"))
        left = ranked.where(~F.col("full")).drop("bin", "full")
        if workers == 1:
            break
        left = materialise(left.withColumn("grp", F.expr(f"grp div {FAN}")), "unfilled")
        workers, level = -(-workers // FAN), level + 1
    rest = left.select("worker", "ord", "length").groupBy().applyInPandas(_best_fit(capacity, 7 << 60), "worker long, ord long, sequence_id long, offset long")
    placed = out[0]
    for x in (*out[1:], rest):
        placed = placed.unionByName(x)
    return pieces.drop("k").join(placed, ["worker", "ord"]).select(*columns)


def _sequence(capacity: int, level: int, k, group, number):
    """level (3 bits) | class (as many as the capacity has) | worker group (36 less these) | bin (24)."""
    return F.lit(level).cast("long") * (1 << 60) + k * (1 << (60 - capacity.bit_length())) + group * (1 << 24) + number


def assemble(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids ARRAY<INT>, length): the sequences of pack(keep_ids=True); a sequence bounds every group."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"), F.sum("length").alias("length"))

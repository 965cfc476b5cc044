"""Removal of repeated and nearly repeated lines by an exact set-similarity join (operator 2).

Two lines match if the Jaccard similarity of their sets of words is at least 0.8. Lines with equal sets collapse to
their first occurrence, short ones included. The distinct sets then meet as in prefix-filter joins: words are ordered from
rare to frequent, a set's rarest words form its prefix, and only sets that share a prefix word, fit in length, can still
reach the overlap from their positions and whose parity sketches allow it are verified, on the words of the whole lines.

Rarity comes from counts of all words in a table of fixed size; words of one bucket are ordered by hash, so the order is
total and the join exact whatever collides. Under a frequent word sets meet by their first two common words instead: after
the first at position i the second stands at n - o + 1 at the latest, o being the overlap that the similarity asks for.
Prefixes travel as packed columns, a blob for each task and part of the words, and no text goes with them.

Where many sets under one word may match, each meets its closest few first. Only those that these do not match meet all
others, in a second pass over the words in question.

To verify, texts are read again and only the lines in question travel: a filter of bits, which grows with their number, lets
them pass and few others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._workspace import free_shuffles, materialise, release

#: Similarity in fractions, for exact integer arithmetic: numerator and denominator.
NUM, DEN = 4, 5
#: Lines of fewer words, blank ones, stay.
LEAST_WORDS = 1
#: Sets of fewer words are similar to equal ones only, as n / (n + 1) is below the similarity: they are not joined.
JOINED_WORDS = -(-NUM // (DEN - NUM))
#: Buckets of the table of word counts (its bytes are four times that), and of one of its rows.
BUCKETS, ROW = 1 << 20, 1 << 12
#: Above so many sets under one word, sets are compared in steps of STEP; one that MANY may match meets the CLOSEST first.
CROWD, STEP, MANY, CLOSEST = 64, 512, 32, 8
#: Words counted as often as this meet others with a second word. Classes of rarity are half powers of two.
FREQUENT = 2 * 14
#: Bits of a word's hash; lines of a chunk have the rest of 64.
WORD_BITS = 52
MOST_ROWS = (1 << (64 - WORD_BITS)) - 2
#: Prefix words that a mapper packs at a time, and least parts that words are dealt into.
FLUSH, PARTS = 1 << 20, 512
#: Sets of so many words or more have sketches of 128 bits that count, others of 64.
WIDE = 64
#: Bits of the filter for a line in question, of one of its blocks, and of the whole at most (32 MB: beyond, more lines pass).
FILTER_BITS, BLOCK_BITS, MOST_FILTER = 8, 1 << 12, 1 << 28
_U = np.uint64
_CODEC = "zstd"


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def _line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of all lines (a line takes its newline with it), and row and number (from 0) of each."""
    cuts = np.flatnonzero(data == 10)
    rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cuts, "right") - 1])
    starts = np.concatenate([offsets[:-1], cuts + 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    return np.append(starts, offsets[-1]), rows, np.arange(len(rows)) - np.searchsorted(rows, rows)


def word_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct words (as WORD_BITS of hash) of each row, and row pointers; of MOST_ROWS rows at most.

    Words are runs without ASCII white space, A-Z in lower case.
    """
    starts, ends, rows = K.spans(data, offsets, K.SPACES)
    h = K.span_hash(K.LOWER[data], starts, ends) >> _U(64 - WORD_BITS)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64).astype(_U), rows[1:] - rows[:-1])
    key = np.sort((row << _U(WORD_BITS)) | h)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return key & _mask(WORD_BITS), np.searchsorted(key, np.arange(len(offsets)).astype(_U) << _U(WORD_BITS))


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in K.chunks(offsets):
        for k in range(i, j, MOST_ROWS):
            yield k, min(k + MOST_ROWS, j)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of all words in BUCKETS buckets; BUCKETS / ROW rows of fixed size reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for i, j in K.chunks(offsets):
                low = K.LOWER[data[offsets[i] : offsets[j]]]
                starts, ends, _ = K.spans(low, offsets[i : j + 1] - offsets[i], K.SPACES)
                h = K.span_hash(low, starts, ends) >> _U(64 - WORD_BITS)
                total += np.bincount((h & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        parts = np.minimum(total, 2**32 - 1).astype("<u4").reshape(-1, ROW)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["k", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("counts"), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(v.as_py(), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in sums.values()], pa.binary())], names=["k", "counts"])

    out = np.zeros((BUCKETS // ROW, ROW), np.uint32)
    source = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for k, v in source.mapInArrow(count, "k long, counts binary").repartition("k").mapInArrow(add, "k long, counts binary").collect():
        out[k] = np.frombuffer(v, "<u4")
    return out.ravel()


def _probe(n: np.ndarray) -> np.ndarray:
    """Words of the prefix: a set of n loses at most n - ceil(s n) words to a similar one."""
    return n - (-(-NUM * n // DEN)) + 1


def _index(n: np.ndarray) -> np.ndarray:
    """Words of the prefix that the smaller of two sets needs: n - ceil(2 s / (1 + s) n) + 1."""
    return n - (-(-2 * NUM * n // (NUM + DEN))) + 1


def _least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Fewest common words of similar sets of n and m: ceil(s / (1 + s) (n + m))."""
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_cells(h: np.ndarray, ptr: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, row, position) of the prefixes of sets of words h[ptr[i]:ptr[i + 1]]; sets below JOINED_WORDS have none.

    A cell is a prefix word or, where that is frequent, the word and one that follows; position is the first word's.
    """
    n = ptr[1:] - ptr[:-1]
    row = np.repeat(np.arange(len(n)), n)
    rare = rarity[(h & _U(BUCKETS - 1)).astype(np.int64)].astype(_U)
    word = np.sort((row.astype(_U) << _U(WORD_BITS)) | (rare << _U(WORD_BITS - 6)) | (h >> _U(6))) & _mask(WORD_BITS)
    pos = np.arange(len(h)) - np.repeat(ptr[:-1], n)
    last = np.repeat(np.where(n >= JOINED_WORDS, _probe(n), 0), n)  # words of the prefix
    at = np.flatnonzero(pos < last)
    often = (word[at] >> _U(WORD_BITS - 6)) >= _U(FREQUENT)
    one, two = at[~often], at[often]
    follow = last[two] - pos[two]
    first = np.repeat(two, follow)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(follow) - follow, follow)
    with np.errstate(over="ignore"):
        cell = np.concatenate([K.mix(word[one]), K.mix(K.mix(word[first]) + word[second] * K.P1)])
    where = np.concatenate([one, first])
    return cell, row[where], pos[where]


def sketches(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parities of each set: a bit is set where an odd number of its words have it; of small sets 64, and 0."""
    n = ptr[1:] - ptr[:-1]
    low, high = np.zeros(len(n), _U), np.zeros(len(n), _U)
    full = np.flatnonzero(n)
    if len(full):
        bit, side = _U(1) << ((h >> _U(20)) & _U(63)), (h >> _U(26)) & _U(1)
        low[full] = np.bitwise_xor.reduceat(np.where(side == 0, bit, _U(0)), ptr[:-1][full])
        high[full] = np.bitwise_xor.reduceat(np.where(side == 1, bit, _U(0)), ptr[:-1][full])
    small = n < WIDE
    return np.where(small, low ^ high, low), np.where(small, _U(0), high)


def _differ(low: np.ndarray, high: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least words that only one of two sets has: each bit that differs takes one."""
    a, b = low[x] ^ low[y], high[x] ^ high[y]
    wide = (n[x] >= WIDE) & (n[y] >= WIDE)
    return np.where(wide, np.bitwise_count(a) + np.bitwise_count(b), np.bitwise_count(a ^ b)).astype(np.int64)


def _pack(part: np.ndarray, kind: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A row (part, kind, size, body) for each part: its rows of the columns as one compressed record batch."""
    order = np.argsort(part, kind="stable")
    table = pa.RecordBatch.from_arrays([c.take(pa.array(order)) for c in columns.values()], names=list(columns))
    cut = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(part) else np.zeros(0, np.int64)
    bodies, sizes = [], []
    for a, b in zip(cut, np.append(cut[1:], len(part))[: len(cut)], strict=True):
        raw = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, b - a)]) for c in table.columns], names=table.schema.names).serialize()
        sizes.append(raw.size)
        bodies.append(pa.compress(raw, _CODEC, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(part[order][cut].astype(np.int64)), pa.array(np.full(len(cut), kind, np.int64)), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], names=["part", "kind", "size", "body"])


_PACKED = "part long, kind long, size long, body binary"
_KEYS, _CELLS, _GONE, _OPEN = range(4)


def _schema(kind: int, id_type: pa.DataType) -> pa.Schema:
    own = [("id", id_type), ("line", pa.int64())]
    return pa.schema({_KEYS: [("sid", pa.uint64()), *own], _CELLS: [("cell", pa.uint32()), *own, ("n", pa.int32()), ("pos", pa.int32()), ("low", pa.uint64()), ("high", pa.uint64()), ("tag", pa.uint32()), ("mark", pa.uint8())], _GONE: own, _OPEN: [("cell", pa.uint32()), *own]}[kind])


def _place(cell: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of a cell and the bits that tell it from others there."""
    return ((cell >> _U(32)) % _U(parts)).astype(np.int64), (cell & _mask(32)).astype(np.uint32)


def _later_copies(sid: np.ndarray, ids: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first row of each sid by id and line, and of the rest."""
    order = np.lexsort((line, ids, sid))
    first = np.append(True, sid[order][1:] != sid[order][:-1])[: len(order)]
    return order[first], order[~first]


def packed_lines(docs: DataFrame, id_col: str, text_col: str, rarity: np.ndarray, parts: int) -> DataFrame:
    """(part, kind, size, body): set keys of the lines that a task has not seen, later copies of others, and prefix cells."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(np.log2(rarity.astype(float) + 1) * 2, 63).astype(np.uint8))  # BUCKETS bytes

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, line, sid, n, low, high, cell, row, pos = (pa.chunked_array([h[k] for h in held]).combine_chunks() if k == 0 else np.concatenate([h[k] for h in held]) for k in range(9))
        place = lambda at: {"id": ids.take(pa.array(at)), "line": pa.array(line[at])}
        first, later = _later_copies(sid, ids.to_numpy(zero_copy_only=False), line)
        if len(later):
            yield _pack(np.full(len(later), int(sid[later[0]] % _U(parts))), _GONE, place(later))
        yield _pack((sid[first] % _U(parts)).astype(np.int64), _KEYS, {"sid": pa.array(sid[first]), **place(first)})
        keep = np.zeros(len(line), bool)
        keep[first] = True
        use = keep[row]
        cell, row, pos = cell[use], row[use], pos[use]
        part, short = _place(cell, parts)
        order = np.argsort(short, kind="stable")
        part, short, row, pos = part[order], short[order], row[order], pos[order]
        yield _pack(part, _CELLS, {"cell": pa.array(short), **place(row), "n": pa.array(n[row].astype(np.int32)), "pos": pa.array(pos.astype(np.int32)), "low": pa.array(low[row]), "high": pa.array(high[row]), "tag": pa.array((sid[row] & _mask(32)).astype(np.uint32)), "mark": pa.array((sid[row] >> _U(56)).astype(np.uint8))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, held, rows, cells = shared.value, [], 0, 0
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            own = batch.column("id")
            for i, j in K.chunks(offsets):
                raw = data[offsets[i] : offsets[j]]
                bounds, doc, number = _line_bounds(raw, offsets[i : j + 1] - offsets[i])
                for a in range(0, len(doc), MOST_ROWS):
                    b = min(a + MOST_ROWS, len(doc))
                    h, ptr = word_sets(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                    n = ptr[1:] - ptr[:-1]
                    sid = K.mix(K.segment_sums(K.mix(h), ptr) ^ K.mix(n.astype(_U)))
                    low, high = sketches(h, ptr)
                    cell, row, pos = prefix_cells(h, ptr, scale)
                    at = np.flatnonzero(n >= LEAST_WORDS)
                    back = np.cumsum(n >= LEAST_WORDS) - 1 + rows
                    held.append((own.take(pa.array(doc[a:b][at] + i)), number[a:b][at], sid[at], n[at], low[at], high[at], cell, back[row], pos))
                    rows += len(at)
                    cells += len(cell)
                    if cells >= FLUSH or rows >= FLUSH:
                        yield from flush(held)
                        held, rows, cells = [], 0, 0
        if rows:
            yield from flush(held)

    return _texts(docs, id_col, text_col).mapInArrow(run, _PACKED)


def _may_match(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length, prefix and positional filter for a first common word at position i of a set of n and j of a set of m."""
    small_first = n <= m
    little, lot = np.minimum(n, m), np.maximum(n, m)
    in_index = np.where(small_first, i < _index(n), j < _index(m)) | ((n == m) & (j < _index(m)))
    return (DEN * little >= NUM * lot) & in_index & (np.minimum(n - i, m - j) >= _least_overlap(n, m))


_FOUND = ["xi", "xl", "yi", "yl", "part", "cell"]


class _Cells:
    """The sets of one part, sorted by cell, and the pairs of them that pass all filters."""

    def __init__(self, table: pa.Table):
        cell, low, high = (table.column(c).to_numpy() for c in ("cell", "low", "high"))
        with np.errstate(over="ignore"):
            order = np.argsort((cell.astype(_U) << _U(32)) | (K.mix(low + high * K.P1) >> _U(32)), kind="stable")
        self.cell, self.low, self.high = cell[order], low[order], high[order]
        self.ids_arrow = table.column("id").combine_chunks().take(pa.array(order))
        self.ids = self.ids_arrow.to_numpy(zero_copy_only=False)
        self.line, self.n, self.pos = (table.column(c).to_numpy()[order].astype(np.int64) for c in ("line", "n", "pos"))
        self._without_twins(*(table.column(c).to_numpy()[order] for c in ("tag", "mark")))

    def _without_twins(self, tag: np.ndarray, mark: np.ndarray) -> None:
        """Of neighbours under a cell that look alike the first by id and line stays. The others have equal sets, as 40 bits of
        hash, size, sketch and a prefix word agree, and are gone by their keys (similar sets agree so about once in 2^46)."""
        like = np.append(False, np.logical_and.reduce([c[1:] == c[:-1] for c in (self.cell, self.low, self.high, self.n, self.pos, tag, mark)]))[: len(self.cell)]
        run = np.cumsum(~like)
        at = np.flatnonzero(like | np.append(like[1:], False))
        at = at[np.lexsort((self.line[at], self.ids[at], run[at]))]
        lead = np.append(True, run[at][1:] != run[at][:-1])[: len(at)]
        here = np.ones(len(self.cell), bool)
        here[at[~lead]] = False
        self.at = np.flatnonzero(here)
        own = self.cell[self.at]
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
        self.heads, self.sizes = cut[:-1], np.diff(cut)

    def filtered(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that may match, and the least words by which they differ."""
        n, p = self.n, self.pos
        ok = _may_match(n[x], p[x], n[y], p[y])
        x, y = x[ok], y[ok]
        d = _differ(self.low, self.high, n, x, y)
        ok = d <= n[x] + n[y] - 2 * _least_overlap(n[x], n[y])
        return x[ok], y[ok], d[ok]

    def ordered(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x the later of each pair; rows of one place are no pair."""
        same = self.ids[x] == self.ids[y]
        swap = np.where(same, self.line[x] < self.line[y], self.ids[x] < self.ids[y]).astype(bool)
        other = ~(same & (self.line[x] == self.line[y])).astype(bool)
        return np.where(swap, y, x)[other], np.where(swap, x, y)[other]

    def small(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs under cells of CROWD sets or fewer."""
        for size in np.unique(self.sizes[(self.sizes > 1) & (self.sizes <= CROWD)]):
            at = self.heads[self.sizes == size]
            j, i = np.triu_indices(int(size), 1)
            step = max(1, 1_000_000 // len(i))
            for s in range(0, len(at), step):
                x, y, _ = self.filtered(self.at[(at[s : s + step, None] + i[None, :]).ravel()], self.at[(at[s : s + step, None] + j[None, :]).ravel()])
                yield self.ordered(x, y)

    def crowded(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs under larger cells, and the sets that more may match than are told."""
        none = np.zeros(0, np.int64)
        for head, size in zip(self.heads[self.sizes > CROWD], self.sizes[self.sizes > CROWD], strict=True):
            member = self.at[head : head + size]
            first = member[0]
            member = member[np.lexsort((self.line[member], self.ids[member]))]
            rank = np.zeros(int(member.max()) - first + 1, np.int64)
            rank[member - first] = np.arange(size)
            active, got = np.arange(1, size), [none, none, none]
            for b in range(0, size, STEP):
                earlier, told = np.arange(b, min(b + STEP, size)), [got]
                active = active[active > b]
                for s in range(0, len(active), 2048):
                    x, y = np.repeat(active[s : s + 2048], len(earlier)), np.tile(earlier, len(active[s : s + 2048]))
                    before = y < x
                    told.append(self.filtered(member[x[before]], member[y[before]]))
                got = [np.concatenate(v) for v in zip(*told, strict=True)]
                place = rank[got[0] - first]
                full = np.bincount(place, minlength=size) >= MANY
                done = full[place]
                if done.any():
                    x, y, d = (v[done] for v in got)
                    order = np.lexsort((y, d, x))
                    x, y = x[order], y[order]
                    nth = np.arange(len(x)) - np.searchsorted(x, x)
                    yield x[nth < CLOSEST], y[nth < CLOSEST], member[full]
                    got = [v[~done] for v in got]
                    active = active[~full[active]]
            yield got[0], got[1], none

    def of(self, cell: np.ndarray, ids: np.ndarray, line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of the open sets (cell, id, line) with others under the cell."""
        own = self.cell[self.at]
        for c in np.unique(cell):
            a, b = np.searchsorted(own, c, "left"), np.searchsorted(own, c, "right")
            group = self.at[a:b]
            mine = cell == c
            wanted = set(zip(ids[mine].tolist(), line[mine].tolist(), strict=True))
            opened = np.array([g for g in group.tolist() if (self.ids[g], self.line[g]) in wanted], np.int64)
            step = max(1, 1_000_000 // max(1, len(group)))
            for s in range(0, len(opened), step):
                x, y, _ = self.filtered(np.repeat(opened[s : s + step], len(group)), np.tile(group, len(opened[s : s + step])))
                yield self.ordered(x, y)


def found_pairs(packed: DataFrame, parts: int, kind: str, id_type: pa.DataType) -> DataFrame:
    """(xi, xl, yi, yl, part, cell) from packed_lines(): lines gone as copies (yi and cell null), pairs to verify, the later
    line first, and with a cell lines of which not all pairs under it are told."""

    def unpacked(rows: list[tuple], which: int) -> pa.Table:
        schema = _schema(which, id_type)
        batches = [pa.ipc.read_record_batch(pa.decompress(body, size, _CODEC), schema) for kind, size, body in rows if kind == which]
        return pa.Table.from_batches(batches, schema)

    def out(xi: pa.Array, xl, yi=None, yl=None, part=None, cell=None) -> pa.RecordBatch:
        m = len(xi)
        none = pa.nulls(m, pa.int64())
        columns = [xi, pa.array(xl), pa.nulls(m, id_type) if yi is None else yi, none if yl is None else pa.array(yl), none if part is None else pa.array(np.full(m, part)), none if cell is None else pa.array(cell.astype(np.int64))]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=_FOUND)

    def solve(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        gone, keys, opened = unpacked(rows, _GONE), unpacked(rows, _KEYS), unpacked(rows, _OPEN)
        if gone.num_rows:
            yield out(gone.column("id").combine_chunks(), gone.column("line").to_numpy())
        if keys.num_rows:
            ids, line = keys.column("id").combine_chunks(), keys.column("line").to_numpy()
            _, later = _later_copies(keys.column("sid").to_numpy(), ids.to_numpy(zero_copy_only=False), line)
            yield out(ids.take(pa.array(later)), line[later])
        table = unpacked(rows, _CELLS)
        if not table.num_rows:
            return
        cells = _Cells(table)
        pairs = lambda x, y: out(cells.ids_arrow.take(pa.array(x)), cells.line[x], cells.ids_arrow.take(pa.array(y)), cells.line[y])
        if opened.num_rows:
            for x, y in cells.of(opened.column("cell").to_numpy(), opened.column("id").combine_chunks().to_numpy(zero_copy_only=False), opened.column("line").to_numpy()):
                yield pairs(x, y)
            return
        if any(kind == _OPEN for kind, _, _ in rows):
            return
        for x, y in cells.small():
            yield pairs(x, y)
        for x, y, more in cells.crowded():
            yield pairs(*cells.ordered(x, y))
            yield out(cells.ids_arrow.take(pa.array(more)), cells.line[more], part=part, cell=cells.cell[more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for part, which, size, body in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "size", "body")), strict=True):
                if part != now and rows:
                    yield from solve(now, rows)
                    rows = []
                now = part
                rows.append((which, size, body))
        if rows:
            yield from solve(now, rows)

    count = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed.repartition(count, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, f"xi {kind}, xl long, yi {kind}, yl long, part long, cell long")


def _probes(row: np.ndarray, number: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and places of four bits (12 each) in the filter, from hashes of ids and line numbers."""
    key = K.mix(row.astype(np.int64).view(_U) ^ K.mix(number.astype(_U)))
    return (key % _U(blocks)).astype(np.int64), K.mix(key)


def line_filter(wanted: DataFrame, most: int) -> np.ndarray:
    """(blocks, BLOCK_BITS / 8) bytes: the filter of the lines of wanted(id, line_no), of which there are most at most."""
    blocks = max(1, min(MOST_FILTER, 1 << (most * FILTER_BITS).bit_length()) // BLOCK_BITS)

    def told(held: set[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], pa.int64()) for i in range(2)], names=["k", "bits"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[int, int]] = set()  # a line of many pairs goes once from a task
        for batch in batches:
            k, bits = _probes(batch.column("h").to_numpy(), batch.column("line_no").to_numpy(), blocks)
            held.update(zip(k.tolist(), bits.view(np.int64).tolist(), strict=True))
            if len(held) >= FLUSH:
                yield told(held)
                held = set()
        yield told(held)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            k, bits = batch.column("k").to_numpy(), batch.column("bits").to_numpy().view(_U)
            order = np.argsort(k, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(k[order])) + 1) if len(k) else []:
                block = own.setdefault(int(k[some[0]]), np.zeros(BLOCK_BITS, bool))
                for b in range(4):
                    block[(bits[some] >> _U(12 * b)) & _mask(12)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in own.values()], pa.binary())], names=["k", "bits"])

    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    hashed = wanted.select(F.xxhash64("id").alias("h"), F.col("line_no").cast("long").alias("line_no"))
    for k, v in hashed.mapInArrow(probe, "k long, bits long").repartition("k").mapInArrow(fill, "k long, bits binary").collect():
        out[k] = np.frombuffer(v, np.uint8)
    return out


def _lines_of(docs: DataFrame, wanted: DataFrame, most: int, id_col: str, text_col: str, kind: str) -> DataFrame:
    """(id, line_no, line) of the lines of wanted(id, line_no), and of a few others that the filter lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(line_filter(wanted, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            row = batch.column("h").to_numpy()
            for i, j in K.chunks(offsets):
                raw = data[offsets[i] : offsets[j]]
                bounds, doc, number = _line_bounds(raw, offsets[i : j + 1] - offsets[i])
                k, probe = _probes(row[doc + i], number, len(bits))
                at = np.arange(len(doc))
                for b in range(4):
                    p = (probe[at] >> _U(12 * b)) & _mask(12)
                    at = at[(bits[k[at], p >> _U(3)] >> (p & _U(7)).astype(np.uint8)) & 1 == 1]
                lines = pa.Array.from_buffers(pa.large_string(), len(doc), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc[at] + i)), pa.array(number[at]), lines.cast(pa.string())], names=["id", "line_no", "line"])

    read = _texts(docs, id_col, text_col).withColumn("h", F.xxhash64("id"))
    return read.mapInArrow(run, f"id {kind}, line_no long, line string")


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, line_no): the first of the pairs (xi, xl, yi, yl) whose lines have the similarity; whole lines are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                a, b = (set(t.encode().lower().split()) for t in (x, y))  # of bytes: ASCII case and white space only
                both = len(a & b)
                if DEN * both >= NUM * (len(a) + len(b) - both):
                    good.append(k)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("xi").take(at), batch.column("xl").take(at)], names=["id", "line_no"])

    kind = pairs.schema["xi"].dataType.simpleString()
    left = lines.select(F.col("id").alias("xi"), F.col("line_no").alias("xl"), F.col("line").alias("x"))
    right = lines.select(F.col("id").alias("yi"), F.col("line_no").alias("yl"), F.col("line").alias("y"))
    met = pairs.join(left, ["xi", "xl"]).join(right, ["yi", "yl"]).select("xi", "xl", "x", "y")
    return met.mapInArrow(run, f"id {kind}, line_no long").distinct()


def _matched(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """The lines of the verified pairs of found, written."""
    pairs = materialise(found.where("yi is not null").select("xi", "xl", "yi", "yl").distinct(), "line-pairs")
    each = pairs.select(F.col("xi").alias("id"), F.col("xl").alias("line_no")).unionAll(pairs.select("yi", "yl"))
    lines = materialise(_lines_of(docs, each, 2 * pairs.count(), id_col, text_col, kind), "pair-lines")
    out = materialise(verified(pairs, lines), "matched-lines")
    release(pairs, lines)
    return out


def _opened(open_cells: DataFrame, id_type: pa.DataType) -> DataFrame:
    """Rows (xi, xl, part, cell) in the form of packed_lines()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _pack(batch.column("part").to_numpy(), _OPEN, {"cell": pa.array(batch.column("cell").to_numpy().astype(np.uint32)), "id": batch.column("xi").cast(id_type), "line": batch.column("xl")})

    return open_cells.select("xi", "xl", "part", "cell").mapInArrow(run, _PACKED)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no): the lines that have a match at an earlier place (smaller id, then smaller line number).

    Lines are the parts between newlines, numbered from 0. Ids are expected to be unique: rows of one id are taken as one
    place, of which the lines of equal number are one; rows with a null id are left alone. Null texts have no lines to
    remove, nor have empty tables; a line may be of any length; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.where(F.col(id_col).isNotNull())
    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    parts = max(PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    free_shuffles(docs.sparkSession)
    packed = materialise(packed_lines(docs, id_col, text_col, word_counts(docs, text_col), parts), "packed-lines", "uncompressed")
    free_shuffles(docs.sparkSession)
    found = materialise(found_pairs(packed, parts, kind, id_type), "found-lines")
    free_shuffles(docs.sparkSession)
    copies = found.where("yi is null and cell is null").select(F.col("xi").alias("id"), F.col("xl").alias("line_no"))
    gone = materialise(copies.unionAll(_matched(found, docs, id_col, text_col, kind)).distinct(), "gone-lines")
    left = found.where("cell is not null").select("xi", "xl", "part", "cell")
    more = materialise(left.join(gone.toDF("xi", "xl"), ["xi", "xl"], "left_anti").distinct(), "open-lines")
    release(found)
    if not more.isEmpty():
        own = packed.where(f"kind = {_CELLS}").join(more.select("part").distinct(), "part", "left_semi")
        rest = materialise(found_pairs(own.unionAll(_opened(more, id_type)), parts, kind, id_type), "found-lines")
        gone = gone.unionAll(_matched(rest, docs, id_col, text_col, kind)).distinct()
        release(rest)
    release(packed, more)
    free_shuffles(docs.sparkSession)
    return gone.withColumnRenamed("id", id_col)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _without(lines: Column, numbers: Column) -> Column:
    """The runs of lines between those of the numbers, each sliced once."""
    ends = F.concat(F.array(F.lit(-1).cast("long")), F.sort_array(numbers), F.array(F.size(lines).cast("long")))

    def runs(own: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(own["ends"]) - 2)
        end = lambda k: F.get(own["ends"], k).cast("int")
        return F.flatten(F.transform(at, lambda k: F.slice(own["lines"], end(k) + 2, end(k + 1) - end(k) - 1)))

    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), ends.alias("ends"))), runs), F.lit(0))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with two more columns, n_lines and n_removed, and without the lines of repeated_lines() in the text column.

    A null text stays null (n_lines 0). Rows whose id is null and blank lines stay, as do repeated rows, which lose the same
    lines. Columns n_lines and n_removed that docs has already give way; all others stay, whatever their names.
    """
    key, lost = _free(docs, "_gone_id"), _free(docs, "_gone")
    gone = repeated_lines(docs, id_col, text_col).groupBy(F.col(id_col).alias(key)).agg(F.collect_set("line_no").alias(lost))
    plain = docs.select(*(c for c in (F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed"))))
    met = plain.join(gone, plain[id_col] == gone[key], "left").drop(key)
    split = F.split(F.col(text_col), "\n", -1)
    numbers = {"n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size(lost), F.lit(0)).cast("long")}
    cut = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(_without(split, F.col(lost)), "\n"))
    return met.withColumns(numbers | {text_col: cut}).drop(lost)

"""Exact repeated substrings by distributed prefix doubling over sampled suffixes.

A byte is removed when it lies in a string of ``2 * PREFIX`` bytes that also
starts in a document with a smaller doc_id. Ranks are names: equal strings have
equal names, so a rank pair (name of the first half, name of the second half)
names the doubled string.

1. Rank the ``PREFIX``-byte prefix of every position locally. Of the prefixes
   inside a window of twice that length only the one with the least name (the
   rightmost if tied) is sent on; it depends on the window's bytes alone, so
   equal windows send equal prefixes. Windows that follow each other and share
   that prefix are one run, sent as a rank pair (name of the prefix, name of
   the run).
2. Spark deals the pairs by the first rank; each bucket is sorted and
   reranked. A run that occurs whole in an earlier document is covered. A
   prefix whose runs all agree is finished, and one that is unique drops out.
   Where runs differ around a shared prefix, one run of each kind goes on.
3. For those, prefixes double: every position's pair (rank of its prefix, rank
   of the prefix that starts ``PREFIX`` bytes further) is dealt and sorted, and
   the positions whose pair has an earlier document are covered.

A task dedups its own pairs before they are dealt, so a passage that a third
of all documents hold sends one pair a task and not one a document. Positions
travel as packed arrays, each bucket of a bounded share of the input. The
texts are dealt once by a hash; step 3 and the cut read the same exchange.

Defined results: a null or empty text has nothing to remove; texts shorter than
the threshold lose nothing; a null doc_id sorts after all others; rows with the
same doc_id are not earlier than one another, so exact repeats of a row both
stay; matches never cross documents; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, bytes_of, corpus_bytes, only, release, settle, sliced, small_transfers, trim

PREFIX = 25
#: Input bytes for which a bucket is made.
BUCKET_BYTES = 6 << 20
#: Text bytes whose pairs a task dedups at once, and bytes for which names are held at once.
CHUNK_BYTES, SEGMENT = 2 << 20, 256 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of a rank pair that travel: what the bucket leaves of the first rank, and the second.
KEY_BYTES, NAME_BYTES = 6, 5
SPAN, OPEN, MARK = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    k = 1
    while k <= n:  # doubling, as cumprod of one repeated factor
        m = min(k, n + 1 - k)
        out[k : k + m] = out[:m] * (out[k - 1 : k] * base)
        k += m
    return out


class Names:
    """Names of any substring of a byte array in constant time, from a prefix sum."""

    _powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))

    def __init__(self, flat: np.ndarray):
        n = len(flat)
        if len(Names._powers[0]) <= n:
            Names._powers = _powers(_BASE, n), _powers(_INV, n)
        base, self.inv = Names._powers
        self.sums = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * base[:n], out=self.sums[1:])

    def fixed(self, length: int) -> np.ndarray:
        """Name of the substring of this length at every position where it fits."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return _mix((self.sums[length:] - self.sums[:n]) * self.inv[:n])

    def at(self, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[lo]) * self.inv[lo])


def names_at(flat: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names of the substrings of one length at these positions, a segment of the bytes at a time."""
    out = np.empty(len(at), np.uint64)
    order = np.argsort(at, kind="stable")
    where = at[order]
    for a in range(0, len(flat), SEGMENT):
        i, j = np.searchsorted(where, (a, a + SEGMENT))
        if i < j:
            lo = where[i:j] - a
            out[order[i:j]] = Names(flat[a : a + SEGMENT + length]).at(lo, lo + length)
    return out


def _least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least value, the rightmost if tied, in every window of ``w`` values."""
    pos, val, span = np.arange(len(h), dtype=np.int32), h, 1
    while span < w:
        step = min(span, w - span)
        n = len(val) - step
        right = val[step:] <= val[:n]
        pos = np.where(right, pos[step:], pos[:n])
        val = np.where(right, val[step:], val[:n])
        span += step
    return pos


def _segment_runs(flat: np.ndarray, doc: np.ndarray, limit: np.ndarray, start: int, prefix: int):
    """Runs among the windows of one segment that begin before ``limit``, the last window start of their document."""
    need = 2 * prefix
    names = Names(flat)
    h = names.fixed(prefix)
    least = _least_in_window(h, prefix + 1)
    at = np.arange(len(least))
    ok = at + start <= limit
    at, least, doc = at[ok], least[ok], doc[ok]
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    lo = at[first]
    return doc[first], lo + start, count, h[least[first]], names.at(lo, lo + count + need - 1)


def runs_of(flat: np.ndarray, offsets: np.ndarray, prefix: int = PREFIX, segment: int = SEGMENT):
    """Runs of a chunk of documents: document index, first window, windows, prefix name, run name.

    A run that a segment's end cuts in two only loses the short cut of step 2.
    """
    need = 2 * prefix
    found = []
    for a in range(0, max(0, len(flat) - need + 1), segment):
        n = min(segment, len(flat) - need + 1 - a)
        doc = np.searchsorted(offsets, np.arange(a, a + n), "right") - 1 if n < 4096 else _owners(offsets, a, n)
        r = _segment_runs(flat[a : a + n + need - 1], doc, offsets[1:][doc] - need, a, prefix)
        if r is not None:
            found.append(r)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    doc, lo, count, key, name = (np.concatenate(x) for x in zip(*found))
    return doc, lo - offsets[doc], count, key, name


def _owners(offsets: np.ndarray, a: int, n: int) -> np.ndarray:
    """Document index of each of the bytes a .. a + n - 1."""
    step = np.zeros(n, np.int64)
    inside = offsets[(offsets > a) & (offsets < a + n)]
    np.add.at(step, inside - a, 1)
    return np.cumsum(step) + int(np.searchsorted(offsets, a, "right") - 1)


def _split(kind: int, bucket: np.ndarray, pack) -> list[tuple[int, int, bytes]]:
    """Rows (kind, bucket, payload) of items dealt by bucket, their order within one kept."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order))
    starts = np.append(0, ends[:-1])
    return [(kind, int(bucket[order[i]]), pack(order[i:j])) for i, j in zip(starts, ends)]


def _bytes_of_low(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned 64-bit numbers, one byte plane after another."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _low_of_bytes(raw: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _width(x: np.ndarray) -> int:
    return max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)


def pack_items(key: np.ndarray, name: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray, row: np.ndarray, ids: np.ndarray, buckets: int, kind: int = OPEN):
    """Items by bucket = key modulo ``buckets``: what is left of the key, the name, and the documents with gaps between starts.

    Items must come in the order of documents and starts. Columns are stored one
    after another in as few bytes as they need, so a run takes some 13 bytes.
    """
    quotient = key // np.uint64(buckets)

    def pack(at: np.ndarray) -> bytes:
        used, first, count = np.unique(doc[at], return_index=True, return_counts=True)
        gap = lo[at].astype(np.int64)
        gap[1:] -= lo[at[:-1]]
        gap[first] = lo[at[first]]
        size = n[at].astype(np.uint64)
        widths = [_width(c) for c in (count, gap, size)]
        head = np.array([len(at), len(used), *widths], "<i8").tobytes()
        cols = [_bytes_of_low(quotient[at], KEY_BYTES), _bytes_of_low(name[at], NAME_BYTES), _bytes_of_low(gap.astype(np.uint64), widths[1]), _bytes_of_low(size, widths[2])]
        return head + row[used].astype("<i8").tobytes() + ids[used].astype("<i8").tobytes() + _bytes_of_low(count.astype(np.uint64), widths[0]) + b"".join(cols)

    return _split(kind, (key % np.uint64(buckets)).astype(np.int64), pack)


def unpack_items(payload: bytes):
    """Row and id of each item's document, quotient, name, start and length."""
    raw = memoryview(payload)
    k, d, wc, wg, wn = np.frombuffer(raw[:40], "<i8").tolist()
    at = 40

    def take(size: int) -> memoryview:
        nonlocal at
        at += size
        return raw[at - size : at]

    row, ids = np.frombuffer(take(8 * d), "<i8"), np.frombuffer(take(8 * d), "<i8")
    count = _low_of_bytes(take(wc * d), d, wc).astype(np.int64)
    quotient, name = _low_of_bytes(take(KEY_BYTES * k), k, KEY_BYTES), _low_of_bytes(take(NAME_BYTES * k), k, NAME_BYTES)
    gap, size = _low_of_bytes(take(wg * k), k, wg).astype(np.int64), _low_of_bytes(take(wn * k), k, wn).astype(np.int64)
    total = np.cumsum(gap)
    first = np.cumsum(count) - count
    lo = total - np.repeat(total[first] - gap[first], count)
    return np.repeat(row, count), np.repeat(ids, count), quotient, name, lo, size


def pack_spans(kind: int, row: np.ndarray, lo: np.ndarray, n: np.ndarray, buckets: int):
    """Spans (start, windows) by document; those that touch or overlap are joined."""
    order = np.lexsort((lo, row))
    row, lo, n = row[order], lo[order].astype(np.int64), n[order].astype(np.int64)
    if len(row) and kind == SPAN:
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (lo[1:] > lo[:-1] + n[:-1])
        first = np.flatnonzero(new)
        end = np.maximum.reduceat(lo + n, first)
        row, lo = row[first], lo[first]
        n = end - lo

    def pack(at: np.ndarray) -> bytes:
        used, count = np.unique(row[at], return_counts=True)
        at = at[np.argsort(row[at], kind="stable")]
        widths = [_width(c) for c in (count, lo[at], n[at])]
        return np.array([len(at), len(used), *widths], "<i8").tobytes() + used.astype("<i8").tobytes() + b"".join(_bytes_of_low(c.astype(np.uint64), w) for c, w in zip((count, lo[at], n[at]), widths))

    return _split(kind, row % buckets, pack)


def unpack_spans(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = memoryview(payload)
    k, d, wc, wl, wn = np.frombuffer(raw[:40], "<i8").tolist()
    row = np.frombuffer(raw[40 : 40 + 8 * d], "<i8")
    at = 40 + 8 * d
    count = _low_of_bytes(raw[at:], d, wc).astype(np.int64)
    at += wc * d
    lo = _low_of_bytes(raw[at:], k, wl).astype(np.int64)
    return np.repeat(row, count), lo, _low_of_bytes(raw[at + wl * k :], k, wn).astype(np.int64)


def _joined(parts: list[tuple], columns: int, kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kinds[i]) for i in range(columns)]


_ITEM = (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64)
_MARKS = (np.int64, np.int64, np.int64)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns begins a new group."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _batch(found) -> pa.RecordBatch:
    kind, bucket, payload = list(zip(*found)) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary())], names=["kind", "bucket", "payload"])


_OUT = "kind int, bucket long, payload binary"


def _table(found) -> pa.Table:
    return pa.Table.from_batches([_batch(found)])


def _first_of(new: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Id of the first member of each item's group, groups beginning where ``new``."""
    return ids[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(new) else ids


def _later(key, name, n, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items sorted by rank pair and id: the order, which have an earlier document in their group, and where groups begin."""
    order = np.lexsort((ids, n, name, key))
    new = _heads(key[order], name[order], n[order])
    return order, ids[order] > _first_of(new, ids[order]), new


def _short(key: np.ndarray, buckets: int) -> np.ndarray:
    """The first rank cut so that what a bucket leaves of it fits in ``KEY_BYTES``."""
    return _mix(key) % (np.uint64(min(buckets, 1 << 15)) << np.uint64(8 * KEY_BYTES))


def _emit_runs(prefix: int, buckets: int):
    def run(rows):
        only("suffix")
        for t in sliced(rows, "text", CHUNK_BYTES):
            row, ids = t.column("row").to_numpy(), t.column("id").to_numpy()
            flat, offsets = bytes_of(t.column("text"))
            doc, lo, n, key, name = runs_of(flat, offsets, prefix)
            if not len(doc):
                continue
            key, name = _short(key, buckets), name >> np.uint64(64 - 8 * NAME_BYTES)
            order, late, _ = _later(key, name, n, ids[doc])
            again = np.zeros(len(doc), bool)
            # of equal runs of one document the first goes on, and a mark has the cut look for the others
            by = np.lexsort((lo, doc, n, name, key))
            again[by] = ~_heads(key[by], name[by], n[by], doc[by])
            later = np.zeros(len(doc), bool)
            later[order] = late
            go = np.flatnonzero(~later & ~again)
            found = pack_items(key[go], name[go], doc[go], lo[go], n[go], row, ids, buckets)
            found += pack_spans(SPAN, row[doc[later]], lo[later], n[later], buckets)
            marked = np.unique(doc[again & ~later])
            found += pack_spans(MARK, row[marked], 0 * marked, 0 * marked, buckets)
            yield _batch(found)
        trim()

    return run


def _opened(table: pa.Table):
    """Rows of other kinds as they are, and all items of the open ones."""
    kinds, buckets, payloads = (table.column(c).to_pylist() for c in ("kind", "bucket", "payload"))
    return [x for x in zip(kinds, buckets, payloads) if x[0] != OPEN], [p for k, p in zip(kinds, payloads) if k == OPEN]


def _rerank_runs(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        found, payloads = _opened(table)
        row, ids, key, name, lo, n = _joined([unpack_items(p) for p in payloads], 6, _ITEM)
        order, late, new = _later(key, name, n, ids)
        s = order[late]
        found += pack_spans(SPAN, row[s], lo[s], n[s], buckets)
        keys = _heads(key[order])
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(keys))[np.cumsum(keys) - 1] if len(order) else np.zeros(0)
        s = order[~late & (kinds > 1)]
        # two spans of one document that touch stay two: each is a run of its own
        found += pack_spans(OPEN, row[s], lo[s], n[s], buckets)
        return _table(found)

    return run


def _double(prefix: int, buckets: int):
    def run(_, texts: pa.Table, asked: pa.Table) -> pa.Table:
        _, payloads = _opened(asked)
        want, lo, n = _joined([unpack_spans(p) for p in payloads], 3, _MARKS)
        if not len(want) or not texts.num_rows:
            return _table([])
        row, ids = texts.column("row").to_numpy(), texts.column("id").to_numpy()
        flat, offsets = bytes_of(texts.column("text"))
        number = np.argsort(row, kind="stable")
        doc = np.repeat(number[np.searchsorted(row[number], want)], n)
        lo = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((lo, doc))
        doc, lo = doc[order], lo[order]
        at = lo + offsets[doc]
        a, b = names_at(flat, at, prefix), names_at(flat, at + prefix, prefix)
        key, name = _short(a ^ (b << np.uint64(1)), buckets), b >> np.uint64(64 - 8 * NAME_BYTES)
        one = np.ones(len(doc), np.int64)
        order, late, new = _later(key, name, one, ids[doc])
        later = np.zeros(len(doc), bool)
        later[order] = late
        go = np.flatnonzero(~later)
        found = pack_items(key[go], name[go], doc[go], lo[go], one[go], row, ids, buckets)
        return _table(found + pack_spans(SPAN, row[doc[later]], lo[later], one[later], buckets))

    return run


def _rerank_pairs(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        found, payloads = _opened(table)
        row, ids, key, name, lo, n = _joined([unpack_items(p) for p in payloads], 6, _ITEM)
        order, late, _ = _later(key, name, n, ids)
        s = order[late]
        return _table(found + pack_spans(SPAN, row[s], lo[s], n[s], buckets))

    return run


def covered(size: int, lo: np.ndarray, n: np.ndarray, need: int) -> np.ndarray:
    """Mask of the bytes under windows of ``need`` bytes that start at lo, lo + 1, ... lo + n - 1."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, lo + n + need - 1, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(prefix: int):
    need = 2 * prefix

    def run(_, texts: pa.Table, given: pa.Table) -> pa.Table:
        kinds, payloads = given.column("kind").to_pylist(), given.column("payload").to_pylist()
        marked = {r for k, p in zip(kinds, payloads) if k == MARK for r in unpack_spans(p)[0].tolist()}
        key, starts_, counts_ = _joined([unpack_spans(p) for k, p in zip(kinds, payloads) if k == SPAN], 3, _MARKS)
        order = np.argsort(key, kind="stable")
        key, starts_, counts_ = key[order], starts_[order], counts_[order]
        rows = texts.column("row").to_numpy()
        flat, offsets = bytes_of(texts.column("text"))
        total, removed, runs, digest, raws = [], [], [], [], []
        for i in range(texts.num_rows):
            body = flat[offsets[i] : offsets[i + 1]]
            a, b = np.searchsorted(key, rows[i]), np.searchsorted(key, rows[i], "right")
            if a == b or len(body) < need:
                kept, gone, n = body, 0, 0
            else:
                lo, count = starts_[a:b], counts_[a:b]
                if int(rows[i]) in marked:
                    h = names_at(body, np.arange(len(body) - need + 1), need)
                    starts = np.unique(np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                    lo = np.flatnonzero(np.isin(h, h[starts]))
                    count = np.ones(len(lo), np.int64)
                mask = covered(len(body), lo, count, need)
                kept, gone = body[~mask], int(mask.sum())
                n = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
            raw = kept.tobytes()
            total.append(len(body))
            removed.append(gone)
            runs.append(n)
            digest.append(hashlib.sha256(raw).hexdigest())
            raws.append(raw)
        return pa.table({
            "doc_id": texts.column("doc_id"), "lang": texts.column("lang"), "source": texts.column("source"), "n_bytes": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(raws, pa.binary()), "text": pa.array([kept_text(x) for x in raws], pa.string()),
        })

    return run


def remove_repeats(documents: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """doc_id, lang, source, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) and text for every row.

    The threshold is ``2 * prefix`` bytes. Cutting bytes can split a character;
    text is what is left without such stumps.
    """
    have = set(documents.columns)
    more = [(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")]
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    buckets = max(8, -(-corpus_bytes(docs) // BUCKET_BYTES))
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("row", F.xxhash64("doc_id", "text", "lang", "source"))
    runs = docs.select("row", "id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_emit_runs(prefix, buckets), _OUT)
    # the runs are most of what is dealt: once they are reranked their shuffle can go
    with small_transfers(docs.sparkSession):
        ranked = settle(runs.groupBy("bucket").applyInArrow(_rerank_runs(buckets), _OUT), "ranked")
    release(docs.sparkSession)
    texts = docs.withColumn("bucket", F.pmod("row", F.lit(buckets).cast("long")))
    asked, known = ranked.where(F.col("kind") == OPEN).toDF("kind", "bucket", "payload"), ranked.where(F.col("kind") != OPEN).toDF("kind", "bucket", "payload")
    pairs = texts.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_double(prefix, buckets), _OUT).groupBy("bucket").applyInArrow(_rerank_pairs(buckets), _OUT)
    spans = known.unionByName(pairs)
    out = "doc_id long, lang string, source string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string"
    return texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_cut(prefix), out)


def kept_text(raw: bytes) -> str:
    """What is left of a text, without the stumps of characters that a cut has split."""
    return raw.decode("utf-8", "ignore")

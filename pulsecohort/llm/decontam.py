"""Benchmark decontamination by latent semantic retrieval.

1. Texts become word hashes (lower case, ASCII punctuation as white space).
   Words fall into ``FEATURES`` hashed features; passages of ``PASSAGE`` words
   give document frequencies over all rows, hence idf weights.
2. One pass over the passages of all documents sums Y = sum of a (a' Omega) for their normalised TF-IDF vectors
   a and a fixed Gaussian Omega of ``RANK`` columns. Y is a sketch
   of the Gram matrix; the Nystrom form Y (Omega' Y)^-1 Y' gives its singular
   vectors, which is a randomised SVD in one distributed pass.
   Partial sums are added in blocks of features.
3. Every text is cut into blocks of ``STEP`` words; windows of blocks are
   projected (centred, components scaled to unit variance) and compared with the
   projected benchmark passages. Windows over the cosine ``NEAR`` that also share
   ``SHARED`` of a passage's informative words are candidates. So is, whatever its
   cosine, every place that can hold an item at all: at most a ``PARAPHRASE``
   complement of an item's words may be missing, so of that many of its rarest
   words and ``MORE`` further ones, ``MORE`` stand within twice its length. This
   gate loses nothing that the check of words would accept.
4. A candidate's surroundings are held against the whole item: the longest
   common subsequence of words must reach ``SAME`` of the item, or ``PARAPHRASE``
   of it and ``ANSWER`` of its answer (its last sentence or last third, whichever
   is longer). An item of over ``LONG + STEP`` words also leaks by ``SAME`` of one
   of its passages of ``LONG`` words.

Benchmark items are the stated query set; they are taken ``QUERY_BLOCK`` passages
at a time, so what is sent to workers is bounded whatever the benchmark's size.

Defined results: a null or empty text is not contaminated; an empty or null item
matches nothing; items of under ``LEAST_WORDS`` words must occur whole; a null
doc_id is carried; repeated rows each get their row; an empty benchmark or
documents table gives no contamination; further columns are ignored.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, only, settle, small_batches, texts_of

FEATURES, RANK, PASSAGE, STEP = 1 << 14, 32, 64, 12
#: Words of the windows, short and long, and the item passage length up to which the short ones serve.
SHORT, LONG, SHORT_ITEM = 24, 48, 33
NEAR, SHARED, SAME, PARAPHRASE, ANSWER = 0.4, 0.4, 0.75, 0.6, 0.8
#: Weight from which a word is informative, and the documents that the latent index is fitted on: all (None), or some so many.
RARE, FIT_DOCUMENTS = 3.0, None
LEAST_WORDS = 8
#: Of an item's rarest words, those that must be met beyond what may be missing.
MORE = 4
QUERY_BLOCK = 4096
SUM_BLOCK = 256
#: Passages of a feature that the sketch adds up at once.
LINE = 16

_SPACE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


class WordHashes(dict):
    """Word to four bytes of its hash; begun anew when full."""

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = (xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF).to_bytes(4, "little")
        return found

    def __call__(self, text: str) -> bytes:
        if len(self) > 300_000:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().encode("utf-8", "surrogatepass").translate(_SPACE).split()))


_hashes = WordHashes()
keeps("decontam", _hashes.clear)


def word_table(documents: DataFrame) -> DataFrame:
    """doc_id, rid and the word hashes (unsigned 32-bit, little-endian) of every whole text."""

    def run(batches):
        only("decontam")
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([_hashes(t) for t in texts_of(b.column(1))], pa.binary())], names=["doc_id", "rid", "words"])

    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("rid")).mapInArrow(run, "doc_id long, rid long, words binary")


def _flat(column: pa.Array, most: int = 1 << 20):
    """Word arrays of a batch, some ``most`` words at a time: words, ends of the documents, first row."""
    rows = [np.frombuffer(x, "<u4") for x in column.to_pylist()]
    start, size = 0, 0
    for i, r in enumerate(rows):
        size += len(r)
        if size >= most or i + 1 == len(rows):
            part = rows[start : i + 1]
            yield np.concatenate(part), np.cumsum([len(x) for x in part]), start
            start, size = i + 1, 0


def _groups(ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``length`` words that documents with these ends fall into, and the document of each."""
    sizes = np.diff(ends, prepend=0)
    count = -(-sizes // length)
    doc = np.repeat(np.arange(len(ends)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return (ends - sizes)[doc] + within * length, doc


def _summed(rows, width: int):
    """Sum of equal-length vectors by block: rows (block, part, payload of float64)."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for x in table.column("payload").to_pylist():
            total += np.frombuffer(x, "<f8")
        return pa.table({"block": table.column("block")[:1], "part": pa.array([0], pa.int32()), "payload": pa.array([total.tobytes()], pa.binary())})

    kinds = "block int, part int, payload binary"
    return rows.groupBy("block", "part").applyInArrow(add, kinds).groupBy("block").applyInArrow(add, kinds)


def _collected(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Blocks put together on the driver: a matrix of fixed size."""
    out = np.zeros(shape)
    for r in rows.select("block", "payload").collect():
        out[r["block"] * SUM_BLOCK : (r["block"] + 1) * SUM_BLOCK] = np.frombuffer(r["payload"], "<f8").reshape(SUM_BLOCK, shape[1])
    return out


def _parts(matrix: np.ndarray, part: int) -> pa.RecordBatch:
    blocks = matrix.astype("<f8").reshape(-1, SUM_BLOCK * matrix.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "part", "payload"])


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() % 64


def frequencies(words: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Per feature: passages that hold it and occurrences; and the number of passages."""

    def run(batches):
        held = np.zeros((FEATURES, 3))
        for b in batches:
            for flat, ends, _ in _flat(b.column(0)):
                if not len(flat):
                    continue
                start, _ = _groups(ends, PASSAGE)
                own = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(flat))))
                f = (flat % FEATURES).astype(np.int16)
                held[:, 1] += np.bincount(f, minlength=FEATURES)
                # a passage a row, sorted: a feature counts where it first stands; -1 fills short ones
                grid = np.full((len(start), PASSAGE), -1, np.int16)
                grid[own, np.arange(len(flat)) - start[own]] = f
                grid.sort(axis=1)
                new = grid >= 0
                new[:, 1:] &= grid[:, 1:] != grid[:, :-1]
                held[:, 0] += np.bincount(grid[new], minlength=FEATURES)
                held[0, 2] += len(start)
        yield _parts(held, _part())

    found = _collected(_summed(words.select("words").mapInArrow(run, "block int, part int, payload binary"), SUM_BLOCK * 3), (FEATURES, 3))
    return found[:, 0], found[:, 1], float(found[0, 2])


def sketch_matrix(rank: int = RANK, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((FEATURES, rank)).astype(np.float32)


def _row_sums(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``table`` that each row of ``at`` names; little is gathered at a time."""
    ones, step = np.ones((1, at.shape[1]), table.dtype), max(1, (1 << 14) // at.shape[1])
    out = np.empty((len(at), table.shape[1]), table.dtype)
    for a in range(0, len(at), step):
        out[a : a + step] = (ones @ table.take(at[a : a + step], axis=0, mode="clip"))[:, 0]
    return out


def gram_sketch(words: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Y = sum over all passages of a (a' Omega), a being unit TF-IDF vectors."""
    weight = idf.astype(np.float32)

    def run(batches):
        # a passage a row, a feature's passages in rows of LINE; what a row lacks is the zero after the last
        omega = np.vstack([sketch_matrix(rank) * weight[:, None], np.zeros((1, rank), np.float32)])
        square = np.append(weight**2, np.float32(0))
        total = np.zeros((FEATURES, rank), np.float64)
        for b in batches:
            for flat, ends, _ in _flat(b.column(0), 1 << 19):
                if not len(flat):
                    continue
                start, _ = _groups(ends, PASSAGE)
                f = (flat % FEATURES).astype(np.uint16)
                own = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(flat))))
                grid = np.full((len(start), PASSAGE), FEATURES)
                grid[own, np.arange(len(flat)) - start[own]] = f
                seen = np.zeros((len(start) + 1, rank), np.float32)
                seen[:-1] = _row_sums(omega, grid) / np.maximum(square[grid].sum(axis=1), 1e-9)[:, None]
                order = np.argsort(f, kind="stable")
                ranked = f[order]
                first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
                size = np.diff(np.append(first, len(f)))
                lines = -(-size // LINE)
                base = np.cumsum(lines) - lines
                slots = np.full(lines.sum() * LINE, len(start))
                slots[np.arange(len(f)) + np.repeat(base * LINE - first, size)] = own[order]
                total[ranked[first]] += np.add.reduceat(_row_sums(seen, slots.reshape(-1, LINE)), base, axis=0) * weight[ranked[first], None]
        yield _parts(total, _part())

    return _collected(_summed(words.select("words").mapInArrow(run, "block int, part int, payload binary"), SUM_BLOCK * rank), (FEATURES, rank))


def singular_vectors(y: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and squared singular values of the passage matrix from the sketch of its Gram matrix."""
    omega = sketch_matrix(rank).astype(np.float64)
    core = omega.T @ y
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    keep = values > max(values.max(initial=0.0), 1e-12) * 1e-9
    root = y @ (vectors[:, keep] / np.sqrt(values[keep]))
    u, s, _ = np.linalg.svd(root, full_matrices=False)
    return u, s**2


def projection(words: DataFrame, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """What each feature adds to a window's latent vector (idf weighted, centred on the mean word, scaled to equal components), and idf.

    Frequencies are those of all rows, and the index is fitted on all rows, or
    on some ``FIT_DOCUMENTS`` documents, those with the least hashes, where that is a number.
    """
    df, tf, passages = frequencies(words)
    idf = np.log((passages + 1) / (df + 1)) + 0.1
    share = 1.0 if FIT_DOCUMENTS is None else min(1.0, FIT_DOCUMENTS / max(1, words.count()))
    # of 2 ** 64 hashes the least ones, so that a share of any size takes its rows
    fitted = words.where(F.xxhash64("rid") < F.lit(int(share * 2.0**64) - 2**63)) if share < 1 else words
    sketch = gram_sketch(fitted, idf, rank)
    if passages and not sketch.any():
        raise ValueError("the latent index has no passage to be fitted on")
    u, s = singular_vectors(sketch, rank)
    out = idf[:, None] * u / np.sqrt(np.maximum(s, s.max(initial=1e-9) * 1e-6))
    centre = (tf[:, None] * out).sum(axis=0) / max(1.0, tf.sum())
    return (out - centre).astype(np.float32), idf


def signatures(words: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """One of 256 bits for each informative word, as four numbers of 64 bits; none for the others."""
    out = np.zeros((len(words), 4), np.uint64)
    at = np.flatnonzero(rare[words % FEATURES])
    bit = (words[at] >> np.uint32(14)) % np.uint32(256)
    out[at, bit >> np.uint32(6)] = np.uint64(1) << (bit & np.uint32(63)).astype(np.uint64)
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by the bit-parallel scan over b."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Item:
    """A benchmark item: its words, its answer and its passages."""

    def __init__(self, number: int, text: str):
        self.number = number
        self.words = np.frombuffer(_hashes(text), "<u4")
        sentences = [s for s in (np.frombuffer(_hashes(x), "<u4") for x in re.split(r"[.!?\n]+", text)) if len(s)]
        third = -(-len(self.words) // 3)
        self.answer = sentences[-1] if sentences and len(sentences[-1]) > third else self.words[len(self.words) - third :]

    def passages(self) -> list[np.ndarray]:
        n = len(self.words)
        if n <= LONG + STEP:
            return [self.words] if n else []
        return [self.words[i : i + LONG] for i in range(0, n - LONG // 2, LONG // 2)]

    def parts(self) -> list[Item]:
        """The passages of a long item as items whose answer is the whole, so that ``SAME`` of it must be there."""
        found = self.passages()
        if len(found) < 2:
            return []
        out = [Item(self.number, "") for _ in found]
        for part, words in zip(out, found):
            part.words = part.answer = words
        return out


def verdict(item: Item, region: np.ndarray) -> tuple[bool, float]:
    """Whether a region of a text holds the item, and the share of the item's words that stand there in order."""
    n = len(item.words)
    present = np.isin(item.words, region).mean()
    if present < PARAPHRASE:
        return False, 0.0
    share = common_subsequence(item.words, region) / n
    if n < LEAST_WORDS:
        return share == 1.0, share
    if share >= SAME:
        return True, share
    return share >= PARAPHRASE and common_subsequence(item.answer, region) >= ANSWER * len(item.answer), share


def least_words(item: Item) -> int:
    """The fewest words in order that ``verdict`` accepts."""
    n = len(item.words)
    return n if n < LEAST_WORDS else next(k for k in range(n + 1) if k / n >= PARAPHRASE)


class Gate:
    """Places that can hold an item: of its rarest words, one more than may be missing and so on up to ``MORE``, enough stand within twice its length."""

    def __init__(self, items: list[Item], idf: np.ndarray):
        words, owner, weight, need = [], [], [], []
        for k, item in enumerate(items):
            n, least = len(item.words), least_words(item)
            need.append(min(MORE, least))
            rarest = np.argsort(-idf[item.words % FEATURES], kind="stable")[: n - least + need[-1]]
            u, times = np.unique(item.words[rarest], return_counts=True)
            words.append(u)
            weight.append(times)
            owner.append(np.full(len(u), k))
        flat = np.concatenate(words)
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight = np.concatenate(owner)[order], np.concatenate(weight)[order]
        self.words, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.need, self.width = np.array(need), np.array([2 * len(x.words) for x in items])
        self.table = np.zeros(1 << 20, bool)
        self.table[self.words & 0xFFFFF] = True

    def __call__(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item and position of the words from which on enough of the item's rarest words stand within twice its length."""
        at = np.flatnonzero(self.table[flat & 0xFFFFF])
        i = np.minimum(np.searchsorted(self.words, flat[at]), len(self.words) - 1)
        same = self.words[i] == flat[at]
        at, i = at[same], i[same]
        count = self.count[i]
        pos = np.repeat(at, count)
        entry = np.repeat(self.first[i] - np.cumsum(count) + count, count) + np.arange(count.sum())
        key = self.owner[entry] << 32 | pos
        order = np.argsort(key)
        key, pos, entry = key[order], pos[order], entry[order]
        owner = self.owner[entry]
        doc = np.searchsorted(ends, pos, "right")
        end = np.searchsorted(key, owner << 32 | np.minimum(pos + self.width[owner], ends[doc]))
        total = np.concatenate([[0], np.cumsum(self.weight[entry])])
        hit = total[end] - total[:-1] >= self.need[owner]
        return doc[hit], owner[hit], pos[hit]


def held(item: Item, flat: np.ndarray) -> tuple[float, int]:
    """The greatest share found of the item's words in order in a part of twice its length that holds it, and where that starts; 0 if none does."""
    n, top = len(item.words), (0.0, 0)
    # what the whole doesn't hold, no part of it does
    if not verdict(item, flat)[0]:
        return top
    # no wider than twice the item, so that common words far apart don't add up to it
    for i in range(0, max(1, len(flat) - n), max(1, n // 2)):
        ok, share = verdict(item, flat[i : i + 2 * n])
        if ok:
            top = max(top, (share, i))
    if top[0]:
        return top
    own = np.isin(flat, item.words)
    met = np.concatenate([[0], np.cumsum(own)])
    starts = np.flatnonzero(own)
    for i in starts[met[np.minimum(starts + 2 * n, len(flat))] - met[starts] >= least_words(item)].tolist():
        ok, share = verdict(item, flat[i : i + 2 * n])
        if ok:
            return share, i
    return top


def _windows(blocks: np.ndarray, bits: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``length`` blocks in a row within a document, the first block of each, and the bits in them; a shorter document has one."""
    n = len(blocks)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    last = np.append(first[1:], n) - 1
    end = np.minimum(np.arange(n) + length - 1, np.repeat(last, last - first + 1))
    start = np.flatnonzero((end - np.arange(n) == length - 1) | (np.arange(n) == np.repeat(first, last - first + 1)))
    out, held = blocks[start], bits[start]
    for k in range(1, length):
        more = start + k
        ok = more <= end[start]
        out[ok] += blocks[more[ok]]
        held[ok] |= bits[more[ok]]
    return out, start, held


def _search(words: DataFrame, table: tuple[np.ndarray, np.ndarray], items: list[tuple[int, str]], near: float) -> DataFrame:
    """doc_id, rid, item_id, lcs_share, cosine of the verified matches of one block of items."""
    sent = words.sparkSession.sparkContext.broadcast((table, items))

    def run(batches):
        (vectors, idf), given = sent.value
        rare = idf >= RARE
        known = [Item(i, t) for i, t in given]
        passages = [(k, p) for k, item in enumerate(known) for p in item.passages()]
        latent = np.stack([vectors[p % FEATURES].sum(axis=0) for _, p in passages])
        latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
        # long items are searched whole and by their passages
        entries = [(k, item) for k, item in enumerate(known)] + [(k, part) for k, item in enumerate(known) for part in item.parts()]
        gate = Gate([x for _, x in entries], idf)
        of_item = [latent[[i for i, (j, _) in enumerate(passages) if j == k]] for k in range(len(known))]
        scales = []
        for length, pick in ((SHORT // STEP, [i for i, (_, p) in enumerate(passages) if len(p) < SHORT_ITEM]), (LONG // STEP, [i for i, (_, p) in enumerate(passages) if len(p) >= SHORT_ITEM])):
            if pick:
                marks = np.stack([np.bitwise_or.reduce(signatures(passages[i][1], rare), axis=0) for i in pick])
                need = np.ceil(SHARED * np.bitwise_count(marks).sum(axis=1)).astype(np.int64)
                scales.append((length, np.array([passages[i][0] for i in pick]), np.ascontiguousarray(latent[pick].T), marks, need))
        for b in batches:
            found: list[tuple] = []
            for flat, ends, row in _flat(b.column(2), 1 << 14):
                if not len(flat):
                    continue
                start, doc = _groups(ends, STEP)
                blocks = np.add.reduceat(vectors[flat % FEATURES], start, axis=0)
                bits = np.bitwise_or.reduceat(signatures(flat, rare), start, axis=0)
                best: dict[tuple[int, int], list] = {}
                for length, owner, queries, marks, need in scales:
                    sums, at, seen = _windows(blocks, bits, doc, length)
                    sums /= np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
                    for a in range(0, len(sums), 8192):
                        cosine = sums[a : a + 8192] @ queries
                        ws, qs = np.nonzero(cosine >= near)
                        # a candidate must also share informative words before its words are held against the item
                        both = np.bitwise_count(seen[a + ws] & marks[qs]).sum(axis=1) >= need[qs]
                        for w, q in zip(ws[both], qs[both]):
                            k = int(owner[q])
                            spot = int(start[at[a + w]])
                            best.setdefault((int(doc[at[a + w]]), k), []).append((spot, spot + length * STEP, float(cosine[w, q])))
                for d, k, spot in zip(*(x.tolist() for x in gate(flat, ends))):
                    # with the extension below, twice the item on both sides
                    around = len(entries[k][1].words)
                    best.setdefault((d, k), []).append((spot - around, spot + around, -1.0))
                tops: dict[tuple[int, int], tuple[float, float]] = {}
                for (d, number), spots in best.items():
                    (k, item), low, high = entries[number], int(ends[d - 1]) if d else 0, int(ends[d])
                    around = len(item.words)
                    spots.sort()
                    joined: list[list] = []
                    for s, e, c in spots:
                        s, e = max(low, s - around), min(high, e + around)
                        if joined and s <= joined[-1][1]:
                            joined[-1][1], joined[-1][2] = max(e, joined[-1][1]), max(c, joined[-1][2])
                        else:
                            joined.append([s, e, c])
                    top = (0.0, 0.0)
                    for s, e, c in joined:
                        share, i = held(item, flat[s:e])
                        if share:
                            if c < near:
                                # found by its words alone
                                part = vectors[flat[s + i : min(e, s + i + 2 * around)] % FEATURES].sum(axis=0)
                                c = float((of_item[k] @ part).max() / max(1e-9, np.linalg.norm(part)))
                            if item is not known[k]:
                                # the share is of the whole item
                                wide = len(known[k].words)
                                share = common_subsequence(known[k].words, flat[max(low, s + i - wide) : min(high, s + i + wide)]) / wide
                            top = max(top, (share, c))
                    if top[0]:
                        tops[d, k] = max(tops.get((d, k), top), top)
                found.extend((row + d, known[k].number, *top) for (d, k), top in tops.items())
            rows = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(rows, pa.int64())), b.column(1).take(pa.array(rows, pa.int64())), *(pa.array([x[i] for x in found], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()))),
            ], names=["doc_id", "rid", "item_id", "lcs_share", "cosine"])

    return words.select("doc_id", "rid", "words").mapInArrow(run, "doc_id long, rid long, item_id long, lcs_share double, cosine double")


def _item_blocks(benchmark: DataFrame):
    """Items (number, text) by blocks of bounded size, in the order of their numbers."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and length(text) > 0")
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(Item(r["item_id"], r["text"]).passages())
        if n:
            held.append((r["item_id"], r["text"]))
            size += n
        if size >= QUERY_BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(documents: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, rid, item_id, lcs_share, cosine of every document that holds an item."""
    words = settle(word_table(documents), "words", "snappy")
    table, out = None, None
    for items in _item_blocks(benchmark):
        if table is None:
            table = projection(words)
        found = _search(words, table, items, near)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else documents.sparkSession.createDataFrame([], "doc_id long, rid long, item_id long, lcs_share double, cosine double")


def decontaminate(documents: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """The rows of ``documents`` with n_items, item_ids, lcs_share and kept (false if they hold an item).

    A column of the caller's that has one of these four names is given up for it; ``clean`` keeps all columns.
    """
    found, added = _judged(documents, benchmark, near), ("item_ids", "lcs_share", "n_items", "kept")
    return found.select(*[F.col("row")[c].alias(c) for c in documents.columns if c not in added], *added)


def clean(documents: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """The rows of ``documents`` that hold no item, in their own columns."""
    return _judged(documents, benchmark, near).where("kept").select(*[F.col("row")[c].alias(c) for c in documents.columns])


def _judged(documents: DataFrame, benchmark: DataFrame, near: float) -> DataFrame:
    """row (the caller's columns), item_ids, lcs_share, n_items, kept; a row is known by its id and the hash of its text."""
    by = leaks(documents, benchmark, near).groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("lcs_share").alias("lcs_share"))
    id_ = F.col("doc_id").cast("long")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), id_.alias("id"), F.xxhash64(id_, F.col("text").cast("string")).alias("key"))
    out = rows.join(by, (F.col("key") == F.col("rid")) & F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return out.select("row", "item_ids", "lcs_share", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.col("item_ids").isNull().alias("kept"))

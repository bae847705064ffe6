"""MinHash near-duplicates with banding, exact verification and star components.

Texts become sets of distinct word shingles (A-Z lower-cased, words separated
by ASCII white space). Equal sets are one class, found by a 128-bit digest, so
exact copies never meet pair by pair. For the classes:

1. ``rows * bands`` universal hash minima, cut into bands; classes that agree
   on a whole band share a bucket.
2. Every bucket has its smallest class as centre. A class is compared, on full
   sets, with the ``CENTRES`` centres that it shares most bands with. That is
   linear in the number of classes, whatever a bucket holds.
3. Links and bucket stars both go through large-star / small-star. A bucket
   star component ("cluster") whose links already join all its classes is
   done. In the others every class outside the cluster's largest joined part is
   a query that is compared, block against block and on full sets, with all
   classes of the cluster, so that no link is lost; a block gives back the
   edges of a spanning forest, not all its pairs.
4. The edges of 2 and 3 give the final components.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; a text with fewer words than a shingle takes has
the whole sequence as its one shingle; a null doc_id never becomes a
component_id unless all rows of a component have none; repeated rows each get
their row, the smallest doc_id being the kept one; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, bytes_of, only, salted_lookup, settle, small_batches
from .components import components

ROWS = 5
#: Chance that a pair just at the threshold agrees on no band; the number of bands follows from it.
MISS = 1e-6
#: Classes in a block of a cluster that needs comparing block against block.
BLOCK = 512
#: Bucket centres that a class is compared with first; the rest of its cluster follows only where these do not join it.
CENTRES = 2
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the shingles of a text in UTF-8."""
    words = raw.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    name = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    w = np.fromiter(map(name.__getitem__, words), np.uint64, len(words))
    n = len(w) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minima_parameters(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the multiply-shift family on 32-bit keys."""
    g = np.random.default_rng(seed)
    return g.integers(0, 1 << 32, count, np.uint64).astype(np.uint32) | np.uint32(1), g.integers(0, 1 << 32, count, np.uint64).astype(np.uint32)


def band_keys(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The name of each band of a set's hash minima."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.empty(len(a), np.uint32)
    step = max(1, (1 << 16) // max(1, len(x)))
    for i in range(0, len(a), step):
        h = x[None, :] * a[i : i + step, None] + b[i : i + step, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        least[i : i + step] = h.min(axis=1)
    m = least.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows):
        key = (key ^ m[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _signatures(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    a, b = minima_parameters(bands * rows)

    def run(batches_):
        only("neardup")
        for batch in small_batches(batches_):
            flat, offsets = bytes_of(batch.column(1))
            raw = flat.tobytes()
            keys, digest_a, digest_b, n = [], [], [], []
            for i in range(len(offsets) - 1):
                s = shingle_set(raw[offsets[i] : offsets[i + 1]], size)
                d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                digest_a.append(int.from_bytes(d[:8], "little", signed=True) if d else None)
                digest_b.append(int.from_bytes(d[8:], "little", signed=True) if d else None)
                n.append(len(s))
                keys.append(band_keys(s, a, b, bands, rows) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digest_a, pa.int64()), pa.array(digest_b, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "rid", "class_a", "class_b", "n_shingles", "bands"])

    return texts.mapInArrow(run, "doc_id long, rid long, class_a long, class_b long, n_shingles long, bands array<long>")


def is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted distinct sets."""
    small, large = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are links on full sets; v, the centre, may be in very many pairs."""
    with_u = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
    centre = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    hubs = pairs.select("v").distinct()
    both = salted_lookup(with_u, centre.join(hubs, "v", "left_semi"), ["v"], "inner", F.col("u"), 8, merge=True).select("u", "v", "su", "sv")

    def run(rows):
        only("neardup")
        for b in small_batches(rows):
            su, sv = b.column(2).to_pylist(), b.column(3).to_pylist()
            yield b.select([0, 1]).filter(pa.array([is_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(su, sv)], pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def block_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """All links between two blocks of sets, by one sparse count over the shingles that both hold."""
    if not left or not right:
        return []
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    fl, fr = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(fl, fr)
    if not len(common):
        return []
    found = []
    counts = np.zeros((len(left), len(right)), np.float32)
    ol, orr = np.repeat(np.arange(len(left)), nl), np.repeat(np.arange(len(right)), nr)

    def within(flat, owner):
        at = np.searchsorted(common, flat)
        at[at == len(common)] = 0
        ok = common[at] == flat
        return at[ok], owner[ok]

    cl, wl = within(fl, ol)
    cr, wr = within(fr, orr)
    for start in range(0, len(common), 4096):
        m = min(4096, len(common) - start)
        a, b = np.zeros((len(left), m), np.float32), np.zeros((len(right), m), np.float32)
        k = (cl >= start) & (cl < start + m)
        a[wl[k], cl[k] - start] = 1
        k = (cr >= start) & (cr < start + m)
        b[wr[k], cr[k] - start] = 1
        counts += a @ b.T
    inter = counts.astype(np.int64)
    ok = (inter > 0) & (100 * inter >= percent * (nl[:, None] + nr[None, :] - inter))
    found = np.argwhere(ok)
    return [(int(i), int(j)) for i, j in found]


class _Forest:
    """Union-find over the ids of one block, for giving back a spanning forest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _compare_blocks(queries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Spanning edges (u, v) of the links between each query block and each member block of a cluster."""

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        only("neardup")
        forest, edges = _Forest(), []
        cu, cv = left.column("part").to_pylist(), right.column("part").to_pylist()
        iu, iv = left.column("node").to_pylist(), right.column("node").to_pylist()
        sl = [np.frombuffer(x, np.uint64) for x in left.column("shingles").to_pylist()]
        sr = [np.frombuffer(x, np.uint64) for x in right.column("shingles").to_pylist()]
        for n, p in zip(iu + iv, cu + cv):
            forest.join(n, p)
        step = BLOCK
        for a in range(0, len(sl), step):
            for b in range(0, len(sr), step):
                for i, j in block_links(sl[a : a + step], sr[b : b + step], percent):
                    if forest.join(iu[a + i], iv[b + j]):
                        edges.append((iu[a + i], iv[b + j]))
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    keys = ["cluster", "qb", "mb"]
    queries, members = queries.toDF(*queries.columns), members.toDF(*members.columns)
    return queries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(run, "u long, v long")


def row_key() -> Column:
    """Names a row of documents by its id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("rid")


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)) if percent < 100 else 1


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row per row of ``documents``: doc_id, rid (``row_key``), n_shingles, component_id, kept.

    ``size`` words make a shingle; documents whose sets overlap by ``percent``
    of their union are linked. There are as many bands of ``rows`` minima as
    keep the chance that a pair at the threshold shares none under ``miss``.
    """
    bands = bands_for(percent, rows, miss)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = settle(_signatures(docs.select("doc_id", "text", row_key()), size, bands, rows), "sets")
    key = ["class_a", "class_b"]
    classes = each.where("class_a is not null").groupBy(*key).agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("node"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    # two classes with the same smallest doc_id (rows that repeat an id) stay apart by their digest
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    member = classes.select("cid", "node", F.explode("bands").alias("bucket"))
    order = F.struct("node", "cid")
    stars = member.groupBy("bucket").agg(F.min(order).alias("c"), F.max(order).alias("top")).where("c.cid != top.cid").select("bucket", F.col("c.cid").alias("v"))
    star = salted_lookup(member.select("bucket", F.col("cid").alias("u")), stars, ["bucket"], "inner", F.col("u"), merge=True).where("u != v")
    star = settle(star.groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared")), "stars")
    # a class is in one bucket a band, so this window sees as many rows as there are bands at most
    best = star.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("shared"), "v"))).where(F.col("r") <= CENTRES).select("u", "v")

    touched = star.select(F.col("u").alias("cid")).unionByName(star.select(F.col("v").alias("cid"))).distinct()
    chosen = classes.select("cid", "node", *key).join(touched, "cid", "left_semi")
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("node"), "text").join(chosen.select("cid", "node", *key), "node")
    # a repeated id can bring in a text of another class; the digest of the set tells them apart
    sets = settle(_class_sets(texts, size), "shingles")
    links = settle(_verify(best, sets, percent), "links")

    whole = components(star)
    part = components(links)
    placed = whole.select(F.col("node").alias("cid"), F.col("component").alias("cluster")).join(part.select(F.col("node").alias("cid"), F.col("component").alias("part")), "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    placed = settle(placed, "placed")
    sizes = placed.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("cluster").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("members")).where("parts > 1").select("cluster", F.col("main.part").alias("main"), "members")
    rest = salted_lookup(placed, open_, ["cluster"], "inner", F.col("cid"), merge=True).join(sets.withColumnRenamed("node", "cid"), "cid").withColumnRenamed("cid", "node")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rest = settle(rest, "open").withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    queries = rest.where("part != main").select("cluster", F.col("own").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("mb"), "node", "part", "shingles")
    wanted = rest.where("part != main").groupBy("cluster").agg(F.collect_set("own").alias("qbs"))
    members = rest.join(wanted, "cluster").select("cluster", F.explode("qbs").alias("qb"), F.col("own").alias("mb"), "node", "part", "shingles")
    more = _compare_blocks(queries, members, percent)

    final = components(links.unionByName(settle(more, "more")))
    joined = classes.select(*key, "node", "copies", "cid").join(final.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = joined.groupBy("component").agg(F.min("node").alias("least"), F.sum("copies").alias("size"))
    named = salted_lookup(joined, least, ["component"], "inner", F.col("cid"), merge=True).where("size > 1").select(*key, "least")
    out = salted_lookup(each.select("doc_id", "rid", "n_shingles", *key), named, key, "left", F.monotonically_increasing_id(), merge=True)
    component = F.when(F.coalesce("least", F.lit(NO_ID)) == NO_ID, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "rid", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` of which one per component stays; a row that repeats another's id and text goes too.

    The caller's columns travel in one struct, whatever they are called; of rows
    that differ in these only, one stays. A row is known by its id and its text's
    hash, so that no two ids are taken for one.
    """
    kept = near_duplicates(documents, size, percent).where("kept").select(F.col("doc_id").alias("id"), F.col("rid").alias("key")).distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_key())
    left = rows.join(kept, (F.col("rid") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["doc_id", "rid"])
    return left.select(*[F.col("row")[c].alias(c) for c in documents.columns])


def _class_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles) for each class: ``texts`` has cid, node and a text, of that class or of a row with the same id."""

    def run(rows):
        only("neardup")
        for batch in small_batches(rows):
            flat, offsets = bytes_of(batch.column("text"))
            raw = flat.tobytes()
            ids = batch.column("cid").to_pylist()
            da, db, sets = [], [], []
            for i in range(len(offsets) - 1):
                s = shingle_set(raw[offsets[i] : offsets[i + 1]], size)
                d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16)
                da.append(int.from_bytes(d[:8], "little", signed=True))
                db.append(int.from_bytes(d[8:], "little", signed=True))
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("class_a"), batch.column("class_b"), pa.array(da, pa.int64()), pa.array(db, pa.int64()), pa.array(sets, pa.binary())], names=["node", "class_a", "class_b", "da", "db", "shingles"])

    made = texts.select("cid", "text", "class_a", "class_b").mapInArrow(run, "node long, class_a long, class_b long, da long, db long, shingles binary")
    return made.where("da = class_a and db = class_b").groupBy("node").agg(F.first("shingles").alias("shingles"))

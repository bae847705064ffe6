"""Content-addressed store of token ids.

A rolling hash over the last ``WINDOW`` ids ends a chunk where its low bits are
zero, so equal passages are cut alike wherever they stand. A chunk is named by
the SHA-256 of its bytes and stored once. A document is a recipe, the names of
its chunks in order, with the Merkle root over them; each recipe file has a
manifest row with the Merkle root over its documents.

Files, all Parquet in one folder: ``chunks`` (name, n, width, data: ids as
little-endian unsigned integers of ``width`` bytes), ``recipes`` (position
order: doc_id, start, n_tokens, names, root; range-partitioned, so files and
rows within them ascend in doc_id) and ``manifests`` (part, first, n_documents,
n_tokens, root). Reading checks every chunk against its name, every document
against its root and every part against its manifest, and raises where one
differs.

Defined results: a null or empty text has the end id alone; a null doc_id comes
after all others; rows that repeat a doc_id stand side by side in the order of
their content; an empty table gives an empty store; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Recent, read_vocabulary
from .common import NO_ID, keeps, only, release, salted_lookup, scratch, settle, sliced

#: Pieces of which a worker keeps the ids, in each of two generations.
WORDS_KEPT = 250_000
#: Text bytes that are encoded at once, and documents for which a part is made at least.
BATCH_BYTES, PART_DOCUMENTS = 8 << 20, 100_000
WINDOW, MEAN_BITS, LEAST, MOST = 16, 9, 64, 8192
END_ID = 1
#: Words that the library encodes in one call.
TOGETHER = 4096
#: Copies of the chunk table in the join with recipes; what one name still gathers, adaptive execution splits.
COPIES = 4


#: Letters that composing leaves alone, and ASCII punctuation but apostrophes. Between the former and the latter the splitter always cuts.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_letters, _plain = frozenset(_LETTERS), re.compile(f"[{_LETTERS}]+|[{re.escape(_MARKS)}]+").fullmatch


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    The file's normaliser turns white space into a space and its splitter never
    joins across one. So Arrow splits a batch of texts into words and numbers
    the distinct ones; those are taken apart where the splitter would surely do
    so, and the library encodes the pieces that this worker has not met lately,
    by its model alone where the splitter and the normaliser have nothing to do.
    """

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        self.library = library = Tokenizer.from_str(definition.decode())
        kinds = json.loads(definition)
        parts = (kinds.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if kinds["model"].get("type") != "BPE" or not parts or parts[0].get("behavior") != "Removed" or kinds.get("post_processor") or {"type": "Lowercase"} not in (kinds.get("normalizer") or {}).get("normalizers", []):
            raise ValueError("this tokenizer may join across white space")
        model = library.model
        # a worker keeps what it needs itself
        model._resize_cache(0)
        to_model = {ord(c): "".join(self.byte_names()[x] for x in c.encode()) for c in _LETTERS[26:]}
        model_only = [x.get("type") for x in parts] == ["Split", "ByteLevel"] and not (parts[1].get("add_prefix_space") or parts[1].get("use_regex"))

        def make(pieces: list[str]) -> list[bytes]:
            found = dict.fromkeys(pieces, b"")
            rest = []
            for p in found:
                if model_only and _plain(p):
                    # a piece that is neither split nor changed: only the merges are left to do
                    found[p] = np.array([t.id for t in model.tokenize(p if p.isascii() else p.translate(to_model))], "<u4").tobytes()
                elif p:
                    rest.append(p)
            for i in range(0, len(rest), TOGETHER):
                for p, e in zip(rest[i : i + TOGETHER], library.encode_batch_fast(rest[i : i + TOGETHER], add_special_tokens=False)):
                    found[p] = np.array(e.ids, "<u4").tobytes()
            return list(found.values())

        self.known = Recent(make, WORDS_KEPT)

    @staticmethod
    def byte_names() -> list[str]:
        """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from 256 on."""
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        names, more = [], 256
        for x in range(256):
            names.append(chr(x if x in printable else more))
            more += x not in printable
        return names

    def words(self, distinct: list[str]) -> list[bytes]:
        """Ids of each of these words."""
        heads, tails = list(distinct), {}
        for i, w in enumerate(distinct):
            s = w.rstrip(_MARKS)
            if len(s) < len(w) and s and s[-1] in _letters and "<|" not in w:
                heads[i], tails[i] = s, w[len(s) :]
        known = self.known.of({*heads, *tails.values()})
        ids = list(map(known.__getitem__, heads))
        for i, tail in tails.items():
            ids[i] += known[tail]
        return ids

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts, "")
        # only the added tokens tell upper case from lower
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lower.cast(pa.large_string()))
        numbered = split.flatten().dictionary_encode()
        ids = self.words(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        at, ends = numbered.indices.to_numpy(), np.cumsum(pc.list_value_length(split).to_numpy()).tolist()
        return [b"".join(map(ids.__getitem__, at[a:b].tolist())) for a, b in zip([0, *ends], ends)]

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(self.batch(pa.array([text]))[0], "<u4")


def rolling(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hash of the last ``window`` ids (a power of two) at every position; of fewer at the start.

    Hashes of 2, 4, 8 ... ids are put together from two of half the length.
    """
    h = (ids.astype(np.uint64) + np.uint64(0x51ED)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    span = 1
    while span < min(window, len(h)):
        grown = h.copy()
        grown[span:] += h[:-span] * np.uint64(pow(0xBF58476D1CE4E5B9, span, 1 << 64))
        h, span = grown, 2 * span
    return h ^ (h >> np.uint64(32))


def cuts(spots: np.ndarray, n: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids: at its ``spots``, ascending, if ``least`` ids on, or after ``most`` ids."""
    out, at = [], 0
    for e in [*spots.tolist(), n]:
        while e - at > most:
            at += most
            out.append(at)
        if e - at >= least or (e == n and e > at):
            out.append(e)
            at = e
    return out


class Merkle:
    """SHA-256 tree over leaves in order, holding one node for each power of two; a node without a neighbour moves up as it is."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        size, node = 1, hashlib.sha256(b"\x00" + leaf).digest()
        while self.nodes and self.nodes[-1][0] == size:
            node = hashlib.sha256(b"\x01" + self.nodes.pop()[1] + node).digest()
            size *= 2
        self.nodes.append((size, node))

    def root(self) -> bytes:
        if not self.nodes:
            return hashlib.sha256(b"").digest()
        node = self.nodes[-1][1]
        for _, left in reversed(self.nodes[:-1]):
            node = hashlib.sha256(b"\x01" + left + node).digest()
        return node


def merkle_root(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


def _encoded(docs: DataFrame, definition: bytes, end_id: int, make_encoder) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(definition)

    def run(rows):
        only("store")
        encoder = _encoder(sent.value, make_encoder)
        end = np.array([end_id], "<u4").tobytes()
        seen: set[bytes] = set()
        for t in sliced(rows, "text", BATCH_BYTES):
            ids, texts = t.column(0).to_pylist(), t.column(1).combine_chunks()
            streams = [x + end for x in encoder.batch(texts)]
            flat = np.frombuffer(b"".join(streams), "<u4")
            # a hash that reaches into the text before stands within LEAST ids of a start, where nothing is cut
            spots = np.flatnonzero((rolling(flat) & np.uint64((1 << MEAN_BITS) - 1)) == 0) + 1
            width = 2 if flat.max(initial=0) < 1 << 16 else 4
            raw, salt = flat.astype(f"<u{width}").tobytes(), bytes((width,))
            base, out = 0, [[] for _ in range(9)]
            for i, stream in zip(ids, streams):
                n = len(stream) // 4
                a, b = np.searchsorted(spots, (base + 1, base + n))
                at, names, sizes, datas = 0, [], [], []
                for e in cuts(spots[a:b] - base, n):
                    data = raw[(base + at) * width : (base + e) * width]
                    name = hashlib.sha256(salt + data).digest()
                    if len(seen) > 200_000:
                        seen.clear()
                    datas.append(None if name in seen else data)
                    seen.add(name)
                    names.append(name)
                    sizes.append(e - at)
                    at = e
                base += n
                row = (NO_ID if i is None else i, i, n, hashlib.sha256(b"".join(names)).digest()[:8], names, merkle_root(names), sizes, [width] * len(names), datas)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["key", "doc_id", "n_tokens", "tie", "names", "root", "sizes", "widths", "datas"])

    kinds = "key long, doc_id long, n_tokens long, tie binary, names array<binary>, root binary, sizes array<int>, widths array<int>, datas array<binary>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


_made: dict = {}
keeps("store", _made.clear)


def _encoder(definition: bytes, make_encoder):
    """This worker's encoder; kept between tasks."""
    key = hashlib.sha256(definition).digest(), make_encoder.__qualname__
    if key not in _made:
        _made.clear()
        _made[key] = make_encoder(definition)
    return _made[key]


def write_store(documents: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, make_encoder=WordEncoder, parts: int | None = None) -> str:
    """Encode every whole text, append ``end_id`` and write the store to ``folder``."""
    spark = documents.sparkSession
    encoded = settle(_encoded(documents, read_vocabulary(tokenizer_path), end_id, make_encoder), "encoded")

    pieces = encoded.select(F.explode(F.arrays_zip("names", "sizes", "widths", "datas")).alias("c")).where("c.datas is not null")
    chunks = pieces.groupBy(F.col("c.names").alias("name")).agg(F.first("c.sizes").alias("n"), F.first("c.widths").alias("width"), F.first("c.datas").alias("data"))
    chunks.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/chunks")

    release(spark)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-encoded.count() // PART_DOCUMENTS))
    ordered = encoded.select("key", "doc_id", "tie", "n_tokens", "names", "root").repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie").withColumn("part", F.spark_partition_id())
    ordered = settle(ordered, "ordered")
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first"))
    offset = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    offsets = sums.select("part", F.coalesce(offset, F.lit(0)).alias("offset"))
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1))
    placed = ordered.withColumn("before", F.coalesce(running, F.lit(0))).join(offsets, "part").select("part", "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "names", "root")
    placed.repartitionByRange(parts, "start").sortWithinPartitions("start").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/recipes")
    _manifest(spark.read.parquet(f"{folder}/recipes")).write.mode("overwrite").parquet(f"{folder}/manifests")
    return folder


def _manifest(recipes: DataFrame) -> DataFrame:
    """(part, n_documents, n_tokens, root): the Merkle root over the documents of each part in position order."""

    def run(rows):
        part, count, tokens, leaves = None, 0, 0, Merkle()

        def done():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_documents": pa.array([count], pa.int64()), "n_tokens": pa.array([tokens], pa.int64()), "root": pa.array([leaves.root()], pa.binary())})

        for b in rows:
            for p, n, root in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    if part is not None:
                        yield done()
                    part, count, tokens, leaves = p, 0, 0, Merkle()
                count, tokens = count + 1, tokens + n
                leaves.add(root)
        if part is not None:
            yield done()

    return recipes.select("part", "n_tokens", "root", "start").repartition("part").sortWithinPartitions("part", "start").select("part", "n_tokens", "root").mapInArrow(run, "part int, n_documents long, n_tokens long, root binary")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk files: name, n, width, data."""
    return spark.read.schema("name binary, n int, width int, data binary").parquet(f"{folder}/chunks")


def _shift(crc: int, zeros: int) -> int:
    """The part of a CRC-32 that lies before ``zeros`` further bytes."""
    at = 0
    while zeros:
        if zeros & 1:
            out, table = 0, _squares(at)
            while crc:
                low = crc & -crc
                out ^= table[low.bit_length() - 1]
                crc ^= low
            crc = out
        zeros >>= 1
        at += 1
    return crc


@lru_cache(maxsize=64)
def _squares(power: int) -> tuple[int, ...]:
    """What 2 ** power zero bytes make of each bit of a CRC-32 register."""
    if power == 0:
        out = []
        for bit in range(32):
            r = 1 << bit
            for _ in range(8):
                r = (r >> 1) ^ (0xEDB88320 if r & 1 else 0)
            out.append(r)
        return tuple(out)
    half = _squares(power - 1)

    def twice(r: int) -> int:
        out = 0
        while r:
            low = r & -r
            out ^= half[low.bit_length() - 1]
            r ^= low
        return out

    return tuple(twice(half[bit]) for bit in range(32))


def join_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings end to end, the second of ``size`` bytes."""
    return _shift(first, size) ^ second


def _checked_chunks(chunks: DataFrame) -> DataFrame:
    """(name, n, crc) of each chunk, after its bytes were held against its name."""

    def run(rows):
        for b in rows:
            name, width, data = (b.column(i).to_pylist() for i in (0, 2, 3))
            crc, n = [], []
            for x, w, d in zip(name, width, data):
                if hashlib.sha256(bytes((w,)) + d).digest() != x:
                    raise ValueError(f"chunk {x.hex()} doesn't match its bytes")
                ids = np.frombuffer(d, f"<u{w}").astype("<u4")
                crc.append(zlib.crc32(ids.tobytes()))
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["name", "n", "crc"])

    return chunks.select("name", "n", "width", "data").mapInArrow(run, "name binary, n long, crc long")


def verify_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, rebuilt from the files and checked against them.

    Chunks stay where they are: each yields its checksum, and a document's
    checksum is put together from those of its chunks in recipe order.
    """
    recipes = spark.read.schema("part int, doc_id long, start long, n_tokens long, names array<binary>, root binary").parquet(f"{folder}/recipes")
    manifests = spark.read.schema("part int, n_documents long, n_tokens long, root binary").parquet(f"{folder}/manifests")
    both = _manifest(recipes).withColumn("side", F.lit(1)).unionByName(manifests.withColumn("side", F.lit(-1)))
    if not both.groupBy("part", "n_documents", "n_tokens", "root").agg(F.sum("side").alias("side")).where("side != 0").isEmpty():
        raise ValueError("recipes don't match their manifests")
    found = _checked_chunks(read_chunks(spark, folder))
    steps = recipes.select("start", F.posexplode("names").alias("at", "name"))
    steps = salted_lookup(steps, found, ["name"], "left", F.col("start"), COPIES)
    whole = recipes.select("start", "doc_id", "n_tokens", "root").join(steps.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("at", "name", "n", "crc"))).alias("steps")), "start")

    def run(rows):
        for b in rows:
            start, doc_id, want, root, steps_ = (c.to_pylist() for c in b.columns)
            crcs = []
            for s, n, r, parts in zip(start, want, root, steps_):
                if any(p["n"] is None for p in parts) or merkle_root([p["name"] for p in parts]) != r or sum(p["n"] for p in parts) != n:
                    raise ValueError(f"the document at {s} can't be rebuilt")
                crc = 0
                for p in parts:
                    crc = join_crc(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), b.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.select("start", "doc_id", "n_tokens", "root", "steps").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and the ids of every document, put together from its chunks."""
    recipes = spark.read.schema("part int, doc_id long, start long, n_tokens long, names array<binary>, root binary").parquet(f"{folder}/recipes")
    steps = salted_lookup(recipes.select("doc_id", "start", F.posexplode("names").alias("at", "name")), read_chunks(spark, folder), ["name"], "left", F.col("start"), COPIES)
    whole = steps.groupBy("start", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "width", "data"))).alias("parts"))

    def run(rows):
        for b in rows:
            ids = [np.concatenate([np.frombuffer(p["data"], f"<u{p['width']}").astype("<u4") for p in parts]) for parts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return whole.select("doc_id", "start", "parts").mapInArrow(run, "doc_id long, start long, ids array<long>")


def new_folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/store-{uuid.uuid4().hex}"

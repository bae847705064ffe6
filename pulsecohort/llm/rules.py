"""Quality rules: per-document counts and cross-document line frequency within a host.

Lines are normalised (A-Z lower-cased, white space runs to one space, ends
trimmed) and hashed. For every host the distinct contents that hold a line are
counted; exact copies of one document count once, so a group of copies does not
make its own lines look like boilerplate. A line held by more than
``max_documents`` contents and by more than ``max_share`` of the host's
contents is removed from every document of that host but the one with the
smallest id. A document that loses more than ``max_loss`` of its words is
depleted and rejected.

Defined results: a null or empty text has no words and fails the base rules; a
null host is a host of its own; a null doc_id is carried and sorts last;
repeated rows each get their row; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import NO_ID, bytes_of, only, salted_lookup, settle, small_batches, texts_of

MAX_DOCUMENTS = 20
MAX_SHARE = 0.002
MAX_LOSS = 0.5
MIN_WORDS = 50
MAX_REPEAT_SHARE = 0.5

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_LINES = "doc_key long, host string, content long, rid long, line_keys array<long>, line_words array<int>"


def normalise_line(line: bytes) -> bytes:
    return b" ".join(line.translate(_LOWER).split())


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = len(_SYMBOLS.findall(text))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            hit = np.fromiter((seen[w] > 1 for w in windows), np.int8, len(windows))
            cover = np.zeros(n, np.int8)
            cover[:-2] |= hit
            cover[1:-1] |= hit
            cover[2:] |= hit
            repeated = int(cover.sum())
    return n, chars, symbols, dup, repeated


def document_lines(docs: DataFrame) -> DataFrame:
    """One row a document: its counts, the distinct keys of its lines and the words it holds in each; its text is read once."""

    def run(rows):
        only("rules")
        for b in small_batches(rows):
            flat, offsets = bytes_of(b.column(1))
            raw = flat.tobytes()
            content, keys, counts = [], [], []
            for i in range(len(offsets) - 1):
                body = raw[offsets[i] : offsets[i + 1]]
                content.append(xxhash.xxh3_64_intdigest(body) - (1 << 63))
                held: dict[int, int] = {}
                for line in body.split(b"\n"):
                    words = line.split()
                    if words:
                        key = line_key(line)
                        held[key] = held.get(key, 0) + len(words)
                keys.append(list(held))
                counts.append(list(held.values()))
            found = [text_stats(t) for t in texts_of(b.column(1))]
            cols = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(0).fill_null(NO_ID), b.column(3), pa.array(content, pa.int64()), b.column(2), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), *[pa.array(c, pa.int64()) for c in cols],
            ], names=["doc_id", "doc_key", "host", "content", "rid", "line_keys", "line_words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return docs.select("doc_id", "text", "rid", "host").mapInArrow(run, f"doc_id long, {_LINES}, {_STATS}")


def frequent_lines(lines: DataFrame, max_documents: int, max_share: float) -> DataFrame:
    """(host, line, first): lines of a host above both limits and the smallest id that holds them."""
    single = lines.groupBy("host", "content").agg(F.min("doc_key").alias("doc_key")).select("host", "content")
    hosts = single.groupBy("host").agg(F.count(F.lit(1)).alias("contents"))
    held = (
        lines.select("host", "content", "doc_key", F.explode("line_keys").alias("line"))
        .groupBy("host", "line", "content").agg(F.min("doc_key").alias("first"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
        .where(F.col("n") > max_documents)
    )
    return salted_lookup(held, hosts, ["host"], "inner", F.col("line")).where(F.col("n") > max_share * F.col("contents")).select("host", "line", "first")


def quality_rules(documents: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS) -> DataFrame:
    """Counts, base rules and line-frequency verdict for every row of ``documents``.

    Returns doc_id, rid (the row's key: a hash of id, host and text), the counts,
    base_failed, removed_words, n_removed_lines, depleted, kept and removed (the
    keys of the lines that go, null for none). Repeated rows have the same rid
    and the same verdict.
    """
    docs = _keyed(documents, host)
    lines = settle(document_lines(docs), "lines")
    frequent = frequent_lines(lines, max_documents, max_share)
    each = lines.select("host", "doc_key", "rid", F.explode(F.arrays_zip("line_keys", "line_words")).alias("x")).select("host", "doc_key", "rid", F.col("x.line_keys").alias("line"), F.col("x.line_words").alias("words"))
    lost = (
        salted_lookup(each, frequent, ["host", "line"], "inner", F.col("rid"))
        .where(F.col("doc_key") > F.col("first"))
        .groupBy("rid", "line").agg(F.first("words").alias("words"))
        .groupBy("rid").agg(F.sum("words").cast("long").alias("removed_words"), F.count(F.lit(1)).alias("n_removed_lines"), F.collect_list("line").alias("removed"))
    )
    out = lines.drop("host", "content", "doc_key", "line_keys", "line_words").join(lost, "rid", "left")
    removed = F.coalesce("removed_words", F.lit(0).cast("long"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT_SHARE) * F.col("n_words"))
    depleted = removed > F.lit(max_loss) * F.col("n_words")
    return out.select(
        "doc_id", "rid", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        removed.alias("removed_words"), F.coalesce("n_removed_lines", F.lit(0).cast("long")).alias("n_removed_lines"), depleted.alias("depleted"), (~base & ~depleted).alias("kept"), "removed",
    )


def _keyed(documents: DataFrame, host: str) -> DataFrame:
    text, site = F.col("text").cast("string"), F.coalesce(F.col(host).cast("string"), F.lit("\x00null"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), site.alias("host")).withColumn("rid", F.xxhash64("doc_id", "host", "text"))


def line_key(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(normalise_line(line)) - (1 << 63)


def without_lines(text: str, keys: set[int]) -> str:
    """The text without the lines that have one of these keys."""
    return "\n".join(x for x in text.split("\n") if not (x.encode("utf-8", "surrogatepass").split() and line_key(x.encode("utf-8", "surrogatepass")) in keys))


def apply_quality_rules(documents: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept rows of ``documents`` in their columns, frequent lines taken out of the text and n_chars counted anew.

    The caller's columns travel in one struct, whatever they are called.
    """
    text, site = F.col("text").cast("string"), F.coalesce(F.col(host).cast("string"), F.lit("\x00null"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), site.alias("host"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "host", "text"))
    # two hashes meet only where the id is the same too
    verdict = quality_rules(documents, host, **limits).where("kept").select(F.col("doc_id").alias("id"), F.col("rid").alias("key"), "removed").dropDuplicates(["id", "key"])
    both = rows.join(verdict, (F.col("rid") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))

    def run(batches):
        only("rules")
        for b in small_batches(batches):
            texts, keys = b.column(1).to_pylist(), b.column(2).to_pylist()
            clean = [without_lines(t, set(k)) if k and t else t for t, k in zip(texts, keys)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string())], names=["row", "text"])

    schema = documents.schema
    out = both.select("row", "text", "removed").mapInArrow(run, StructType([StructField("row", schema), StructField("text", StringType())]))
    made = {"text": F.col("text").cast(schema["text"].dataType)}
    if "n_chars" in documents.columns:
        made["n_chars"] = F.length("text").cast(schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in documents.columns])

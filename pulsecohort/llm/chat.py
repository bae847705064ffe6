r"""Chat formatting in Spark expressions alone.

The turns of a conversation are collected as structs and sorted by (turn, role,
text); neighbours with one role become one block. The template is

    ### role
    text</turn>

with one header for each block and one closing mark for each turn, so that the
turns inside a block can be told apart again. Inside texts and roles ``\``
becomes ``\b``, ``<`` becomes ``\l`` and ``#`` becomes ``\h``; in roles a line
break becomes ``\n``. An escaped text holds no mark, and undoing the three in
the order h, l, b gives back the text.

The loss mask is a list of spans (start, length) in code points of the
formatted text: the texts of assistant turns, without headers and marks.

Defined results: a null text or role is empty; turns with one number are
ordered by role and text, and repeated rows stay as turns of their own; a null
conv_id is a conversation; an empty table gives an empty table; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, CLOSE = "### ", "</turn>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (array of start, length) of every conversation."""
    turns = conversations.select(
        "conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t")
    )
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # a block is (role, texts): the turns from one change of role to the next
    changes = lambda t: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))

    def blocks(t: Column) -> Column:
        def block(starts: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(starts, k + 1), F.size(t))
                return F.struct(F.get(t, start)["role"].alias("role"), F.transform(F.slice(t, start + 1, stop - start), lambda x: x["text"]).alias("texts"))

            return F.transform(starts, one)

        return let(changes(t), block)

    merged = gathered.select("conv_id", let(F.col("turns"), blocks).alias("blocks"))
    # pieces: the header of a block (learned false), then each of its texts and closing marks
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(F.struct(F.concat(F.lit(HEAD), _escape_role(b["role"]), F.lit("\n")).alias("s"), F.lit(False).alias("learn"))),
        F.flatten(F.transform(b["texts"], lambda x: F.array(F.struct(escape(x).alias("s"), (b["role"] == LEARNED_ROLE).alias("learn")), F.struct(F.lit(CLOSE).alias("s"), F.lit(False).alias("learn"))))),
    )))
    laid = merged.select("conv_id", pieces.alias("pieces"))
    sizes = lambda p: F.transform(p, lambda x: F.length(x["s"]))
    spans = let(F.col("pieces"), lambda p: let(sizes(p), lambda n: F.filter(F.zip_with(p, before(n), lambda x, at: F.struct(at.alias("start"), F.when(x["learn"], F.length(x["s"])).alias("length"))), lambda x: x["length"].isNotNull())))
    return laid.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def before(sizes: Column) -> Column:
    """For each size the sum of those before it, by sums of stretches of about the square root of their number, so that no long array is copied."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def by_stretch(n: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(n))).cast("int"))

        def with_step(w: Column) -> Column:
            count = F.ceil(F.size(n) / w).cast("int")
            stretches = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: add(F.slice(n, k * w + 1, w)))

            def sums(t: Column) -> Column:
                starts = F.transform(t, lambda _, k: add(F.slice(t, F.lit(1), k)))

                def at(s: Column) -> Column:
                    return F.transform(n, lambda _, i: F.get(s, F.floor(i / w).cast("int")) + add(F.slice(n, F.floor(i / w).cast("int") * w + 1, i % w)))

                return let(starts, at)

            return let(stretches, sums)

        return let(step, with_step)

    return let(sizes, by_stretch)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role, text) and loss_text, parsed from the formatted text and the mask alone."""
    blocks = F.filter(F.split("formatted", HEAD, -1), lambda b: b != "")

    def turns_of(b: Column) -> Column:
        role = _unescape_role(F.substring_index(b, "\n", 1))
        body = F.substr(b, F.instr(b, "\n") + 1)
        texts = F.split(body, CLOSE, -1)
        return F.transform(F.slice(texts, F.lit(1), F.size(texts) - 1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    # four bytes a character, so that a span is found without counting characters from the start; a header stands before every span,
    # and the character before it is taken along, as a byte order mark at the start of what is decoded would go
    wide = F.encode(F.col("formatted"), "UTF-32")
    span = lambda w, s: F.substr(F.decode(F.substr(w, 4 * s["start"] - 3, 4 * s["length"] + 4), "UTF-32"), F.lit(2))
    learned = let(wide, lambda w: F.array_join(F.transform("loss_spans", lambda s: unescape(span(w, s))), ""))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"), learned.alias("loss_text"))

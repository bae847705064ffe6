"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The encoding of a piece is the one token sequence in which every two
neighbours stay apart when merged on their own. So the last token of every
prefix follows from the bytes read so far, and tokens can be put out while
reading: a position is live if a token may still run over the end from it, and
what lies before the point where the paths of all live positions meet cannot
change any more. A state is the token before that point, the bytes since and
the last token of each prefix since. States and their transitions on bytes are
made when first needed, up to a limit; past it the same rule runs on without
storing. A token waits only while a live position lies before its end, and a
live position is younger than the longest token.

Decoding feeds tokens to an incremental UTF-8 machine whose state is the
unfinished character; its transitions on tokens are made when first needed.

Defined results: a null or empty text has no ids; repeated rows each get their
row; a null doc_id is carried; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, only, small_batches, texts_of

#: States that a worker makes; beyond them the machine runs without storing. Tables of pieces and pairs are begun anew when full.
TABLE_LIMIT = 40_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


class Transducer:
    """Ids of a piece, read byte by byte.

    ``known`` has, for each string that is a token or begins one, twice its id
    plus two (zero if it is no token) plus one if a longer token begins with it.
    A state is (token before, live positions, last token of each prefix since,
    bytes since).
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = TABLE_LIMIT):
        self.ranks, self.limit = ranks, limit
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.known = {t: 2 * i + 2 for t, i in ranks.items()}
        for t in ranks:
            for k in range(1, len(t)):
                self.known[t[:k]] = self.known.get(t[:k], 0) | 1
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.apart: dict[int, bool] = {}
        self.states: list[tuple] = [(-1, (), (), b"")]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[tuple[int, ...], int]] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """The definition: merge the neighbours of least rank, the leftmost first, until none merges."""
        return self._merge(piece)[0]

    def _merge(self, piece: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        parts, made = [piece[i : i + 1] for i in range(len(piece))], None
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            made = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, made

    def _spines(self, i: int) -> tuple[list, list] | None:
        """The parts that stand at the right and at the left edge of a token while it is merged, each with the rank
        that takes it up; None for a token that merging never makes."""
        if i in self.spines:
            return self.spines[i]
        token = self.token[i]
        parts, made = self._merge(token)
        if len(parts) != 1:
            found = None
        elif made is None:
            found = [(token, 1 << 60)], [(token, 1 << 60)]
        else:
            left, right = self._spines(self.ranks[made[0]]), self._spines(self.ranks[made[1]])
            edge = lambda inner: [(token, 1 << 60), *((p, min(up, i)) for p, up in inner)]
            found = edge(right[0]), edge(left[1])
        self.spines[i] = found
        return found

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens gives back the two: no pair across the edge merges while both stand.

        Of merges with one rank the leftmost comes first, so the left part must outlast the rank and the right part need not.
        """
        for x, up_x in self._spines(a)[0]:
            for y, up_y in self._spines(b)[1]:
                rank = self.ranks.get(x + y)
                if rank is not None and rank < up_x and rank <= up_y:
                    return False
        return True

    def _run(self, piece: bytes, at: int, before: int, live: list[int], last: list[int], base: int, stop: int) -> list[int]:
        """Read piece[at:stop]. last[e] is the last token of the first e bytes since ``base``; live holds starts of what may be a token."""
        known, apart = self.known, self.apart
        while at < stop:
            at += 1
            live.append(at - 1)
            chosen, left_live = -1, []
            for p in live:
                k = known.get(piece[p:at])
                if k is None:
                    continue
                if k & 1:
                    left_live.append(p)
                if chosen < 0 and k > 1:
                    i = (k >> 1) - 1
                    left = last[p - base]
                    if left < 0:
                        if self._spines(i):
                            chosen = i
                        continue
                    pair = left << 20 | i
                    fits = apart.get(pair)
                    if fits is None:
                        if len(apart) >= 4 * self.limit:
                            apart.clear()
                        fits = apart[pair] = self._spines(i) is not None and self.stay_apart(left, i)
                    if fits:
                        chosen = i
            if chosen < 0:
                raise ValueError(f"no token ends at {piece[:at]!r}")
            last.append(chosen)
            live = left_live
        return live

    def _sure(self, live: list[int], last: list[int], base: int) -> int:
        """The point (bytes since base) where the paths back from the end and from all live positions meet."""

        def path(end: int) -> set[int]:
            out = {end}
            while end:
                end -= self.size[last[end]]
                out.add(end)
            return out

        common = path(len(last) - 1)
        for p in live:
            common &= path(p - base)
        return max(common)

    def _tokens(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= self.size[last[end]]
        return out[::-1]

    def _move(self, at: int, byte: int) -> tuple[tuple[int, ...], int]:
        """A new transition: what is put out, and the number of the state after."""
        before, live, last, held = self.states[at]
        held += bytes((byte,))
        last = [before, *last]
        live = self._run(held, len(held) - 1, before, list(live), last, 0, len(held))
        cut = self._sure(live, last, 0)
        out = tuple(self._tokens(last, cut))
        state = (last[cut], tuple(p - cut for p in live), tuple(last[cut + 1 :]), held[cut:])
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        self.moves[at << 8 | byte] = found = (out, n)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, moves, n = 0, self.moves, len(piece)
        for at, byte in enumerate(piece):
            known = moves.get(state << 8 | byte)
            if known is None:
                if len(self.states) >= self.limit:
                    break
                known = self._move(state, byte)
            if known[0]:
                out += known[0]
            state = known[1]
        else:
            at = n
        before, live, last, held = self.states[state]
        # the table is full: go on without making states, putting out what is certain every few token lengths
        base = at - len(held)
        live, last = [p + base for p in live], [before, *last]
        while at < n:
            stop = min(n, at + 4 * self.longest)
            live = self._run(piece, at, before, live, last, base, stop)
            at = stop
            if at < n:
                cut = self._sure(live, last, base)
                out += self._tokens(last, cut)
                last, base = last[cut:], base + cut
                before = last[0]
        return out + self._tokens(last, len(last) - 1)


class Recent:
    """Results for pieces, of which the last two generations are kept. ``make`` gives those of a list of pieces."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit
        self.young: dict = {}
        self.old: dict = {}

    def of(self, pieces) -> dict:
        """A table that has all of these pieces."""
        # by lookups: a set less a dictionary's keys would walk the whole dictionary
        new = [p for p in set(pieces) if p not in self.young]
        if new:
            if len(self.young) + len(new) > self.limit:
                self.old, self.young, new = self.young, {}, list(set(pieces))
            known = [p for p in new if p in self.old]
            self.young.update(zip(known, map(self.old.__getitem__, known)))
            if len(known) < len(new):
                new = [p for p in new if p not in self.young]
                self.young.update(zip(new, self.make(new)))
        return self.young


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        # the two libraries' \s differ in four control characters
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        encode = self.transducer.encode_piece
        self.known = Recent(lambda new: [array("I", encode(p.encode())).tobytes() for p in new], 5 * TABLE_LIMIT)

    def __call__(self, text: str) -> bytes:
        pieces = self.split(text)
        return b"".join(map(self.known.of(pieces).__getitem__, pieces))


class StreamDecoder:
    """Ids to text, a token at a time, over a UTF-8 machine that keeps unfinished characters."""

    def __init__(self, ranks: dict[bytes, int], errors: str = "replace"):
        self.token = {i: t for t, i in ranks.items()}
        self.errors = errors
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    def _move(self, held: bytes, i: int) -> tuple[str, bytes]:
        machine = codecs.getincrementaldecoder("utf-8")(self.errors)
        text = machine.decode(held + self.token[i])
        if len(self.moves) >= 2 * TABLE_LIMIT:
            self.moves.clear()
        known = self.moves[held, i] = (text, machine.getstate()[0])
        return known

    def stream(self, ids):
        """Texts that become certain with each id; the rest at the end."""
        held, moves = b"", self.moves
        for i in ids:
            known = moves.get((held, i))
            if known is None:
                known = self._move(held, i)
            text, held = known
            yield text
        if held:
            yield held.decode("utf-8", self.errors)

    def __call__(self, ids) -> str:
        return "".join(self.stream(ids))


_made: dict[bytes, tuple[Encoder, StreamDecoder]] = {}
keeps("bpe", _made.clear)


def _machines(vocabulary: bytes, pattern: str) -> tuple[Encoder, StreamDecoder]:
    """This worker's machines for a vocabulary; kept between tasks."""
    key = hashlib.sha256(vocabulary + pattern.encode()).digest()
    if key not in _made:
        ranks = load_ranks(vocabulary)
        _made.clear()
        _made[key] = Encoder(ranks, pattern), StreamDecoder(ranks)
    return _made[key]


def read_vocabulary(path: str, most: int = 64 << 20) -> bytes:
    """A vocabulary file, which is sent to every worker; refused above ``most`` bytes."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return data


def encode_documents(documents: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every whole text."""
    sent = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(rows):
        only("bpe")
        encode, _ = _machines(sent.value, pattern)
        for b in small_batches(rows):
            ids = [encode(t) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the decoded text."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(rows):
        only("bpe")
        _, decode = _machines(sent.value, pattern)
        for b in small_batches(rows):
            texts = [decode(memoryview(x or b"").cast("I")) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")

"""Byte-level BPE: merges compiled into a lazily determinised transducer, and a streaming decoder.

The transducer reads bytes and emits tokens as soon as no continuation can change them. Two facts make it finite:
the encoding of any prefix is the encoding of a shorter prefix plus one token, and a sequence of tokens is the
encoding of its bytes exactly if every neighbouring pair is (`_merged_apart`). So the last token of a position is found
among the tokens that end there, and a position can start a token later only while the bytes since it open a longer
token ("live"). What all live positions share of their histories is emitted. A state is the last emitted token and
the bytes after it; states and moves are made when first needed and kept up to a number.
"""

import base64
import gc
import hashlib
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from rulelens.llm.texts import slices

# Long texts are worked off in pieces of about so many characters.
SEGMENT_CHARS = 1 << 20
MAX_STATES = 60_000
# Chunks that are remembered; pre-tokens and pairs of tokens, in each of two generations.
MAX_CHUNKS = 1_000_000
MAX_WORDS = 60_000
MAX_PAIRS = 120_000
BYTES = [bytes((byte,)) for byte in range(256)]
# Texts encoded together, in bytes: chunks they share are looked up once.
TOGETHER_BYTES = 8 << 20
# Ids decoded at a time.
DECODE_IDS = 1 << 16
NEVER = 1 << 60


def read_ranks(path):
    """Token bytes by rank from a rank file (base64 token and rank per line)."""
    with open(path, "rb") as lines:
        return parse_ranks(lines.read())


def parse_ranks(data):
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class State:
    """What the transducer knows between two bytes.

    `pending`: the bytes after the last emitted token; `lasts[p]`: last token of the encoding up to pending position
    p (None at the start of a pre-token, False where the last emitted token is no part of it); `live`: positions
    at which a later token can start; `number`: place in the table of moves.
    """

    __slots__ = ("pending", "lasts", "live", "number", "tail")

    def __init__(self, pending, lasts, live, number):
        self.pending, self.lasts, self.live, self.number, self.tail = pending, lasts, live, number, None


class Transducer:
    """Lazily determinised BPE transducer over one pre-token at a time.

    States and moves are kept up to `max_states`. A pre-token that leaves them after that is finished by the same rules without
    making states.
    """

    def __init__(self, ranks, max_states=MAX_STATES):
        self.ranks = ranks
        self.codes = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        # One object a token, however many states hold it.
        self.tokens = {token: token for token in ranks}
        # Byte strings that some longer token starts with.
        self.openings = {token[:k] for token in ranks for k in range(1, len(token))}
        self.max_states = max_states
        self.edges, self.prefixes = {}, {}
        self.neighbours = Recent(lambda pair: self._merged_apart(*pair), MAX_PAIRS)
        self.start = State(b"", (None,), (0,), 0)
        self.states, self.moves = {(None, b""): self.start}, {}

    def merge(self, data, watch=None):
        """Encoding by the definition: merge the adjacent pair of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            costs = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            low = min(costs)
            if low == NEVER:
                break
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if watch is not None:
                watch(low, parts)
        return parts

    def _edges(self, token):
        """What stands at the token's two ends while it is merged: (part, rank of the merge that takes it up)."""
        known = self.edges.get(token)
        if known is None:
            sides = [[token[:1], []], [token[-1:], []]]

            def watch(rank, parts):
                for side, part in zip(sides, (parts[0], parts[-1])):
                    if part != side[0]:
                        side[1].append((side[0], rank))
                        side[0] = part

            self.merge(token, watch)
            known = self.edges[token] = tuple([*steps, (part, NEVER)] for part, steps in sides)
        return known

    def _merged_apart(self, left, right):
        """Whether two neighbouring tokens stay as they are when their bytes are encoded together.

        They do unless the parts that meet at the boundary are merged before either is taken up on its own side;
        at equal rank the merge further left comes first.
        """
        ends, starts = self._edges(left)[1], self._edges(right)[0]
        i = j = 0
        while True:
            (a, gone_a), (b, gone_b) = ends[i], starts[j]
            cross = self.ranks.get(a + b, NEVER)
            if cross < gone_a and cross <= gone_b and cross < NEVER:
                return False
            if gone_a <= gone_b:
                if gone_a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _step(self, state, byte):
        """Read one byte: the next state, with the tokens that are now certain if there are any."""
        pending, lasts, openings, stable = state.pending + BYTES[byte], state.lasts, self.openings, self.neighbours
        size, last, live, paths = len(pending), False, [], 0
        for start in state.live:
            token = pending[start:]
            if last is False and token in self.codes:
                left = lasts[start]
                if left is None or stable((left, token)):
                    last = self.tokens[token]
            if token in openings:
                live.append(start)
                paths |= 1 << start
        lasts += (last,)
        if last is not False:
            live.append(size)
            paths |= 1 << size
        # Walk the histories of all live positions, the furthest first, back to where they meet.
        while paths & (paths - 1):
            far = paths.bit_length() - 1
            paths ^= 1 << far
            paths |= 1 << (far - len(lasts[far]))
        meet, sure = paths.bit_length() - 1, None
        if meet:
            sure = self._history(lasts, meet)
            pending, lasts, live = pending[meet:], lasts[meet:], [p - meet for p in live]
        key = (lasts[0], pending)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = State(pending, lasts, tuple(live), len(self.states))
        move = self.moves[state.number << 8 | byte] = (target, sure) if sure else target
        return move

    def _history(self, lasts, at):
        """Packed tokens that lead to a position."""
        out = b""
        while at > 0:
            out = self.codes[lasts[at]] + out
            at -= len(lasts[at])
        return out

    def _shorter(self, token):
        """The longest token that a token starts with, itself left out; None for single bytes."""
        known = self.prefixes.get(token, False)
        if known is False:
            known = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.codes), None)
            self.prefixes[token] = known
        return known

    def _finish(self, state, rest):
        """Packed tokens of a state's pending bytes and the rest of the pre-token, without making states on the way.

        Takes the longest token that may stand after the one before, and goes back a token where none may. A prefix has one
        encoding only, so a place that led nowhere is not tried again.
        """
        codes, openings, stable, shorter = self.codes, self.openings, self.neighbours, self._shorter
        data, at, size = state.pending + rest, 0, len(state.pending) + len(rest)
        tokens, dead, token = [state.lasts[0]], set(), None
        while at < size:
            if token is None:  # the longest token from here
                end = at + 1
                token = part = data[at:end]
                while part in openings and end < size:
                    end += 1
                    part = data[at:end]
                    if part in codes:
                        token = part
            left = tokens[-1]
            while token is not None and (at + len(token) in dead or not (left is None or stable((left, token)))):
                token = shorter(token)
            if token is None:
                token = tokens.pop()
                dead.add(at)
                at -= len(token)
                token = shorter(token)
                while token is None:  # nothing else from there either
                    token = tokens.pop()
                    dead.add(at)
                    at -= len(token)
                    token = shorter(token)
            else:
                tokens.append(token)
                at += len(token)
                token = None
        return b"".join([codes[token] for token in tokens[1:]])

    def run(self, data):
        """Ids of one pre-token, packed as little-endian unsigned 32-bit integers."""
        whole = self.codes.get(data)
        if whole is not None:
            return whole
        out, state, get = b"", self.start, self.moves.get
        for at, byte in enumerate(data):
            move = get(state.number << 8 | byte)
            if move is None:
                if len(self.states) + len(self.moves) >= self.max_states:
                    return out + self._finish(state, data[at:])
                move = self._step(state, byte)
            if move.__class__ is State:
                state = move
            else:
                state, sure = move
                out += sure
        if state.tail is None:
            state.tail = self._history(state.lasts, len(state.pending))
        return out + state.tail


class Recent:
    """A memo of bounded size: two generations, the older is dropped when the younger is full."""

    def __init__(self, make, size):
        self.make, self.size = make, size
        self.young, self.old = {}, {}

    def __call__(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            if len(self.young) >= self.size:
                self.young, self.old = {}, self.young
            self.young[key] = value
        return value


class Chunks:
    """Packed ids of chunks seen lately, as arrays sorted by 128 bits of hash: far smaller than a dictionary of as many."""

    def __init__(self, size):
        self.size = size
        self.clear()

    def clear(self):
        self.keys = np.zeros((0, 2), np.uint64)
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    @staticmethod
    def hashes(chunks):
        return np.frombuffer(b"".join([xxh3_128_digest(chunk) for chunk in chunks]), ">u8").astype(np.uint64).reshape(-1, 2)

    def find(self, keys):
        """Place of each key, -1 where it is not there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys[:, 0], keys[:, 0]), len(self.keys) - 1)
        return np.where((self.keys[at] == keys).all(axis=1), at, -1)

    def add(self, keys, packed):
        """Put in new keys; if there are too many, what was there is dropped."""
        if len(self.keys) + len(keys) > self.size:
            self.clear()
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(packed), "<u4")])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys[:, 0], kind="stable")
        self.keys = keys[order]
        self.starts, self.sizes = (np.concatenate(pair)[order] for pair in ((self.starts, starts), (self.sizes, sizes)))


class Encoder:
    """Encodes whole texts: pre-tokens by the pattern, each through the transducer.

    `cut_at_spaces` says that with this pattern a space between two characters that are no white space always starts a
    pre-token. Texts are then cut there, and what stands between two such spaces (a chunk) is encoded once for all texts of a
    slice and looked up among the chunks seen lately.
    """

    def __init__(self, ranks, pattern, max_chunks=MAX_CHUNKS, cut_at_spaces=True):
        self.machine = Transducer(ranks)
        self.regex, self.cut = regex.compile(pattern), cut_at_spaces
        self.find = self.regex.findall
        self.word = Recent(lambda word: self.machine.run(word.encode()), min(max_chunks, MAX_WORDS))
        # Of a chunk after a space, where both its ends are no white space: for single texts, and for many together.
        self.chunk = Recent(lambda chunk: self._pack(" " + chunk), min(max_chunks, MAX_WORDS))
        self.chunks = Chunks(max_chunks)

    def _pack(self, piece):
        return b"".join(map(self.word, self.find(piece)))

    def _joined(self, chunks):
        """Ids of chunks of which some are empty or have white space at an end: join where a space is no safe cut."""
        out, piece, plain = [], chunks[0], False
        for before, chunk in zip(chunks, chunks[1:]):
            if before and chunk and not before[-1].isspace() and not chunk[0].isspace():
                out.append(self.chunk(piece) if plain else self._pack(piece))
                piece, plain = chunk, True
            else:
                piece, plain = (" " if plain else "") + piece + " " + chunk, False
        out.append(self.chunk(piece) if plain and not piece[-1].isspace() else self._pack(" " * plain + piece))
        return b"".join(out)

    def pieces(self, text):
        """Packed ids of a text, in parts of bounded size."""
        at, size = 0, len(text)
        while at < size:
            end = min(size, at + SEGMENT_CHARS)
            while end < size:  # go on to the next safe cut
                end = text.find(" ", end)
                if end < 0:
                    end = size
                elif end + 1 < size and not (text[end - 1].isspace() or text[end + 1].isspace()):
                    break
                else:
                    end += 1
            yield self._piece(text[at:end])
            at = end

    def _piece(self, text):
        chunks = text.split(" ")
        found = list(map(self.chunk.young.get, chunks))
        found[0] = None
        for i, packed in enumerate(found):
            if packed is None:
                chunk = chunks[i]
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    return self._joined(chunks)
                found[i] = self.chunk(chunk) if i else self._pack(chunk)
        return b"".join(found)

    def encode(self, text):
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cut:
            return b"".join(self.word(match.group()) for match in self.regex.finditer(text))
        return b"".join(self.pieces(text))

    def encode_all(self, texts):
        """As `encode`, of an Arrow column of texts without nulls."""
        if not self.cut or len(texts) == 1:
            return pa.array([self.encode(text) for text in texts.to_pylist()], pa.binary())
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        starts = np.concatenate([[0], ends[:-1]])
        # A text in which some space is no safe cut is encoded by itself.
        loose = np.array([not chunk or chunk[0].isspace() or chunk[-1].isspace() for chunk in known], bool)
        alone = np.add.reduceat(loose[code], starts) > 0
        first = np.zeros(len(code), bool)
        first[starts] = True
        text_of = np.repeat(np.arange(len(starts)), ends - starts)
        needed = np.zeros(len(known), bool)
        needed[code[~first & ~alone[text_of]]] = True
        wanted = np.flatnonzero(needed)
        keys = Chunks.hashes([known[i] for i in wanted])
        at = self.chunks.find(keys)
        if (at < 0).any():
            fresh = wanted[at < 0] if len(self.chunks.keys) + (at < 0).sum() <= self.chunks.size else wanted
            self.chunks.add(keys[np.searchsorted(wanted, fresh)], [self._pack(" " + known[i]) for i in fresh])
            at = self.chunks.find(keys)
        # A text's first chunk has no space before it; it stands at its own place behind all others.
        own = []
        for i, text in enumerate(texts.to_pylist() if alone.any() else [None] * len(starts)):
            own.append(self.encode(text) if alone[i] else self._pack(known[code[starts[i]]]))
        sizes, places = np.zeros(len(known) + len(own), np.int64), np.zeros(len(known) + len(own), np.int64)
        sizes[wanted], places[wanted] = self.chunks.sizes[at], self.chunks.starts[at]
        sizes[len(known) :] = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        places[len(known) :] = len(self.chunks.ids) + np.cumsum(sizes[len(known) :]) - sizes[len(known) :]
        flat = np.concatenate([self.chunks.ids, np.frombuffer(b"".join(own), "<u4")])
        code = code.astype(np.int64)
        code[starts] = len(known) + np.arange(len(starts))
        code, text_of = code[first | ~alone[text_of]], text_of[first | ~alone[text_of]]
        many = sizes[code]
        at = np.repeat(places[code] - (np.cumsum(many) - many), many)
        at += np.arange(len(at))
        ids = flat[at]
        offsets = np.concatenate([[0], 4 * np.cumsum(np.bincount(text_of, many, len(starts)).astype(np.int64))]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


class Utf8Stream:
    """Incremental UTF-8 decoder: holds back the bytes of a character that is not complete yet."""

    def __init__(self):
        self.tail = b""

    def push(self, data):
        data = self.tail + data
        cut = len(data)
        for back in range(1, min(4, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:  # a lead byte says how many bytes its character has
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                cut -= back if need > back else 0
                break
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self):
        rest, self.tail = self.tail, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks):
        self.tokens = {rank: token for token, rank in ranks.items()}

    def decode(self, packed):
        """Text of packed ids, decoded piece by piece."""
        stream, take = Utf8Stream(), self.tokens.__getitem__
        ids = memoryview(packed).cast("I") if sys.byteorder == "little" else array("I", packed)
        out = [
            stream.push(b"".join(map(take, ids[at : at + DECODE_IDS]))) for at in range(0, len(ids), DECODE_IDS)
        ]
        return "".join([*out, stream.finish()])


_MACHINES = {}


def _machines(data, pattern, cut_at_spaces):
    """Encoder and decoder of a worker process, kept from task to task."""
    key = hashlib.sha256(data + pattern.encode()).digest(), cut_at_spaces
    if key not in _MACHINES:
        _MACHINES.clear()
        ranks = parse_ranks(data)
        _MACHINES[key] = Encoder(ranks, pattern, cut_at_spaces=cut_at_spaces), Decoder(ranks)
    return _MACHINES[key]


def encode_decode(docs, ranks, pattern, id_col="doc_id", text_col="text", cut_at_spaces=False):
    """Encode every text and decode the ids again: `(id, ids, decoded)`.

    `ranks` is the content of a rank file (bytes), which bounds what is broadcast. `ids` is binary: little-endian
    unsigned 32-bit integers, see `unpack_ids`. No special tokens: their strings are ordinary text. A null or empty
    text has no ids and decodes to an empty text. Rows map one to one, repeated ones and null ids included; other
    columns are not looked at. `cut_at_spaces` is much faster and right only for patterns that always start a match at a
    space between two characters that are no white space.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    data = docs.sparkSession.sparkContext.broadcast(ranks)

    def convert(batches):
        encoder, decoder = _machines(data.value, pattern, cut_at_spaces)
        gc.disable()  # states refer to no states: nothing here is a cycle, and there are very many of them to look through
        try:
            for batch in batches:
                for at, n in slices(batch, "text", TOGETHER_BYTES):
                    ids = encoder.encode_all(batch["text"].slice(at, n))
                    decoded = pa.array([decoder.decode(packed.as_buffer()) for packed in ids], pa.string())
                    yield pa.RecordBatch.from_arrays([batch["id"].slice(at, n), ids, decoded], names=["id", "ids", "decoded"])
        finally:
            gc.enable()

    schema = T.StructType([*rows.schema.fields[:1], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    out = rows.mapInArrow(convert, schema)
    return out.withColumnRenamed("id", id_col)


def encode(docs, ranks, pattern, id_col="doc_id", text_col="text", cut_at_spaces=False):
    """`(id, ids)` with ids as an array of integers."""
    packed = encode_decode(docs, ranks, pattern, id_col, text_col, cut_at_spaces)
    return packed.select(id_col, unpack_ids(F.col("ids")).alias("ids"))


def unpack_ids(packed):
    """Packed ids as an array of integers."""
    digits = F.hex(packed)

    def number(i):
        at = i * 8 + 1
        parts = [digits.substr(at + k, F.lit(2)) for k in (6, 4, 2, 0)]
        return F.conv(F.concat(*parts), 16, 10).cast("bigint")

    count = (F.length(packed) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), number)).otherwise(F.array().cast("array<bigint>"))

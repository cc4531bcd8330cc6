"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding reads a piece byte by byte. After each byte the BPE encoding of the prefix has
one last token, found by testing which token may follow the last token of a shorter
prefix. A state holds those places from which a coming token may still start, each with
the last token before it, so it does not depend on the tokens further back; they are
read off the states from the piece's end back. States are made when first met and their
transitions kept, so known words cost one table step a byte. Pieces that are new in a
slice of rows are read in step, and ask together for what they share. A full table keeps
the states from which pieces have branched, and the rest is made anew where it is met
again.
"""

from __future__ import annotations

import base64
import gc
import os
import sys
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from srcgraph.llm.common import Batches, kept, map_batches, record, texts, with_id

#: Bounds of what a Python worker keeps. Results do not depend on them.
MAX_STATES = 200_000
MAX_WORDS = 400_000
MAX_PAIRS = 600_000
#: Rows, and bytes of their texts, whose ids are held and sent on together.
ROWS = 1000
BYTES = 1 << 23
#: Characters that are neither letters, numbers, white space nor an apostrophe.
ENDS = frozenset(".,;:!?")
#: Pieces that are read at once, and the bytes of the longest that is.
TOGETHER = 1 << 14
WIDE = 48
#: Bits of the last token in a place of a state.
LAST_BITS = 24
LAST = (1 << LAST_BITS) - 1


class Merges:
    """The merges that a rank file implies: which token may stand after which."""

    def __init__(self, ranks: dict[bytes, int], room: float = 1.0):
        self.most_pairs = int(MAX_PAIRS * room)
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._edges: tuple[dict[int, tuple], dict[int, tuple]] = ({}, {})
        self.pairs: dict[int, bool] = {}
        unmade = {t for t, rank in ranks.items() if not self.made(rank)}
        #: what only a whole piece can be: merges never make it
        self.ranks = {t: rank for t, rank in ranks.items() if t not in unmade}
        self.unmade = {t: ranks[t] for t in unmade}
        #: tree of the tokens' bytes: child by node and byte; token that ends at a node or -1; whether one goes on
        self.child: dict[int, int] = {}
        self.ends, self.goes_on = [-1], [True]
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                self.goes_on[node] = True
                after = self.child.setdefault(node << 8 | byte, len(self.ends))
                if after == len(self.ends):
                    self.ends.append(-1)
                    self.goes_on.append(False)
                node = after
            self.ends[node] = rank

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token that no merge makes."""
        if token not in self._parts:
            left = self._merged(self.bytes_of[token], token)
            self._parts[token] = (left[0], left[1]) if len(left) == 2 else None
        return self._parts[token]

    def _merged(self, text: bytes, below: int) -> list[int]:
        """The tokens of `text` after all merges of a rank under `below`, lowest rank first, then leftmost."""
        spans = [text[i:i + 1] for i in range(len(text))]
        while len(spans) > 1:
            best = min(
                ((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(spans, spans[1:]))),
            )
            if best[0] >= below:
                break
            spans[best[1]:best[1] + 2] = [spans[best[1]] + spans[best[1] + 1]]
        return [self.ranks[s] for s in spans]

    def made(self, token: int) -> bool:
        """Whether merges alone make the token."""
        return len(self.bytes_of[token]) == 1 or self.parts(token) is not None

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes together is just these two tokens.

        Replays, in order of rank, the merges that make the tokens at the border between
        them; a merge across the border that would come earlier rules the pair out.
        """
        if len(self.pairs) >= self.most_pairs:
            self.pairs.clear()
        lefts, rights = self._edge(left, 1), self._edge(right, 0)
        i, j = len(lefts) - 1, len(rights) - 1
        never = len(self.bytes_of)
        ok = True
        while True:
            across = self.ranks.get(self.bytes_of[lefts[i]] + self.bytes_of[rights[j]], never)
            next_left = lefts[i - 1] if i else never
            next_right = rights[j - 1] if j else never
            if across < next_left and across <= next_right:
                ok = False
                break
            if not i and not j:
                break
            if next_left <= next_right:  # of equal ranks the merge further left comes first
                i -= 1
            else:
                j -= 1
        self.pairs[left << 32 | right] = ok
        return ok

    def _edge(self, token: int, side: int) -> tuple[int, ...]:
        """The token and what stood at its first (0) or last (1) byte before each of its merges."""
        known = self._edges[side].get(token)
        if known is None:
            p = self.parts(token)
            known = self._edges[side][token] = (token,) if p is None else (token, *self._edge(p[side], side))
        return known


class Encoder:
    """The transducer for one rank file and pattern. `encode` gives what the rank file's library gives.

    room: the share of the module's bounds that the tables may fill.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: float = 1.0):
        self.merges = Merges(ranks, room)
        self.most_states, self.most_words = int(MAX_STATES * room), int(MAX_WORDS * room)
        # \s of the pattern is Unicode white space; this module's also takes in U+001C to U+001F
        self.pattern = regex.compile(pattern)
        self.length = np.ones(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = [len(token) for token in ranks]
        #: words met lately, and those met before the last time this table was full
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        #: next state by state << 8 | byte
        self.steps: dict[int, int] = {}
        self._state((0,))

    def _state(self, places: tuple[int, ...]) -> int:
        """A state: each live place, earliest first, as node of the token tree << LAST_BITS | last token + 1.

        The last place is the end of what was read, so its last token is the one that ends there.
        """
        number = self.ids.setdefault(places, len(self.states))
        if number == len(self.states):
            self.states.append(places)
        return number

    def _last(self, state: int, byte: int) -> int:
        """The token that ends with this byte if the piece does; the state after it need not be made."""
        step = self.steps.get(state << 8 | byte)
        if step is not None:
            return self.states[step][-1] - 1
        child, ends, pairs = self.merges.child, self.merges.ends, self.merges.pairs
        for place in self.states[state]:
            node = child.get(place >> LAST_BITS << 8 | byte)
            if node is not None and (token := ends[node]) >= 0:
                last = (place & LAST) - 1
                fits = last < 0 or pairs.get(last << 32 | token)
                if fits or fits is None and self.merges.follows(last, token):
                    return token
        raise ValueError(f"no token of the vocabulary ends at byte {byte}")

    def _step(self, state: int, byte: int) -> int:
        """The next state."""
        child, ends, goes_on, pairs = self.merges.child, self.merges.ends, self.merges.goes_on, self.merges.pairs
        live, new = [], -1
        for place in self.states[state]:
            node = child.get(place >> LAST_BITS << 8 | byte)
            if node is None:
                continue
            if new < 0 and (token := ends[node]) >= 0:
                last = (place & LAST) - 1
                fits = last < 0 or pairs.get(last << 32 | token)
                if fits or fits is None and self.merges.follows(last, token):
                    new = token
            if goes_on[node]:
                live.append(node << LAST_BITS | place & LAST)
        if new < 0:
            raise ValueError(f"no token of the vocabulary ends at byte {byte}")
        live.append(new + 1)
        done = self.steps[state << 8 | byte] = self._state(tuple(live))
        return done

    def _thin(self) -> None:
        """Make room: keep the states that several bytes have led out of; all go if those are over half of the table."""
        old, steps = self.states, self.steps
        ways = Counter(key >> 8 for key in steps)
        stay = [state for state, out in ways.items() if out > 1]
        self._reset()
        if 2 * len(stay) <= self.most_states:
            number = {state: self._state(old[state]) for state in stay}
            for key, after in steps.items():
                if key >> 8 in number and after in number:
                    self.steps[number[key >> 8] << 8 | key & 255] = number[after]

    def piece(self, text: bytes) -> tuple[int, ...]:
        """The tokens of one piece: the piece itself if it is a token, else those its states lead back through."""
        rank = self.merges.ranks.get(text)
        if rank is None and self.merges.unmade:
            rank = self.merges.unmade.get(text)
        if rank is not None:
            return (rank,)
        if len(self.states) >= self.most_states:
            self._thin()
        state, steps, read = 0, self.steps, []
        for byte in text[:-1]:
            after = steps.get(state << 8 | byte)
            state = self._step(state, byte) if after is None else after
            read.append(state)
        out = [self._last(state, text[-1])]
        at = len(read) - int(self.length[out[0]])
        while at >= 0:
            out.append(self.states[read[at]][-1] - 1)
            at -= int(self.length[out[-1]])
        return tuple(out[::-1])

    def _in_step(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of pieces of at most WIDE bytes, as bytes of 32-bit numbers, all read byte by byte at once.

        Pieces in the same state that go on with the same byte ask for their step once.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")
        lengths, width = lengths[order], int(lengths.max())
        data = np.array(pieces, f"S{width}").view(np.uint8).reshape(-1, width)[order].astype(np.int64)
        longer = np.searchsorted(-lengths, -np.arange(1, width + 1), "left")  # of more than 1, 2, ... bytes
        states, get = self.states, self.steps.get
        state, read = np.zeros(len(pieces), np.int64), len(pieces)
        tokens = np.zeros((len(pieces), width), np.int64)
        for at in range(width):
            go = longer[at]
            keys, place = np.unique(state[:read] << 8 | data[:read, at], return_inverse=True)
            going = np.zeros(len(keys), bool)
            going[place[:go]] = True
            after = list(map(get, keys.tolist()))
            ends = []
            for i, goes in enumerate(going.tolist()):
                if after[i] is None:
                    key = int(keys[i])
                    if not goes:
                        after[i] = 0
                        ends.append(self._last(key >> 8, key & 255))
                        continue
                    after[i] = self._step(key >> 8, key & 255)
                ends.append(states[after[i]][-1] - 1)
            state[:go] = np.array(after, np.int64)[place[:go]]
            tokens[:read, at] = np.array(ends, np.int64)[place]
            read = go
        found = np.full((len(pieces), width), -1, np.int32)
        rows, at = np.arange(len(pieces)), lengths - 1
        for column in range(width - 1, -1, -1):
            last = tokens[rows, at]
            found[rows, column] = last
            at = at - self.length[last]
            rows, at = rows[at >= 0], at[at >= 0]
            if not len(rows):
                break
        back = np.empty(len(pieces), np.int64)
        back[order] = np.arange(len(pieces))
        found = found[back]
        cuts = [0, *((found >= 0).sum(axis=1).cumsum() * 4).tolist()]
        packed = found[found >= 0].tobytes()
        return [packed[i:j] for i, j in zip(cuts, cuts[1:])]

    def _encoded(self, pieces: list[str]) -> Iterator[bytes]:
        """The tokens of each piece, as bytes of 32-bit numbers."""
        ranks, unmade = self.merges.ranks, self.merges.unmade
        data = [p.encode() for p in pieces]
        found = [ranks.get(d, unmade.get(d)) if unmade else ranks.get(d) for d in data]
        short = sorted({d for d, rank in zip(data, found) if rank is None and len(d) <= WIDE})
        known: dict[bytes, bytes] = {}
        for i in range(0, len(short), TOGETHER):
            if len(self.states) >= self.most_states:
                self._thin()
            known.update(zip(short[i:i + TOGETHER], self._in_step(short[i:i + TOGETHER])))
        for d, rank in zip(data, found):
            if rank is not None:
                yield rank.to_bytes(4, sys.byteorder)
            else:
                yield known[d] if len(d) <= WIDE else np.array(self.piece(d), np.int32).tobytes()

    def _keep(self, text: str, ids: bytes) -> None:
        """Kept unless the stretch is long or ends in white space."""
        if len(text) <= 64 and not text[-1].isspace():
            if len(self.words) >= self.most_words:
                self.older, self.words = self.words, {}
            self.words[text] = ids

    def _stretches(self, texts_: list[str]) -> list[bytes]:
        """The ids of stretches of text that are not in the table of words, as bytes of 32-bit numbers."""
        words, older = self.words, self.older
        pieces_of: list[tuple[list[str], bool] | None] = []
        ids: dict[str, bytes | None] = {}
        for text in texts_:
            if older and (known := older.get(text)) is not None:
                ids[text] = known
                pieces_of.append(([text], True))
                continue
            # a mark after a letter is a piece of its own
            body = text[:-1] if text[-1] in ENDS and len(text) > 2 and text[-2].isalpha() else text
            letters = body[1:] if body[0] == " " else body
            pieces = [body] if letters.isalpha() else self.pattern.findall(body)
            if body is not text:
                pieces.append(text[-1])
            # kept if the longer part of two is a word met before
            pieces_of.append((pieces, len(pieces) == 1 or len(pieces) == 2 and pieces[0] in words))
            for piece in pieces:
                if piece not in ids:
                    ids[piece] = words.get(piece) or older.get(piece)
        new = [piece for piece, known in ids.items() if known is None]
        for piece, known in zip(new, self._encoded(new)):
            ids[piece] = known
            self._keep(piece, known)
        out = []
        for text, (pieces, keep) in zip(texts_, pieces_of):
            known = ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces])
            if keep:
                self._keep(text, known)
            out.append(known)
        return out

    def encode_all(self, texts_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has.

        A space after a character that is not white space always starts a piece, so texts fall into
        stretches that the pattern never joins. Each stretch that several places share is looked up once.
        """
        if not len(texts_):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        split = pc.split_pattern(texts_, " ")
        starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        parts, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        first = np.zeros(len(codes), bool)
        first[starts] = True
        # what ends in white space may join what follows; before a leading space there is nothing
        open_ = np.array([not p or p[-1].isspace() for p in parts])[codes]
        open_[starts] &= np.array([parts[c] != "" for c in codes[starts]])
        joins = np.zeros(len(codes), bool)
        joins[1:] = open_[:-1]
        joins &= ~first
        own = first | open_ & ~joins
        plain = np.zeros(len(parts), bool)
        plain[codes[~(own | joins)]] = True
        spaced = [" " + p for p in parts]
        ids = list(map(self.words.get, spaced))
        which = codes.astype(np.int64)
        which[joins] = len(ids)
        ids.append(b"")
        spaced.append("")
        for at in np.flatnonzero(own).tolist():
            end = at + 1
            while end < len(codes) and joins[end]:
                end += 1
            which[at] = len(ids)
            spaced.append(" " * (not first[at]) + " ".join([parts[c] for c in codes[at:end]]))
            ids.append(self.words.get(spaced[-1]) if spaced[-1] else b"")
        missing = [i for i, known in enumerate(ids) if known is None and (i >= len(parts) or plain[i])]
        for i, known in zip(missing, self._stretches([spaced[i] for i in missing])):
            ids[i] = known
        ids = [known or b"" for known in ids]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        known = np.frombuffer(b"".join(ids), np.int32)
        counts = lengths[which]
        shift = (lengths.cumsum() - lengths)[which] - (counts.cumsum() - counts)
        return known[np.repeat(shift, counts) + np.arange(int(counts.sum()))], np.add.reduceat(counts, starts)

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()


class Utf8Machine:
    """Incremental UTF-8: bytes in any cuts in, text out; a broken sequence becomes one U+FFFD.

    State: bytes of the open sequence, how many are still to come, and the range of the next.
    """

    def __init__(self):
        self.open, self.left, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        plain = 0
        i = 0
        while i < len(data):
            byte = data[i]
            if self.left:
                if self.low <= byte <= self.high:
                    self.open += data[i:i + 1]
                    self.left -= 1
                    self.low, self.high = 0x80, 0xBF
                    i += 1
                    if not self.left:
                        out.append(self.open.decode())
                        self.open = b""
                else:  # the byte starts anew
                    out.append("�")
                    self.open, self.left = b"", 0
                plain = i
                continue
            if byte < 0x80:
                i += 1
                if i == len(data) or data[i] >= 0x80:
                    out.append(data[plain:i].decode("ascii"))
                    plain = i
                continue
            i += 1
            plain = i
            if 0xC2 <= byte <= 0xF4:
                self.left = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                self.open = bytes([byte])
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What an unfinished sequence at the end of the stream becomes."""
        rest = "�" if self.left else ""
        self.__init__()
        return rest


class Decoder:
    """Streaming decode of token ids: the state machine steps from token to token.

    Tokens that are whole characters leave the machine in its resting state, so their
    texts are kept and texts that consist of them need no step.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.text_of: dict[int, str] = {}
        for token, data in bytes_of.items():
            machine = Utf8Machine()
            text = machine.feed(data)
            if not machine.left and "�" not in text:
                self.text_of[token] = text
        self.whole = pa.array(map(self.text_of.get, range(max(bytes_of) + 1)), pa.large_string())
        self.machine = Utf8Machine()

    def feed(self, ids: list[int]) -> str:
        out = []
        known, machine = self.text_of, self.machine
        for token in ids:
            text = known.get(token) if not machine.left else None
            out.append(machine.feed(self.bytes_of[token]) if text is None else text)
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        texts_ = list(map(self.text_of.get, ids))
        if None not in texts_:
            return "".join(texts_)
        return self.feed(ids) + self.machine.end()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[memoryview | bytes]:
        """The UTF-8 bytes of texts whose ids lie one after the other, each up to its end."""
        found = self.whole.take(pa.array(ids))
        broken = found.is_null().to_numpy(zero_copy_only=False) if found.null_count else None
        for at, end, data in zip(chain([0], ends), ends, stretches(found, ends)):
            yield data if broken is None or not broken[at:end].any() else self.decode(ids[at:end].tolist()).encode()


def stretches(values: pa.Array, ends: np.ndarray) -> Iterator[memoryview]:
    """The bytes of a fresh large string array, up to each end one after the other."""
    _, offsets, data = values.buffers()
    data = memoryview(data or b"")
    cuts = np.frombuffer(offsets, np.int64)[ends].tolist() if len(values) else [0] * len(ends)
    for at, end in zip([0, *cuts], cuts):
        yield data[at:end]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def tools(path: str, pattern: str, room: float = 1.0) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of this Python process for a rank file."""
    def make() -> tuple[Encoder, Decoder]:
        encoder = Encoder(read_ranks(path), pattern, room)
        return encoder, Decoder(encoder.merges.bytes_of)

    return kept(("bpe", path, pattern, room), make)


def uncollected(batches: Batches) -> Batches:
    """The batches, with the cycle collector at rest meanwhile: the tables have no cycles, but walking them takes time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield from batches
    finally:
        if was:
            gc.enable()


def slices(batches: Batches, room: float = 1.0) -> Batches:
    """The batches in slices of at most ROWS rows, and of BYTES bytes of text unless a single row has more.

    room: the share of both bounds that a slice may fill.
    """
    rows, most = max(1, int(ROWS * room)), int(BYTES * room)
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start == rows or held + size > most):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if sizes:
            yield batch.slice(start)


def as_strings(data: pa.Array) -> pa.Array:
    """Bytes as text; those that are no UTF-8 count as U+FFFD."""
    try:
        return data.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([d.decode(errors="replace") for d in data.to_pylist()], pa.string())


def _local(path: str) -> str:
    """The file as this machine has it: sent by Spark under its name, or at its own place."""
    return path if os.path.isabs(path) else SparkFiles.get(path)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True, room: float = 1.0,
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]): one row per row of `docs`, without a shuffle.

    ids: the tokens of the whole text by the ranks in `ranks_path`, a file that each
    machine has, or a name given to SparkContext.addFile. ids_sha256 is over the decimal
    ids joined by commas, decoded_sha256 over the bytes decoded from the ids. Null and
    empty texts have no tokens. room: the share of the tables' bounds that a worker may fill,
    for less memory and more time. Bytes that are no UTF-8 count as U+FFFD. Rows are taken one by one, so repeated ones repeat.
    """
    def run(batches: Batches) -> Batches:
        encoder, decoder = tools(_local(ranks_path), pattern, room)
        decimals = pa.array([f"{rank}," for rank in range(len(decoder.whole))], pa.large_string())
        for batch in slices(uncollected(batches), room):
            ids, lengths = encoder.encode_all(as_strings(batch.column("text")))
            ends = lengths.cumsum()
            columns = {
                "id": batch.column("id"), "n_tokens": pa.array(lengths, pa.int64()),
                "ids_sha256": pa.array([sha256(d[:-1]).hexdigest() for d in stretches(decimals.take(pa.array(ids)), ends)], pa.string()),
                "decoded_sha256": pa.array([sha256(d).hexdigest() for d in decoder.decode_all(ids, ends)], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    rest = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(texts(docs, id_col, text_col), run, with_id(docs, id_col, rest))


def decode_documents(
    encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "id", ids_col: str = "ids",
) -> DataFrame:
    """(id, text): the texts of token lists, decoded as streams. Null lists give empty texts."""
    def run(batches: Batches) -> Batches:
        decoder = tools(_local(ranks_path), pattern)[1]
        for batch in batches:
            schema = pa.schema([pa.field("id", batch.schema.field("id").type), pa.field("text", pa.string())])
            yield record(schema, batch.column("id"), [decoder.decode(i or []) for i in batch.column("ids").to_pylist()])

    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return map_batches(rows, run, with_id(encoded, id_col, "text string"))

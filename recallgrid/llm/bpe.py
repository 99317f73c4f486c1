"""Byte-level BPE encoding and decoding.

The merge ranks are compiled into a finite-state transducer that is determinised lazily. While a piece
is read byte by byte, the state holds, for the bytes not yet emitted, the last token of the encoding of
each prefix that a later token may still start after; a token is emitted as soon as all of those
prefixes agree on it, which takes a lookahead of at most the longest token. The next state and the
emitted tokens of (state, byte) are worked out once and kept. That rests on a property of BPE: a token
sequence is the encoding of its bytes exactly if each token is its own encoding and each two neighbours
are the encoding of their joined bytes.

Null texts count as empty; empty texts give no ids. Texts of any length are encoded whole. Rows are
independent, so repeated rows and ids give repeated results, and columns beside the named ones are
neither read nor needed.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import common

#: States kept (others are worked out anew each time), and pieces remembered in each of two generations.
STATES, PIECES, PIECE_CHARS = 90_000, 400_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_BYTE = [bytes((i,)) for i in range(256)]


class _State(dict):
    """byte -> (next state, emitted ids), filled in as bytes are met."""

    __slots__ = ("ends", "kept", "machine", "nodes", "open")

    def __missing__(self, byte: int):
        found = self.machine.step(self, byte)
        if found[0].kept:
            self[byte] = found
        return found

    @property
    def end(self) -> tuple[int, ...]:
        """What is emitted if the piece ends here."""
        if self.ends is None:
            token, length, out, at = {i: t for i, t, _ in self.nodes}, self.machine.length, [], len(self.open)
            while at > 0:
                out.append(token[at])
                at -= length[token[at]]
            self.ends = tuple(reversed(out))
        return self.ends


class Transducer:
    """Lazily determinised transducer from the bytes of a piece to its ids."""

    def __init__(self, ranks: dict[bytes, int], limit: int | None = None) -> None:
        self.ranks, self.limit = ranks, limit or STATES
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.starts = {token[:n] for token in ranks for n in range(len(token))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.grown: dict[int, tuple | None] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.misses = 0
        self.start = self.state(b"", ((0, -1, True),))

    def merge(self, piece: bytes, edges: list | None = None) -> list[int]:
        """The encoding by its definition: the lowest-ranked pair is merged, the leftmost first. edges:
        gets (first token, last token) as they change."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            if edges is not None:
                edges.append((self.ranks[parts[0]], self.ranks[parts[-1]]))
            if len(parts) == 1:
                break
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def growth(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The tokens that stand at the left and at the right edge while the token's bytes are merged, in
        order; None if they aren't merged to this token."""
        if token not in self.grown:
            edges: list = []
            own = self.merge(self.tokens[token], edges) == [token]
            self.grown[token] = tuple(tuple(dict.fromkeys(side)) for side in zip(*edges, strict=True)) if own else None
        return self.grown[token]

    def follows(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their joined bytes: merges come in the order of their ranks, so
        the boundary holds if at each step the two tokens beside it have a higher rank together (or
        none) than the next merge at either edge; of equal ranks the left one goes first."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 4 * self.limit:
                self.pairs.clear()
            if not self.growth(b) or a < 0:
                self.pairs[a, b] = found = bool(self.growth(b))
                return found
            left, right = self.growth(a)[1], self.growth(b)[0]
            i = j = 0
            found, size, never = True, self.tokens, 1 << 60
            while True:
                x = left[i + 1] if i + 1 < len(left) else never
                y = right[j + 1] if j + 1 < len(right) else never
                both = self.ranks.get(size[left[i]] + size[right[j]], never)
                if both < x and both <= y and both < never:
                    found = False
                    break
                if x == y == never:
                    break
                if x <= y:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = found
        return found

    def state(self, pending: bytes, nodes: tuple[tuple[int, int, bool], ...]) -> _State:
        """The state with these bytes not emitted yet. nodes: ascending, the prefixes of them that matter still:
        (length, last token of the prefix's encoding (-1: none), whether a token may start after it)."""
        found = self.states.get((pending, nodes))
        if found is None:
            found = _State()
            found.kept = len(self.states) < self.limit
            if found.kept:
                self.states[pending, nodes] = found
            else:
                self.misses += 1
            found.machine, found.open, found.nodes, found.ends = self, pending, nodes, None
        return found

    def step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        text, ranks, starts, pairs = state.open + _BYTE[byte], self.ranks, self.starts, self.pairs
        here, nodes = len(text), state.nodes
        last, live, found = {}, [], None
        for at, left, alive in nodes:
            last[at] = left
            if alive:
                tail = text[at:]
                if found is None:
                    token = ranks.get(tail)
                    if token is not None:
                        fit = pairs.get((left, token))
                        if fit is None:
                            fit = self.follows(left, token)
                        if fit:
                            found = token
                if tail in starts:
                    live.append(at)
        last[here] = found
        # the longest prefix that the encodings of all live prefixes go through is settled
        length = self.length
        if not live:
            cut, kept = here, ()
        else:
            paths, kept, top = set(live), [], here
            while paths:
                kept.append(top)
                paths.add(top - length[last[top]])
                top = max(paths)
                paths.remove(top)
            cut = top
        out, at = [], cut
        while at > 0:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        live.append(here)
        # prefixes that no live one goes through don't matter any more
        new = [(0, last[cut], True)] if cut in live else []
        new += [(i - cut, last[i], i in live) for i in reversed(kept)]
        return self.state(text[cut:], tuple(new)), tuple(out)

    def simulate(self, state: _State, rest: bytes) -> list[int]:
        """What follows in a state on the rest of a piece, without new states."""
        text, at = state.open + rest, len(state.open)
        ranks, starts, pairs, length = self.ranks, self.starts, self.pairs, self.length
        last = {i: t for i, t, _ in state.nodes}
        live = [i for i, _, alive in state.nodes if alive]
        for here in range(at + 1, len(text) + 1):
            still, found = [], None
            for i in live:
                tail = text[i:here]
                if found is None:
                    token = ranks.get(tail)
                    if token is not None:
                        fit = pairs.get((last[i], token))
                        if fit is None:
                            fit = self.follows(last[i], token)
                        if fit:
                            found = token
                if tail in starts:
                    still.append(i)
            last[here] = found
            still.append(here)
            live = still
        out, at = [], len(text)
        while at > 0:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if self.misses > 100 * self.limit:  # the texts have changed since the table filled up
            self.reset()
        state, out, full = self.start, [], len(self.states) >= self.limit
        for i, byte in enumerate(piece):
            if full and byte not in state:
                self.misses += 1
                return (*out, *self.simulate(state, piece[i:]))
            state, more = state[byte]
            if more:
                out += more
        return (*out, *state.end)


class _Memo(dict):
    """Pieces met lately, in two generations of bounded size."""

    def __init__(self, transducer: Transducer, limit: int | None = None) -> None:
        super().__init__()
        self.encode, self.old, self.limit = transducer.encode, {}, limit or PIECES

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece.encode())
        if len(piece) <= PIECE_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


def utf8_machine() -> list[list[int]]:
    """next state by state and byte of the machine that reads UTF-8: 0 stands between characters; 1, 2 and 3 wait for so
    many further bytes; 4 to 7 stand after E0, ED, F0 and F4, which not every byte may follow; -1: not UTF-8."""
    start = [0] * 0x80 + [-1] * 0x42 + [1] * 0x1E + [2] * 0x10 + [3] * 0x05 + [-1] * 0x0B
    start[0xE0], start[0xED], start[0xF0], start[0xF4] = 4, 5, 6, 7
    rows = [start]
    for low, high, then in ((0x80, 0xBF, 0), (0x80, 0xBF, 1), (0x80, 0xBF, 2), (0xA0, 0xBF, 1), (0x80, 0x9F, 1), (0x90, 0xBF, 2), (0x80, 0x8F, 2)):
        rows.append([then if low <= byte <= high else -1 for byte in range(256)])
    return rows


_UTF8 = utf8_machine()


def pending(held: bytes, more: bytes) -> bytes:
    """The bytes of a character begun but not complete after `held` (likewise) and `more`. A byte that no character
    goes on with ends the one begun, and is read again as a first byte."""
    data, state, since = held + more, 0, 0
    for at, byte in enumerate(data):
        was, state = state, _UTF8[state][byte]
        if state < 0:
            state = max(0, _UTF8[0][byte]) if was else 0
            since = at
        if state == 0:
            since = at + 1
        elif was == 0:
            since = at
    return data[since:]


class StreamDecoder:
    """Ids in, text out, in chunks of any size. The UTF-8 machine runs token by token: what a token does to a
    character begun before it is worked out byte by byte once and kept; a character cut between chunks waits
    for its last byte. What isn't UTF-8 becomes U+FFFD."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.held = codec, b""

    def feed(self, ids: Iterable[int]) -> str:
        own, held, ids = self.codec, self.held, list(ids)
        if held or not own.partial.isdisjoint(ids):
            partial, moves = own.partial, own.moves
            for i in ids:
                if held or i in partial:
                    after = moves.get((held, i))
                    if after is None:
                        after = moves[held, i] = pending(held, own.bytes[i])
                    held = after
        data = self.held + own.decode(ids)
        self.held = held
        return data[: len(data) - len(held)].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str, states: int | None = None, pieces: int | None = None) -> None:
        self.transducer = Transducer(read_ranks(path), states)
        self.split = regex.compile(pattern).findall
        self.memo = _Memo(self.transducer, pieces)
        top = max(self.transducer.tokens) + 1
        self.bytes = [self.transducer.tokens.get(i, b"") for i in range(top)]
        self.names = [str(i) for i in range(top)]
        #: Tokens that don't end with a whole character when they begin with one; moves of the UTF-8 machine by them.
        self.partial = frozenset(i for i, t in enumerate(self.bytes) if not t.isascii() and pending(b"", t))
        self.moves: dict[tuple[bytes, int], bytes] = {}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def spell(self, ids: Iterable[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str, states: int | None = None, pieces: int | None = None) -> Codec:
    """The codec of this process: tables and states live as long as the worker. states, pieces: how many of
    them it keeps, if not the usual number."""
    key = (path, pattern, states, pieces)
    if key not in _codecs:
        gc.set_threshold(100_000, 50, 1000)  # the tables are large and hold no garbage
        _codecs[key] = Codec(*key)
    return _codecs[key]


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    return (x.as_py() or "" for x in batch.column(1))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", states: int | None = None, pieces: int | None = None) -> DataFrame:
    """(id, ids array<int>) of every whole text; states, pieces: bounds of a worker's tables."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("bpe", _codecs.clear)
        own = codec(path, pattern, states, pieces)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(x) for x in _texts(batch)], pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(common.trimmed(run), f"`{id_col}` {kind}, ids array<int>")


def _streamed(own: Codec, ids: list[int] | None) -> Iterator[str]:
    """The text of the ids, decoded in chunks."""
    stream = StreamDecoder(own)
    for i in range(0, len(ids or ()), 4096):
        yield stream.feed(ids[i : i + 4096])
    yield stream.finish()


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of (id, ids), decoded in chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("bpe", _codecs.clear)
        own = codec(path, pattern)
        for batch in batches:
            texts = ["".join(_streamed(own, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, "ids").mapInArrow(common.trimmed(run), f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes the ids again, keeping counts and digests of both: (id,
    n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the text, decoded in chunks, as UTF-8)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("bpe", _codecs.clear)
        own = codec(path, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            rows = []
            for text in _texts(batch):
                ids = own.encode(text)
                rows.append((len(ids), sha(own.spell(ids).encode()), sha("".join(_streamed(own, ids)).encode())))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(common.trimmed(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

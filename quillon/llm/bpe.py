"""Byte-level BPE by a lazily determinised finite-state transducer.

Merging a byte string by ranks leaves a token sequence in which every neighbouring pair is *stable*: merging the
bytes of the two tokens alone gives those two tokens back. The sequence that ends at each byte position is thereby
fixed by its last token, so an encoder can read bytes from left to right. A state of the transducer holds the
positions from which some vocabulary entry may still be growing (trie node, last token before it); reading a byte gives
the next state and the token that ends the sequence here, should the text be cut here. A token is final once no older
position is still growing: no vocabulary entry is longer than L bytes, so it waits for fewer than L further bytes, and
walking back from there over the tokens' lengths emits what is certain. States and transitions are made when first
needed and kept in a bounded table.

Decoding joins the tokens' bytes; `Utf8Stream` turns chunks of bytes into text by an incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import documents, held, slices

#: Lead byte range -> continuation bytes wanted, lowest and highest first continuation byte (RFC 3629).
UTF8_LEADS = (
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)
_LEAD = {b: rule[2:] for rule in UTF8_LEADS for b in range(rule[0], rule[1] + 1)}


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes single pieces (one match of the pre-tokenising pattern each) of bytes to ranks."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 120_000):
        self.ranks, self.max_states = ranks, max_states
        # pairs are kept as one integer: (trie node, last token + 1), (state, token), (token, token)
        self.shift = (max(ranks.values(), default=0) + 1).bit_length()
        self.child: dict[int, int] = {}
        self.depth = [0]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = rank
        self.inner = bytearray(len(self.depth))
        for key in self.child:
            self.inner[key >> 8] = 1
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length_of = {rank: len(token) for token, rank in ranks.items()}
        if any(bytes((b,)) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes, so it cannot encode every text")
        self.whole: dict[int, bool] = {}
        self.stable: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, ...]] = [(0,)]
        self.ids = {self.states[0]: 0}
        self.moves: dict[int, int] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The defining procedure: again and again join the leftmost pair of the lowest rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _usable(self, last: int, token: int) -> bool:
        """Whether token can follow last (-1: stand first) in a merged sequence."""
        if (ok := self.whole.get(token)) is None:
            ok = self.whole[token] = self.merge(self.bytes_of[token]) == [token]
        if last < 0 or not ok:
            return ok
        key = last << self.shift | token
        if (ok := self.stable.get(key)) is None:
            if len(self.stable) > 300_000:
                self.stable.clear()
            ok = self.stable[key] = self.merge(self.bytes_of[last] + self.bytes_of[token]) == [last, token]
        return ok

    def _move(self, state: int, byte: int) -> int:
        """The next state and the token that ends the sequence after this byte."""
        live, ended, child, token_at, shift = [], -1, self.child, self.token_at, self.shift
        for pair in self.states[state]:
            node = pair >> shift
            if (to := child.get(node << 8 | byte)) is not None:
                after = pair - (node << shift)
                if self.inner[to]:
                    live.append(to << shift | after)
                if ended < 0 and (token := token_at[to]) >= 0 and self._usable(after - 1, token):
                    ended = token
        if ended < 0:
            raise ValueError("no stable sequence ends here: these ranks do not come from merges")
        live.append(ended + 1)
        made = tuple(live)
        if (to := self.ids.get(made)) is None:
            to = self.ids[made] = len(self.states)
            self.states.append(made)
        move = self.moves[state << 8 | byte] = to << shift | ended
        return move

    def encode(self, piece: bytes, block: int = 1 << 16) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._forget()
        done: list[int] = []
        ends: list[int] = []  # for each byte that is not emitted, the token that would end after it
        state, step, shift = 0, self._move, self.shift
        mask = (1 << shift) - 1
        for start in range(0, len(piece), block):
            if start:  # only pieces as long as a text
                state = self._emit(ends, done, state)
            find, add = self.moves.get, ends.append
            for byte in piece[start : start + block]:
                move = find(state << 8 | byte) or step(state, byte)  # never 0, as no move leads to the first state
                state = move >> shift
                add(move & mask)
        return done + self._back(ends, len(ends))

    def _back(self, ends: list[int], to: int) -> list[int]:
        """The tokens of ends[:to]."""
        out, length = [], self.length_of
        while to:
            token = ends[to - 1]
            out.append(token)
            to -= length[token]
        out.reverse()
        return out

    def _emit(self, ends: list[int], done: list[int], state: int) -> int:
        """Moves to done what every growing position has in common, and tidies up the tables; the state to go on with."""
        paths = [self._back(ends, len(ends) - self.depth[pair >> self.shift]) for pair in self.states[state]]
        sure = 0
        while all(len(p) > sure and p[sure] == paths[0][sure] for p in paths):
            sure += 1
        done += paths[0][:sure]
        del ends[: sum(len(self.bytes_of[t]) for t in paths[0][:sure])]
        if len(self.states) > self.max_states:
            kept = self.states[state]
            self._forget()
            state = self.ids.setdefault(kept, len(self.states))
            self.states += [kept] * (state == len(self.states))
        return state


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; when full, forgets what was not asked for again."""

    def __init__(self, transducer: Transducer, most: int):
        super().__init__()
        self.transducer, self.most, self.older = transducer, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.pop(piece, None)) is None:
            ids = self.transducer.encode(piece.encode())
            ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Utf8Stream:
    """Chunks of bytes in, text out; bytes of a character that is not over wait for the next chunk."""

    def __init__(self, errors: str = "strict"):
        self.errors, self.waiting = errors, b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that is not over."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead in _LEAD:
                wanted, low, high = _LEAD[lead]
                if back > wanted:
                    return 0
                rest = data[len(data) - back + 1 :]
                return back if not rest or low <= rest[0] <= high else 0
            if not 0x80 <= lead <= 0xBF:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data) - self._open_tail(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", self.errors)

    def finish(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", self.errors)


class Codec:
    """A vocabulary and a pre-tokenising pattern: texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 240_000):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.transducer, most_pieces)
        self.token_bytes = self.transducer.bytes_of

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        """One codec for a vocabulary and worker process."""
        return held(("bpe", path, pattern), lambda: cls(read_ranks(path), pattern))

    def encode_bytes(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_stream(self, chunks: Iterable[Iterable[int]], errors: str = "strict") -> Iterator[str]:
        """Text as the ids come; a character that is spread over chunks comes out when it is whole."""
        stream = Utf8Stream(errors)
        for ids in chunks:
            if piece := stream.feed(self.decode_bytes(ids)):
                yield piece
        if piece := stream.finish():
            yield piece

    def decode(self, ids: np.ndarray, chunk: int = 1 << 14) -> str:
        return "".join(self.decode_stream(ids[i : i + chunk].tolist() for i in range(0, len(ids), chunk)))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id long, ids binary (little-endian unsigned 32-bit) of each document.

    A null or empty text has no ids. Rows that repeat each give a row, null doc_ids stay null, further columns are
    left out, an empty table gives an empty one. A text of any length is one row: memory is in proportion to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in slices(batches):
            ids = [codec.encode_bytes(t) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id long, text string of each row of encode(). Null ids give a null text. Bad ids raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in slices(batches, "ids"):
            texts = [None if i is None else codec.decode(np.frombuffer(i, dtype="<u4")) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """docs without text, with n_tokens, ids_sha256, decoded_sha256 (and ids): encode, decode the ids, digest both.

    One pass, without a shuffle. A null or empty text has no ids. Rows that repeat each give a row, an empty table gives
    an empty one. Columns of docs with the names of the new ones give way to them.
    """
    new = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())] + [StructField("ids", BinaryType())] * with_ids
    docs = docs.drop(*(f.name for f in new))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in slices(batches):
            raws, counts, encoded, decoded = [], [], [], []
            for text in batch.column(at).to_pylist():
                raw = codec.encode_bytes(text) if text else b""
                ids = np.frombuffer(raw, dtype="<u4")
                sha, stream = hashlib.sha256(), Utf8Stream()
                for i in range(0, len(ids), 1 << 14):
                    sha.update(stream.feed(codec.decode_bytes(ids[i : i + (1 << 14)].tolist())).encode())
                sha.update(stream.finish().encode())
                counts.append(len(ids))
                encoded.append(hashlib.sha256(raw).hexdigest())
                decoded.append(sha.hexdigest())
                if with_ids:
                    raws.append(raw)
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            made = [pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())] + [pa.array(raws, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays([*rest, *made], [*(f.name for f in schema.fields)])

    schema = StructType([f for f in docs.schema.fields if f.name != "text"] + new)
    return docs.mapInArrow(run, schema)

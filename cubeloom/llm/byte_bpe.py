"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Two tokens may stand side by side in an encoding exactly if encoding their joined
bytes gives just these two. So the encoding of every prefix of a byte string ends
in one definite token, and reading byte by byte is a nondeterministic transducer:
a configuration is a place where a longer token may still begin (a node in the trie
of the vocabulary), the token before it, and what has been said up to there. The
transducer is made deterministic as it is used: a state is the set of live
configurations; what all of them have said is emitted, the rest stays with them as
residue, so output follows input after a lookahead bounded by the longest token.
Transitions are remembered up to a bound and then begun anew. Every distinct pre-token
of a part of the texts goes through the transducer once.

Defined cases: null and empty texts encode to no ids. Null doc_ids and repeated
rows are encoded as any other row. Further columns do not matter.
"""

from __future__ import annotations

import base64
import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.pieces import Cutter, byte_level, decoded
from cubeloom.llm.runtime import relieved, ship

TRANSITIONS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """encode(bytes) -> ids of one pre-token."""

    def __init__(self, ranks: dict[bytes, int], limit: int = TRANSITIONS):
        self.ranks, self.limit = ranks, limit
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        # The trie: node << 8 | byte -> (next node << 8, the token that ends there or -1,
        # whether a longer token goes on).
        inner = {token[:k] for token in ranks for k in range(1, len(token))}
        nodes = {b"": 0} | {prefix: k + 1 for k, prefix in enumerate(sorted(inner | ranks.keys()))}
        self.trie = {nodes[t[:-1]] << 8 | t[-1]: (n << 8, ranks.get(t, -1), t in inner) for t, n in nodes.items() if t}
        self.reset()

    def reset(self) -> None:
        # A configuration: (trie node << 8, token before it or -1, residue). A state is
        # a dict from byte to (next state, output); under -1 it keeps its residue at an
        # end of input, under -2 its configurations.
        start = ((0, -1, ()),)
        self.root: dict = {-1: (), -2: start}
        self.states: dict[tuple, dict] = {start: self.root}
        self.moves = 0
        self.beside: dict[tuple[int, int], bool] = {}

    def _merged(self, raw: bytes, below: int) -> list[int]:
        """BPE by ranks below a bound, the definition: the pair of lowest rank first,
        leftmost first."""
        parts = [raw[k : k + 1] for k in range(len(raw))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = below, -1
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1], below)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens that merge into a token; itself twice for a byte."""
        got = self.halves.get(token)
        if got is None:
            parts = self._merged(self.bytes_of[token], token)
            got = self.halves[token] = (parts[0], parts[-1]) if len(parts) == 2 else (token, token)
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side: undoing merges from the
        latest on, no pair at the border ever has a merge that comes before the one
        undone last. The leftmost of equal ranks merges first, hence the bounds."""
        key = (left, right)
        ok = self.beside.get(key)
        if ok is None:
            bytes_of, ranks, halves = self.bytes_of, self.ranks, self._halves
            bound, ok = len(ranks) + 1, True
            while True:
                joined = ranks.get(bytes_of[left] + bytes_of[right])
                if joined is not None and joined < bound:
                    ok = False
                    break
                a, b = halves(left)[1], halves(right)[0]
                if a == left and b == right:
                    break
                if b == right or (a != left and left > right):
                    left, bound = a, left
                else:
                    right, bound = b, right + 1
            self.beside[key] = ok
        return ok

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple]:
        live, said, get = [], None, self.trie.get
        for node, last, residue in state[-2]:
            if (found := get(node | byte)) is not None:
                nxt, token, longer = found
                if longer:
                    live.append((nxt, last, residue))
                if said is None and token >= 0 and (last < 0 or self.compatible(last, token)):
                    ended, said = token, (*residue, token)
        live.append((0, ended, said))
        low, high = min(x[2] for x in live), max(x[2] for x in live)
        common = 0  # emit what all configurations agree on
        for a, b in zip(low, high):
            if a != b:
                break
            common += 1
        new = tuple([(n, last, r[common:]) for n, last, r in live]) if common else tuple(live)
        to = self.states.get(new)
        if to is None:
            to = self.states[new] = {-1: new[-1][2], -2: new}
        self.moves += 1
        move = state[byte] = (to, said[:common])
        return move

    def encode(self, raw: bytes) -> list[int]:
        if self.moves > self.limit:
            self.reset()
        out: list[int] = []
        state = self.root
        for b in raw:
            try:
                state, said = state[b]
            except KeyError:
                state, said = self._step(state, b)
            if said:
                out += said
        out += state[-1]
        return out


def _utf8_table() -> np.ndarray:
    """next[state][byte]: 0 complete, 1-3 bytes to come, 4-7 the lead bytes whose
    next byte is restricted, 8 not UTF-8."""
    t = np.full((9, 256), 8, np.uint8)
    t[0, 0x00:0x80] = 0
    t[0, 0xC2:0xE0] = 1
    t[0, 0xE1:0xF0] = 2
    t[0, 0xF1:0xF4] = 3
    t[0, 0xE0], t[0, 0xED], t[0, 0xF0], t[0, 0xF4] = 4, 5, 6, 7
    t[1, 0x80:0xC0], t[2, 0x80:0xC0], t[3, 0x80:0xC0] = 0, 1, 2
    t[4, 0xA0:0xC0], t[5, 0x80:0xA0], t[6, 0x90:0xC0], t[7, 0x80:0x90] = 1, 1, 2, 2
    return t


class Utf8Stream:
    """Incremental UTF-8: feed(bytes) gives the text that is complete so far; an
    unfinished character waits for the next call. finish() fails on a broken end.

    The machine starts at every lead byte and runs on all of them side by side."""

    table = _utf8_table()

    def __init__(self) -> None:
        self.held = b""

    def feed(self, raw: bytes) -> str:
        raw = self.held + raw
        self.held = b""
        if raw.isascii():
            return raw.decode("ascii")
        b = np.frombuffer(raw, np.uint8)
        later = (b & 0xC0) == 0x80
        lead = np.flatnonzero((b >= 0x80) & ~later)
        state, taken, cut = self.table[0][b[lead]], 0, len(b)
        for step in range(1, 4):
            going = np.flatnonzero((state > 0) & (state < 8))
            at = lead[going] + step
            if len(at) and at[-1] == len(b):  # only the last character can be cut off
                cut, going, at = int(lead[-1]), going[:-1], at[:-1]
                state[-1] = 0
            state[going] = self.table[state[going], b[at]]
            taken += len(going)
        if (state == 8).any() or taken != np.count_nonzero(later):
            raise UnicodeDecodeError("utf-8", raw, 0, len(raw), "not UTF-8")
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8")

    def finish(self) -> None:
        if self.held:
            raise UnicodeDecodeError("utf-8", self.held, 0, len(self.held), "unexpected end of ids")


class ByteBPE:
    """Encoding and decoding with a rank file, behind the byte-level cut."""

    def __init__(self, path: str):
        self.transducer = Transducer(read_ranks(path))
        self.tokens = [self.transducer.bytes_of.get(i, b"") for i in range(max(self.transducer.bytes_of) + 1)]
        self.cutter = Cutter(byte_level, "<u4", self._distinct)

    def _distinct(self, points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        encode, text, out, ends = self.transducer.encode, decoded(points), [], []
        begin, collects = 0, gc.isenabled()
        gc.disable()  # states are many and stay: looking through them again and again is waste
        try:
            for end in edges[1:].tolist():
                out += encode(text[begin:end].encode())
                ends.append(len(out))
                begin = end
        finally:
            if collects:
                gc.enable()
        size = np.diff(np.array(ends, np.int64), prepend=0)
        return np.array(out, "<u4"), np.cumsum(size) - size, size

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.cutter.one(text).tobytes()

    def encode_all(self, texts: list[str]):
        """The ids of every text, in order."""
        for _, ids, at in self.cutter.encode(texts):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                yield ids[a:b].tobytes()

    def decode(self, ids: bytes, block: int = 1 << 16):
        """Yields text as the ids come in, never with half a character."""
        stream, get = Utf8Stream(), self.tokens.__getitem__
        array = np.frombuffer(ids, "<u4")
        for at in range(0, len(array), block):
            yield stream.feed(b"".join(map(get, array[at : at + block].tolist())))
        stream.finish()


_made: dict[str, ByteBPE] = {}


def codec(path: str) -> ByteBPE:
    """One per worker process."""
    if path not in _made:
        _made[path] = ByteBPE(path)
    return _made[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit), decoded (text from the ids)."""
    ship(docs.sparkSession)

    def run(batches):
        bpe = codec(path)
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            ids = list(bpe.encode_all([t or "" for t in batch.column(1).to_pylist()]))
            back = ["".join(bpe.decode(x)) if decode else None for x in ids]
            yield pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(relieved(run), "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() gives, in digests
    made beside it so that no ids leave the worker."""
    ship(docs.sparkSession)

    def run(batches):
        bpe = codec(path)
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            n, one, two = [], [], []
            for ids in bpe.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                whole = hashlib.sha256()
                for part in bpe.decode(ids):
                    whole.update(part.encode())
                two.append(whole.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(relieved(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

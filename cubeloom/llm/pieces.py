"""Whole-text encoding by distinct pre-tokens.

A tokenizer of the kinds used here first cuts a text into pre-tokens and encodes each
by itself. So texts are cut a part of CHARS characters at a time with array operations
over their code points, a part's distinct pre-tokens go to the tokenizer once, many
together, where a bounded table of known ones (KNOWN of at most LONGEST characters)
lacks them, and ids are gathered back in place. Texts that hold an added token's string,
or code points past LAST, go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHARS, GROUP, KNOWN, LONGEST, LAST = 1 << 21, 512, 1 << 18, 64, "\u3000"
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = (ord(every[k]) for k in (m.start(), m.end() - 1))
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def _turns(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the class changes or a text begins."""
    turn = first.copy()
    turn[1:] |= kind[1:] != kind[:-1]
    return turn


def _endings(points: np.ndarray, begin: np.ndarray, first: np.ndarray) -> None:
    """Ties 's, 't, 're, 've, 'm, 'll, 'd together where a pre-token begins with them."""
    n = len(points)
    at = np.flatnonzero(begin & (points == ord("'")))
    if not len(at):
        return
    one, two = np.minimum(at + 1, n - 1), np.minimum(at + 2, n - 1)
    has_one = (at + 1 < n) & ~first[one]
    has_two = has_one & (at + 2 < n) & ~first[two]
    for ending in _ENDINGS:
        ok = has_one & (points[one] == ord(ending[0]))
        if len(ending) == 2:
            ok &= has_two & (points[two] == ord(ending[1]))
        here = at[ok]
        begin[here + 1] = False
        after = here + 1 + len(ending)
        begin[after[after < n]] = True


def byte_level(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: endings, then runs of letters, numbers or other
    characters with one space before them, then white space, whose last character goes
    to what follows it in the text."""
    turn = _turns(kind, first)
    begin = turn.copy()
    solid = np.flatnonzero(turn & (kind != SPACE))
    solid = solid[~first[solid]]
    solid = solid[kind[solid - 1] == SPACE]
    begin[solid - 1] = True
    begin[solid[points[solid - 1] == 32]] = False
    _endings(points, begin, first)
    return begin


def words_and_marks(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: endings, runs of letters, single numbers, runs of other
    characters; white space is dropped beforehand where it stands, so runs end at it."""
    begin = (_turns(kind, first) | (kind == NUMBER)) & (kind != SPACE)
    _endings(points, begin, first)
    return begin & (kind != SPACE)


def _points(text: str) -> np.ndarray:
    """The code points, one byte each where all have room."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    place = np.repeat(start - np.cumsum(size) + size, size)
    place += np.arange(len(place))
    return place


class Cutter:
    """Cuts texts into pre-tokens and gives, of every text, the ids of all of them.

    ids_of(points, edges) -> (ids, where the ids of each distinct pre-token begin, how
    many they are), for pre-tokens points[edges[k]:edges[k + 1]]; whole(text) -> ids;
    normal(text) is the text to cut, or None to go to whole()."""

    def __init__(self, begins, dtype: str, ids_of, whole: Callable[[str], np.ndarray] | None = None, normal: Callable[[str], str | None] = str, parts: int = 1):
        self.begins, self.dtype, self.ids_of, self.whole, self.normal = begins, np.dtype(dtype), ids_of, whole, normal
        self.parts = parts  # how many times CHARS and KNOWN
        self.known: dict[int, tuple] = {}  # by width of a code point: pre-tokens, ids, start, size

    def _looked_up(self, pieces: pa.Array, points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids_of() with the table of known pre-tokens before it."""
        wide, length = points.dtype.itemsize, np.diff(edges)
        none = (pieces.slice(0, 0), np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64))
        words, ids, start, size = self.known.get(wide, none)
        at = pc.index_in(pieces, value_set=words).fill_null(-1).to_numpy() if len(words) else np.full(len(pieces), -1)
        new = at < 0
        all_start, all_size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        all_start[~new], all_size[~new] = start[at[~new]], size[at[~new]]
        if new.any():
            own = points if new.all() else points[np.repeat(new, length)]
            got, begin, many = self.ids_of(own, np.concatenate(([0], np.cumsum(length[new]))))
            all_start[new], all_size[new] = begin + len(ids), many
            ids = np.concatenate((ids, got))
            short = np.flatnonzero(new & (length <= LONGEST))
            if len(words) + len(short) > self.parts * KNOWN:  # begin anew with what this part has
                keep = np.flatnonzero(length <= LONGEST)[: self.parts * KNOWN]
                flat = ids[_ragged(all_start[keep], all_size[keep])]
                self.known[wide] = (pieces.take(pa.array(keep)), flat, np.cumsum(all_size[keep]) - all_size[keep], all_size[keep])
            else:
                flat = ids[_ragged(all_start[short], all_size[short])]
                begin = np.cumsum(all_size[short]) - all_size[short]
                self.known[wide] = (pa.concat_arrays([words, pieces.take(pa.array(short))]), np.concatenate((ids[: len(ids) - len(got)], flat)), np.concatenate((start, begin + len(ids) - len(got))), np.concatenate((size, all_size[short])))
        return ids, all_start, all_size

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each begins: texts + 1)."""
        whole = "".join(texts)
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        if not whole:
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        points = _points(whole)
        kind = classes()[points] if points.dtype.itemsize > 1 else classes()[:0x100][points]
        first = np.zeros(len(points), bool)
        first[at[:-1][at[:-1] < len(points)]] = True
        starts = np.flatnonzero(self.begins(points, kind, first))
        if self.begins is words_and_marks:
            keep = kind != SPACE
            edges = np.append(starts, len(points))
            edges -= np.searchsorted(np.flatnonzero(~keep), edges)
            points = points[keep]
        else:
            edges = np.append(starts, len(points))
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        narrow = points if points.dtype.itemsize < 4 or points.max() >= 0x10000 else points.astype(np.uint16)
        wide = narrow.dtype.itemsize
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64) * wide), pa.py_buffer(narrow)]).dictionary_encode()
        pieces, index = cut.dictionary, np.asarray(cut.indices)
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] // wide
        ids, start, size = self._looked_up(pieces, np.frombuffer(pieces.buffers()[2], narrow.dtype)[: ends[-1]], ends)
        each = size[index]
        total = np.concatenate(([0], np.cumsum(each)))
        return ids[_ragged(start[index], each)], total[np.searchsorted(starts, at)]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids, where each text's ids begin) for parts of
        texts, in order."""
        begun, part, chars, odd = 0, [], 0, {}
        for k, text in enumerate(texts):
            cut = self.normal(text)
            if cut is None:
                odd[k - begun], cut = text, ""
            part.append(cut)
            chars += len(cut)
            if chars >= self.parts * CHARS or k + 1 == len(texts):
                ids, at = self._together(part)
                if odd:
                    rows = [self.whole(odd[j]) if j in odd else ids[at[j] : at[j + 1]] for j in range(len(part))]
                    ids, at = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
                yield begun, ids, at
                begun, part, chars, odd = k + 1, [], 0, {}

    def one(self, text: str) -> np.ndarray:
        return next(self.encode([text]))[1]


def decoded(points: np.ndarray) -> str:
    """The string of code points."""
    names = {1: "latin-1", 2: "utf-16-le", 4: "utf-32-le"}
    return points.tobytes().decode(names[points.dtype.itemsize], *(["surrogatepass"] if points.dtype.itemsize > 1 else []))


def _grouped(bulk, alone, apart: str, closes: np.ndarray, kept: bool, dtype: str, points: np.ndarray, edges: np.ndarray):
    """ids_of() that joins pre-tokens by a separator: closes[id] says that an id ends
    one of them (kept) or is the separator itself; alone(piece) gives one's ids."""
    size = np.diff(edges)
    odd = np.add.reduceat(points == ord(apart), edges[:-1]) > 0
    good = np.flatnonzero(~odd)
    spaced = np.full(int(size[good].sum()) + len(good), ord(apart), points.dtype)
    spaced[np.arange(len(spaced) - len(good)) + np.repeat(np.arange(len(good)), size[good])] = points[np.repeat(~odd, size)] if odd.any() else points
    text, ends = decoded(spaced), np.cumsum(size[good] + 1)
    marks = np.concatenate(([0], ends[GROUP - 1 :: GROUP], ends[-1:] if len(good) % GROUP else [])).astype(np.int64).tolist()
    parts, many, out = [], np.zeros(len(size), np.int64), [text[a : b - 1] for a, b in zip(marks[:-1], marks[1:])]
    for k, ids in enumerate(bulk(out)):
        group = good[k * GROUP : (k + 1) * GROUP]
        ids = np.array(ids, dtype)
        close = closes[ids]
        stops = np.flatnonzero(close) + 1 if kept else np.append(np.flatnonzero(close), len(ids))
        if len(stops) == len(group):
            many[group] = np.diff(stops, prepend=0 if kept else -1) - (0 if kept else 1)
            parts.append(ids if kept else ids[~close])
        else:  # the tokenizer sees other white space: one by one
            for g in group.tolist():
                parts.append(np.array(alone(decoded(points[edges[g] : edges[g + 1]])), dtype))
                many[g] = len(parts[-1])
    start = np.zeros(len(size), np.int64)
    start[good] = np.cumsum(many[good]) - many[good]
    full = int(many.sum())
    for g in np.flatnonzero(odd).tolist():
        parts.append(np.array(alone(decoded(points[edges[g] : edges[g + 1]])), dtype))
        start[g], many[g] = full, len(parts[-1])
        full += len(parts[-1])
    return np.concatenate(parts) if parts else np.zeros(0, dtype), start, many


def _library(path: str, keep_special: bool):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = keep_special
    return tok


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class _Files:
    """A file's tokenizer as it is (read when it is first needed), and its model behind
    another cut."""

    def __init__(self, path: str, dtype: str, keep_special: bool, cut):
        self.path, self.dtype, self.keep_special = path, dtype, keep_special
        self.special = [] if keep_special else [t["content"] for t in _file(path)["added_tokens"]]
        self.plain = _library(path, True)
        cut(self.plain)

    @cached_property
    def own(self):
        return _library(self.path, self.keep_special)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, self.dtype)

    def bulk(self, texts: list[str]):
        for k in range(0, len(texts), 64):
            yield from (e.ids for e in self.plain.encode_batch_fast(texts[k : k + 64], add_special_tokens=False))

    def alone(self, piece: str) -> list[int]:
        """The ids of one pre-token, by the model itself."""
        from tokenizers import pre_tokenizers

        [(shown, _)] = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(piece)
        return [t.id for t in self.plain.model.tokenize(shown)]


@lru_cache(4)
def word_encoder(path: str, dtype: str = "<u2", keep_special: bool = False, parts: int = 1) -> Cutter:
    """The ids of a file of the tokenizers library whose words end in a suffix, with
    NFC, white space as one space and lower case before them; with keep_special the
    strings of added tokens are ordinary text. One per worker process."""
    from tokenizers import normalizers, pre_tokenizers

    def cut(plain):
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    files = _Files(path, dtype, keep_special, cut)
    suffix = _file(path)["model"]["end_of_word_suffix"]
    closes = np.zeros(1 << 16, bool)
    closes[[i for t, i in files.plain.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    def normal(text: str) -> str | None:
        if any(s in text for s in files.special):
            return None
        if _latin(text) or (max(text) < "\u0130" and unicodedata.is_normalized("NFC", text)):
            return text.lower()
        made = files.own.normalizer.normalize_str(text)
        return made if max(made) < LAST else None

    return Cutter(words_and_marks, dtype, partial(_grouped, files.bulk, files.alone, " ", closes, True, dtype), files.whole, normal, parts)


@lru_cache(4)
def byte_level_encoder(path: str, dtype: str = "<u2", keep_special: bool = False) -> Cutter:
    """The ids of a byte-level file of the tokenizers library. One per worker process."""
    from tokenizers import pre_tokenizers

    def cut(plain):
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    files = _Files(path, dtype, keep_special, cut)
    closes = np.zeros(1 << 16, bool)
    closes[files.alone("\n")] = True

    def normal(text: str) -> str | None:
        return None if any(s in text for s in files.special) or not (_latin(text) or max(text) < LAST) else text

    return Cutter(byte_level, dtype, partial(_grouped, files.bulk, files.alone, "\n", closes, False, dtype), files.whole, normal)

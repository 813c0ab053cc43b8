"""Byte-pair encoding with word ends by a pair occurrence index.

For tokenizers whose JSON file has a BPE model with an end-of-word suffix, drops white space and lower-cases.
White space always ends a token there, so a text's ids are those of its chunks, the maximal runs without white
space. A batch of texts is encoded by its distinct new chunks: every adjacent pair of symbols in them is indexed
by the rank of its merge, with all the positions where it occurs; the lowest active rank is applied at all its
positions at once, and the pairs that this makes enter the index. A worker keeps the ids of recent chunks in a hash
table of numpy arrays, in which all chunks of a batch are looked up at once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import regex

from .common import trim
from .texthash import mix

#: Entries and bytes of a generation of a cache, of which a worker keeps two, young and old; an entry takes ENTRY bytes besides its key and value.
CACHE, CACHE_BYTES, ENTRY = 80_000, 16_000_000, 120
#: Chunks that a worker's table keeps, about 50 bytes each, and chunks looked up at once.
TABLE, LOOKUP = 400_000, 1 << 16
#: Bytes of the longest chunk that the table keeps; with its length it makes three 64-bit words.
SHORT = 23
#: Characters of the texts or pieces encoded at once, and pre-tokens indexed at once.
BATCH_CHARS, BATCH_WORDS = 2_000_000, 100_000
#: Characters encoded at once by way of the table: more, so that more of the new pre-tokens share an index.
ENCODE_CHARS = 4_000_000
_SPACE = regex.compile(r"[^\S\x1c-\x1f]")
#: White space of str.split() that is not white space to the tokenizer.
_FALSE_SPACE = "\x1c\x1d\x1e\x1f"
_CHUNK = regex.compile(r"(?:[^\s]|[\x1c-\x1f])+")
#: Chunks of these characters only are in normal form already, but for their case.
_SIMPLE = regex.compile(r"[\n\x21-\x7e\xa1-įı-ſ]+")
_NONE = np.int64(1) << 40
#: Stands between chunks in a run of ids.
_MARK = b"\xff\xff\xff\xff"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Cache:
    """A dict of bounded size: when the young generation is full it becomes the old one, whose entries come back on use."""

    def __init__(self, size: int = CACHE, most: int = CACHE_BYTES):
        self.size, self.most, self.young, self.old, self.bytes = size, most, {}, {}, 0

    def missing(self, keys: set) -> list:
        """Keys without a value; those of keys that have one are in young afterwards. Turns generations at most once, before."""
        if len(self.young) >= self.size or self.bytes >= self.most:
            self.young, self.old, self.bytes = {}, self.young, 0
        new = keys - self.young.keys()
        known = new & self.old.keys()
        self.put(known, [self.old[k] for k in known])
        return list(new - known)

    def put(self, keys: Iterable, values: Sequence) -> None:
        before = len(self.young)
        self.young.update(zip(keys, values, strict=True))
        self.bytes += (len(self.young) - before) * ENTRY + sum(map(len, keys)) + (sum(map(len, values)) if values and isinstance(values[0], bytes) else 0)


class ChunkTable:
    """Ids of chunks of up to SHORT bytes, found by their bytes themselves: an open-addressing hash table of arrays.

    Entries are numbered from 0; first and count tell where the ids of an entry lie in ids. A table that is full
    keeps the entries that were found again since it last was, half its size at most.
    """

    _LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)

    def __init__(self, size: int = TABLE):
        self.size = size
        self._reset()

    def _reset(self) -> None:
        self.n, self.held = 0, 0  # entries, ids
        self.key = [np.empty(1 << 12, np.uint64) for _ in range(3)]
        self.first, self.count, self.again = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int32), np.empty(1 << 12, bool)
        self.ids = np.empty(1 << 14, np.uint16)
        self.slots = np.full(1 << 14, -1, np.int32)

    @classmethod
    def keys(cls, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The three words of the chunks of text, which ends with 24 further bytes; lengths of SHORT at most."""
        words = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
        out = [words[starts + 8 * k] & cls._LOW[np.clip(lengths - 8 * k, 0, 8)] for k in range(3)]
        out[2] |= lengths.astype(np.uint64) << np.uint64(56)
        return out

    def _places(self, key: list[np.ndarray]) -> np.ndarray:
        h = mix(key[0] ^ mix(key[1] ^ mix(key[2] + np.uint64(0x9E3779B97F4A7C15))))
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, key: list[np.ndarray]) -> np.ndarray:
        """The entries of keys, -1 for those that are not there."""
        at, out = self._places(key), np.full(len(key[0]), -1, np.int32)
        rows = np.arange(len(at))
        while len(rows):
            entry = self.slots[at]
            some = np.flatnonzero(entry >= 0)
            rows, at, entry = rows[some], at[some], entry[some]
            same = (self.key[0][entry] == key[0][rows]) & (self.key[1][entry] == key[1][rows]) & (self.key[2][entry] == key[2][rows])
            out[rows[same]] = entry[same]
            other = ~same
            rows, at = rows[other], (at[other] + 1) & (len(self.slots) - 1)
        self.again[out[out >= 0]] = True
        return out

    def _enter(self, lo: int, hi: int) -> None:
        """Put the entries lo .. hi - 1 into the slots, which are at most half full afterwards."""
        if 2 * hi > len(self.slots):
            self.slots = np.full(1 << (4 * hi - 1).bit_length(), -1, np.int32)
            lo = 0
        entry = np.arange(lo, hi, dtype=np.int32)
        at = self._places([k[lo:hi] for k in self.key])
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]
            left = self.slots[at] != entry  # the slot was taken, or another entry came last
            entry, at = entry[left], (at[left] + 1) & (len(self.slots) - 1)

    def put(self, key: list[np.ndarray], ids: list[bytes], keyless: list[bytes]) -> int:
        """Number of the first of new entries: those of keys, then those of keyless, which only stay until forget."""
        new = len(ids) + len(keyless)
        count = np.fromiter((len(x) // 4 for x in (*ids, *keyless)), np.int32, new)
        values = np.frombuffer(b"".join((*ids, *keyless)), "<u4")
        self.key = [_room(k, self.n + new) for k in self.key]
        self.first, self.count, self.again = (_room(x, self.n + new) for x in (self.first, self.count, self.again))
        if len(values) and values.max() > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        self.ids = _room(self.ids, self.held + len(values))
        for k, x in zip(self.key, key, strict=True):
            k[self.n : self.n + len(ids)] = x
        self.first[self.n : self.n + new] = self.held + np.cumsum(count, dtype=np.int64) - count
        self.count[self.n : self.n + new] = count
        self.again[self.n : self.n + new] = False
        self.ids[self.held : self.held + len(values)] = values
        self._enter(self.n, self.n + len(ids))
        begin, self.n = self.n, self.n + len(ids)
        self.held += int(count[: len(ids)].sum(dtype=np.int64))
        return begin

    def forget(self) -> None:
        """Make room before a batch if the table is full."""
        if self.n < self.size:
            return
        kept = np.flatnonzero(self.again[: self.n])[-(self.size // 2 or 1) :]
        key, ids = [k[kept] for k in self.key], self.gather(kept)
        count = self.count[kept]
        self._reset()
        cuts = np.concatenate([[0], 4 * np.cumsum(count)]).tolist()
        raw = ids.tobytes()
        self.put(key, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [])

    def gather(self, entries: np.ndarray) -> np.ndarray:
        """The ids of entries, one after the other, as little-endian unsigned 32-bit integers."""
        count = self.count[entries]
        at = np.repeat(self.first[entries] - (np.cumsum(count, dtype=np.int64) - count), count)
        at += np.arange(len(at))
        return self.ids[at].astype("<u4")


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy of it that is longer, with room for n elements."""
    if n <= len(x):
        return x
    out = np.empty(max(n, 3 * len(x) // 2), x.dtype)
    out[: len(x)] = x
    return out


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Regex, normalizers

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not suffix or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is no lower-casing BPE with word ends")
        space = spec["normalizer"]["normalizers"][1]
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(space["pattern"]["Regex"]), space["content"]), normalizers.Lowercase()])
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.lines = regex.compile(self.pattern.pattern + r"|\n")
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.byte = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[symbols[b] + suffix] for b in range(256)], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.width = max(vocab.values()) + 2
        left, right, made = (np.array([vocab[x] for x in col], np.int64) for col in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.made, self.twin = made, left == right
        order = np.argsort(left * self.width + right)
        self.keys = np.append((left * self.width + right)[order], np.iinfo(np.int64).max)  # the last is no pair
        self.ranks = np.append(order.astype(np.int64), _NONE)
        self.chunks, self.words = ChunkTable(), Cache()

    @cached_property
    def library(self):
        """The tokenizers library's own encoder, for chunks with special strings."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _rank(self, sym: np.ndarray, nxt: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the merges of the symbols at positions at with their right neighbours."""
        key = sym.take(at) * self.width + sym.take(nxt.take(at))
        i = self.keys.searchsorted(key)
        return np.where(self.keys.take(i) == key, self.ranks.take(i), _NONE)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, each as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        length = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(length)
        text = np.frombuffer(b"".join(raw), np.uint8)
        n = len(text)
        sym = np.append(self.byte[text], self.width - 1)  # the last is no symbol
        sym[ends - 1] = self.last[text[ends - 1]]
        nxt = np.append(np.arange(1, n + 1), n)
        nxt[ends - 1] = n
        prv = np.arange(-1, n)
        prv[0] = n
        prv[ends[:-1]] = n  # before the first there is none
        now = np.append(self._rank(sym, nxt, np.arange(n)), _NONE)
        alive = np.ones(n, bool)
        merged = np.zeros(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            order = rank.argsort(kind="stable")
            at, rank = at[order], rank[order]
            cuts = ((rank[1:] != rank[:-1]).nonzero()[0] + 1).tolist()
            for r, lo, hi in zip(rank[[0, *cuts]].tolist(), [0, *cuts], [*cuts, len(at)], strict=True):
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(heap, r)

        if len(some := np.flatnonzero(now < _NONE)):
            enter(some, now[some])
        # a pair at a position never comes back, as symbols only grow, so that a position is in one list of a rank only
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = np.concatenate(found) if len(found) > 1 else found[0]
            at = at[now.take(at) == r]
            if self.twin[r] and len(at) > 1:  # of overlapping pairs the leftmost come first
                at.sort()
                taken, free = [], -1
                for p in at.tolist():
                    if p != free:
                        taken.append(p)
                        free = int(nxt[p])
                at = np.array(taken, np.int64)
            if not len(at):
                continue
            right = nxt.take(at)
            sym[at] = self.made[r]
            alive[right] = False
            now[right] = _NONE
            nxt[at] = after = nxt.take(right)
            prv[after] = at
            prv[n] = n
            before = prv.take(at)
            merged[at] = merged[n] = True
            touched = np.concatenate((at, before[~merged.take(before)]))
            merged[at] = False
            now[touched] = rank = self._rank(sym, nxt, touched)
            if len(some := (rank < _NONE).nonzero()[0]):
                enter(touched.take(some), rank.take(some))
        count = np.concatenate([[0], np.cumsum(alive)])
        ids = sym[:n][alive].astype("<u4").tobytes()
        cut = (4 * count[np.concatenate([[0], ends])]).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without white space; special strings inside them count as the library has it by default."""
        whole = "\n".join(chunks)
        plain = list(chunks)
        special: dict[int, bytes] = {}
        if any(a in whole for a in self.added):
            for i, c in enumerate(chunks):
                if any(a in c for a in self.added):
                    special[i] = np.array(self.library.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
                    plain[i] = ""
        if _SIMPLE.fullmatch(whole):
            lower = "\n".join(plain).lower()
        else:
            lower = "\n".join(c.lower() if _SIMPLE.fullmatch(c) else c and self.normalizer.normalize_str(c) for c in plain)
        words = self.lines.findall(lower)
        new = self.words.missing(set(words))
        self.words.young["\n"] = _MARK
        for lo in range(0, len(new), BATCH_WORDS):
            some = [w for w in new[lo : lo + BATCH_WORDS] if w != "\n"]
            if some:
                self.words.put(some, self.encode_words(some))
        # an id has zeros in its upper bytes, so that the mark is found at ends of chunks only
        out = b"".join(map(self.words.young.__getitem__, words)).split(_MARK)
        for i, ids in special.items():
            out[i] = ids
        return out

    def split(self, text: str) -> list[str]:
        if any(c in text for c in _FALSE_SPACE):
            return _CHUNK.findall(text)
        return text.split()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text (null: empty), as little-endian unsigned 32-bit integers."""
        parts: list[bytes] = []
        for pieces in batches(texts, ENCODE_CHARS):
            for ids, (_, last) in zip(self.encode_pieces([t for t, _ in pieces]), pieces, strict=True):
                parts.append(ids.tobytes())
                if last:
                    yield b"".join(parts)
                    parts = []

    def encode_pieces(self, pieces: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text or piece, as little-endian unsigned 32-bit integers."""
        self.chunks.forget()
        raw = [t.encode() for t in pieces]
        ends = np.cumsum([len(x) + 1 for x in raw])
        joined = b"\n".join([b"", *raw, bytes(SHORT + 1)])  # a byte more before each piece
        del raw
        text = np.frombuffer(joined, np.uint8)
        # white space of one byte; other white space stays in its chunk until that is encoded
        space = (text[: -(SHORT + 1)] - np.uint8(9) < 5) | (text[: -(SHORT + 1)] == 32)
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        del space
        starts, stops = edges[::2], edges[1::2]
        entries = np.concatenate([np.zeros(0, np.int32), *(self._entries(text, starts[lo : lo + LOOKUP], stops[lo : lo + LOOKUP]) for lo in range(0, len(starts), LOOKUP))])
        entries = self._learn(joined, text, starts, stops, entries)
        cuts = np.searchsorted(starts, ends).tolist()
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
            yield self.chunks.gather(entries[lo:hi])

    def _entries(self, text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The entries of the chunks in the table, -1 for those that it lacks."""
        lengths = stops - starts
        if lengths.max() <= SHORT:
            return self.chunks.find(ChunkTable.keys(text, starts, lengths))
        out = np.full(len(starts), -1, np.int32)
        short = np.flatnonzero(lengths <= SHORT)
        out[short] = self.chunks.find(ChunkTable.keys(text, starts[short], lengths[short]))
        return out

    def _learn(self, joined: bytes, text: np.ndarray, starts: np.ndarray, stops: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """entries with the lacking ones encoded; those of long chunks hold until the next call."""
        lacking = np.flatnonzero(entries < 0)
        if not len(lacking):
            return entries
        found = [joined[a:b] for a, b in zip(starts[lacking].tolist(), stops[lacking].tolist(), strict=True)]
        where = dict(zip(reversed(found), reversed(lacking.tolist()), strict=True))  # the first place of each
        short = [c for c in where if len(c) <= SHORT]
        new = [*short, *(c for c in where if len(c) > SHORT)]
        ids = self._encode_any([c.decode() for c in new])
        at = np.array([where[c] for c in short], np.int64)
        begin = self.chunks.put(ChunkTable.keys(text, starts[at], stops[at] - starts[at]), ids[: len(short)], ids[len(short) :])
        number = dict(zip(new, range(begin, begin + len(new)), strict=True))
        entries[lacking] = list(map(number.__getitem__, found))
        return entries

    def _encode_any(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that may hold white space of several bytes."""
        odd = {i: self.split(c) for i, c in enumerate(chunks) if not c.isascii() and _SPACE.search(c)}
        flat = [x for i, c in enumerate(chunks) for x in (odd[i] if i in odd else (c,))] if odd else chunks
        ids = [x for lo in range(0, len(flat), BATCH_WORDS) for x in self.encode_chunks(flat[lo : lo + BATCH_WORDS])]
        if odd:
            each = iter(ids)
            ids = [b"".join([next(each) for _ in odd[i]]) if i in odd else next(each) for i in range(len(chunks))]
        return ids


def pieces_of(text: str, chars: int) -> Iterator[tuple[str, bool]]:
    """(piece, whether it is the last) of a text: whole, or cut at white space after about chars characters each."""
    at = 0
    while len(text) - at > chars and (m := _SPACE.search(text, at + chars)):
        yield text[at : m.start()], False
        at = m.start()
    yield text[at:] if at else text, True


def batches(texts: list[str | None], chars: int = BATCH_CHARS) -> Iterator[list[tuple[str, bool]]]:
    """The pieces of the texts (null: empty), in lists of about chars characters."""
    part, have = [], 0
    for t in texts:
        for piece, last in pieces_of(t or "", chars):
            if part and have + len(piece) > chars:
                yield part
                part, have = [], 0
            part.append((piece, last))
            have += len(piece)
    if part:
        yield part


@lru_cache(2)
def load(path: str) -> WordBpe:
    """The encoder of a file, once for each worker process."""
    found = WordBpe(path)
    trim()
    return found

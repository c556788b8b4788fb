"""Subword ids of whole texts, with a bounded word cache.

The vocabulary's pre-tokenizer never joins text across a blank or a line feed, so a text's ids are
the ids of its blank-separated words in order. Words repeat, so each worker keeps a bounded cache.
A new word of plain letters goes straight to the tokenizer's BPE model, any other one through the
whole tokenizer.

Many texts at once are cut into runs of letters, runs of punctuation and digits, which are pre-tokens,
with array operations over their characters; runs seen before are found in a hash table of arrays, and
new ones are merged together. Words of other characters go through the tokenizer one by one.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

import numpy as np

from gridloom.session import kept

#: Entries after which a worker's word cache starts anew.
CACHE_WORDS = 400_000
#: Characters of texts that are cut into runs together; a text of half as many goes word by word.
TOGETHER = 1 << 20

# A run of plain letters, perhaps followed by a run of ASCII punctuation without the apostrophe
# (which may begin a contraction): each run is exactly one pre-token, and lower-casing is one to one.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)?")

_loaded: dict[str, "WordEncoder"] = {}
kept["tokens"] = _loaded  # some 75 MB in each worker


class _Runs(dict):
    """Lower-case run -> ids of one pre-token, as bytes."""

    def __init__(self, model, dtype: np.dtype):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenize, self.kind = model.tokenize, "H" if dtype.itemsize == 2 else "I"
        # the characters that stand for the bytes of a run, as the byte-level pre-tokenizer writes them
        write = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        seen = {b: c for x in map(chr, range(0x80, 0x800)) for b, c in zip(x.encode(), write(x)[0][0])}
        self.letters = {b: ord(c) for b, c in seen.items()}

    def __missing__(self, run: str) -> bytes:
        seen = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        self[run] = out = array(self.kind, [t.id for t in self.tokenize(seen)]).tobytes()
        return out


class _Words(dict):
    """Word without blanks -> its ids as bytes."""

    def __init__(self, tokenizer, dtype: np.dtype):
        self.tokenizer, self.dtype, self.runs = tokenizer, dtype, _Runs(tokenizer.model, dtype)

    def __missing__(self, word: str) -> bytes:
        m = _SIMPLE.fullmatch(word)
        if m:
            a, b = m.groups()
            out = self.runs[a.lower()]
            if b:
                out += self.runs[b]
        else:
            out = np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        self[word] = out
        return out


class _Merges:
    """Byte-pair merges of many runs at once: a run is a matrix column, and each round every run does its next merge.

    The next merge is that of the least rank, the leftmost of equals, as in the tokenizer's model. Raises
    ValueError for models of other settings, and for those that lack a byte.
    """

    NONE = np.uint32(0xFFFFFFFF)

    def __init__(self, model: dict):
        from tokenizers.pre_tokenizers import ByteLevel

        plain = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
        suffix, vocab = model.get("end_of_word_suffix") or "", model.get("vocab", {})
        if any(model.get(k) != v for k, v in plain.items()) or len(vocab) > 1 << 16:
            raise ValueError("a model of other settings")
        # every byte of the runs as the byte-level pre-tokenizer writes it
        write = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        seen = {b: c for x in map(chr, range(0x21, 0x100)) for b, c in zip(x.encode(), write(x)[0][0])}
        self.inner, self.last = np.zeros(256, dtype=np.uint32), np.zeros(256, dtype=np.uint32)
        for b, c in seen.items():
            if c not in vocab or c + suffix not in vocab:
                raise ValueError("a byte is not in the vocabulary")
            self.inner[b], self.last[b] = vocab[c], vocab[c + suffix]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.asarray([vocab[a + b] for a, b in pairs], dtype=np.uint32)
        key = np.asarray([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint32)
        if len(key) >= 1 << 24 or len(np.unique(key)) < len(key):
            raise ValueError("too many ranks, or a pair with two")
        # two hash tables: the second has what collides in the first, with a factor at which nothing collides
        rank, self.tables, factor = np.arange(len(key), dtype=np.uint32), [], 0x9E3779B1
        while len(key):
            slot = self._slot(key, factor)
            _, first = np.unique(slot, return_index=True)
            if self.tables and len(first) < len(key):
                factor = (factor * 5 + 2) & 0xFFFFFFFF | 1
                continue
            keys, ranks = np.full(1 << 20, self.NONE), np.zeros(1 << 20, dtype=np.uint32)
            keys[slot[first]], ranks[slot[first]] = key[first], rank[first]
            self.tables.append((np.uint32(factor), keys, ranks))
            key, rank, factor = np.delete(key, first), np.delete(rank, first), 0x85EBCA6B

    @staticmethod
    def _slot(key: np.ndarray, factor: int) -> np.ndarray:
        return (key * np.uint32(factor)) >> np.uint32(12)

    def _keys(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids and, in the last eight bits, its place; NONE where the pair has no rank."""
        key = (a << np.uint32(16)) | b
        out = np.full(key.shape, self.NONE)
        for factor, keys, ranks in self.tables:
            slot = self._slot(key, factor)
            at = np.flatnonzero(keys[slot] == key)
            out.ravel()[at] = ranks[slot.ravel()[at]] << np.uint32(8) | np.broadcast_to(place, key.shape).ravel()[at]
        return out

    def merge(self, byte: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all columns one after the other, ids per column) of a matrix with a run's bytes, ``length`` of them, from the top of each column."""
        n, width = byte.shape
        column, places = np.arange(width), np.arange(n, dtype=np.uint32)[:, None]
        ids = self.inner[byte]
        ids[length - 1, column] = self.last[byte[length - 1, column]]
        live = places < length
        if n > 1:
            key = self._keys(ids[:-1], ids[1:], places[:-1])
            key[~live[1:]] = self.NONE
            after, before = np.empty((n, width), dtype=np.int16), np.empty((n, width), dtype=np.int16)
            after[:], before[:] = np.arange(1, n + 1)[:, None], np.arange(-1, n - 1)[:, None]
            while True:
                least = key.min(axis=0)
                go = np.flatnonzero(least != self.NONE)
                if not len(go):
                    break
                if 4 * len(go) < 3 * key.shape[1]:  # the columns that still merge
                    key, column, least, go = key[:, go], column[go], least[go], np.arange(len(go))
                least, c = least[go], column[go]
                p = (least & np.uint32(255)).astype(np.int64)
                q = after[p, c]
                made = self.made[least >> np.uint32(8)]
                ids[p, c], live[q, c] = made, False
                r, o = after[q, c], before[p, c]
                after[p, c] = r
                key[p, go] = self.NONE
                m = np.flatnonzero(q < n - 1)  # the last place begins no pair
                key[q[m], go[m]] = self.NONE
                m = np.flatnonzero(r < length[c])
                before[r[m], c[m]] = p[m]
                key[p[m], go[m]] = self._keys(made[m], ids[r[m], c[m]], p[m].astype(np.uint32))
                m = np.flatnonzero(o >= 0)
                key[o[m], go[m]] = self._keys(ids[o[m], c[m]], made[m], o[m].astype(np.uint32))
        return ids.T[live.T], live.sum(axis=0)


_BLANK, _LETTER, _MARK, _DIGIT, _ODD = range(5)
_BEYOND = re.compile("[^\\x00-\\xff]")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower-case character) of each Latin-1 character. Odd ones are those that the runs do not tell: apostrophes, which may
    begin contractions, ``<``, with which special tokens begin, other blanks, and what is no letter beyond ASCII."""
    kind, lower = np.full(256, _ODD, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    for k, c in enumerate(map(chr, range(256))):
        if c in " \n":
            kind[k] = _BLANK
        elif re.fullmatch("[A-Za-zÀ-ÖØ-öø-ÿ]", c):
            kind[k], lower[k] = _LETTER, ord(c.lower())
        elif re.fullmatch("[0-9]", c):
            kind[k] = _DIGIT
        elif re.fullmatch("[!-&(-/:;=-@\\[-`{-~]", c):
            kind[k] = _MARK
    return kind, lower


class _RunTable:
    """Ids of lower-case runs of up to 32 Latin-1 characters: an open hash table, and a pool of ids."""

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    BITS, LONGEST, WIDTH = 21, 32, 4096

    def __init__(self, tokenizer, dtype: np.dtype, limit: int):
        whole = json.loads(tokenizer.to_str())
        steps = (whole.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if steps[0].get("pattern") != {"Regex": self.SPLIT} or not all(t["content"].startswith("<") for t in whole["added_tokens"]):
            raise ValueError("another pre-tokenizer")
        self.merges, self.dtype, self.limit = _Merges(whole["model"]), dtype, limit
        self.kind, self.lower = _classes()
        self.masks = np.asarray([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        room = 1 << self.BITS - 1
        self.n, self.end = 0, 0
        self.slots = np.full(1 << self.BITS, -1, dtype=np.int32)
        self.parts = [np.empty(room, dtype=np.uint64) for _ in range(4)]
        self.offset, self.count = np.empty(room, dtype=np.int64), np.empty(room, dtype=np.int64)
        self.pool = np.empty(1 << 20, dtype=self.dtype)

    def write(self, ids: np.ndarray) -> None:
        """Puts ids behind the pool's end, where the next ones replace them unless the end is moved."""
        if self.end + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.end], np.empty(self.end + 2 * len(ids), dtype=self.dtype)))
        self.pool[self.end : self.end + len(ids)] = ids

    def encode(self, texts: list[str], words: _Words) -> list[bytes]:
        """Ids of each text, as bytes; texts are together of at most half as many characters more than TOGETHER."""
        joined = "\n".join(texts) + "\n"
        try:
            raw = joined.encode("latin-1")
        except UnicodeEncodeError:  # the others become an odd one
            raw = _BEYOND.sub("\x01", joined).encode("latin-1")
        b = np.frombuffer(raw, dtype=np.uint8)
        c = self.kind[b]
        before = np.concatenate((np.zeros(1, dtype=np.uint8), c[:-1]))
        edge = c != before
        odd = np.flatnonzero(c == _ODD)
        first = np.flatnonzero(edge & (before == _BLANK))  # of the words, and what follows them
        stop = np.flatnonzero(edge & (c == _BLANK))
        edge |= c == _DIGIT
        whole = np.unique(np.searchsorted(first, odd, "right") - 1)  # words that stay in one piece
        for a, z in zip(first[whole].tolist(), stop[whole].tolist()):
            edge[a + 1 : z] = False
        cut = np.flatnonzero(edge)
        if not len(cut):
            return [b""] * len(texts)
        at = np.flatnonzero(c[cut] != _BLANK)
        start, length = cut[at], cut[at + 1] - cut[at]
        single = length > self.LONGEST
        single[np.searchsorted(start, first[whole])] = True
        # a run is up to four numbers of eight characters
        plain = np.flatnonzero(~single)
        padded = np.zeros(len(b) + 32, dtype=np.uint8)
        padded[: len(b)] = self.lower[b]
        eight = np.ndarray((len(b) + 25,), dtype=np.uint64, buffer=padded, strides=(1,))
        s, n = start[plain], length[plain]
        parts = [eight[s] & self.masks[np.minimum(n, 8)]]
        h = parts[0] * np.uint64(0x9E3779B97F4A7C15)
        for k, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
            more, part = np.flatnonzero(n > k), np.zeros(len(n), dtype=np.uint64)
            part[more] = eight[s[more] + k] & self.masks[np.minimum(n[more] - k, 8)]
            h[more] ^= (part[more] ^ (part[more] >> np.uint64(29))) * np.uint64(factor)
            parts.append(part)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        entry = self._find(h, parts)
        new = np.flatnonzero(entry < 0)
        if len(new):
            h_new, one, which = np.unique(h[new], return_index=True, return_inverse=True)
            same = np.logical_and.reduce([x[new] == x[new[one]][which] for x in parts])
            single[plain[new[~same]]] = True  # two runs with one hash
            if self.n + len(one) > len(self.count):
                self.clear()
                return self.encode(texts, words)
            entry[new] = self._add(h_new, [x[new[one]] for x in parts], padded, s[new[one]], n[new[one]])[which]
        offset, count = np.empty(len(start), dtype=np.int64), np.empty(len(start), dtype=np.int64)
        offset[plain], count[plain] = self.offset[entry], self.count[entry]
        alone = np.flatnonzero(single)
        raw = [words[joined[a:z]] for a, z in zip(start[alone].tolist(), (start + length)[alone].tolist())]
        size = np.asarray([len(x) // self.dtype.itemsize for x in raw], dtype=np.int64)
        self.write(np.frombuffer(b"".join(raw), dtype=self.dtype))
        offset[alone], count[alone] = self.end + np.cumsum(size) - size, size
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.repeat(offset - total[:-1], count) + np.arange(total[-1])]
        begin = np.cumsum([0] + [len(x) + 1 for x in texts])
        bound = total[np.searchsorted(start, begin)].tolist()
        out = [ids[x:y].tobytes() for x, y in zip(bound[:-1], bound[1:])]
        if self.n > self.limit:
            self.clear()
        return out

    def _find(self, h: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
        """Entry of each run, -1 for new ones."""
        out, todo, slot = np.full(len(h), -1, dtype=np.int64), np.arange(len(h)), (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(todo):
            e = self.slots[slot]
            used = np.flatnonzero(e >= 0)
            todo, slot, e = todo[used], slot[used], e[used]
            same = np.logical_and.reduce([mine[e] == x[todo] for mine, x in zip(self.parts, parts)])
            out[todo[same]] = e[same]
            todo, slot = todo[~same], slot[~same] + 1 & (1 << self.BITS) - 1
        return out

    def _add(self, h: np.ndarray, parts: list[np.ndarray], padded: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Entries of new runs, all different; a run's characters are ``length`` ones of ``padded`` from ``start``."""
        # as UTF-8: characters from 0x80 on are two bytes
        chars = padded[np.minimum(start[:, None] + np.arange(self.LONGEST), len(padded) - 1)]
        chars[np.arange(self.LONGEST) >= length[:, None]] = 0
        wide = chars >= 0x80
        two = wide.any(axis=1)
        size = length + wide.sum(axis=1)
        order = np.argsort(size, kind="stable")
        entry = np.empty(len(h), dtype=np.int64)
        limits = np.searchsorted(size[order], (0, 3, 5, 7, 9, 11, 13, 17, 25, 65)).tolist()
        for a, z in zip(limits[:-1], limits[1:]):
            for k in range(a, z, self.WIDTH):
                some = order[k : min(z, k + self.WIDTH)]
                height = int(size[some[-1]])
                byte = np.zeros((len(some), height), dtype=np.uint8)
                own = min(height, self.LONGEST)
                byte[:, :own] = chars[some, :own]
                row = np.flatnonzero(two[some])
                if len(row):
                    x, w = chars[some[row]], wide[some[row]]
                    r, i = np.nonzero(np.arange(self.LONGEST) < length[some[row], None])
                    x, w, to = x[r, i], w[r, i], (np.arange(self.LONGEST) + np.cumsum(w, axis=1) - w)[r, i]
                    byte[row[r], to] = np.where(w, 0xC0 | x >> 6, x)
                    byte[row[r[w]], to[w] + 1] = 0x80 | x[w] & 0x3F
                ids, count = self.merges.merge(np.ascontiguousarray(byte.T), size[some])
                self.write(ids)
                e = np.arange(self.n, self.n + len(some))
                entry[some] = e
                self.offset[e], self.count[e] = self.end + np.cumsum(count) - count, count
                self.n, self.end = self.n + len(some), self.end + len(ids)
        for mine, x in zip(self.parts, parts):
            mine[entry] = x
        todo, slot = np.arange(len(h)), (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.slots[slot] < 0)
            taken, one = np.unique(slot[free], return_index=True)
            self.slots[taken] = entry[todo[free[one]]]
            left = np.ones(len(todo), dtype=bool)
            left[free[one]] = False
            todo, slot = todo[left], slot[left] + 1 & (1 << self.BITS) - 1
        return entry


class WordEncoder:
    """encode(text) and encode_all(texts) -> little-endian uint16 ids (uint32 for vocabularies over 65,535), as bytes."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 65535 else np.dtype("<u4")
        self.cache_words = cache_words
        self.words = _Words(self.tokenizer, self.dtype)
        try:
            self.table = _RunTable(self.tokenizer, self.dtype, cache_words)
        except ValueError:
            self.table = None  # each text word by word

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        for cache in (self.words, self.words.runs):
            if len(cache) > self.cache_words:
                cache.clear()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """``encode`` of each text, many at once."""
        out: list[bytes] = []
        held: list[int] = []
        some: list[str] = []
        size = 0

        def flush() -> None:
            if len(self.words) > self.cache_words:
                self.words.clear()
            for k, raw in zip(held, self.table.encode(some, self.words)):
                out[k] = raw

        for text in texts:
            if self.table is None or not text or 2 * len(text) > TOGETHER:
                out.append(self.encode(text))
                continue
            some.append(text)
            held.append(len(out))
            out.append(b"")
            size += len(text)
            if size >= TOGETHER:
                flush()
                held, some, size = [], [], 0
        if held:
            flush()
        return out


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)

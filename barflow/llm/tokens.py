"""Token ids of whole texts, equal to the tokenizers library's, by a table of known words.

The vocabulary in use drops white space and never joins over it, so a text's ids are those of its
words in order. Words of up to 16 bytes are looked up as two 64-bit numbers in an open-addressing
numpy table; a word seen for the first time goes to the library. Longer words and words with
unusual characters are encoded by the library as they stand. A tokenizer file with another way to
normalise or split is used through the library alone.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .common import steps

END_ID = 1
#: Words that a worker remembers; its table then takes about 70 MB.
MOST_WORDS = 1 << 20
#: Parts of words with signs that it remembers besides.
MOST_PIECES = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Characters for which lower case, NFC and the split below need no table of Unicode.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lead bytes of U+0080 to U+00FF; with no others (so no combining mark) a text may be lower-cased first.
_LATIN = np.zeros(256, bool)
_LATIN[:0xC0] = True
_LATIN[[0xC2, 0xC3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:97] = _SIGN[123:127] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def _byte_names() -> dict[int, str]:
    """Byte-level vocabularies name a byte by a printable character, others by U+0100 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The normaliser and the split (fixed values of such a file) that the word table stands for.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
           {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def splits_at_blanks(config: dict) -> bool:
    """Whether a tokenizer file normalises and splits as the word table does."""
    model = config["model"]
    return ((config.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and (config.get("pre_tokenizer") or {}).get("pretokenizers") == _SPLITS
            and model.get("type") == "BPE" and model.get("dropout") is None and not config.get("truncation") and not config.get("padding")
            and all(t["content"].startswith("<|") and t["special"] for t in config["added_tokens"]))


class LibraryIds:
    """Ids by the library alone, for any tokenizer file."""

    def __init__(self, tok):
        self.tok = tok

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As WordIds.encode."""
        parts = [np.zeros(0, np.uint32)]
        for i, j in steps(offs):
            text = [raw[a:b].tobytes().decode() for a, b in zip(offs[i:j].tolist(), offs[i + 1:j + 1].tolist())]
            parts += [np.array([*e.ids, END_ID], np.uint32) for e in self.tok.encode_batch(text, add_special_tokens=False)]
        return np.concatenate(parts), np.cumsum([0] + [len(x) for x in parts[1:]])


class WordIds:
    """Ids of words by the tokenizer file at ``path``; at most ``most`` words are remembered."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.names = _byte_names()
        self.most = most
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._clear(1 << 17)

    def _clear(self, slots: int) -> None:
        self.k1 = np.zeros(slots, np.uint64)
        self.k2 = np.zeros(slots, np.uint64)
        self.at = np.full(slots, -1, np.int32)  # place in flat; -1: free
        self.n_ids = np.zeros(slots, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = self.words = 0

    def word(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        w = raw.decode("utf-8")
        if raw.isalpha() and raw.islower() and len(raw) <= 16:
            return tuple(t.id for t in self.model.tokenize(w))
        if not _PLAIN.fullmatch(w) or "<|" in w or len(raw) > 4096:
            return tuple(self.tok.encode(w, add_special_tokens=False).ids)
        out: list[int] = []
        for p in _PIECES.findall(w.lower()):
            got = self.pieces.get(p)
            if got is None:
                named = p if p.isascii() else "".join(self.names[b] for b in p.encode())
                got = tuple(t.id for t in self.model.tokenize(named))
                if len(self.pieces) >= MOST_PIECES:
                    self.pieces.clear()
                self.pieces[p] = got
            out.extend(got)
        return tuple(out)

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of the words, -1 where unknown."""
        mask = len(self.at) - 1
        slot = (self._slot(a, b) & np.uint64(mask)).astype(np.int64)
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        while len(todo):
            s = slot[todo]
            taken = self.at[s] >= 0
            hit = taken & (self.k1[s] == a[todo]) & (self.k2[s] == b[todo])
            out[todo[hit]] = s[hit]
            todo = todo[taken & ~hit]
            slot[todo] = (slot[todo] + 1) & mask
        return out

    def _put(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Insert words that are not there, all different."""
        mask = len(self.at) - 1
        slot = (self._slot(a, b) & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(a))
        while len(todo):
            s = slot[todo]
            free = np.flatnonzero(self.at[s] < 0)
            _, first = np.unique(s[free], return_index=True)
            won = free[first]
            i, s = todo[won], s[won]
            self.k1[s], self.k2[s], self.at[s], self.n_ids[s] = a[i], b[i], at[i], n[i]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo = todo[left]
            slot[todo] = (slot[todo] + 1) & mask

    def _learn(self, a: np.ndarray, b: np.ndarray) -> None:
        new = np.unique(np.rec.fromarrays([a, b]))
        a, b = np.ascontiguousarray(new.f0), np.ascontiguousarray(new.f1)
        if self.words + len(a) > self.most and self.words:
            self._clear(len(self.at))
        while 2 * (self.words + len(a)) > len(self.at):
            old = np.flatnonzero(self.at >= 0)
            k1, k2, at, n = self.k1[old], self.k2[old], self.at[old], self.n_ids[old]
            size = 2 * len(self.at)
            self.k1, self.k2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
            self.at, self.n_ids = np.full(size, -1, np.int32), np.zeros(size, np.int32)
            self._put(k1, k2, at, n)
        raw = np.stack([a, b], 1).astype("<u8").tobytes()
        ids = [self.word(raw[i:i + 16].rstrip(b"\0")) for i in range(0, len(raw), 16)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        at = self.used + np.cumsum(n) - n
        total = int(n.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used:self.used + total] = np.fromiter((x for t in ids for x in t), np.uint32, total)
        self._put(a, b, at, n)
        self.used += total
        self.words += len(a)

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id, and the n+1 offsets of the rows in them."""
        parts, lens = [], [np.zeros(0, np.int64)]
        for i, j in steps(offs):
            ids, n = self._step(raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            parts.append(ids)
            lens.append(n)
        n = np.concatenate(lens)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(n)])

    def _step(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, rows = len(raw), len(offs) - 1
        plain = bool(_LATIN[raw].all()) and not self._special(raw)
        if plain:
            raw = _LOWER[raw]
        ink = np.zeros(size + 1, bool)
        np.logical_not(_SPACE[raw], out=ink[:size])
        # A word starts where ink follows a blank or a row starts; it ends likewise.
        edge = np.zeros(size + 1, bool)
        edge[offs] = True
        before = np.concatenate([[False], ink[:-1]])
        if plain and size:
            # The vocabulary's split always falls between a letter and a sign or digit: known words get fewer.
            edge[1:size] |= _LETTER[raw[:-1]] & _SIGN[raw[1:]]
        start = np.flatnonzero(ink & (~before | edge))
        stop = np.flatnonzero(before & (~ink | edge))
        length = stop - start
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        eight = np.ndarray(size + 9, "<u8", padded.tobytes(), strides=(1,))
        short = np.flatnonzero((length <= 16) & ~self._zeros(raw, start, stop))
        a = eight[start[short]] & _MASK[np.minimum(length[short], 8)]
        b = eight[start[short] + 8] & _MASK[np.clip(length[short] - 8, 0, 8)]
        if 2 * len(short) > self.most:  # more words than the table may hold: by smaller steps
            self._clear(1 << 17)
        slot = self._find(a, b)
        miss = slot < 0
        if miss.any():
            before_clear = self.words
            self._learn(a[miss], b[miss])
            again = miss if self.words >= before_clear and len(slot) and self._kept(slot, a, b, miss) else np.ones(len(slot), bool)
            if again.all():
                slot = self._find(a, b)
                if (slot < 0).any():
                    self._learn(a[slot < 0], b[slot < 0])
                    slot = self._find(a, b)
            else:
                slot[again] = self._find(a[again], b[again])
        n = np.zeros(len(start), np.int64)
        n[short] = self.n_ids[slot]
        long = np.flatnonzero(np.bincount(short, minlength=len(start)) == 0) if len(short) < len(start) else np.zeros(0, np.int64)
        own = [self.word(raw[start[k]:stop[k]].tobytes()) for k in long]
        n[long] = [len(x) for x in own]
        first = np.searchsorted(start, offs)
        words = np.concatenate([[0], np.cumsum(n)])
        per_row = words[first[1:]] - words[first[:-1]] + 1
        row_end = np.cumsum(per_row)
        ids = np.full(int(row_end[-1]) if rows else 0, END_ID, np.uint32)
        if len(start):
            row_of = np.repeat(np.arange(rows), first[1:] - first[:-1])
            to = words[:-1] + row_of  # one end id for each row before
            src = np.zeros(len(start), np.int64)
            src[short] = self.at[slot]
            flat = self.flat
            if len(long):
                src[long] = len(flat) + np.cumsum(n[long]) - n[long]
                flat = np.concatenate([flat, np.fromiter((x for t in own for x in t), np.uint32, int(n[long].sum()))])
            step = np.arange(int(n.sum())) - np.repeat(words[:-1], n)
            ids[np.repeat(to, n) + step] = flat[np.repeat(src, n) + step]
        return ids, per_row

    def _kept(self, slot, a, b, miss) -> bool:
        """Whether slots found before learning still hold their words (no growth, no clearing)."""
        ok = ~miss
        s = slot[ok]
        return bool(len(s) == 0 or (s.max() < len(self.at) and (self.at[s] >= 0).all() and (self.k1[s] == a[ok]).all() and (self.k2[s] == b[ok]).all()))

    @staticmethod
    def _special(raw: np.ndarray) -> bool:
        """Whether a special token may occur."""
        return b"<|" in raw.tobytes()

    @staticmethod
    def _zeros(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether a word holds a zero byte, which padding could not be told from."""
        if raw.all():
            return np.zeros(len(start), bool)
        zeros = np.concatenate([[0], np.cumsum(raw == 0)])
        return zeros[stop] > zeros[start]


def first_free_id(path: str) -> int:
    """The number after the file's largest id."""
    from tokenizers import Tokenizer

    return max(END_ID, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


_KNOWN: dict[str, WordIds | LibraryIds] = {}


def word_ids(path: str, most: int = MOST_WORDS) -> WordIds | LibraryIds:
    """The worker's own table for a tokenizer file, of at most ``most`` words; kept between tasks."""
    if path not in _KNOWN:
        with open(path, encoding="utf-8") as f:
            known = splits_at_blanks(json.load(f))
        if known:
            _KNOWN[path] = WordIds(path)
        else:
            from tokenizers import Tokenizer

            _KNOWN[path] = LibraryIds(Tokenizer.from_file(path))
    if isinstance(_KNOWN[path], WordIds):
        _KNOWN[path].most = max(_KNOWN[path].most, most)
    return _KNOWN[path]

"""The word-level byte-pair encoding of a tokenizer file: normalising, splitting and merging of words.

Reads a `tokenizers` JSON file whose words end in a suffix and whose alphabet is bytes written as
characters. Text is composed (NFC), lower-cased, split, and each word is merged by rank.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from siftwork.llm.runs import as_text, code_points, distinct

#: The contractions, letters, single digits and other signs of the tokenizer's split pattern,
#: for texts of the characters that PLAIN admits, already in lower case.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ɏß]+|[0-9]|[^\\sa-z0-9à-öø-ɏß]+")
#: Characters that need none of composing, special lower case or Unicode's space and digit classes.
#: Nor is a capital admitted whose lower case lies beyond the letters of PIECES.
BEYOND = "".join(c for c in map(chr, range(0x132, 0x250)) if not re.fullmatch("[a-zà-öø-ɏß]+", c.lower()))
UNUSUAL = re.compile(f"[^\\t-\\r -~À-ÖØ-öø-įĲ-ɏ]|[{BEYOND}]")


#: Bits of the hash table of pairs, which stays far from full.
SLOTS = 18
SPACE, LETTER, DIGIT, SIGN = range(4)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point up to U+024F and one for all beyond: is it plain, its lower case, and that one's kind."""
    plain, lower, kind = np.zeros(0x251, bool), np.zeros(0x251, np.uint32), np.zeros(0x251, np.int8)
    for i in range(0x250):
        low = chr(i).lower()
        plain[i], lower[i] = not UNUSUAL.search(chr(i)), ord(low[0])
        kind[i] = SPACE if low.isspace() else DIGIT if "0" <= low <= "9" else LETTER if re.fullmatch("[a-zà-öø-ɏß]+", low) else SIGN
    return plain, lower, kind


IS_PLAIN, LOWER, KIND = _tables()


def plain_pieces(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what PIECES finds in plain lower-case code points, which end in a space."""
    kind = KIND[units]
    new = np.ones(len(units), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    quote = np.flatnonzero((units == ord("'")) & new)  # inside a run of signs it is one of them
    if len(quote):
        a, b = (units[np.minimum(quote + i, len(units) - 1)] for i in (1, 2))
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        new[quote[one] + 1], new[quote[two] + 1] = False, False
        new[quote[one] + 2], new[quote[two] + 3] = True, True
    bounds = np.append(np.flatnonzero(new), len(units))
    starts, ends = bounds[:-1], bounds[1:]
    words = kind[starts] != SPACE
    return starts[words], ends[words]


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from 256 on, in order."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class WordBpe:
    """Splits texts into words as the tokenizer does and merges words into ids."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: A rank beyond all; pairs of ids in a hash table; the id that each rank makes.
        self.none = len(merges)
        self._hashed(np.array([self.vocab[a] << 20 | self.vocab[b] for a, b in merges], np.int64))
        self.merged = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        made = {int(m): i for i, m in enumerate(self.merged)}
        if any(max(made.get(self.vocab[x], -1) for x in pair) >= i for i, pair in enumerate(merges)):
            raise ValueError(f"{path}: a merge comes before the merges of its parts")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        #: The id of each byte inside a word and at its end.
        self.inner = np.array([self.vocab[c] for c in byte_letters()], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in byte_letters()], np.int64)
        self.library = Tokenizer.from_file(path)

    def words(self, text: str) -> list[str]:
        """Normalised words in order, spelt as plain text; special strings are words of their own."""
        if not UNUSUAL.search(text) and "<|" not in text:
            return PIECES.findall(text.lower())
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [*self._unusual(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._unusual(text[at:])

    def numbered(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words of many texts, the number of each word in text order, and how many each text has; null is empty."""
        texts = [t or "" for t in texts]
        units, ends = code_points(texts)
        capped = np.minimum(units, 0x250)
        odd = ~IS_PLAIN[capped]
        odd[:-1] |= (units[:-1] == ord("<")) & (units[1:] == ord("|"))
        others = np.unique(np.searchsorted(ends, np.flatnonzero(odd))).tolist()
        lower = LOWER[capped]
        for i in others:
            lower[ends[i] - len(texts[i]) : ends[i]] = ord(" ")
        starts, stops = plain_pieces(lower)
        first, number = distinct(lower, starts, stops)
        whole = as_text(lower)
        words = [whole[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
        if others:
            known = {w: i for i, w in enumerate(words)}
            parts = np.split(number, np.cumsum(sizes)[:-1])
            for i in others:
                parts[i] = np.array([known.setdefault(w, len(known)) for w in self.words(texts[i])], np.int64)
                sizes[i] = len(parts[i])
            words, number = list(known), np.concatenate(parts)
        return words, number, sizes

    def _unusual(self, text: str) -> list[str]:
        """Words by the file's own normaliser and split pattern; offsets are into the normalised text."""
        if not UNUSUAL.search(text):
            return PIECES.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _hashed(self, keys: np.ndarray) -> None:
        """Fills the table of pairs: each key is in the first free slot from its own on."""
        self.slots, self.slot_rank = np.full((1 << SLOTS) + 64, -1, np.int64), np.full((1 << SLOTS) + 64, self.none, np.int32)
        rank, slot = np.arange(len(keys)), self._slot(keys)
        while len(rank):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.slots[slot[placed]], self.slot_rank[slot[placed]] = keys[rank[placed]], rank[placed]
            left = np.ones(len(rank), bool)
            left[placed] = False
            rank, slot = rank[left], slot[left] + 1

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, `none` for those that never merge."""
        key = left << 20 | right
        slot = self._slot(key)
        found = self.slots[slot]
        rank = np.where(found == key, self.slot_rank[slot], self.none)
        again = np.flatnonzero((found != key) & (found >= 0))
        while len(again):  # another pair's slot: few go on to the next one
            slot[again] += 1
            found = self.slots[slot[again]]
            hit = found == key[again]
            rank[again[hit]] = self.slot_rank[slot[again[hit]]]
            again = again[~hit & (found >= 0)]
        return rank

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers; all words are merged in step.

        A round merges in every word the pair of lowest rank, at all its places from the left. Since a
        merge only makes pairs of higher rank, that equals merging one place at a time.
        """
        coded = [w.encode() if w not in self.special else b"" for w in words]
        size = np.array([len(c) for c in coded], np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        word = np.repeat(np.arange(len(words)), size)
        ids, ends = self.inner[data], (np.cumsum(size) - 1)[size > 0]
        ids[ends] = self.last[data[ends]]
        rank = np.full(len(ids), self.none)
        rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(ids[:-1], ids[1:]), self.none)
        ended: list[tuple[np.ndarray, np.ndarray]] = [(word[:0], ids[:0])]
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            over = low == self.none
            if over.any():
                ended.append((word[over], ids[over]))
                ids, word, rank, low = ids[~over], word[~over], rank[~over], low[~over]
            at = np.flatnonzero(rank == low)
            if not len(at):
                break
            # Of places that overlap, as in a run of one letter, every second one from the left.
            new = np.concatenate([[True], at[1:] != at[:-1] + 1])
            run = np.arange(len(at))
            at = at[(run - np.maximum.accumulate(np.where(new, run, 0))) % 2 == 0]
            ids[at] = self.merged[rank[at]]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, word, rank = ids[kept], word[kept], rank[kept]
            at -= np.arange(len(at))
            for p in (at, at[at > 0] - 1):
                more = p + 1 < len(ids)
                q = np.where(more, p + 1, p)
                rank[p] = np.where(more & (word[p] == word[q]), self._ranks(ids[p], ids[q]), self.none)
        word, ids = (np.concatenate([e[i] for e in ended]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        blob = ids[order].astype("<u4").tobytes()
        bounds = (4 * np.searchsorted(word[order], np.arange(len(words) + 1))).tolist()
        return [blob[a:b] if w not in self.special else self.special[w].to_bytes(4, "little") for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True)]


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)

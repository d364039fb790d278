"""Byte-level BPE of whole texts, by pieces that are coded once and remembered.

A text is cut where a code never crosses: before the space or newline of each
word. Pieces recur, so their codes come from a bounded memory; those not in
it come from the ``tokenizers`` library (ids) or from the dynamic programme
over prefixes (counts). Texts with other white space, double spaces or a
special string are cut by a slower, general pattern.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import regex

PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: White space with the word, number or sign run behind it: no cut of a text
#: inside such a unit changes how the text before it is split.
UNIT = regex.compile(
    r"'(?:s|t|re|ve|m|ll|d)"
    r"|\s*(?:\p{L}+|\p{N}+|(?<=[^\S ])'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+)|\s+"
)
SPACE = regex.compile(r"\s*")
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
#: Words that a worker remembers, about 200 bytes each and at most twice as many for a while.
MEMORY = 800_000
#: Units of texts and words that are not one unit themselves.
UNIT_MEMORY = 100_000
LONGEST_KEPT = 64
#: Lengths in bytes, longest first, at which the state of a word is remembered, and of how many beginnings.
CUTS = (10, 7, 4)
BEGINNINGS = 50_000
#: Pairs of tokens of which it is remembered whether they are compatible.
PAIRS = 100_000


def default_path() -> str:
    """The public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memory(dict):
    """Values by key, made on demand; the least used of about ``size`` are forgotten."""

    def __init__(self, make, size: int = MEMORY):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST_KEPT:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def plain_pieces(text: str) -> list[str] | None:
    """The words of a text with single spaces or newlines between them, else None.

    All but the first stand for a space and the word, or begin with a newline.
    """
    if text.replace("\n", " ") != " ".join(text.split()):
        return None
    return text.replace("\n", " \n").split(" ")


class Coder:
    """Joins what ``make`` gives for the units of a text; ``make`` returns bytes.

    Words with the space before them are remembered; the units of other texts in a memory of their own.
    """

    def __init__(self, make):
        self.make = make
        self.units = Memory(make, UNIT_MEMORY)
        self.spaced = Memory(self.by_word)

    def by_word(self, word: str) -> bytes:
        text = word if word[0] == "\n" else " " + word
        units = UNIT.findall(text)
        return self.make(text) if len(units) == 1 else b"".join(map(self.units.__getitem__, units))

    def by_units(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, UNIT.findall(text)))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        words = plain_pieces(text)
        if words is None:
            return self.by_units(text)
        return self.by_units(words[0]) + b"".join(map(self.spaced.__getitem__, words[1:]))


@lru_cache(maxsize=2)
def ids_coder(path: str):
    """A function from a text to its ids as little-endian unsigned 32-bit bytes."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special]

    def encode(piece: str) -> bytes:
        return array("I", tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    coder = Coder(encode)

    def code(text: str) -> bytes:
        return encode(text) if any(s in text for s in special) else coder(text)

    return code


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of every prefix of a text, by dynamic programming.

    The code of a prefix ends in exactly one token that is compatible with the
    last token of the shorter prefix before it: two tokens are compatible if
    the pair codes to itself. So the last token and the count of a prefix
    follow from those of shorter prefixes, and no prefix is coded anew. The
    state at a few lengths is remembered, so words share that of a common beginning.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if data["model"]["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("prefix counts need a byte-level BPE vocabulary")
        byte = byte_alphabet()
        as_bytes = lambda s: bytes(byte[c] for c in s)
        self.special = [t["content"] for t in data["added_tokens"] if t["special"]]
        self.tokens = {as_bytes(t) for t in data["model"]["vocab"] if t not in self.special}
        self.longest = max(map(len, self.tokens))
        self.rank = {}
        for i, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[as_bytes(a), as_bytes(b)] = i
        #: How each token is merged: left part, right part, rank.
        self.made = {a + b: (a, b, i) for (a, b), i in self.rank.items()}
        #: Last tokens and counts of the prefixes of common beginnings of words, by their bytes.
        self.begun: dict[bytes, tuple[tuple[bytes, ...], tuple[int, ...]]] = {}
        self.fits = Memory(lambda pair: self.compatible(*pair), PAIRS)
        self.blanks = Memory(self.counts, 1000)
        self.coder = Coder(self.unit_steps)

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Does the code of ``a + b`` consist of the tokens a and b.

        Their merges are undone from the last to the first. In between, the part
        that ends a and the part that begins b lie side by side; if these had a
        merge of an earlier rank than the one just undone, it would have come first.
        """
        rank, made = self.rank, self.made
        before = len(rank)
        while True:
            if rank.get((a, b), before) < before:
                return False
            left, right = made.get(a), made.get(b)
            if left is None and right is None:
                return True
            if right is not None and (left is None or right[2] >= left[2]):
                b, before = right[0], right[2] + 1  # of equal merges the left one comes first
            else:
                a, before = left[1], left[2]

    def counts(self, word: str) -> list[int]:
        """Tokens of each prefix of one word, by its code points, from 0 on."""
        data = word.encode("utf-8", "surrogatepass")
        tokens, longest, fits = self.tokens, self.longest, self.fits
        last, count = [b""], [0]
        for cut in CUTS:
            if cut < len(data) and data[:cut] in self.begun:
                last, count = map(list, self.begun[data[:cut]])
                break
        for end in range(len(last), len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = data[start:end]
                if token in tokens and (start == 0 or fits[last[start], token]):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("no token fits; the vocabulary lacks a byte")
            if end in CUTS and end < len(data):
                if len(self.begun) >= BEGINNINGS:
                    self.begun.clear()
                self.begun[data[:end]] = tuple(last), tuple(count)
        if len(data) == len(word):
            return count
        at, out = 0, [0]
        for c in word:
            at += len(c.encode("utf-8", "surrogatepass"))
            out.append(count[at])
        return out

    def whole(self, text: str) -> int:
        return sum(self.counts(w)[-1] for w in PATTERN.findall(text))

    def unit_counts(self, unit: str) -> list[int]:
        """Tokens of each prefix of a unit: white space, then one run of a kind or nothing."""
        cut = SPACE.match(unit).end()
        space, word = unit[:cut], unit[cut:]
        if not word:
            return self.counts(unit)
        if word in CONTRACTIONS:
            return [self.whole(unit[:k]) for k in range(len(unit) + 1)]
        if space in ("", " "):
            return self.counts(unit)
        blank = self.blanks[space]
        if space[-1] == " ":
            base, tail = blank[-2], self.counts(" " + word)[2:]
        else:
            base, tail = blank[-2] + self.counts(space[-1])[-1], self.counts(word)[1:]
        return blank + [base + n for n in tail]

    def unit_steps(self, unit: str) -> bytes:
        """How each further code point of a unit changes its count, as signed bytes."""
        counts = self.unit_counts(unit)
        return array("b", [b - a for a, b in zip(counts, counts[1:], strict=False)]).tobytes()

    def __call__(self, text: str) -> bytes:
        """The steps of a whole text; their sum over a prefix is the prefix's exact count."""
        special = next((s for s in self.special if s in text), None)
        if special is None:
            return self.coder(text)
        parts = text.split(special)
        out = self.coder(parts[0])
        for before, part in zip(parts, parts[1:], strict=False):
            unit = (UNIT.findall(before) or [""])[-1]
            now, steps = self.whole(unit), array("b")
            full = now + 1
            for k in range(1, len(special)):
                count = self.whole(unit + special[:k])
                steps.append(count - now)
                now = count
            steps.append(full - now)
            out += steps.tobytes() + self.coder(part)
        return out


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)

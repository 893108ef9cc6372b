"""Encoding whole texts with a public tokenizer, word by word with a bounded memory of words."""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

from .common import held

#: Words whose ids a worker remembers before it keeps only those just used; results do not depend on it.
MAX_WORDS = 1_000_000

#: Unicode white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class TextEncoder:
    """Ids of whole texts, as packed little-endian unsigned integers, equal to those of the tokenizers library.

    Both kinds of public tokenizers split a text at white space before they merge, so ids of a text are those of
    its words in a row. Each distinct word is encoded by the library once, many in one call, and remembered; a final comma
    or full stop after a letter is a piece of its own and is remembered apart.

    Texts with anything but single blanks and line feeds between words are cut where white space
    begins, and their pieces are remembered like words. A text that holds the string of a special token goes to the library whole, which gives that token's id."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # what is left to this one holds none of their strings
        self.path = path
        self.special = [t.content.lower() for t in self.model.get_added_tokens_decoder().values()]
        self.size = self.model.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.max_words = max_words
        names = {i: t for t, i in self.model.get_vocab(with_added_tokens=True).items()}
        tokens = [names.get(i, "") for i in range(self.size)]
        self.drops_space = not self.model.encode("a b", add_special_tokens=False).tokens[1].startswith("Ġ")
        self.opens = np.array([t.startswith("Ġ") for t in tokens])
        self.closes = np.array([t.endswith("</w>") for t in tokens])
        self.known: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}

    def _pack(self, ids: Sequence[int]) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of one piece each, from one call for many of them."""
        out: list[bytes] = []
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            text = " ".join(part) if self.drops_space else " " + " ".join(part)
            ids = np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(self.closes[ids]) + 1 if self.drops_space else np.append(np.flatnonzero(self.opens[ids])[1:], len(ids))
            if len(cut) != len(part) or (len(cut) and cut[-1] != len(ids)):
                out += self._direct(part if self.drops_space else [" " + w for w in part])
                continue
            whole, size, low = ids.tobytes(), self.dtype.itemsize, 0
            for high in cut.tolist():
                out.append(whole[low * size : high * size])
                low = high
        return out

    @staticmethod
    def _plain(word: str) -> bool:
        """Whether letters that are not ASCII stay letters, and as they are, when the tokenizer normalises them."""
        low = word.lower()
        return low.isalpha() and unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", low)

    def learn(self, words: set[str]) -> None:
        """Makes ``known`` hold all these words (None: the word's text needs the general way)."""
        stems: dict[str, int] = {}
        users: list[tuple[str, str, str]] = []
        rest: list[str] = []
        for w in words:
            tail = w[-1:] if w[-1:] in ",." else ""
            stem = w[:-1] if tail else w
            if stem.isalpha() and (stem.isascii() or self._plain(stem)):
                stems.setdefault(stem, len(stems))
                users.append((w, stem, tail))
            elif not w or "\n" in w or ODD_SPACE.search(w):
                self.known[w] = None
            else:
                rest.append(w)
        tails = {t: self._direct([t])[0] for t in (",", ".")} | {"": b""}
        made = self._encode_plain(list(stems))
        for w, stem, tail in users:
            self.known[w] = made[stems[stem]] + tails[tail]
        for w, ids in zip(rest, self._direct(rest if self.drops_space else [" " + w for w in rest])):
            self.known[w] = ids

    def _general(self, text: str) -> bytes:
        """Ids of any text: its pieces up to the next white space, in the library's own division."""
        pattern = f"[^{SPACE}]+" if self.drops_space else f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        pieces = re.findall(pattern, text)
        used = {*pieces}
        if len(self.pieces) > self.max_words:
            self.pieces = {p: self.pieces[p] for p in used if p in self.pieces}
        new = list(used.difference(self.pieces))
        self.pieces.update(zip(new, self._direct(new)))
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _marked(self, text: str) -> bool:
        """Whether the text may hold the string of a special token, however it is normalised."""
        if not any(s[:2] in text for s in self.special):
            return False
        low = text.lower()
        return any(s in low for s in self.special)

    def _words(self, text: str) -> list[list[str]]:
        """Words of each line."""
        if self.drops_space:
            return [text.split()]
        return [line.split(" ") for line in text.split("\n")]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text, packed."""
        marked = [self._marked(t) for t in texts]
        ready = [None if m or ODD_SPACE.search(t) else self._words(t) for t, m in zip(texts, marked)]
        used: set[str] = set()
        for lines in ready:
            for line in lines or ():
                used.update(line if self.drops_space else line[1:])
        if len(self.known) > self.max_words:
            self.known = {w: self.known[w] for w in used if w in self.known}
        self.learn(used.difference(self.known))
        return [
            self._pack(self.whole.encode(t, add_special_tokens=False).ids) if m else self._general(t) if lines is None else self._assemble(t, lines)
            for t, m, lines in zip(texts, marked, ready)
        ]

    def _assemble(self, text: str, lines: list[list[str]]) -> bytes:
        get = self.known.__getitem__
        try:
            if self.drops_space:
                return b"".join(map(get, lines[0]))
            heads = [line[0] for line in lines]
            if len(lines) > 1 and ("" in heads or any(line[-1] == "" for line in lines)) or len(lines[0]) > 1 and not heads[0]:
                return self._general(text)
            first = self._heads(heads)
            parts = [h + b"".join(map(get, line[1:])) for h, line in zip(first, lines)]
            return self.feed.join(parts)
        except TypeError:
            return self._general(text)

    @functools.cached_property
    def whole(self):
        """The library's tokenizer as the contract calls it, made when the first text with a special token's string comes."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def feed(self) -> bytes:
        return self._direct(["\n"])[0]

    def _heads(self, words: list[str]) -> list[bytes]:
        """Ids of words with no blank before them."""
        marked = ["\n" + w for w in words]
        new = [m for m in marked if m not in self.known]
        for m, ids in zip(new, self._direct([m[1:] for m in new])):
            self.known[m] = ids
        return [self.known[m] for m in marked]


def encoder(path: str) -> TextEncoder:
    """The worker's encoder of a tokenizer file."""
    return held("encoding", path, lambda: TextEncoder(path))

"""Exact subword encoding inside tasks, with a memory for words.

Both supported kinds of tokenizer cut a text to words by a pattern before any
merge, so the ids of a text are the ids of its words in a row. A word is merged
by the tokenizers library's model when it is first met and then remembered; a
text with characters for which the standard library's patterns might differ from
the tokenizer's own is given to the tokenizers library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np

# Remembered words per Python worker. Beyond it the half that came first is
# kept: frequent words are met early. Longer words are merged each time, so the
# memory is bounded in bytes too.
WORDS = 300_000
LONGEST = 128
# No marks, no separators but ASCII white space, no numerals but 0-9, so categories
# agree between all pattern libraries.
USUAL = (
    "\t-\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ſ"
    "‐-‧‰-⁞€"
)
UNUSUAL = re.compile(f"[^{USUAL}]")


def listed(kind: str) -> str:
    """The usual characters of a kind, as a set that is looked up in one step."""
    usual = re.findall(f"[{USUAL}]", "".join(map(chr, range(0x20AD))))
    return f"[{''.join(re.escape(c) for c in usual if re.fullmatch(kind, c))}]"


LETTER, OTHER = listed(r"[^\W\d_]"), listed(r"[^\w\s]|_")
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
# The frequent alternative goes first; it starts with other characters than SHORT.
WORD = re.compile(rf"{LETTER}+|{SHORT}|[0-9]|{OTHER}+")
SPACED = re.compile(rf" ?{LETTER}+|{SHORT}| ?[0-9]+| ?{OTHER}+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
# Byte-level tokenizers write each byte as a printable character: itself where
# it is one in Latin-1, else the next free character from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {
    b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(PLAIN))
}


class Words(dict):
    """The ids of words; one that is not there is merged when it is looked up."""

    def __init__(self, merged: Callable[[str], bytes], known: Iterable[tuple[str, bytes]] = ()) -> None:
        super().__init__(known)
        self.merged = merged

    def __missing__(self, word: str) -> bytes:
        ids = self.merged(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class Encoder:
    """Encodes and decodes lists of texts as the tokenizers library does.

    ``most`` is the number of remembered words, by default ``WORDS``.
    """

    def __init__(self, path: str, most: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        added = [t["content"] for t in settings["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.spaced = settings["pre_tokenizer"]["type"] == "ByteLevel"
        self.model = self.whole.model
        self.most = WORDS if most is None else most
        self.known = Words(self.word)
        self.joined = settings["decoder"] is None
        if self.joined:
            self.tokens = [
                self.whole.id_to_token(i) or ""
                for i in range(self.whole.get_vocab_size(with_added_tokens=True))
            ]

    def words(self, text: str) -> list[str] | None:
        """The words of a text, or None where the library must do it."""
        if UNUSUAL.search(text) or self.special.search(text):
            return None
        return SPACED.findall(text) if self.spaced else WORD.findall(text.lower())

    def library(self, texts: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def word(self, word: str) -> bytes:
        """The ids of one word by the tokenizer's own merges."""
        if word.isascii() and word[-1] > " ":  # only a leading space is written otherwise
            spelled = BYTES[32] + word[1:] if word[0] == " " else word
        else:
            spelled = word.encode().decode("latin-1").translate(BYTES)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.words(t) for t in texts]
        if len(self.known) > self.most:
            self.known = Words(self.word, islice(self.known.items(), self.most // 2))
        ids = self.known.__getitem__
        return [
            self.library([t])[0] if ws is None else b"".join(map(ids, ws))
            for t, ws in zip(texts, split)
        ]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts of encoded ids, special tokens included."""
        lists = [np.frombuffer(b, "<u4").tolist() for b in ids]
        if self.joined:
            name = self.tokens.__getitem__
            return [" ".join(map(name, x)) for x in lists]
        return self.whole.decode_batch(lists, skip_special_tokens=False)


_made: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, most: int | None = None) -> Encoder:
    """One encoder per worker process, file and number of remembered words."""
    if (path, most) not in _made:
        _made[path, most] = Encoder(path, most)
    return _made[path, most]


def blocks(texts: list[str], chars: int = 2_000_000):
    """Runs of a batch with about so many characters: (from, to)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)

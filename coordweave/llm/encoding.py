"""Identifiers of texts under a vocabulary with word ends, as the tokenizers library gives them.

Words of plain Latin text are found by one pattern and encoded together by tiktoken, in which the end of a word is a byte of
its own that joins the last character before anything else does. Both libraries merge the pair of lowest rank first, and a
token here comes from one pair only (checked on loading), so they agree; tests hold them equal. Whatever is not plain - other
scripts, combining marks, special strings - goes to the tokenizers library, which is loaded when first needed.
"""

from __future__ import annotations

import json
import re

import numpy as np

END = "\x00"  # stands for the end of a word; texts that hold it are not plain
# Characters whose lower case, composition and class both libraries take alike.
_PLAIN = re.compile("[\x01-\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
_WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r 0-9a-zß-öø-ÿ]+").findall
_BLANKS = re.compile("[\t\n\r ]+").split


class WordEndEncoder:
    """Maps texts to the bytes of their identifiers (unsigned, little-endian, 32 bits)."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self._library = path, None
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, ending = content["model"], content["model"]["end_of_word_suffix"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
        self.special = [t["content"] for t in content["added_tokens"]]
        ranks = {}
        for piece, number in model["vocab"].items():
            if piece not in self.special:
                ended = piece.endswith(ending)
                ranks[bytes(byte_of[c] for c in (piece[: -len(ending)] if ended else piece)) + END.encode() * ended] = number
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        first = 512  # bytes, and bytes that end a word
        if sorted(ranks.values()) != list(range(len(ranks))) or made != list(range(first, first + len(made))) or len(ranks) != first + len(made):
            raise ValueError(f"{path}: not a vocabulary of bytes, last bytes and one token per merge in order")
        self.fast = tiktoken.Encoding("own", pat_str="[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def _exact(self, text: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library.encode(text, add_special_tokens=False).ids

    def _is_plain(self, text: str) -> bool:
        return _PLAIN(text) is not None and not any(s in text for s in self.special)

    def _words(self, words: list[str]) -> list[int]:
        return self.fast.encode_ordinary(END.join(words) + END) if words else []

    def encode(self, text: str) -> bytes:
        if self._is_plain(text):
            ids = self._words(_WORDS(text.lower()))
        else:  # no token spans a blank
            ids, held = [], []
            for part in _BLANKS(text):
                if self._is_plain(part):
                    held += _WORDS(part.lower())
                else:
                    ids += self._words(held)
                    ids += self._exact(part)
                    held = []
            ids += self._words(held)
        return np.array(ids, "<u4").tobytes()


_ENCODERS: dict[str, WordEndEncoder] = {}


def encoder(path: str) -> WordEndEncoder:
    """The worker's encoder for ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEndEncoder(path)
    return _ENCODERS[path]

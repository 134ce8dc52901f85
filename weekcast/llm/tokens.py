"""Subword ids by a tokenizer file, each distinct word of a task encoded once."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd

from weekcast.llm.common import spread

#: Characters for which the plain patterns below split exactly as the tokenizers library does: ASCII without
#: control characters, and the letters of Latin-1. A text with any other character is encoded whole.
PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The split rule of the lower-casing word vocabulary, over plain text.
LOWER_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: The split rule of the byte-level vocabulary, over plain text.
BYTE_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
#: Words in each of the two generations of a worker's word table.
TABLE_WORDS = 250_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the
    other bytes, in order, for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTER_OF = {byte: letter for letter, byte in byte_letters().items()}


def load_tokenizer(path: str):
    """The file's tokenizer with truncation and padding off; encoding stays in the task's own thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def word_ids(model, word: str) -> list[int]:
    """The merges' result for one word that the split rule has cut and the normaliser has seen."""
    return [token.id for token in model.tokenize(word.encode().decode("latin-1").translate(LETTER_OF))]


class LowerWordEncoder:
    """Ids of whole texts by a lower-casing word vocabulary, as the tokenizers library gives them.

    The word table has two generations: when the young one is full it becomes the old one, so that words
    that go on occurring are kept and the table stays bounded."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.specials = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids end to end) of distinct words."""
        model, out = self.tokenizer.model, []
        for word in words:
            ids = self.young.get(word)
            if ids is None:
                ids = self.old.get(word)
                if ids is None:
                    ids = np.array(word_ids(model, word), "<u4").tobytes()
                if len(self.young) >= TABLE_WORDS:
                    self.old, self.young = self.young, {}
                self.young[word] = ids
            out.append(ids)
        return np.fromiter(map(len, out), np.int64, len(out)) // 4, np.frombuffer(b"".join(out), "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32 arrays."""
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        split = [LOWER_WORD.findall(texts[i].lower()) for i in plain]
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        if plain:
            code, words = pd.factorize(np.array([w for s in split for w in s], dtype=object))
            if len(words):
                lengths, ids = self._ids(list(words))
                flat = ids[spread((np.cumsum(lengths) - lengths)[code], lengths[code])]
                upto = np.concatenate([[0], np.cumsum(lengths[code])])[np.concatenate([[0], np.cumsum([len(s) for s in split])])]
                for k, i in enumerate(plain):
                    out[i] = flat[upto[k] : upto[k + 1]]
        for i in set(range(len(texts))) - set(plain):
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(maxsize=2)
def lower_word_encoder(path: str) -> LowerWordEncoder:
    """One encoder for all tasks that a worker process runs."""
    return LowerWordEncoder(path)

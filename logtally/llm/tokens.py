"""Token ids of whole texts under a public vocabulary, as fast as the ``tokenizers`` library allows.

The vocabulary's pre-tokenizer never joins what white space separates, so a text's ids are those of
its words. Each word is looked up once per task; words of plain Latin letters go straight to the BPE
model, all others through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import struct

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Words that a task remembers; a bound of memory only.
MEMO_WORDS = 1_000_000
#: Letters whose normal form and lower case are one for one.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\\-./:;<=>?@\\[\\]^_`{|}~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    """``ids(text)``: the ids of a UTF-8 text as little-endian unsigned 32-bit numbers, without special tokens.

    For vocabularies whose pre-tokenizer splits at white space and whose normalizer is NFC and lower case.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        splits = [x["type"] for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: not a vocabulary of lower-case words")
        # Special tokens inside a text are found across words.
        self.special = [t["content"].encode() for t in made.get("added_tokens", [])]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _of_model(self, part: str) -> bytes:
        found = self.cores.get(part)
        if found is None:
            if len(self.cores) > MEMO_WORDS:
                self.cores.clear()
            written = part.encode().decode("latin-1").translate(self.letters)
            found = self.cores[part] = _packed([t.id for t in self.model.tokenize(written)])
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        plain = _PLAIN.fullmatch(text)
        if not plain:
            return self.whole(text)
        return self._of_model(plain[1].lower()) + (self._of_model(plain[2]) if plain[2] else b"")

    def _learn(self, word: bytes) -> bytes:
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        self.known[word] = found = self._word(word)
        return found

    def ids(self, text: bytes) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text.decode())
        get, learn = self.known.get, self._learn
        return b"".join([get(w) or learn(w) for w in text.split()])

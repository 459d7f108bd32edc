"""Token ids of the public word-level BPE vocabulary, quickly.

The ids are those of the `tokenizers` library for the same file with add_special_tokens=False. White space never lies inside a
token of this vocabulary, so texts are cut at ASCII blanks and each distinct word is encoded once per worker (a bounded cache).
Words of ASCII and Latin characters go through `tiktoken` with the same merges: the end-of-word mark becomes a newline byte, whose
merges with the last byte rank first. All other words, and those that hold a special token, go through `tokenizers` itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pre-tokenizer's pattern in the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = b"\n"
#: Characters below this code point take the quick path: lower-casing them needs no context, and none of them composes with another.
QUICK = 0x180


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache_words: int = 400_000):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix, letters = model["vocab"], model["end_of_word_suffix"], _byte_letters()

        def raw(token: str) -> bytes:
            body = token.removesuffix(suffix)
            return bytes(letters[c] for c in body) + (END if token != body else b"")

        ranks = {bytes([b]): b for b in range(256)}
        ids = np.zeros(512 + len(model["merges"]), np.uint32)
        for c, b in letters.items():
            ids[b] = vocab[c]
            ranks[bytes([b]) + END] = 256 + b
            ids[256 + b] = vocab[c + suffix]
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(raw(a) + raw(b), 512 + k)
            ids[512 + k] = vocab[a + b]
        self.quick = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})
        self.ids, self.mark = ids, ranks[b"\r\n"]
        self.pieces = regex.compile(PIECES)
        self.odd = regex.compile(f"[^\\x00-{chr(QUICK - 1)}]|<\\|")
        self.cache: dict[bytes, bytes] = {}
        self.cache_words = cache_words

    def _learn(self, words: list[bytes]) -> None:
        text = b"\n".join(words).decode()
        slow = []
        if self.odd.search(text):
            slow = [w for w in words if self.odd.search(w.decode())]
            words = [w for w in words if not self.odd.search(w.decode())]
            text = b"\n".join(words).decode()
        if words:
            cut_up = self.pieces.findall
            parts = [s + "\n\r" if s.isalpha() else "\n".join([*cut_up(s), "\r"]) for s in text.lower().split("\n")]
            found = self.quick.encode_to_numpy("\n".join(parts) + "\n", disallowed_special=())
            ends = np.flatnonzero(found == self.mark)
            raw = self.ids[found].astype("<u4").tobytes()
            bounds = (4 * ends).tolist()
            self.cache.update(zip(words, [raw[a + 4 : b] for a, b in zip([-4, *bounds], bounds, strict=False)], strict=True))
        for w, e in zip(slow, self.slow.encode_batch([w.decode() for w in slow], add_special_tokens=False), strict=True):
            self.cache[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; a null is an empty text."""
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        get = self.cache.get
        split = [(t or "").encode().split() for t in texts]
        found = [list(map(get, words)) for words in split]
        late = [k for k, x in enumerate(found) if None in x]
        if late:
            self._learn(list({w for k in late for w, x in zip(split[k], found[k], strict=True) if x is None}))
            for k in late:
                found[k] = list(map(get, split[k]))
        return [b"".join(x) for x in found]


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One encoder per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]

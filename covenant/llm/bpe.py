"""Byte-level BPE over a public ``tokenizers`` vocabulary file.

Ids are those of the ``tokenizers`` library. Where the file is of the plain
byte-level kind, its vocabulary is handed to ``tiktoken``, whose merge order is
the order of ids; tests hold both libraries to the same ids. Any other file goes
through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The split pattern of this family of vocabularies. White space is
# spelled as the Unicode property, which is what the library's engine matches.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# The same pattern where all characters are below U+0250 and no separator
# controls occur: there the classes can be listed, which `re` matches faster.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "
SPLIT_LATIN = re.compile(
    f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+"
    f"| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
OUTSIDE_LATIN = re.compile("[^\x00-\x1b\x20-ɏ]")

#: Longer pre-tokens are worked out each time rather than remembered.
LONG = 64


def split(text: str) -> list[str]:
    """Pre-tokens of a text without special strings."""
    return (SPLIT if OUTSIDE_LATIN.search(text) else SPLIT_LATIN).findall(text)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


#: Characters of the Unicode property White_Space (fixed values).
SPACES = frozenset(
    "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes, as such vocabularies spell them."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Vocabulary:
    """A ``tokenizers`` file; one per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = (
            re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.byte_level = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        self.ids: dict[bytes, int] = {}
        self.joins: dict[tuple[int, int], int] = {}
        if self.byte_level:
            back = {c: b for b, c in byte_alphabet().items()}
            raw = lambda s: bytes(back[c] for c in s)
            self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            joined = [self.ids[raw(a + b)] for a, b in merges]
            # merges must be in the order of the ids they make
            self.byte_level = all(x < y for x, y in zip(joined, joined[1:]))
            self.joins = {(self.ids[raw(a)], self.ids[raw(b)]): i for (a, b), i in zip(merges, joined)}
        self.ranked = None

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stand alone in the list."""
        if self.at_special is None or not self.at_special.search(text):
            return [text]
        return [x for x in self.at_special.split(text) if x]

    def _rank_encoder(self):
        """The same vocabulary and merges in the ``tiktoken`` library, which is several times faster."""
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding(
            os.path.basename(self.path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ids, special_tokens={}
        )

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of a whole text, as unsigned 32-bit integers."""
        if not self.byte_level:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if self.ranked is None:
            self.ranked = self._rank_encoder()
        parts = self.segments(text)
        found = [
            np.asarray([self.special[x]], dtype="<u4") if x in self.special else self.ranked.encode_to_numpy(x, disallowed_special=())
            for x in parts
        ]
        return found[0] if len(found) == 1 else np.concatenate(found or [np.zeros(0, dtype="<u4")])


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's copy of a vocabulary, loaded at its first use."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

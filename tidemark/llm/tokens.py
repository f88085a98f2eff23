"""Byte-pair vocabularies: token ids of texts and the strings that are one token alone.

``Vocabulary`` takes the path of a tokenizers .json file of a byte-level BPE.
Its merges run in tiktoken, whose ids for the same ranks and pattern are the
same; tests compare the two libraries.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space that starts a pre-token whatever stands before it: what follows isn't white space.
_STARTING_SPACE = re.compile(rb" (?!$|[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)")
_DOUBTFUL_SPACE = re.compile(rb" (?:$|[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)")

#: Longer runs of white space are cut out of a text before the pattern sees it: it looks ahead from each of their places.
LONG_RUN = 1 << 15

#: Fixed value: the white space of the pattern.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of texts as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letter = _byte_of_letter()
        ranks = {bytes(letter[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self._bpe = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._ranks = ranks
        self._special = [s.encode() for s in special]
        self._special_ids = special
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def ids(self, text: bytes) -> np.ndarray:
        """Strings of special tokens inside a text count as these, which is the library's default."""
        plain = text.decode("utf-8", "replace")
        if len(plain) < LONG_RUN or not _LONG_RUN.search(plain):
            return self._bpe.encode_to_numpy(plain, allowed_special="all")
        out: list[np.ndarray] = []
        for part in self._special_split.split(plain) if self._special_split else [plain]:
            out.append(np.array([self._special_ids[part]], dtype=np.uint32) if part in self._special_ids else self._long(part))
        return np.concatenate(out)

    def _long(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens whose long runs of white space are cut out.

        The pattern takes such a run as one piece, but for its last character
        if a word follows. What stands before the run ends in another
        character, so no piece crosses either cut.
        """
        out, at = [], 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            out.append(self._bpe.encode_to_numpy(text[at : run.start()]))
            out.append(np.array(self._bpe._encode_single_piece(text[run.start() : end]), dtype=np.uint32))
            at = end
        out.append(self._bpe.encode_to_numpy(text[at:]))
        return np.concatenate(out)

    @functools.cached_property
    def whole(self) -> frozenset[bytes]:
        """The vocabulary's strings of a space and a pre-token that encode alone as one token, without the space.

        The proof is by encoding each of the vocabulary's strings once. What
        is one pre-token here is one in any text too, as it starts at a space
        that a character other than white space follows, and a caller cuts at
        the next such space.
        """
        out = set()
        for raw in self._ranks:
            if raw[:1] == b" " and len(raw) > 1 and b" " not in raw[1:] and not _DOUBTFUL_SPACE.match(raw):
                try:
                    text = raw.decode()
                except UnicodeDecodeError:
                    continue
                if len(self._bpe.encode_ordinary(text)) == 1:
                    out.add(raw[1:])
        return frozenset(out)

    def count(self, text: bytes) -> int:
        """len(ids(text)): proven pieces count one each, and only the rest is merged."""
        if any(s in text for s in self._special):
            return len(self.ids(text))
        pieces = _STARTING_SPACE.split(text) if _DOUBTFUL_SPACE.search(text) else text.split(b" ")
        whole = self.whole
        rest = [p for p in pieces[1:] if p not in whole]
        merged = b" ".join([pieces[0], *rest])
        return len(pieces) - 1 - len(rest) + (len(self.ids(merged)) if merged else 0)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Vocabulary(path)

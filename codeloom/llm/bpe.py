"""Byte-level BPE ids of whole texts, by a public tokenizer file whose path is a parameter.

The file is a `tokenizers` JSON. Its merges run in the tiktoken library, several times as fast with the
same ids; a text that holds one of the file's special tokens, or that the fast form refuses, goes
through `tokenizers` itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np

#: Fixed value: the pre-tokenizer pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that such vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        letters, ranks = _byte_letters(), {}
        for word, i in spec["model"]["vocab"].items():
            if word not in self.special:
                ranks[bytes(letters[c] for c in word)] = i
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return np.asarray(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as e:  # its panics on very long runs of white space are no Exception
                if type(e).__name__ not in ("PanicException", "ValueError", "RuntimeError"):
                    raise
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One a worker process."""
    return Encoder(path)

"""Byte-level BPE vocabularies, read from a tokenizers file whose path is a parameter."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How byte-level files spell bytes: printable ones as they are, the others from U+0100 on.
def _spelling() -> dict[str, int]:
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """tokens: bytes of each id; merges: (left id, right id, merged id) by rank; special: the
    added tokens' bytes and ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spell = _spelling()
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if v not in self.special.values()}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * self.size
        for k, v in vocab.items():
            self.tokens[v] = bytes(spell[c] for c in k)
        for k, v in self.special.items():
            self.tokens[v] = k
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(spell.items(), key=lambda x: x[1])], np.int32)
        self.ranks = {self.tokens[v]: v for v in vocab.values()}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def library_encoding(path: str):
    """A compiled encoder with the file's vocabulary. Its pattern is the byte-level one."""
    import public_tokenizers
    import tiktoken

    v = vocabulary(path)
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={k.decode(): i for k, i in v.special.items()})


@lru_cache(maxsize=4)
def tokenizer(path: str, added: bool = True):
    """The tokenizers library's encoder, without truncation and padding; with `added` false, the
    strings of added tokens are plain text."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec |= {"truncation": None, "padding": None} | ({} if added else {"added_tokens": []})
    return Tokenizer.from_str(json.dumps(spec))


def encode(path: str, text: str, added: bool = True) -> np.ndarray:
    """The ids that the tokenizers library gives a text. The compiled encoder makes them, unless a
    run of white space is longer than its pattern's stack (about a million characters)."""
    fast = library_encoding(path)
    try:
        ids = fast.encode_to_numpy(text, allowed_special="all" if added else set(), disallowed_special=())
    except ValueError:
        ids = np.array(tokenizer(path, added).encode(text, add_special_tokens=False).ids, "<u4")
    return ids.astype("<u4", copy=False)

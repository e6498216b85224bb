"""Tokenizers for chunking and budgets: a rank file, a tokenizer file, or plain characters."""

from __future__ import annotations

import base64
import os
from typing import Protocol

# Fixed value: the public pattern that byte-level rank files are meant for.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, ids: list) -> str: ...


class Characters:
    """One token a character; needs no vocabulary."""

    def encode(self, text: str) -> list[str]:
        return list(text)

    def decode(self, ids: list[str]) -> str:
        return "".join(ids)


class Ranks:
    """Byte-level BPE from a file of base64 tokens and ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.coder = tiktoken.Encoding(os.path.basename(path), pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.coder.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.coder.decode(ids)


class TokenizerFile:
    """A tokenizer.json; special tokens count."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Loaded

        self.coder = Loaded.from_file(path)

    def encode(self, text: str) -> list[int]:
        return self.coder.encode(text).ids

    def decode(self, ids: list[int]) -> str:
        return self.coder.decode(ids)


def resolved(name: str | None) -> str | None:
    """What a configured name comes to, decided once, on the driver: the file, or None for characters if there is no
    such file or its library is missing."""
    try:
        tokenizer_for(name)
    except (OSError, ImportError, ValueError):
        return None
    return name or None


def tokenizer_for(name: str | None = None) -> Tokenizer:
    """By the file's ending; characters without a name.  A file or library that is missing is an error here, so that no
    executor counts otherwise than the rest."""
    if not name:
        return Characters()
    if not os.path.exists(name):
        raise FileNotFoundError(f"no vocabulary {name} on this machine")
    return TokenizerFile(name) if name.endswith(".json") else Ranks(name)


def truncate(text: str, most: int | None, tokenizer: Tokenizer) -> str:
    """The first tokens; no limit if null or not positive."""
    if not most or most < 0:
        return text
    ids = tokenizer.encode(text)
    return text if len(ids) <= most else tokenizer.decode(ids[:most])

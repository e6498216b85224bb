"""Byte-level BPE from a rank file, loaded once in each Python worker."""

from __future__ import annotations

import base64
import hashlib
import re

from ..functions.tokenizers import PRE_TOKENS

#: The rank files' vocabulary; a parameter everywhere.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Runs of white space from here on go past the pattern, whose backtracking keeps a state for each character.
LONG_BLANK = 10_000
# Fixed value: characters that the pattern's \s matches.
_BLANK = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_BLANK = re.compile(rf"(?<![{_BLANK}])[{_BLANK}]{{{LONG_BLANK},}}")

_loaded: dict[str, object] = {}


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The rank file's bytes, read on the driver; executors get them by broadcast (about 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encoding(vocabulary: bytes):
    import tiktoken

    key = hashlib.md5(vocabulary).hexdigest()
    if key not in _loaded:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _loaded[key] = tiktoken.Encoding(key, pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def vocabulary_size(vocabulary: bytes) -> int:
    return 1 + max(int(line.split()[1]) for line in vocabulary.splitlines() if line)


def encode(coder, text: str) -> list[int]:
    """The text's ids, however long its runs of one kind of character are.

    A run of white space is a pre-token that leaves its last character to what follows, or keeps it at the text's
    end; both ends are pre-token boundaries, so the run is merged alone and the rest by the pattern.
    """
    if len(text) < LONG_BLANK:
        return coder.encode_ordinary(text)
    out, at = [], 0
    for m in _LONG_BLANK.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += coder.encode_ordinary(text[at : m.start()])
        out += coder._encode_single_piece(text[m.start() : end])
        at = end
    return out + coder.encode_ordinary(text[at:])

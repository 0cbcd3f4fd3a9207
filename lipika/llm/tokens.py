"""Byte-level BPE ids for whole texts."""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The rank file of ``byte_bpe_50k.json``: the same vocabulary and ids, several times as fast."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The added token of ``byte_bpe_50k.json``.
SPECIAL = {"<|endoftext|>": 50256}
_loaded: dict[tuple[str, bool], Callable[[str | None], bytes]] = {}


def byte_bpe(path: str, special: bool = False) -> Callable[[str | None], bytes]:
    """The worker's encoder for a rank file of at most 65,536 ids, loaded once.

    It gives ids as little-endian unsigned 16-bit numbers: none for a null or empty text. The
    string of the added token is ordinary text, or that token's id if ``special``, as ``tokenizers``
    has it unless told otherwise.
    """
    if (path, special) not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(ranks.values()) >= 65_536:
            raise ValueError("ids do not fit in 16 bits")
        encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL if special else {})

        def encode(text: str | None) -> bytes:
            if not text:
                return b""
            ids = array("H", encoding.encode(text, allowed_special="all") if special else encoding.encode_ordinary(text))
            if sys.byteorder == "big":
                ids.byteswap()
            return ids.tobytes()

        _loaded[path, special] = encode
    return _loaded[path, special]

"""Token ids of whole texts, by a public vocabulary whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import tiktoken

#: Fixed value: how the byte-level vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Fixed value: the string that is one id, the first after the ranks.
SPECIAL = "<|endoftext|>"


def vocabulary() -> str:
    """The ranks of the 50k byte-level vocabulary; its ids are those of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids; the special string is one id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return lambda text: encoding.encode_to_numpy(text, allowed_special={SPECIAL}, disallowed_special=())

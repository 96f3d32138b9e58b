"""Token counts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import cache

#: Where the vocabulary files of the public tokenizers are; each executor needs it.
FOLDER = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
# Fixed value: how this tokenizer cuts a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def load(path: str):
    """The encoder of a file, once per Python worker: byte ranks (``.tiktoken``) or
    a tokenizer description (``.json``)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    from tiktoken import Encoding

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    one = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda texts: [one(t) for t in texts]


def encode(texts: list[str], path: str = f"{FOLDER}/{TOKENIZER}") -> list[list[int]]:
    """Token ids of whole texts; null texts have none."""
    return load(path)([t or "" for t in texts])

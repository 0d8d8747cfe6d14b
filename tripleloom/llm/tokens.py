"""Token counts and offsets by a public byte-pair vocabulary, whose file stays outside the repository."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Rank file of the default vocabulary; every caller can pass another path.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits a text before merging: contractions, words, numbers, signs, blanks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str = DEFAULT_TOKENIZER):
    """The encoding of a rank file, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_starts(encoding, text: str) -> list[int]:
    """Code-point offset at which each token starts; a token inside a code point starts with it."""
    ids = encoding.encode_ordinary(text)
    starts, at = [], 0
    heads = [i for i, b in enumerate(text.encode("utf-8", "surrogatepass")) if b & 0xC0 != 0x80]
    place = 0
    for i in ids:
        while place + 1 < len(heads) and heads[place + 1] <= at:
            place += 1
        starts.append(place)
        at += len(encoding.decode_single_token_bytes(i))
    return starts

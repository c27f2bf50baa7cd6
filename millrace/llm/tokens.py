"""Token ids of a byte-level BPE vocabulary file, the same ids as the ``tokenizers`` library gives.

Short white-space-separated texts go through a second engine built from the same file, about four times as fast;
texts with very long runs, where that engine's matcher is slow or fails, go through ``tokenizers`` itself.
Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

#: Fixed value: how byte-level BPE files of this family split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LONG_RUN = re.compile(r"\s{2000}|\S{4000}")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use: visible Latin-1 characters stand for themselves, others for 256 + k."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """A function from a text to its token ids."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    exact.encode_special_tokens = True
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = _byte_of_char()
    special = {x.content for x in exact.get_added_tokens_decoder().values()}
    ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("fast", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if _LONG_RUN.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode

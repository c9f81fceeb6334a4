"""Token ids of one byte-level BPE vocabulary, by the faster of two libraries.

``tiktoken`` and ``tokenizers`` give equal ids for this vocabulary.  The first is
four times as fast; it is used for texts made of Latin, punctuation and symbol
characters, where both libraries class every character alike.  All other texts, and
texts that spell a special token, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: Characters that both libraries' Unicode tables class alike: Latin letters and marks, general punctuation, currency.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧‰-⁞€]*\Z")


@lru_cache(maxsize=4)
def encoder(tokenizer_file: str | None = None):
    """``f(text) -> uint32 ids`` for a ``tokenizers`` file; None: the public 50k byte-level BPE.

    A ``.tiktoken`` file of the same name beside it is taken as the same vocabulary.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    import public_tokenizers

    path = tokenizer_file or public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    ranks_file = path.removesuffix(".json") + ".tiktoken"
    fast = None
    if os.path.exists(ranks_file):
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("tessera", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is not None and _PLAIN.match(text) and not any(s in text for s in special):
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    encode.vocab_size = slow.get_vocab_size(with_added_tokens=True)
    return encode

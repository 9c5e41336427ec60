"""Token ids of a public byte-level BPE, fast enough for whole corpora.

The default vocabulary also exists as a rank file, which a second public library reads several times
faster with the same ids (tests compare both); any other file, and any text the fast library refuses,
goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Callable

import public_tokenizers

DEFAULT, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END = 2


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


class Encoder:
    """``ids(text)`` as ``tokenizers`` gives them without special tokens; their strings are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self._slow = path, None
        self._fast: Callable[[str], list[int]] | None = None
        ranks = os.path.join(os.path.dirname(path), RANKS)
        if os.path.basename(path) == DEFAULT and os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self._fast is None:
            return self.slow(text)
        try:
            return self._fast(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # a Rust panic on extreme texts is no Exception
            return self.slow(text)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return array("I", self.ids(text)).tobytes()


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and path."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]

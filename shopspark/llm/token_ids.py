"""Token ids of a byte-level tokenizer file, merged over whole texts.

The file's vocabulary and word pattern are read through the tokenizers library; the
merges of a text then run in one call that takes the tokens' ids as their rank, which
is the order of the merges in such files. Words of extraordinary length, where that
call would take the square of the length, go through the library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

LONG_RUN = 4096


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 are their own letters, the others take the letters from 256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


def longest_run(text: str) -> int:
    """Bytes in the longest run of blanks, or of no blanks; no word of the pattern is longer by more than one."""
    data = np.frombuffer(text.encode(), np.uint8)
    turns = np.flatnonzero(np.diff((data <= 0x20).view(np.int8)))
    return int(np.diff(np.concatenate([[-1], turns, [len(data) - 1]])).max(initial=0))


class TokenIds:
    """Ids of texts, equal to the file's tokenizer without ``add_special_tokens``."""

    def __init__(self, path: str, encode_special_tokens: bool = False, pattern: str | None = None):
        """``pattern`` cuts texts into words; unless given, that of the public byte-level files."""
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = encode_special_tokens
        added = self.whole.get_added_tokens_decoder()
        taken = {t.content: t for t in added.values() if t.content and not (t.special and encode_special_tokens)}
        # Texts with an added token that is taken out of the words go through the library.
        self.added = re.compile("|".join(map(re.escape, taken))).search if taken else None
        settings = json.loads(self.whole.to_str())
        self.plain = settings.get("normalizer") is None and settings["model"]["type"] == "BPE"
        letters = byte_of_letter()
        outside = {t.content for t in added.values()}
        ranks = {
            bytes(letters[c] for c in token): at
            for token, at in self.whole.get_vocab(with_added_tokens=False).items()
            if token not in outside
        }
        self.merge = tiktoken.Encoding("file", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if not self.plain or (self.added and self.added(text)) or longest_run(text) > LONG_RUN:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return self.merge.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

"""Token ids of whole texts with the byte-level vocabulary of a public tokenizer, a batch of rows at a time."""

from __future__ import annotations

import base64
import os

#: Folder of the vocabulary files; they are read where the tasks run and never copied.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
END_OF_TEXT, END_ID = "<|endoftext|>", 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_made: dict[tuple, object] = {}


class Encoder:
    """``ids(text)`` as ``tokenizers`` gives them for ``byte_bpe_50k.json`` without added special tokens.

    The same vocabulary as ranks is several times faster. Texts that hold the end-of-text string, or that the
    fast path cannot take, go through ``tokenizers`` itself. With ``plain`` the end-of-text string in a
    text is ordinary text.
    """

    def __init__(self, folder: str = TOKENIZERS, plain: bool = False):
        import tiktoken
        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.folder, self.plain, self.slow = folder, plain, None

    def ids(self, text: str) -> list[int]:
        if END_OF_TEXT not in text or self.plain:
            try:
                return self.fast.encode_ordinary(text)
            except Exception:  # noqa: BLE001  the regular expression's stack has a limit on extreme texts
                pass
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(f"{self.folder}/byte_bpe_50k.json")
            self.slow.encode_special_tokens = self.plain
        return self.slow.encode(text, add_special_tokens=False).ids


def encoder(folder: str = TOKENIZERS, plain: bool = False) -> Encoder:
    """One encoder per Python worker."""
    key = (folder, plain)
    if key not in _made:
        _made[key] = Encoder(*key)
    return _made[key]


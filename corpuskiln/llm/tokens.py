"""Public tokenizers inside Python workers, loaded once per worker and path."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from corpuskiln.operators.tokenizers import encode_with


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The ``tokenizers`` library's tokenizer, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies, by its public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE file exactly as ``tokenizers`` gives them, but faster.

    The vocabulary of the JSON file is loaded into ``tiktoken`` as merge ranks. That is
    done only if ids are ranks in merge order and a probe text gives the same ids in both
    libraries; texts that hold a special token's string always go to ``tokenizers``. Long
    runs of white space, on which the pattern's matcher overflows, are encoded beside it.
    """

    PROBE = "It's 12 o'clock,  naïve Ünï \t\n\n x1y2 don't WE'LL  中文\U0001f600 a\r\n  b "
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        self.slow = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        symbols = _byte_symbols()
        try:
            ranks = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        except KeyError:
            return
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        if [vocab.get(m.replace(" ", "")) for m in merges] != list(range(256, 256 + len(merges))):
            return
        import tiktoken

        fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if fast.encode_ordinary(self.PROBE) == self.slow.encode(self.PROBE, add_special_tokens=False).ids:
            self.fast = fast

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return encode_with(self.fast, text)


@lru_cache(maxsize=4)
def load_byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)

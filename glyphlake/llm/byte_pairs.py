"""Byte-level merge tokenizers at full speed.

The ids are those of the `tokenizers` library with the same file.  Where the file is a plain byte-level model whose ids follow its merges, texts
are encoded by `tiktoken` with ranks made from the file, several times faster; a text that holds an added token's content goes to
`tokenizers` itself, and so does every text of a model of another kind.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: The split pattern of the byte-level pre-tokenizer (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level token stands for: printable Latin-1 is itself, the rest follow from U+0100 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = None
        letters, model, split = byte_of_letter(), spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        plain = (
            model.get("type") == "BPE" and spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and all(set(t) <= letters.keys() for t in model["vocab"])
            and all(model["vocab"].get(a + b, -1) == 256 + i for i, (a, b) in enumerate(merges)) and len(model["vocab"]) == 256 + len(merges)
        )
        if plain:
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        self.lengths = np.zeros(max([*model["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])]) + 1, np.int64)
        for token, i in model["vocab"].items():
            self.lengths[i] = len(token)
        for t in spec.get("added_tokens") or []:
            self.lengths[t["id"]] = len(t["content"].encode())

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, no special tokens added."""
        if self.fast is None or any(a in text for a in self.added):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_LOADED: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """The tokenizer in the file, loaded once in each worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]

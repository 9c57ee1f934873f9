"""Token ids of a public byte-level tokenizer file.

The file's vocabulary is handed to the faster of the two installed encoders.  A vocabulary of this
kind lists its merges in id order, so both give the same ids; the tests compare them.
"""

import json
from functools import lru_cache

import tiktoken

# Fixed values of the byte-level scheme: how it cuts a text before merging, and which bytes stand for themselves.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))


class Encoder:
    """Ids of whole texts as 4-byte little-endian integers; no special tokens are added."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        other = [b for b in range(256) if b not in PLAIN_BYTES]
        byte = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        self._encoding = tiktoken.Encoding("file", pat_str=CUT, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> "Encoder":
        """One encoder per tokenizer file and worker process."""
        return Encoder(path)

    def encode(self, text: str) -> bytes:
        return self._encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

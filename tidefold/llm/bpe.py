"""Byte-level BPE of whole texts: ids, and the bytes that each token covers.

The vocabulary is read from a ``tokenizers`` file.  Encoding runs in
``tiktoken``, which gives the same ids several times faster; a text that spells
out a special token goes to ``tokenizers`` itself, which gives it its id.
"""

from __future__ import annotations

import json

import numpy as np

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _alphabet() -> dict[str, int]:
    """The byte for each character of the vocabulary: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.path, self.reference = path, None
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        if said["model"]["type"] != "BPE" or said["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is no byte-level BPE")
        self.special = [t["content"] for t in said["added_tokens"]]
        byte = _alphabet()
        ranks = {
            bytes(byte[c] for c in token): rank
            for token, rank in said["model"]["vocab"].items()
            if token not in self.special
        }
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = 1 + max([*ranks.values(), *(t["id"] for t in said["added_tokens"])])
        self.n_bytes = np.zeros(size, np.int64)  # of each id
        for token, rank in ranks.items():
            self.n_bytes[rank] = len(token)
        for token in said["added_tokens"]:
            self.n_bytes[token["id"]] = len(token["content"].encode())

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, as little-endian unsigned numbers of 32 bits."""
        if any(s in text for s in self.special):
            if self.reference is None:
                from tokenizers import Tokenizer

                self.reference = Tokenizer.from_file(self.path)
            return np.array(self.reference.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.encoding.encode_ordinary(text), "<u4")

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last character that every token covers, wholly or in part."""
        lengths = self.n_bytes[self.ids(text)]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        encoded = np.frombuffer(text.encode(), np.uint8)
        if len(encoded) == len(text):
            return starts, ends - 1
        character = np.cumsum((encoded & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1]

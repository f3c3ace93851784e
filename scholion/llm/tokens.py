"""Token ids of a tokenizer file, by the quickest engine that gives the same ids."""

from __future__ import annotations

import functools
import json
import os

import numpy as np

#: Words or blanks longer than this go to the slower engine, whose time stays in proportion.
LONG = 1000
_PROBE = " The Ärger_ of 12345,don't  \n\n\t stop…  漢字🙂​\r\nx\x00y z <tag/> ALL'S "


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes are themselves, others follow from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            blob = f.read()
        self.exact = Tokenizer.from_str(blob.decode())
        said = json.loads(blob)
        self.special = [t["content"] for t in said.get("added_tokens", ())]
        self.quick = self._quick(said)

    def _quick(self, said: dict):
        """The same merges as ranks, if the file is a plain byte-level BPE; None otherwise."""
        if said.get("model", {}).get("type") != "BPE" or (said.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            return None
        try:
            import public_tokenizers
            import tiktoken
        except ImportError:
            return None
        byte = byte_alphabet()
        ranks = {bytes(byte[c] for c in token): rank for token, rank in said["model"]["vocab"].items() if token not in self.special}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return quick if quick.encode_ordinary(_PROBE) == self._ids(_PROBE) else None

    def _ids(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        if self.quick is None or any(s in text for s in self.special) or len(text) > LONG and (" " * LONG in text or "\n" * LONG in text or max(map(len, text.split()), default=LONG) >= LONG):
            return np.array(self._ids(text), "<u4")
        return np.array(self.quick.encode_ordinary(text), "<u4")


@functools.cache
def encoder(path: str) -> Encoder:
    """One of each file in a Python worker."""
    return Encoder(path)

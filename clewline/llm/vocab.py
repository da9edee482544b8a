"""Public tokenizer files: byte alphabet, token strings, a fast exact encoder for byte-level vocabularies."""
from __future__ import annotations

import functools
import json
import re

import numpy as np


def public_path(name: str) -> str:
    """Place of a vocabulary file; resolved on the machine that opens it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def spec(name: str) -> dict:
    with open(public_path(name), encoding="utf-8") as f:
        return json.load(f)


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else 256, 257, ... in turn."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def byte_encoder(name: str, plain: bool) -> tuple:
    """(encoder, special ids) of a byte-level vocabulary.

    The ``plain`` one splits words without look-ahead, which gives the same words where a text has no two white-space
    characters in a row and is about twice as fast; the other takes any text.
    """
    import tiktoken

    data = spec(name)
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in data["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
    pattern = words + (r"|\s+" if plain else r"|\s+(?!\S)|\s+")
    return tiktoken.Encoding(f"{name}-{plain}", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), special


WHITE_RUN = re.compile(r"\s\s")


def encode_bytes(name: str, text: str) -> np.ndarray:
    """Ids (uint32) of a text; strings of special tokens become their ids, as the tokenizers library does by default."""
    coder, special = byte_encoder(name, plain=not WHITE_RUN.search(text))
    if not any(s in text for s in special):
        return coder.encode_to_numpy(text, disallowed_special=())
    return coder.encode_to_numpy(text, allowed_special=set(special), disallowed_special=())

"""Exact BPE by backtracking over longest token matches, and table decoding, for a word-end vocabulary.

A word is looked up with an Aho-Corasick automaton: the longest token at a place is tried first and a shorter one only
where it cannot stand next to its left neighbour. Whether two tokens may stand side by side is asked of a
pair-compatibility table, filled on demand: they may unless merging would join them over the border. Each place of a
word is left for good once no token fits there, so a word takes time linear in its length.
"""
from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf

from .registry import query, table
from .vocab import byte_alphabet, spec

VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker keeps; beyond it, words are encoded again when met.
KEPT_WORDS = 150_000
KEPT_PAIRS = 200_000
#: Bytes of text, or ids, worked on at a time.
SLICE = 8 << 20
#: Unicode White_Space; Python's own notion also holds 1C-1F.
WHITE = "\t-\r \x85\xa0  -     　"
#: Word pattern of the vocabulary, over text without white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"


class PairTable(dict):
    """(left, right) -> whether both stay as they are when their strings are joined and merged anew."""

    def __init__(self, merged: dict[tuple[int, int], int], halves: list[tuple[int, int]]):
        super().__init__()
        self.merged, self.halves = merged, halves

    def __missing__(self, pair):
        if len(self) >= KEPT_PAIRS:
            self.clear()
        fits = self[pair] = self._fits(*pair)
        return fits

    def _fits(self, left: int, right: int) -> bool:
        # Undo merges from the latest to the earliest, on either side of the border; a merge over the border that comes
        # before the one just undone would have happened first.
        undone = len(self.halves)
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < undone:
                return False
            if left > right:
                undone, left, other = left, self.halves[left][1], right
                if left == undone:  # a single symbol: only the right side is left to undo
                    undone, right = other + 1, self.halves[other][0]
                    if right == other:
                        return True
            else:
                undone, right, other = right + 1, self.halves[right][0], right
                if right == other:
                    undone, left, other = left, self.halves[left][1], left
                    if left == other:
                        return True


class WordCoder:
    """Encoder of one vocabulary file whose words end in a suffix and whose text drops white space."""

    def __init__(self, name: str):
        import ahocorasick
        import regex

        data = spec(name)
        model = data["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]] if data["normalizer"] else []
        if not suffix or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{name}: needs a word-end vocabulary over lower-cased NFC text")
        # A last symbol is written as one character of its own, so a token is a plain string of symbols.
        self.alphabet = byte_alphabet()
        place = {c: i for i, c in enumerate(self.alphabet)}
        self.last = [chr(0x10000 + b) for b in range(256)]
        self.shown = dict(enumerate(self.alphabet))
        spelled = lambda t: t[: -len(suffix) - 1] + self.last[place[t[-len(suffix) - 1]]] if t.endswith(suffix) and len(t) > len(suffix) else t
        # Inner numbers follow the order of merges: single symbols first.
        singles = [c for c in self.alphabet] + self.last
        outer = {spelled(t): i for t, i in vocab.items()}
        strings = list(singles)
        number = {s: i for i, s in enumerate(strings)}
        halves = [(i, i) for i in range(len(strings))]
        merged = {}
        for pair in model["merges"]:
            a, b = (spelled(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            if a + b in number:
                raise ValueError(f"{name}: two merges make one token")
            merged[number[a], number[b]] = number[a + b] = len(strings)
            halves.append((number[a], number[b]))
            strings.append(a + b)
        self.strings, self.number = strings, number
        self.outer = [outer[s].to_bytes(4, "little") for s in strings]
        self.lengths = [len(s) for s in strings]
        self.pairs = PairTable(merged, halves)
        self.shorter: dict[int, int | None] = {}
        self.longest = ahocorasick.Automaton()
        for i, s in enumerate(strings):
            self.longest.add_word(s, i)
        self.longest.make_automaton()
        self.cut = regex.compile(WORD).findall
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words, self.chunks = Kept(self.word_ids), Kept(self.chunk_ids)

    def symbols(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word[:-1] + self.last[ord(word[-1])]
        raw = word.encode("utf-8", "replace")
        return raw[:-1].decode("latin-1").translate(self.shown) + self.last[raw[-1]]

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            s = self.strings[token]
            self.shorter[token] = next((self.number[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.number), None)
        return self.shorter[token]

    def merge_word(self, s: str) -> list[int]:
        """Inner numbers of the tokens of one word, given as symbols. A token is taken to be what merging its own symbols gives."""
        whole = self.number.get(s)
        if whole is not None:
            return [whole]
        n, lengths, pairs, longest, at = len(s), self.lengths, self.pairs, self.longest.iter_long, 0
        closed: set[int] = set()
        path: list[int] = []
        token = next(longest(s))[1]
        while True:
            end = at + lengths[token]
            if end not in closed and (not path or pairs[path[-1], token]):
                path.append(token)
                if end == n:
                    return path
                at = end
                token = next(longest(s, at))[1]
                continue
            shorter = self.next_shorter(token)
            if shorter is None:
                closed.add(at)
                token = path.pop()
                at -= lengths[token]
            else:
                token = shorter

    def word_ids(self, word: str) -> bytes:
        outer = self.outer
        return b"".join([outer[i] for i in self.merge_word(self.symbols(word))])

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a stretch without white space, as little-endian 32-bit integers."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # a capital sigma gives the same letter wherever it stands
        text = chunk.lower()
        if text.isascii() and text.isalpha():
            return self.words[text]
        return b"".join(map(self.words.__getitem__, self.cut(text)))

    def encode(self, text: str) -> bytes:
        if self.special_cut and any(s in text for s in self.special):
            parts = self.special_cut.split(text)
            return b"".join([self.special[p].to_bytes(4, "little") if p in self.special else self.encode_plain(p) for p in parts])
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        chunks = text.split() if not ODD_WHITE.search(text) else [c for c in WHITE_RUN.split(text) if c]
        return b"".join(map(self.chunks.__getitem__, chunks))


class Kept(dict):
    """Results of a function by its argument; a bounded number of short arguments is kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < KEPT_WORDS and len(key) <= 64:
            self[key] = value
        return value


ODD_WHITE = re.compile("[\x1c-\x1f]")
WHITE_RUN = re.compile(f"[{WHITE}]+")


@functools.lru_cache(maxsize=2)
def coder(name: str) -> WordCoder:
    return WordCoder(name)


@functools.lru_cache(maxsize=2)
def token_strings(name: str) -> pa.Array:
    """Offset table: every token's text, back to back, in order of its id."""
    data = spec(name)
    by_id = {i: t for t, i in data["model"]["vocab"].items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.large_string())


def encode_array(name: str, texts: pa.Array) -> pa.Array:
    own = coder(name)
    out, first = [], 0
    while first < len(texts):
        ids, size, last = [], 0, first
        while last < len(texts) and size < SLICE:
            text = texts[last].as_py() or ""
            ids.append(own.encode(text))
            size += len(text)
            last += 1
        offsets = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))))
        first = last
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


def decode_array(name: str, ids: pa.Array) -> pa.Array:
    strings = token_strings(name)
    ids = ids.fill_null([]) if ids.null_count else ids
    sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    out, first, upto = [], 0, np.cumsum(sizes)
    while first < len(ids):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + SLICE)))
        part = ids.slice(first, last - first)
        flat = part.flatten()
        if flat.null_count or len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(strings)):
            known = pc.and_kleene(pc.greater_equal(flat, 0), pc.less(flat, len(strings)))
            flat = pc.if_else(pc.fill_null(known, False), flat, pa.scalar(None, flat.type))
        texts = pc.take(strings, flat)
        offsets = np.zeros(len(part) + 1, dtype=np.int32)
        np.cumsum(sizes[first:last], out=offsets[1:])
        if texts.null_count:  # an id without a token stands for nothing
            good = pc.is_valid(texts).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(good)]).astype(np.int32)[offsets]
            texts = texts.drop_null()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts), pa.scalar(" ", pa.large_string()))
        out.append(joined.cast(pa.string()))
        first = last
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def encode(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Ids of a text column as array<int>, equal to the tokenizers library without added special tokens.

    Null and empty text and text of white space alone give an empty array. Strings of the vocabulary's special tokens
    in a text become their ids, as that library does by default.
    """
    # Marked so that it is worked out once and not copied into every expression over its result.
    return arrow_udf(lambda a: encode_array(vocabulary, a), "array<int>").asNondeterministic()(text.cast("string"))


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of an id array joined by one space, which is how a vocabulary without a decoder reads.

    A null or empty array gives an empty text; an id outside the table and a null id are left out.
    """
    return arrow_udf(lambda a: decode_array(vocabulary, a), "string")(ids)


@query("op1_bpe_backtracking")
def op1(spark, folder):
    ids = table(spark, folder, "documents").select("doc_id", encode(F.col("text")).alias("ids"))
    both = ids.select("doc_id", "ids", decode(F.col("ids")).alias("decoded"))
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

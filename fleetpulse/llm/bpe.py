"""BPE encoding and decoding by dynamic programming over prefixes.

The BPE encoding of every prefix of a word ends in one certain token.  All
vocabulary strings that end at a position come from an Aho-Corasick automaton;
the longest one that may stand beside the last token of the prefix in front of
it is that token.  Two tokens may stand side by side if no merge across the
border would have come before the merges that built, or would use up, the parts
it needs.  Back-pointers then give the ids.  The work is linear in the text,
whatever the length of a word.

Defined cases: a null text counts as empty, and an empty text has no token;
special tokens spelled out in a text are recognised, as the tokenizer file says;
repeated rows and null ids are encoded row by row.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import per_process, table, text_column

ENCODED = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries kept in the caches of a process, about 200 bytes each: parts of texts, words, pairs of tokens.
CHUNKS, WORDS, PAIRS = 200_000, 250_000, 150_000
#: Longer pieces are not cached.
CACHED_LENGTH = 64

_NEVER = float("inf")


def young_ranges() -> list[tuple[int, int]]:
    """Ranges of the code points that are assigned for the regex module and not for Python."""
    every = map(chr, (c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000))
    unknown = "".join(c for c in every if unicodedata.category(c) == "Cn")
    out: list[tuple[int, int]] = [(0x10FFFF, 0x10FFFF)]
    for c in map(ord, regex.findall(r"\P{Cn}", unknown)):
        if out[-1][1] == c - 1:
            out[-1] = out[-1][0], c
        else:
            out.append((c, c))
    return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    chars = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a byte-level word vocabulary, read from its tokenizer file.

    Inside, a word is a string of atoms: a character per byte, the last byte of
    the word moved up by 256, since it carries the end-of-word mark.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.tokens: list[bytes] = [b""] * (max(model["vocab"].values()) + 1)
        self.special: dict[str, int] = {}
        for t in spec["added_tokens"]:
            self.tokens += [b""] * (t["id"] + 1 - len(self.tokens))
            self.special[t["content"]] = t["id"]
        for text, i in {**model["vocab"], **self.special}.items():
            self.tokens[i] = text.encode()

        def atoms(text: str) -> str:
            ends = text.endswith(self.end)
            out = [byte_of[c] for c in (text[: -len(self.end)] if ends else text)]
            if ends:
                out[-1] += 256
            return "".join(map(chr, out))

        ids = {atoms(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right = atoms(a), atoms(b)
            pair = ids[left], ids[right]
            self.rank.setdefault(pair, rank)
            made.setdefault(ids[left + right], (rank, *pair))
        # Along the border of a token: its outermost pieces and the rank of the merge that uses each up.
        self.right = {i: self._border(i, made, 2) for i in ids.values()}
        self.left = {i: self._border(i, made, 1) for i in ids.values()}
        self.automaton = ahocorasick.Automaton()
        reachable: dict[int, bool] = {}
        for text, i in sorted(ids.items(), key=lambda x: (len(x[0]), x[0])):
            rank, a, b = made.get(i, (-1, i, i))
            reachable[i] = rank < 0 and len(text) == 1 or rank >= 0 and reachable[a] and reachable[b] and self._beside(a, b, rank)
            if reachable[i]:
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()

        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.split_words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+", regex.V1
        )
        # Python, the regex module and the tokenizers library know different versions of Unicode. The rare
        # parts with a character that is new to Python are normalized and split as the library does it.
        self.young = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in young_ranges()) + "]")
        self.path, self.library = path, None

    @staticmethod
    def _border(token: int, made: dict, side: int) -> list[tuple[int, float]]:
        pieces, used_up = [(token, _NEVER)], token
        while used_up in made:
            rank = made[used_up][0]
            used_up = made[used_up][side]
            pieces.append((used_up, rank))
        return pieces

    def _beside(self, a: int, b: int, before: float = _NEVER) -> bool:
        """Whether no merge of a rank under ``before`` crosses the border of ``a`` and ``b``."""
        rank = self.rank.get
        for x, x_used in self.right[a]:
            for y, y_used in self.left[b]:
                r = rank((x, y))
                # On equal ranks the left merge comes first: inside ``a`` before the border, the border before ``b``.
                if r is not None and r < before and r < x_used and r <= y_used:
                    return False
        return True

    def _compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        fits = self.pairs[a, b] = self._beside(a, b)
        return fits

    def word_ids(self, atoms: str) -> list[int]:
        """Ids of one word given as atoms."""
        last = [-1] * (len(atoms) + 1)  # by prefix length: its last token
        back = [0] * (len(atoms) + 1)  # and the length of the prefix in front of that token
        pairs = self.pairs.get
        for end, (token, length) in self.automaton.iter(atoms):  # at each end the longest comes first
            end += 1
            if last[end] < 0:
                start = end - length
                if start:
                    before = last[start]
                    fits = pairs((before, token))
                    if fits is None:
                        fits = self._compatible(before, token)
                    if not fits:
                        continue
                last[end], back[end] = token, start
        ids, at = [], len(atoms)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def _word(self, word: str) -> bytes:
        packed = self.words.get(word)
        if packed is None:
            raw = word.encode().decode("latin-1")
            packed = _packed(self.word_ids(raw[:-1] + chr(ord(raw[-1]) + 256)))
            if len(word) <= CACHED_LENGTH:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[word] = packed
        return packed

    def _chunk(self, chunk: bytes) -> bytes:
        """Packed ids of a part of a text without ASCII blanks."""
        if chunk.isalpha():  # ASCII letters only: one word
            return self._word(chunk.decode().lower())
        out = []
        for k, part in enumerate(self.split_special.split(chunk.decode())):
            if k % 2:
                out.append(_packed([self.special[part]]))
            elif part:
                if not chunk.isascii() and self.young.search(part):
                    if self.library is None:  # loaded where it is needed, for its memory
                        self.library = Tokenizer.from_file(self.path)
                    part = self.library.normalizer.normalize_str(part)
                    out += [self._word(part[a:b]) for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
                    continue
                # Case is lowered character by character, so a final sigma is no exception.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += map(self._word, self.split_words.findall(part))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers.

        No piece of a text reaches across an ASCII blank, so the parts between
        blanks are encoded on their own and the frequent ones remembered.
        """
        known, out = self.chunks, []
        for chunk in text.encode().split():
            packed = known.get(chunk)
            if packed is None:
                packed = self._chunk(chunk)
                if len(chunk) <= CACHED_LENGTH:
                    if len(known) >= CHUNKS:
                        known.clear()
                    known[chunk] = packed
            out.append(packed)
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        """The tokens of packed ids in UTF-8, set apart by one blank: the file names no decoder."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


def encoder(path: str) -> WordBpe:
    return per_process(("bpe", path), lambda: WordBpe(path))


def encoded(text: Column, path: str) -> Column:
    """Struct ``ENCODED`` and ``ids``, the array of token ids, of each text."""

    def row(x: str) -> tuple:
        bpe = encoder(path)
        packed = bpe.encode(x)
        return *_digests(bpe, packed), np.frombuffer(packed, "<i4")

    return text_column(f"{ENCODED}, ids array<int>", row, text)


def digests(text: Column, path: str) -> Column:
    """Struct ``ENCODED``: token count, hash of the ids, hash of the text decoded from them."""

    def row(x: str) -> tuple:
        bpe = encoder(path)
        return _digests(bpe, bpe.encode(x))

    return text_column(ENCODED, row, text)


def _digests(bpe: WordBpe, packed: bytes) -> tuple:
    sha = hashlib.sha256
    return len(packed) // 4, sha(packed).hexdigest(), sha(bpe.decode(packed)).hexdigest()


def bpe_encoding(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``ENCODED`` for every row of ``docs``; ``path`` names the tokenizer file on every executor."""
    return docs.select("doc_id", digests(F.col("text"), path or vocabulary_path()).alias("e")).select("doc_id", "e.*")


def op1_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encoding(table(spark, sf_dir, "documents"))

"""Byte-pair encoding and decoding, with tree concatenation for long text.

Text longer than ``leaf`` is halved until the parts are short enough. Leaves are encoded in parallel, and encoded halves are
joined pairwise up the tree: a window of units on both sides of the join is encoded anew and grows until its first unit is the
left side's and its last unit is the right side's. This is done at two levels.

* Units are the pieces that the splitting pattern makes. A piece depends on the text from its start to one character past its
  end only, so a start that window and right side share holds in the whole text, and the left side's starts always do.
* Within one long piece (unsplit text) units are tokens. A sequence of tokens is the encoding of its text if each two
  neighbours are; at an agreed token the neighbours come from an encoding on either side.

Null and empty texts have no token. The tokenizer file is a parameter, and its special tokens are found in text as the library
finds them. Rows are encoded independently, repeated ones alike; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

#: How byte-level tokenizers split text (fixed value): 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
#: Here letters and digits are spelled out for Latin text; text with other characters is split by the library itself.
LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+")
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u20ac]*")
CACHE = 300_000


class _Known(dict):
    """Ids of the pieces met so far, made on first use; starts anew when full and keeps no long piece."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.make(piece)
        if len(self) >= CACHE:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def concatenate(left: list, right: list, encode: Callable[[list], list], k: int = 4) -> list:
    """The encoding of both sides' text. encode: units of a text part to the units of that part's own encoding."""
    while True:
        a, b = left[-k:], right[:k]
        window = encode(a + b)
        if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
            return left[: max(0, len(left) - k)] + window + right[k:]
        k *= 2


def tree(parts: list[list], encode: Callable[[list], list]) -> list:
    """Joins neighbouring parts pairwise until one is left."""
    while len(parts) > 1:
        joined = [concatenate(a, b, encode) for a, b in zip(parts[::2], parts[1::2])]
        parts = joined + parts[len(parts) - len(parts) % 2 :]
    return parts[0] if parts else []


def halves(text, leaf: int) -> list:
    """A power of two of parts, none longer than leaf."""
    parts = [text]
    while max(map(len, parts)) > leaf:
        parts = [p for t in parts for p in (t[: (len(t) + 1) // 2], t[(len(t) + 1) // 2 :])]
    return [p for p in parts if p]


class Codec:
    def __init__(self, path: str, leaf: int = 4096):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.leaf = leaf
        tokenizer = Tokenizer.from_file(path)
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        spelled = lambda token: bytes(back[c] for c in token)
        vocab = tokenizer.get_vocab()
        self.bytes_of = [b""] * tokenizer.get_vocab_size()
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.special else spelled(token)
        # A token's rank is the order of the merge that makes it; single bytes come first.
        merges = json.loads(tokenizer.model.__getstate__())["merges"]
        made = [spelled("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
        if len(set(made)) < len(made):
            raise ValueError(f"{path}: two merges make one token")
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(made)}
        self.id_of = [vocab[letters[b]] for b in range(256)] + [vocab["".join(letters[b] for b in t)] for t in made]
        self.core = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self.encode_piece)

    def split(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PATTERN.findall(text)
        return [text[s:e] for _, (s, e) in self.splitter.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """The pattern's pieces of a text, by tree concatenation where it is long."""
        if len(text) <= self.leaf:
            return self.split(text)
        parts = halves(text, self.leaf)
        if len(parts) >= 64:
            with ThreadPoolExecutor(2) as pool:
                encoded = list(pool.map(self.split, parts))
        else:
            encoded = [self.split(p) for p in parts]
        return tree(encoded, lambda units: self.split("".join(units)))

    def _merge(self, piece: bytes) -> list[int]:
        """Token ids of one unsplit piece."""
        return list(map(self.id_of.__getitem__, self.core._encode_single_piece(piece)))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        if len(raw) <= self.leaf:
            return tuple(self._merge(raw))
        with ThreadPoolExecutor(2) as pool:
            parts = list(pool.map(self._merge, halves(raw, self.leaf)))
        return tuple(tree(parts, lambda ids: self._merge(b"".join(map(self.bytes_of.__getitem__, ids)))))

    def encode(self, text: str) -> list[int]:
        ids = self.known.__getitem__
        if self.cut is None or not self.cut.search(text):
            return list(chain.from_iterable(map(ids, self.pieces(text))))
        out: list[int] = []
        at = 0
        for m in self.cut.finditer(text):
            out += chain.from_iterable(map(ids, self.pieces(text[at : m.start()])))
            out.append(self.special[m[0]])
            at = m.end()
        return out + list(chain.from_iterable(map(ids, self.pieces(text[at:]))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(path: str, leaf: int) -> Codec:
    """One codec per worker process and file."""
    if (path, leaf) not in _CODECS:
        _CODECS[path, leaf] = Codec(path, leaf)
    return _CODECS[path, leaf]


def encode_decode(docs: DataFrame, path: str, leaf: int = 4096, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array<int>) and decoded (the text of these ids), one row per document."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids = [c.encode(t) for t in texts(part)]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(map(c.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")

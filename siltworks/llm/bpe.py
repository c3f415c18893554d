"""Byte-level BPE by contiguous rank arrays.

A word is held as one array with an entry for every boundary at which a part begins, the part's id, and beside it an array of the
ranks of every two neighbours' merges. The lowest rank is looked for from the left, the boundary between its parts is
deleted, and only the two ranks next to it are looked up again, until no neighbours merge. That's quick as long as a word is short; in words over LONG bytes, where looking
for the minimum again and again would take squared time, the same merges are taken off a heap in the same order.

Texts are split into words by the vocabulary's pattern. Every distinct word is encoded once a task, in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .huffman import BYTE_CHARS

#: Entries of a task's table of words, which is emptied when full; words over LONG bytes aren't kept.
TABLE, LONG = 500_000, 128
SHIFT, NONE = 20, 1 << 60
MASK = (1 << SHIFT) - 1


def _unassigned(text: str) -> bool:
    """Whether the text holds a character that this Python's Unicode tables don't know. Newer tables may tell letters among them, so the splitting of such texts is the library's."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


class Encoder:
    """Encodes and decodes as the library does with the byte-level BPE vocabulary at ``path``; raises ValueError for vocabularies of other kinds."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        if model.get("type", "BPE") != "BPE" or odd or spec["normalizer"] or not plain or (spec["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE vocabulary without normalizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        self.path = path
        raw = {chr(b): b for b in range(256)} | {chr(c): b for b, c in BYTE_CHARS.items()}
        as_bytes = lambda token: bytes(raw[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        if any(bytes([b]) not in self.ids for b in range(256)) or max(self.ids.values()) > MASK:
            raise ValueError("the vocabulary lacks a byte, or has more ids than a pair's key has room for")
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        #: For the ids of two parts the rank of their merge, and below it the id that it makes.
        self.rank: dict[int, int] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = map(as_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            self.rank[self.ids[a] << SHIFT | self.ids[b]] = k << SHIFT | self.ids[a + b]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        text_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.texts = [text_of.get(i, b"") for i in range(1 + max(text_of))]
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.splitter = None
        self.table: dict[str, bytes] = {}

    def cut(self, word: bytes) -> list[int]:
        """The ids of a word."""
        if len(word) > LONG:
            return self._cut_long(word)
        get = self.rank.get
        parts = [self.byte_ids[b] for b in word]  # the id of the part that begins at each boundary; the parts' lengths are their tokens'
        ranks = [get(a << SHIFT | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]  # of the parts before and after the next boundary
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = made = least & MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << SHIFT | made, NONE)
            if i < len(ranks):
                ranks[i] = get(made << SHIFT | parts[i + 1], NONE)
        return parts

    def _cut_long(self, word: bytes) -> list[int]:
        """The same merges in the same order: entries of a heap are a rank and the place of the left part's begin."""
        n, get = len(word), self.rank.get
        part = array("q", [self.byte_ids[b] for b in word])  # at the begin of each part its id, else -1
        after, before = array("q", range(1, n + 2)), array("q", range(-1, n))  # the begins of the parts next to it
        heap = [r << 40 | i for i in range(n - 1) if (r := get(part[i] << SHIFT | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, a = top >> 40, top & ((1 << 40) - 1)
            if part[a] < 0 or (b := after[a]) >= n or get(part[a] << SHIFT | part[b]) != r:
                continue  # its parts have changed since
            end = after[b]
            part[a], part[b], after[a], before[end] = r & MASK, -1, end, a
            if end < n and (r := get(part[a] << SHIFT | part[end])) is not None:
                heapq.heappush(heap, r << 40 | a)
            if a and (r := get(part[before[a]] << SHIFT | part[a])) is not None:
                heapq.heappush(heap, r << 40 | before[a])
        return [i for i in part if i >= 0]

    def _split(self, text: str) -> list[str]:
        if not _unassigned(text):
            return self.words.findall(text)
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _ordinary(self, text: str) -> bytes:
        words = self._split(text)
        out = list(map(self.table.get, words))
        if None in out:
            for i, (got, word) in enumerate(zip(out, words, strict=True)):
                if got is None:
                    got = self.table.get(word)
                    if got is None:
                        raw = word.encode("utf-8", "replace")
                        got = np.array(self.cut(raw), dtype="<u4").tobytes()
                        if len(raw) <= LONG:
                            if len(self.table) >= TABLE:
                                self.table.clear()
                            self.table[word] = got
                    out[i] = got
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers. An added token in the text is its id, and no word reaches over it."""
        if self.special is None or self.special.search(text) is None:
            return self._ordinary(text)
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [self._ordinary(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*parts, self._ordinary(text[at:])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of any ids, in UTF-8; bytes that aren't UTF-8 become replacement characters. An id beyond the vocabulary has no text."""
        texts = self.texts
        known = ids.tolist()
        if len(ids) and int(ids.max()) >= len(texts):
            known = [i for i in known if i < len(texts)]
        return b"".join(map(texts.__getitem__, known)).decode("utf-8", "replace").encode()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of a vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _kernel(path: str, keep: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, ids_sha, text_sha, ids, texts = [], [], [], [], []
                for text in part.column(1):
                    raw = enc.encode(text.as_py() or "")
                    back = enc.decode(np.frombuffer(raw, dtype="<u4"))
                    counts.append(len(raw) // 4)
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(back).hexdigest())
                    if keep:
                        ids.append(raw)
                        texts.append(back.decode())
                more = [pa.array(ids, pa.binary()), pa.array(texts, pa.string())] if keep else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: len(more)]])

    return kernel


def encode_decode(docs: DataFrame, tokenizer: str, keep: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep`` the ids (binary, little-endian 32-bit) and decoded texts.

    One row per input row, whatever its doc_id, in one narrow pass without a shuffle; null is the empty text, which has no ids.
    Other columns are left out. ``tokenizer``: path of the vocabulary file, the same on every machine.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_kernel(tokenizer, keep), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep)

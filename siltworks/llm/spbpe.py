"""Exact byte-fallback BPE of SentencePiece models by a table over prefixes.

A merge-type encoding of a text is the one sequence of tokens in which every two neighbours are
compatible: their joined text is encoded as just these two. So each prefix has one last token, found in
one pass: an automaton names the tokens that end at a place, and the one that's compatible with the last
token of the prefix before it is stored. The ids are then read backwards from the end.

The table's cost is linear in the text. A text is cut first where no piece spans a place (before a space
mark that follows another character, as no piece of such models holds one inside); equal cuts are
encoded once a task, in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held

MARK = "▁"
#: Entries of a task's table of cuts; it's emptied when full. Longer cuts aren't kept.
TABLE, LONG = 500_000, 64


class Encoder:
    """Encodes and decodes as the library does with the model at ``path``; raises ValueError for models of other kinds."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        kinds = [(sp.is_control(i) or sp.is_unknown(i), sp.is_byte(i), sp.is_unused(i)) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i][1]}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not any(kinds[i])}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        if len(self.byte_ids) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids) or sp.encode("  x") == sp.encode("x"):
            raise ValueError("not a byte-fallback BPE model that keeps spaces")
        # when merges make a token, and of what; a single character is there from the start
        rank = {score: 1 + k for k, score in enumerate(sorted({-self.score[p] for p in self.ids if len(p) > 1}))}
        self.made = {i: rank[-self.score[p]] if len(p) > 1 else 0 for p, i in self.ids.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        # tokens that merges can't form never occur in an encoding
        for p, i in self.ids.items():
            if len(p) > 1 and self._merged(p) == [p]:
                self.halves[i] = self._last_merge(p)
        self.auto = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or i in self.halves:
                self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        self.fits: dict[int, bool] = {}
        text_of = [b"" if kinds[i][0] else bytes([int(p[3:5], 16)]) if kinds[i][1] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.size_of = np.array([len(t) for t in text_of])
        self.at_of = np.cumsum(self.size_of) - self.size_of
        self.bytes_of = np.frombuffer(b"".join(text_of), dtype=np.uint8)
        self.newline = self.byte_ids[10].to_bytes(4, "little")
        #: ids of cuts after a space mark, and of cuts without one
        self.marked: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _merged(self, text: str, history: list | None = None) -> list[str]:
        """The definition: join the neighbours whose joined piece scores highest, leftmost first."""
        parts = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, b, parts[a] + parts[b]))

        for i in range(len(parts) - 1):
            push(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not parts[a] or not parts[b] or parts[a] + parts[b] != joined or right[a] != b:
                continue
            if history is not None:
                history.append((parts[a], parts[b]))
            parts[a], parts[b] = joined, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            push(left[a], a)
            push(a, right[a])
        return [p for p in parts if p]

    def _last_merge(self, piece: str) -> tuple[int, int]:
        history: list = []
        self._merged(piece, history)
        return self.ids[history[-1][0]], self.ids[history[-1][1]]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of both texts together is a, b: undoing the later merge first, no merge across the border came before one within."""
        key = a * 1_000_003 + b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            ids, pieces, made, until, x, y = self.ids, self.pieces, self.made, 1 << 40, a, b
            while True:
                across = ids.get(pieces[x] + pieces[y])
                if across is not None and made[across] < until:
                    ok = False
                    break
                if made[x] > made[y]:
                    until, x = made[x], self.halves[x][1]
                elif made[y]:
                    until, y = made[y] + 1, self.halves[y][0]
                else:
                    ok = True
                    break
            self.fits[key] = ok
        return ok

    def cut_ids(self, cut: str) -> list[int]:
        """Ids of a text, space marks included, by the prefix table. A character without a piece stands alone as its bytes."""
        n = len(cut)
        last, back, fits = [-1] * (n + 1), [0] * (n + 1), self._compatible  # the prefix's last token, and where that begins
        for at, (token, size) in self.auto.iter(cut):
            if last[at + 1] < 0:
                i = at + 1 - size
                if i == 0 or last[i] < 0 or fits(last[i], token):
                    last[at + 1], back[at + 1] = token, i
        out: list[int] = []
        j = n
        while j > 0:
            if last[j] < 0:
                out.extend(self.byte_ids[b] for b in reversed(cut[j - 1].encode("utf-8", "replace")))
                j -= 1
            else:
                out.append(last[j])
                j = back[j]
        return out[::-1]

    def _fill(self, table: dict[str, bytes], mark: str, word: str) -> bytes:
        got = np.array(self.cut_ids(mark + word), dtype="<u4").tobytes()
        if len(word) <= LONG:
            if len(table) >= TABLE:
                table.clear()
            table[word] = got
        return got

    def _words(self, words: list[str], marked: bool = True) -> list[bytes]:
        """Ids of words that a single space precedes; the first one has none unless ``marked``."""
        out = list(map(self.marked.get, words))
        if not marked:
            out[0] = self.bare.get(words[0])
        if None in out:
            for i, (got, word) in enumerate(zip(out, words, strict=True)):
                if got is None:
                    out[i] = self._fill(self.marked, MARK, word) if i or marked else self._fill(self.bare, "", word)
        return out

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian 32-bit integers."""
        parts = [self.bos.to_bytes(4, "little")]
        if text:
            if MARK in text:
                text = text.replace(MARK, " ")
            for k, line in enumerate(text.split("\n")):  # a line end has no piece, so nothing spans it
                if k:
                    parts.append(self.newline)
                words = line.split(" ")
                if "" not in words:
                    parts += self._words(words, not k)
                elif line or not k:  # runs of spaces belong to the word after them
                    marks = "" if k else MARK
                    for i, word in enumerate(words):
                        if i:
                            marks += MARK
                        if word:
                            parts += self._words([word]) if marks == MARK else [self._fill({}, marks, word)]
                            marks = ""
                    if marks:
                        parts.append(self._fill({}, marks, ""))
        parts.append(self.eos.to_bytes(4, "little"))
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids that encode() gave, in UTF-8."""
        ids = ids[(ids != self.bos) & (ids != self.eos)]
        if not len(ids):
            return b""
        size = self.size_of[ids]
        ends = np.cumsum(size)
        out = self.bytes_of[np.repeat(self.at_of[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()
        return out[1:] if self.pieces[ids[0]].startswith(MARK) else out


def encoder(path: str) -> Encoder:
    """The process's encoder of a model."""
    return held(("pieces", path), lambda: Encoder(path))


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


def encode_decode(docs: DataFrame, model: str, keep: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep`` the ids (binary, little-endian 32-bit) and decoded texts.

    One row per input row, in one narrow pass without a shuffle; null is the empty text, whose ids are begin and end.
    ``model``: path of the model file, the same on every machine.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_kernel(model, keep), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep)

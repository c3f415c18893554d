"""Language identification by cross-parsing.

A suffix automaton over labelled text of each language reads a text greedily: a phrase grows while it is
still a substring of the language's text, and the next one starts where it fails. The language that needs
the fewest phrases, each weighed by the bits that point into its labelled text, wins.

Fitting takes a bounded sample: ``sample_docs`` labelled rows a language at most, each as a passage of at most
``sample_chars`` characters from a place that its id draws (a shorter row is one whole). Predicting parses whole texts:
segments of SEGMENT bytes all step through a table of the automaton together, each at first as if a phrase began with it;
then each is stepped again from the state in which its predecessor ends, until both ways agree, and counts are put right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_table, held, slices

SAMPLE_DOCS, SAMPLE_CHARS, SEGMENT = 48, 800, 512
_LETTER = byte_table((0x61, 0x7A), (0x80, 0xFF))


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with every run of other characters as one space; offsets of the rows in them."""
    letter = _LETTER[data]
    keep = letter.copy()
    if len(data):
        keep[1:] |= letter[:-1]
        keep[offs[1:-1][offs[1:-1] < len(data)]] = True
    out = np.where(letter, data, 0x20)[keep]
    return out, np.concatenate(([0], np.cumsum(keep)))[offs]


def automaton(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, table): table[state * classes + class] is the next state times classes times 2, plus 1 if a phrase begins."""
    used = sorted(set(text))
    k = len(used) + 1
    cls = np.full(256, k - 1, dtype=np.int32)
    cls[used] = np.arange(len(used))
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in cls[np.frombuffer(text, dtype=np.uint8)].tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    root = np.ones(k, dtype=np.int32)  # a byte that the language's text lacks is a phrase by itself
    for c, s in nxt[0].items():
        root[c] = s * k * 2 + 1
    out = np.tile(root, (len(nxt), 1))
    for s, to in enumerate(nxt[1:], 1):
        for c, t in to.items():
            out[s, c] = t * k * 2
    return cls, out.ravel()


def _stepped(cls: np.ndarray, steps: np.ndarray, data: np.ndarray, lanes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin in each lane (data[lane : lane + size]) if one begins with it, and the state it ends in; lanes are sorted by falling size."""
    count = np.zeros(len(lanes), dtype=np.int32)
    state = np.zeros(len(lanes), dtype=np.int32)
    codes = cls[data]
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right") if len(size) else []
    for k, n in enumerate(active):
        got = steps[state[:n] + codes[lanes[:n] + k]]
        count[:n] += got & 1
        state[:n] = got >> 1
    return count, state


def phrases(cls: np.ndarray, steps: np.ndarray, data: np.ndarray, lanes: np.ndarray, size: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Phrases that begin in each lane (data[lane : lane + size]); ``follows``: whether it goes on where the lane before it ends."""
    order = np.argsort(-size, kind="stable")
    count, end = np.empty(len(lanes), dtype=np.int32), np.empty(len(lanes), dtype=np.int32)
    count[order], end[order] = _stepped(cls, steps, data, lanes[order], size[order])
    alone, end_alone = count.copy(), end.copy()
    begin = np.zeros(len(lanes), dtype=np.int32)  # the states from which lanes were stepped last
    while True:
        carried = np.where(follows, np.concatenate((np.zeros(1, np.int32), end[:-1])), 0).astype(np.int32)
        open_ = np.flatnonzero(carried != begin)
        if not len(open_):
            return count
        begin[open_] = carried[open_]
        ours, theirs, more = carried[open_].copy(), np.zeros(len(open_), dtype=np.int32), np.zeros(len(open_), dtype=np.int32)
        k = 0
        while len(open_):
            code = cls[data[lanes[open_] + k]]
            a, b = steps[ours + code], steps[theirs + code]
            more += (a & 1) - (b & 1)
            ours, theirs = a >> 1, b >> 1
            k += 1
            met, over = ours == theirs, size[open_] == k
            count[open_] = alone[open_] + more
            end[open_[over]] = ours[over]
            end[open_[met]] = end_alone[open_[met]]
            go = ~met & ~over
            open_, ours, theirs, more = open_[go], ours[go], theirs[go], more[go]


def _built(texts: dict[str, bytes]) -> list:
    return [(lang, np.log2(len(text) + 1), *automaton(text)) for lang, text in sorted(texts.items())]


def _judged(texts: dict[str, bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[float], np.ndarray, np.ndarray]]:
    """Slices of the batches, and for each row the language, score and bits of its column ``text``, and whether that has a letter."""
    langs = held(("languages", *sorted(texts.items())), lambda: _built(texts))
    for whole in batches:
        lowered = pa.RecordBatch.from_arrays([pc.utf8_lower(whole.column(whole.schema.get_field_index("text")))], names=["text"])
        done = 0
        for batch, data, offs in slices(iter([lowered])):
            norm, at = normalised(data, offs)
            size = np.diff(at)
            count = -(-size // SEGMENT)
            row = np.repeat(np.arange(batch.num_rows), count)
            part = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            lanes = at[row] + part * SEGMENT
            length = np.minimum(SEGMENT, at[row + 1] - lanes)
            cost = np.full((len(langs), batch.num_rows), np.inf)
            for i, (_, bits, cls, steps) in enumerate(langs):
                cost[i] = np.bincount(row, weights=phrases(cls, steps, norm, lanes, length, part > 0), minlength=batch.num_rows) * bits
            letters = np.add.reduceat(np.append(_LETTER[norm] & (norm < 0x80), False), np.minimum(at[:-1], len(norm))) > 0 if batch.num_rows else np.zeros(0, bool)
            letters &= size > 0
            for i in np.flatnonzero(~letters & (size > 0)):
                letters[i] = any(ch.isalpha() for ch in norm[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
            later = np.array([c - bits for c, (_, bits, _, _) in zip(cost, langs, strict=True)]).reshape(cost.shape)
            per_byte = np.where(size > 0, later.min(axis=0, initial=np.inf) / np.maximum(size, 1), 0.0)
            names, scores = [], []
            best = np.argmin(cost, axis=0) if langs else np.zeros(batch.num_rows, int)
            ranked = np.sort(cost, axis=0)
            for i in range(batch.num_rows):
                if not langs or not letters[i]:
                    names.append("und")
                    scores.append(0.0)
                else:
                    names.append(langs[best[i]][0])
                    scores.append(float(1 - ranked[0, i] / ranked[1, i]) if len(langs) > 1 else 1.0)
            yield whole.slice(done, batch.num_rows), names, scores, per_byte, letters
            done += batch.num_rows


def _labels(model):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores, bits, _ in _judged(model.value, batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits)], names=["doc_id", "lang_pred", "score", "bits"])

    return kernel


def _known(model, most: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, bits, letters in _judged(model.value, batches):
            yield batch.filter(pa.array(letters & (bits <= most) if model.value else letters))

    return kernel


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """labelled (doc_id, text, lang) -> each language's normalised passages, from a sample that depends on ids only. Rows with a null are left out."""
    rows = labelled.where("doc_id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, 4 * sample_docs / n) * (1 << 30)))])
    begin = F.pmod(F.xxhash64(F.lit("passage"), "doc_id"), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1) + 1
    picked = rows.where(place < F.element_at(share, F.col("lang"))).select("lang", place.alias("place"), "doc_id", F.substring("text", begin.cast("int"), F.lit(sample_chars)).alias("text"))
    ranked = picked.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text"))).where(F.col("n") <= sample_docs)
    out: dict[str, bytes] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["n"])):
        data = np.frombuffer(r["text"].lower().encode("utf-8", "replace"), dtype=np.uint8)
        out[r["lang"]] = out.get(r["lang"], b"") + normalised(data, np.array([0, len(data)]))[0].tobytes() + b" "
    return {lang: text for lang, text in out.items() if text.strip()}


def identify(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, lang_pred, score, bits; one row per input row, in one narrow pass.

    lang_pred is ``und`` with score 0 for a null text, one without a letter, or an empty model. Otherwise score is 1 less the
    winner's cost over the runner-up's; equal costs go to the name that sorts first. ``bits``: the least
    cost, less that of one phrase, for each byte of the normalised text, 0 without any; a text of more than 8 is told better
    by its bytes than by any language. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_labels(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, lang_pred string, score double, bits double")


def known(docs: DataFrame, model: dict[str, bytes], most: float = 8.0) -> DataFrame:
    """The rows of docs (text, ...), with all their columns, in which a language is found: with a letter, and told in at most ``most`` bits a byte (if the model has a language). One narrow pass."""
    return docs.mapInArrow(_known(docs.sparkSession.sparkContext.broadcast(model), most), docs.schema)

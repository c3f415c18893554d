"""Similarity of short names on a scale of 100, for many pairs at once: ratio of the longest common subsequence, on words as sets, and on the best window.

The weighted score follows the public definition of such scorers: the plain ratio; where lengths differ by half or
more, window scores at 0.9 (0.6 beyond a factor of 8); word scores at 0.95.

The longest common subsequence is bit-parallel: a pattern of up to 64 characters is one machine word for each character
that occurs, and all pairs of a batch take a character of their other text in the same few array operations. Longer patterns take
the same steps on one big integer.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

WORD = 64
#: Windows that are compared at once.
AT_ONCE = 1 << 18


def _one(a: str, b: str) -> int:
    """The same recurrence on an integer of any size."""
    full, masks = (1 << len(a)) - 1, {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _points(texts: Sequence[str], width: int) -> np.ndarray:
    """The characters' numbers, a row a text, with 0 after the end."""
    raw = np.array(texts, dtype=f"<U{max(1, width)}")
    return raw.view("<u4").reshape(len(texts), -1)


def lcs(patterns: Sequence[str], p: np.ndarray, texts: Sequence[str], t: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
    """The length of the longest common subsequence of patterns[p] and texts[t][begin:end], for every pair of places p and t.

    A zero character in a text counts as any other.
    """
    out = np.zeros(len(p), dtype=np.int64)
    sizes, lengths = np.array([len(x) for x in patterns], dtype=np.int64), np.array([len(x) for x in texts], dtype=np.int64)
    begin = np.zeros(len(p), dtype=np.int64) if begin is None else begin
    end = lengths[t] if end is None else end
    fits = sizes[p] <= WORD
    for i in np.flatnonzero(~fits).tolist():
        out[i] = _one(patterns[p[i]], texts[t[i]][begin[i] : end[i]])
    pairs = np.flatnonzero(fits & (end > begin) & (sizes[p] > 0))
    if not len(pairs):
        return out
    use, row = np.unique(p[pairs], return_inverse=True)
    at, text = np.unique(t[pairs], return_inverse=True)
    left, right = _points([patterns[i] for i in use.tolist()], int(sizes[use].max())), _points([texts[i] for i in at.tolist()], int(lengths[at].max()))
    letters, code = np.unique(left, return_inverse=True)
    code = code.reshape(left.shape)
    # the bits of each pattern at which a letter stands; the last column is of letters that no pattern has
    masks = np.zeros((len(use), len(letters) + 1), dtype=np.uint64)
    rows = np.arange(len(use))
    for i in range(left.shape[1]):
        held = sizes[use] > i
        masks[rows[held], code[held, i]] |= np.uint64(1) << np.uint64(i)
    place = np.minimum(np.searchsorted(letters, right), len(letters) - 1)
    place = np.where(letters[place] == right, place, len(letters))
    v = np.full(len(pairs), ~np.uint64(0))
    b, e = begin[pairs], end[pairs]
    order = np.argsort(b - e, kind="stable")  # the longest first, so that those that still go on are a prefix
    row, text, b, left_over = row[order], text[order], b[order], (e - b)[order]
    n = len(order)
    for step in range(int(left_over[0])):
        n = int(np.searchsorted(-left_over[:n], -step, side="left"))
        m = masks[row[:n], place[text[:n], b[:n] + step]]
        u = v[:n] & m
        v[:n] = (v[:n] + u) | (v[:n] - u)
    size = sizes[use][row].astype(np.uint64)
    inside = np.where(size == WORD, ~np.uint64(0), (np.uint64(1) << np.minimum(size, np.uint64(WORD - 1))) - np.uint64(1))
    out[pairs[order]] = np.bitwise_count(~v & inside)
    return out


class Names:
    """Distinct texts of one side of a batch's pairs, and their words."""

    def __init__(self, texts: Iterable[str]):
        self.plain = list(texts)
        words = [x.split() for x in self.plain]
        self.words = [frozenset(w) for w in words]
        self.sorted = [" ".join(sorted(w)) for w in words]
        self.set = [" ".join(sorted(w)) for w in self.words]


def ratios(a: Sequence[str], i: np.ndarray, b: Sequence[str], j: np.ndarray) -> np.ndarray:
    """200 times the longest common subsequence over both lengths; 100 for two empty texts."""
    m, n = (np.array([len(x) for x in s], dtype=np.int64)[k] for s, k in ((a, i), (b, j)))
    return np.where(m + n > 0, 200.0 * lcs(a, i, b, j) / np.maximum(m + n, 1), 100.0)


def partial_ratios(a: Sequence[str], i: np.ndarray, b: Sequence[str], j: np.ndarray) -> np.ndarray:
    """The best ratio of the shorter text with a window of the longer one, windows at the ends cut short."""
    m, n = (np.array([len(x) for x in s], dtype=np.int64)[k] for s, k in ((a, i), (b, j)))
    out = np.where(np.maximum(m, n) == 0, 100.0, 0.0)
    for short, x, long, y, size, length, mine in ((a, i, b, j, m, n, m <= n), (b, j, a, i, n, m, m > n)):
        mine = np.flatnonzero(mine & (size > 0))
        count = (size + length - 1)[mine]  # of windows
        cuts = np.flatnonzero(np.diff(np.append(-1, np.cumsum(count) // AT_ONCE)))
        for part, many in zip(np.split(mine, cuts), np.split(count, cuts), strict=True):
            if not len(part):
                continue
            pair = np.repeat(np.arange(len(part)), many)
            start = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + 1 - size[part][pair]
            begin, end = np.maximum(start, 0), np.minimum(start + size[part][pair], length[part][pair])
            common = lcs(short, x[part][pair], long, y[part][pair], begin, end)
            np.maximum.at(out, part[pair], 200.0 * common / (size[part][pair] + end - begin))
    return out


def _token_sets(a: Names, i: np.ndarray, b: Names, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(100 where one's words are all the other's; else the best ratio of the shared words with and without the others; which pairs share a word)."""
    shares = np.array([not a.words[x].isdisjoint(b.words[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)
    empty = np.array([not w for w in a.words], dtype=bool)[i] | np.array([not w for w in b.words], dtype=bool)[j]
    out = np.where(empty | shares, 0.0, ratios(a.set, i, b.set, j))
    left, right, of = [], [], []
    for k in np.flatnonzero(shares).tolist():
        x, y = a.words[i[k]], b.words[j[k]]
        both, only_a, only_b = x & y, x - y, y - x
        if not only_a or not only_b:
            out[k] = 100.0
            continue
        same = " ".join(sorted(both))
        one, two = f"{same} {' '.join(sorted(only_a))}", f"{same} {' '.join(sorted(only_b))}"
        left += [one, same, same]
        right += [two, one, two]
        of += [k] * 3
    every = np.arange(len(of))
    np.maximum.at(out, np.array(of, dtype=np.int64), ratios(left, every, right, every))
    return out, shares


def weighted_ratios(a: Names, i: np.ndarray, b: Names, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted scores, word-set scores); 0 where a text is empty."""
    m, n = np.array([len(x) for x in a.plain], dtype=np.int64)[i], np.array([len(x) for x in b.plain], dtype=np.int64)[j]
    plain = ratios(a.plain, i, b.plain, j)
    sets, shares = _token_sets(a, i, b, j)
    longer = np.maximum(m, n) / np.maximum(np.minimum(m, n), 1)
    out = np.maximum(plain, np.where(longer < 1.5, 0.95 * np.maximum(ratios(a.sorted, i, b.sorted, j), sets), 0.0))
    far = np.flatnonzero((longer >= 1.5) & (m > 0) & (n > 0))
    x, y = i[far], j[far]
    scale = np.where(longer[far] < 8, 0.9, 0.6)
    wordless = np.array([not w for w in a.words], dtype=bool)[x] | np.array([not w for w in b.words], dtype=bool)[y]
    sets_apart = np.where(shares[far], 100.0, 0.0)
    apart = np.flatnonzero(~shares[far] & ~wordless)
    sets_apart[apart] = partial_ratios(a.set, x[apart], b.set, y[apart])
    windows = np.maximum(partial_ratios(a.sorted, x, b.sorted, y), sets_apart)
    out[far] = np.maximum(plain[far], np.maximum(scale * partial_ratios(a.plain, x, b.plain, y), 0.95 * scale * windows))
    return np.where((m > 0) & (n > 0), out, 0.0), sets


def scores(a: pd.Series, b: pd.Series, sets: bool = False) -> pd.Series:
    """The weighted score of each pair, or the better one of it and the word-set score; 0 where a text is null or empty."""
    (i, left), (j, right) = (pd.factorize(s.fillna("")) for s in (a, b))
    weighted, by_set = weighted_ratios(Names(left), i, Names(right), j)
    filled = (a.fillna("") != "") & (b.fillna("") != "")
    return pd.Series(np.where(filled, np.maximum(weighted, by_set) if sets else weighted, 0.0), dtype="float64")


@F.pandas_udf(DoubleType())
def weighted_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return scores(a, b)


@F.pandas_udf(DoubleType())
def best_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return scores(a, b, sets=True)


# ---- candidates by an index of grams


def _grams(form: Column) -> Column:
    """Every two neighbouring characters with the number of their occurrence so far, whole words, and of three characters the outer two."""
    at = F.sequence(F.lit(1), F.greatest(F.length(form) - 1, F.lit(1)))
    two = F.filter(F.transform(at, lambda k: F.substring(form, k, 2)), lambda g: F.length(g) == 2)
    told = F.transform(two, lambda g, k: F.concat(g, F.lit("\x01"), F.size(F.filter(F.slice(two, F.lit(1), k), lambda x: x == g)).cast("string")))
    outer = F.when(F.length(form) == 3, F.array(F.concat(F.substring(form, 1, 1), F.substring(form, 3, 1), F.lit("\x010")))).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.array_distinct(F.filter(F.split(form, " "), lambda w: w != "")), lambda w: F.concat(F.lit("\x02"), w))
    return F.array_distinct(F.concat(told, outer, words))


def _indexed(rows: DataFrame, name: str, longest: int | None = None) -> DataFrame:
    """(name, n, form, size, gram) of a column of distinct texts in lower case: n its length, form 0 the text, 1 its words in order, 2 its distinct words in order.

    Texts of more than ``longest`` characters are left out.
    """
    low = rows.select(F.lower(name).alias("low"), name).withColumn("n", F.length("low"))
    low = low if longest is None else low.where(F.col("n") < longest)
    words = F.filter(F.split("low", r"(?U)\s+"), lambda w: w != "")
    each = F.array("low", F.array_join(F.array_sort(words), " "), F.array_join(F.array_sort(F.array_distinct(words)), " "))
    forms = low.select(name, "n", F.posexplode(each).alias("form", "text"))
    return forms.select(name, "n", "form", F.length("text").alias("size"), F.explode(_grams(F.col("text"))).alias("gram"))


def nearest_names(values: DataFrame, names: DataFrame, least: float = 80) -> DataFrame:
    """values (value) distinct, names (name, code) of fixed size -> (value, code) of the best name that scores ``least`` (75 or more) or more by the weighted score; case doesn't count, of equal scores the last name wins.

    No pair that scores so is missed, and few others are scored. A ratio of r of n characters together has a common subsequence of
    rn/200, which the other (1 - r/100)n characters break at as many places at most; so (3r/200 - 1)n - 1 neighbouring characters
    stay neighbours in both. Pairs must share so many grams in some form, or a word. With a factor of 8 between lengths no score
    exceeds 60. Null, empty and one-letter values have no row.
    """
    if least < 75:
        raise ValueError("the index of grams is for scores of 75 or more")
    window = least / 0.9  # of a window's ratio, whose weight is 0.9; it's a window of p/(200-p) of the pattern at least
    whole, part = 3 * least / 200 - 1, (3 * window / 200 - 1) * (1 + window / (200 - window))
    top = names.agg(F.max(F.length("name"))).first()[0] or 0  # one number
    index = _indexed(names.select("name").distinct(), "name").select("name", F.col("n").alias("name_n"), "form", F.col("size").alias("name_size"), "gram")
    grams = _indexed(values.where(F.length("value") > 1), "value", 8 * top)
    met = grams.join(F.broadcast(index), ["form", "gram"]).where((F.col("n") < 8 * F.col("name_n")) & (F.col("name_n") < 8 * F.col("n")))
    counted = met.groupBy("value", "name", "form").agg(F.count_if(~F.col("gram").startswith("\x02")).alias("shared"), F.bool_or(F.col("gram").startswith("\x02")).alias("word"), F.max("size").alias("size"), F.max("name_size").alias("name_size"))
    need = F.least(F.lit(whole) * (F.col("size") + F.col("name_size")), F.lit(part) * F.least("size", "name_size")) - 1
    candidates = counted.where(F.col("word") | (F.col("shared") >= need - F.lit(1e-9))).select("value", "name").distinct()
    scored = candidates.withColumn("s", weighted_score(F.lower("value"), F.lower("name"))).where(F.col("s") >= least)
    best = scored.groupBy("value").agg(F.max_by("name", F.struct("s", "name")).alias("name"))
    return best.join(F.broadcast(names.groupBy("name").agg(F.max("code").alias("code"))), "name").select("value", "code")

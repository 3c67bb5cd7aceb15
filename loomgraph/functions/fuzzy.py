"""Name similarity, 0 to 100, of many pairs at once: characters are columns of integer matrices, so the Python steps
follow the names' lengths and not the number of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs that one matrix holds, and the fixed values of the bonus for equal first characters.
PAIRS, PREFIX, BONUS = 1 << 15, 4, 0.1
#: Groups of characters that the bound on a score counts apart.
BAG = 32


def jaro(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """a, b: codes of the names' characters, one name a row, -1 and -2 behind their ends; m, n: their lengths.  Greedy
    matching within a window; every mismatched place counts half a transposition."""
    rows = np.arange(len(a))
    reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)
    free, order = np.ones(b.shape, bool), np.full(a.shape, -1, np.int32)
    for i in range(a.shape[1]):
        open_ = i < m
        for j in range(max(0, i - int(reach.max(initial=0))), min(b.shape[1], i + int(reach.max(initial=0)) + 1)):
            hit = open_ & (np.abs(i - j) <= reach) & free[:, j] & (a[:, i] == b[:, j])
            if hit.any():
                free[hit, j] = False
                order[hit, i] = j
                open_ &= ~hit
    matched = (order >= 0).sum(1)
    # The k-th matched character of each name side by side.
    left, right = (np.argsort(~x, axis=1, kind="stable") for x in (order >= 0, ~free & (b >= 0)))
    width = int(matched.max(initial=0))
    moved = np.zeros(len(a))
    for k in range(width):
        moved += (k < matched) & (a[rows, left[:, k]] != b[rows, right[:, k]])
    some = np.maximum(matched, 1)
    out = np.where(matched > 0, (matched / np.maximum(m, 1) + matched / np.maximum(n, 1) + (matched - moved / 2) / some) / 3, 0.0)
    same = (m == n) & ((a[:, : b.shape[1]] == b[:, : a.shape[1]]) | (np.arange(min(a.shape[1], b.shape[1])) >= m[:, None])).all(1)
    return np.where(same, 1.0, out)


def codes(names: list[str], behind: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in names], np.int64)
    out = np.full((len(names), max(1, int(size.max(initial=0)))), behind, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).view(np.int32)
    return out, size


def prefix_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = min(PREFIX, a.shape[1], b.shape[1])
    return np.cumprod(a[:, :width] == b[:, :width], axis=1).sum(1)


def lowered_scores(x: list[str], y: list[str]) -> np.ndarray:
    """Of names in lower case: with a bonus for up to four equal first characters, given at any similarity; rounded
    half up."""
    out = np.empty(len(x), np.int64)
    order = np.argsort([len(p) + len(q) for p, q in zip(x, y, strict=True)], kind="stable")  # so that a matrix has little behind the ends
    for i in range(0, len(order), PAIRS):
        own = order[i : i + PAIRS]
        (a, m), (b, n) = codes([x[k] for k in own], -1), codes([y[k] for k in own], -2)
        j = jaro(a, b, m, n)
        out[own] = np.floor((j + prefix_of(a, b) * BONUS * (1 - j)) * 100 + 0.5).astype(np.int64)
    return out


def token_sorted(x: str) -> str:
    """The words put in order (upper case first) and lower-cased after that."""
    return " ".join(sorted(x.split())).lower()


def jaro_winkler_scores(x: list[str], y: list[str]) -> np.ndarray:
    return lowered_scores([p.lower() for p in x], [q.lower() for q in y])


def token_sort_scores(x: list[str], y: list[str]) -> np.ndarray:
    return lowered_scores([token_sorted(p) for p in x], [token_sorted(q) for q in y])


def name_scores(x: list[str], y: list[str]) -> np.ndarray:
    """The better of both."""
    return np.maximum(token_sort_scores(x, y), jaro_winkler_scores(x, y))


class Bags:
    """Names as what bounds their scores: how often they have each group of characters, their lengths and first
    characters, as they are and with their words in order."""

    def __init__(self, names: list[str]):
        self.names, self.forms = names, []
        for form in ([x.lower() for x in names], [token_sorted(x) for x in names]):
            c, size = codes(form, -1)
            bag = np.zeros((len(names), BAG), np.int16)
            rows, at = np.nonzero(c >= 0)
            np.add.at(bag, (rows, c[rows, at] % BAG), 1)
            first = np.full((len(names), PREFIX), -1, np.int32)
            first[:, : min(PREFIX, c.shape[1])] = c[:, :PREFIX]
            self.forms.append((bag, size, first))

    def most(self, other: Bags) -> np.ndarray:
        """For each name here and each there, a score that name_scores doesn't exceed.

        Matched characters are equal, so there are no more of them than both names share of each character, and of each
        group of characters: c.  Jaro's similarity grows with the matches and falls with transpositions, so it is at most
        (c / m + c / n + 1) / 3, and the bonus grows with it; the equal first characters are counted as they are."""
        out = np.zeros((len(self.names), len(other.names)), np.int16)
        for (bag, m, first), (their, n, their_first) in zip(self.forms, other.forms, strict=True):
            shared = np.zeros(out.shape, np.int16)
            for g in np.flatnonzero(bag.any(0) & their.any(0)):
                shared += np.minimum(bag[:, g, None], their[None, :, g])
            j = np.where(shared > 0, np.minimum(1, (shared / np.maximum(m, 1)[:, None] + shared / np.maximum(n, 1)[None, :] + 1) / 3), (m[:, None] + n[None, :] == 0).astype(float))
            p = np.cumprod((first[:, None] == their_first[None]) & (first[:, None] >= 0), axis=2).sum(2)
            out = np.maximum(out, np.floor((j + p * BONUS * (1 - j)) * 100 + 0.5 + 1e-9).astype(np.int16))
        return out


def _udf(f):
    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=a.index, dtype="Int64")
        good = a.notna() & b.notna()
        if good.any():
            out[good] = f(a[good].tolist(), b[good].tolist())
        return out

    return run


def jaro_winkler(a: Column, b: Column) -> Column:
    return _udf(jaro_winkler_scores)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _udf(token_sort_scores)(a, b)


def name_score(a: Column, b: Column) -> Column:
    """The better of both."""
    return _udf(name_scores)(a, b)


def jaro_winkler_score(a: str, b: str) -> int:
    return int(jaro_winkler_scores([a], [b])[0])


def token_sort_score(a: str, b: str) -> int:
    return int(token_sort_scores([a], [b])[0])

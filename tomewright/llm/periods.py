"""Periodic runs of words by recompression.

A run is a stretch of consecutive words of one text with smallest period q
(words q apart are equal), at least ``least`` words and ``times`` periods
long, that no neighbouring word extends.  The texts of a batch become one
array of exact word numbers.

* Grammar.  Levels alternate: block compression replaces every maximal
  repetition of a symbol by one symbol named (symbol, exponent); pair
  compression splits the symbols into two classes and names each pair of a
  first-class and a following second-class symbol.  Every level is named
  across the batch, so equal symbols derive equal words.  Levels end when
  every text is one symbol; their number is logarithmic.
* Longest common extension.  Two positions advance together by the largest
  symbols that start at both and are equal (a repetition by as many copies as
  both have), first up the levels, then down; leftwards alike over symbols
  that end there.  All queries of a batch run together.
* Candidates.  A run of period p holds a grid point i = 0, s, 2s, ... with
  s = max(p, W) such that W words at i equal those at i + p.  The grid is
  harmonic, so there are n log n points; those whose window hash agrees (a
  filter that loses none) get exact extensions to both sides from the grammar.
  Texts in which no window occurs twice need no grammar.

Extensions with a multiple of the smallest period give the same stretch, of
which the smallest period is kept.  Null and empty texts have no words, hence
no runs.  Rows are independent: repeated rows and ids give a row each, an
empty table gives none; a text must fit one task.  Input columns that carry
the name of a result are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tomewright.llm.common import batches, mix, powers, run_starts

POINTS = 1 << 20                # grid points looked at together
QUERIES = 1 << 17               # extension queries answered together


@dataclass
class Level:
    """Symbols of all texts at one level: where each starts, its name, and how many equal ones follow or precede it."""
    start: np.ndarray           # positions of the symbols, and the end of the array
    sym: np.ndarray
    after: np.ndarray           # equal symbols of the same text from here on
    before: np.ndarray          # equal symbols of the same text up to here


def repetitions(sym: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First symbol of every maximal repetition inside a text; equal symbols from and up to each symbol."""
    first = np.flatnonzero(np.r_[True, (sym[1:] != sym[:-1]) | (text[1:] != text[:-1])])
    size = np.diff(np.r_[first, len(sym)])
    into = np.arange(len(sym)) - np.repeat(first, size)
    return first, np.repeat(size, size) - into, into + 1


class Grammar:
    """Run-length grammar of a batch of texts and extension queries on it."""

    def __init__(self, word: np.ndarray, off: np.ndarray):
        self.n, self.off = len(word), off
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))
        self.end = np.r_[off[1:][text], 0]              # end of the text of a position
        self.begin = np.r_[off[:-1][text], self.n]
        self.levels: list[Level] = []
        sym, start, names, blocks, seed = word.astype(np.int64), np.arange(self.n), int(word.max(initial=-1)) + 1, True, 1
        while True:
            first, after, before = repetitions(sym, text)
            self.levels.append(Level(np.r_[start, self.n], sym, after, before))
            if len(run_starts(text)) == len(sym):
                break
            if blocks:
                size, sym = after[first], sym[first].copy()
                many = np.flatnonzero(size > 1)
                if len(many):
                    sym[many], names = self.named(sym[many], size[many], names)
                start, text = start[first], text[first]
            else:
                side = (mix(sym.astype(np.uint64) + np.uint64(seed << 40)) & np.uint64(1)).astype(bool)
                inside = text[1:] == text[:-1]
                ways = [np.flatnonzero(inside & (side[:-1] == s) & (side[1:] != s)) for s in (True, False)]
                pair = max(ways, key=len)
                seed += 1
                sym = sym.copy()
                if len(pair):
                    sym[pair], names = self.named(sym[pair], sym[pair + 1], names)
                kept = np.ones(len(sym), bool)
                kept[pair + 1] = False
                sym, start, text = sym[kept], start[kept], text[kept]
            blocks = not blocks
        # highest level at which a position is a border between symbols
        self.top = np.zeros(self.n + 1, np.int64)
        for k, level in enumerate(self.levels):
            self.top[level.start] = k

    @staticmethod
    def named(a: np.ndarray, b: np.ndarray, names: int) -> tuple[np.ndarray, int]:
        """New names of the pairs (a, b); equal pairs share one."""
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        out = np.empty(len(a), np.int64)
        out[order] = names + np.cumsum(new) - 1
        return out, names + int(new.sum())

    def extend(self, i: np.ndarray, j: np.ndarray, right: bool) -> np.ndarray:
        """How many words from i and from j on (or up to them) are equal inside the text of j (of i < j)."""
        total = np.zeros(len(i), np.int64)
        for lo in range(0, len(i), QUERIES):
            part = slice(lo, lo + QUERIES)
            total[part] = self._extend(i[part], j[part], right)
        return total

    def _extend(self, i: np.ndarray, j: np.ndarray, right: bool) -> np.ndarray:
        if not len(i):
            return np.zeros(0, np.int64)
        done = np.zeros(len(i), np.int64)
        room = self.end[j] - j if right else i - self.begin[i]
        level, up = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        live = np.flatnonzero(room > 0)
        while len(live):
            x, y = (i[live] + done[live], j[live] + done[live]) if right else (i[live] - done[live], j[live] - done[live])
            now = level[live] = np.minimum(level[live], np.minimum(self.top[x], self.top[y]))
            for k in np.unique(now).tolist():
                at = np.flatnonzero(now == k)
                who, lv = live[at], self.levels[k]
                a, b = np.searchsorted(lv.start, x[at]), np.searchsorted(lv.start, y[at])
                if not right:
                    a, b = a - 1, b - 1
                same = lv.sym[a] == lv.sym[b]
                copies = np.minimum(lv.after[a], lv.after[b]) if right else np.minimum(lv.before[a], lv.before[b])
                step = (lv.start[a + 1] - lv.start[a]) * np.where(same, copies, 0)
                done[who] += step
                up[who] &= same
                level[who] += np.where(same, up[who], -1)
                level[who[same & (level[who] >= len(self.levels))]] = len(self.levels) - 1
            live = live[(level[live] >= 0) & (done[live] < room[live])]
        return np.minimum(done, room)


def window_hash(word: np.ndarray, w: int) -> np.ndarray:
    """Hash of the w words from each position on (positions without w words: of fewer)."""
    h, pw = np.zeros(len(word), np.uint64), powers(w)
    value = mix(word.astype(np.uint64) + np.uint64(1))
    for k in range(w):
        h[:len(word) - k] += value[k:] * pw[k]
    return h


def grid_points(h: np.ndarray, off: np.ndarray, p_lo: int, p_hi: np.ndarray, w: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, p) of all grid points of periods p_lo .. p_hi (of each text) whose windows at i and i + p agree, in bounded portions."""
    n = np.diff(off)
    count = np.maximum(p_hi - p_lo + 1, 0)
    # portions of texts and periods with about POINTS grid points
    text, p = np.repeat(np.arange(len(n)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + p_lo
    step = np.maximum(p, w)
    many = np.maximum((n[text] - p - w) // step + 1, 0)
    upto = np.cumsum(many)
    lo = 0
    while lo < len(p):
        hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + POINTS, side="right")), lo + 1)
        m = many[lo:hi]
        i = np.repeat(off[text[lo:hi]], m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)) * np.repeat(step[lo:hi], m)
        q = np.repeat(p[lo:hi], m)
        hit = h[i] == h[i + q]
        yield i[hit], q[hit]
        lo = hi


def runs(word: np.ndarray, off: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of all texts, by start, then period; positions count over the batch."""
    if times < 3 or least < 1:
        raise ValueError("the grid needs at least three periods")
    w = max((least + 2) // 3, 1)
    none = np.zeros(0, np.int64)
    # only texts in which a window occurs twice can hold a run
    h, n = window_hash(word, w), np.diff(off)
    full = np.flatnonzero(np.arange(len(word)) + w <= np.repeat(off[1:], n))
    text = np.repeat(np.arange(len(n)), n)[full]
    order = np.lexsort((h[full], text))
    a, b = full[order], text[order]
    again = (h[a][1:] == h[a][:-1]) & (b[1:] == b[:-1])
    busy = np.unique(b[1:][again])
    if not len(busy):
        return none, none, none
    at = np.concatenate([np.arange(off[t], off[t + 1]) for t in busy.tolist()])
    sub = np.r_[0, np.cumsum(n[busy])]
    word, h, n = word[at], h[at], n[busy]
    g = Grammar(np.unique(word, return_inverse=True)[1], sub)
    found = [np.zeros((3, 0), np.int64)]
    # short periods: neighbouring grid points that agree lie in one stretch, the first one stands for it
    reach, own = np.zeros(len(word) + 1, np.int64), np.ones(len(word) + 1, np.int64)
    for i, p in grid_points(h, sub, 1, np.minimum(w, n // times), w):
        first = np.r_[True, (p[1:] != p[:-1]) | (i[1:] != i[:-1] + w)] if len(i) else np.zeros(0, bool)
        got = _stretches(g, i[first], p[first], least, times)
        found.append(got)
        for s, e, q in got.T[np.argsort(got[2], kind="stable")[::-1]].tolist():
            reach[s:e], own[s:e] = e, q
    # long periods; points inside a found run whose period divides theirs give that run again
    for i, p in grid_points(h, sub, w + 1, n // times, w):
        new = ~((p % own[i] == 0) & (i + p + w <= reach[i]))
        found.append(_stretches(g, i[new], p[new], least, times))
    s, e, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    keep = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])] if len(s) else np.zeros(0, bool)
    s, e, p = s[keep], e[keep], p[keep]
    t = np.searchsorted(sub, s, side="right") - 1
    shift = off[busy[t]] - sub[t]
    s, e = s + shift, e + shift
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


def _stretches(g: Grammar, i: np.ndarray, p: np.ndarray, least: int, times: int) -> np.ndarray:
    """Maximal stretches of period p around (i, i + p) that are long enough: start, end, period."""
    end = i + p + g.extend(i, i + p, True)
    start = i - g.extend(i, i + p, False)
    ok = end - start >= np.maximum(least, times * p)
    return np.unique(np.stack([start[ok], end[ok], p[ok]]), axis=1)


def number_words(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, a number for each word (equal words, equal numbers), and the word offsets of the texts."""
    found = [t.split() if t else [] for t in texts]         # at ASCII white space
    off = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)
    kinds: dict[bytes, int] = {}
    number = np.fromiter(map(kinds.setdefault, chain.from_iterable(found), count()), np.int64, off[-1])
    return found, number, off


def with_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """All columns plus n_words, runs (array of start, length, period in words, by start, then period) and collapsed.

    ``collapsed`` is the text's words without those that a run holds behind
    its first period, joined by one space.
    """
    new = ("n_words", "runs", "collapsed")
    base = docs.drop(*[c for c in new if c in docs.columns])
    extra = T._parse_datatype_string("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, text):
            texts = b.column(b.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
            found, number, off = number_words(texts)
            s, e, p = runs(number, off, least, times)
            row = np.searchsorted(off, s, side="right") - 1
            gone = np.zeros(len(number) + 1, np.int64)
            np.add.at(gone, s + p, 1)
            np.add.at(gone, e, -1)
            gone = np.cumsum(gone) > 0
            for t in np.unique(row).tolist():
                found[t] = [w for w, g in zip(found[t], gone[off[t]:off[t + 1]].tolist()) if not g]
            items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (s - off[row], e - s, p)], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.diff(off), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(off))), pa.int32()), items),
                 pa.array([b" ".join(f).decode() for f in found], pa.string())], names=[*b.schema.names, *new])
    return base.mapInArrow(run, T.StructType(base.schema.fields + extra.fields))

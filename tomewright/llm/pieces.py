"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model must be BPE with identity normalisation, a dummy prefix, no removal
of extra white space and byte fallback; others are refused.  Its pieces never
hold a space mark behind another character, so a text (spaces turned into
marks, one mark put in front) falls into independent words ``marks + rest``.

The distinct words of a batch form one flat symbol array.  In each round every
word finds its best pair (segmented minimum of pair ranks); its leftmost
non-overlapping occurrences merge at once, unless a pair arising from that
would rank at or before the merged one: then only the leftmost occurrence
merges, which is always what the queue of the library does.  The array is then
compacted, and finished words leave it.  Characters outside the vocabulary
become byte pieces.

Null texts count as empty and have no ids.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tomewright.llm.common import gather, map_batches

MARK = "▁"
_WORD = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NEVER = np.int64(1) << 40
KNOWN_WORDS = 300_000           # words a worker remembers between batches before it starts afresh


class Pieces:
    """Vocabulary tables of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)])
        sample = " a  ａ "
        if sp.decode(sp.encode(sample)) != sample or any(MARK in t.lstrip(MARK) for t in self.text):
            raise ValueError("needs identity normalisation, a dummy prefix and pieces within words")
        self.byte = np.zeros(256, np.int64)
        out = []
        for i, t in enumerate(self.text):
            if sp.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
                out.append(bytes([int(t[3:5], 16)]))
            else:
                out.append(b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else t.replace(MARK, " ").encode())
        self.raw = np.frombuffer(b"".join(out), np.uint8)
        self.raw_off = np.r_[0, np.cumsum([len(x) for x in out])]
        dec = [f"{i},".encode() for i in range(n)]
        self.dec = np.frombuffer(b"".join(dec), np.uint8)
        self.dec_off = np.r_[0, np.cumsum([len(x) for x in dec])]
        self.id = {t: i for i, t in enumerate(self.text) if plain[i]}
        score = {t: sp.get_score(i) for t, i in self.id.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        # every split of a piece into two pieces or characters is a pair that may merge
        self.n = n
        single = sorted({c for t in self.id for c in t} - self.id.keys())
        self.sym = self.id | {c: n + k for k, c in enumerate(single)}      # characters that only occur inside pieces
        keys, ranks, made = [], [], []
        for t, i in self.id.items():
            for k in range(1, len(t)):
                a, b = self.sym.get(t[:k]), self.sym.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(order[score[t]])
                    made.append(i)
        at = np.argsort(keys)
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[at] for x in (keys, ranks, made))
        self.chars = {c: s for c, s in self.sym.items() if len(c) == 1}
        self.forget()

    def forget(self) -> None:
        """Drop the words that earlier batches of this worker have encoded."""
        self.known: dict[str, int] = {}
        self.known_ids, self.known_off = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging a with b (rank NEVER where they don't merge)."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], NEVER), self.made[at]

    def neighbours(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each symbol with its right neighbour in the word."""
        rank, made = np.full(len(sym), NEVER), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            at = np.flatnonzero(word[1:] == word[:-1])
            rank[at], made[at] = self.pairs(sym[at], sym[at + 1])
        return rank, made

    def merge(self, sym, word, rank, made, hit):
        """Merge at the hits and compact; only pairs beside a merge are looked up again."""
        gone = np.r_[False, hit[:-1]]
        kept = np.flatnonzero(~gone)
        s, w, r, m = np.where(hit, made, sym)[kept], word[kept], rank[kept], made[kept]
        new = hit[kept]
        fresh = new | np.r_[new[1:], False]             # the pair of this symbol and the next has changed
        at = np.flatnonzero(fresh)
        r[at] = NEVER
        at = at[at + 1 < len(s)]
        at = at[w[at] == w[at + 1]]
        r[at], m[at] = self.pairs(s[at], s[at + 1])
        return s, w, r, m, kept, fresh

    def encode_words(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the offsets of the words."""
        n_words = len(distinct)
        n = np.fromiter((len(w) for w in distinct), np.int64, n_words)
        code = np.frombuffer("".join(distinct).encode("utf-32-le"), np.uint32)
        kinds, inv = np.unique(code, return_inverse=True)
        own = np.array([self.chars.get(chr(c), -1 - int(c)) for c in kinds], np.int64)     # negative: outside the vocabulary
        sym, word = own[inv] if len(code) else np.zeros(0, np.int64), np.repeat(np.arange(n_words), n)
        done_sym, done_word = [], []
        rank, made = self.neighbours(sym, word)
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            keep = best < NEVER
            if not keep.all():
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, rank, made, best = sym[keep], word[keep], rank[keep], made[keep], best[keep]
                if not len(sym):
                    break
            hit = rank == best
            # leftmost, non-overlapping: every second one of a run of neighbouring hits
            if (hit[1:] & hit[:-1]).any():
                idx = np.arange(len(sym))
                run0 = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], idx, 0))
                hit &= (idx - run0) % 2 == 0
            merged = self.merge(sym, word, rank, made, hit)
            kept, fresh, r2 = merged[4], merged[5], merged[2]
            bad = fresh & (r2 <= best[kept])
            if bad.any():                               # rare: these words merge their leftmost hit only
                slow = np.isin(word, np.unique(word[kept][bad]))
                idx = np.arange(len(sym))
                start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                lead = np.repeat(np.minimum.reduceat(np.where(hit, idx, len(sym)), start), np.diff(np.r_[start, len(sym)]))
                merged = self.merge(sym, word, rank, made, hit & (~slow | (idx == lead)))
            sym, word, rank, made = merged[:4]
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        at = np.argsort(word, kind="stable")
        sym, word = sym[at], word[at]
        # characters without a piece: UTF-8 bytes
        odd = np.flatnonzero((sym < 0) | (sym >= self.n))
        if len(odd):
            back = {v: c for c, v in self.chars.items() if v >= self.n}
            enc = [np.frombuffer((chr(-1 - s) if s < 0 else back[s]).encode(), np.uint8) for s in sym[odd].tolist()]
            rep = np.ones(len(sym), np.int64)
            rep[odd] = [len(e) for e in enc]
            out, where = np.repeat(sym, rep), np.cumsum(rep) - rep
            for e, p in zip(enc, where[odd]):
                out[p:p + len(e)] = self.byte[e]
            sym, word = out, np.repeat(word, rep)
        return sym, np.searchsorted(word, np.arange(n_words + 1))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of the texts."""
        found = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        known, before = self.known, len(self.known)
        code = np.array([known.setdefault(w, len(known)) for f in found for w in f], np.int64)
        if len(known) > before:
            ids, off = self.encode_words(list(islice(known, before, None)))
            self.known_ids = np.r_[self.known_ids, ids]
            self.known_off = np.r_[self.known_off, off[1:] + self.known_off[-1]]
        flat, to = gather(self.known_ids, self.known_off, code)
        return flat, to[np.r_[0, np.cumsum([len(f) for f in found])]]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Text of each id sequence; the dummy prefix goes, as in the library's decode."""
        raw, to = gather(self.raw, self.raw_off, ids)
        data, at = raw.tobytes(), to[off]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decimal(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of each sequence in decimal, joined by commas."""
        raw, to = gather(self.dec, self.dec_off, ids)
        data, at = raw.tobytes(), to[off]
        return [data[a:max(b - 1, a)] for a, b in zip(at[:-1], at[1:])]


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """Tables of a model, built once per Python worker."""
    return Pieces(path)


def encode_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) -> key, ids (array of int), decoded (string)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p, texts = load(model), [t or "" for t in b.column(1).to_pylist()]
        ids, off = p.encode(texts)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())),
             pa.array(p.decode(ids, off), pa.string())], names=[key, "ids", "decoded"])
    return map_batches(docs.select(key, text), run, text, f"`{key}` {kind}, ids array<int>, decoded string")


def digest_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) -> key, n_tokens, ids_sha256, decoded_sha256 (of what ``encode_texts`` gives, kept in the task)."""
    kind = docs.schema[key].dataType.simpleString()
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p, texts = load(model), [t or "" for t in b.column(1).to_pylist()]
        ids, off = p.encode(texts)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.diff(off), pa.int64()), pa.array([sha(x) for x in p.decimal(ids, off)]),
             pa.array([sha(t.encode()) for t in p.decode(ids, off)])],
            names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_batches(docs.select(key, text), run, text,
                       f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

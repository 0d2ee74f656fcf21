"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The tokenizer file must be a BPE of bytes with word ends, over words cut out
of normalised text (NFC, lower case, white space dropped), without a decoder;
others are refused.  A text is cut at spaces and line feeds, which no word
holds, so each distinct piece of a batch is normalised and split once.

* Lexicon.  Words are counted over all texts.  The most frequent ones (at most
  ``most``, a parameter that bounds memory, not results) become an automaton
  whose equal suffixes are shared.  An arc carries how many words pass before
  it, so the sum along a path is the number of the word in byte order, and the
  transducer's output is the id sequence stored under that number.
* File.  All tables lie in one file in the shared folder.  Spark fetches it to
  every executor (also one that joins later) and tasks map it into memory, so
  the Python workers of a machine share its pages.
* Look-up.  All distinct words of a batch walk the automaton together, one
  byte a step.  Words it does not hold are merged exactly: words of equal
  length form a matrix, and every row merges its leftmost best pair per round;
  words over LONG bytes use a queue.

Null and empty texts have no ids and decode to the empty text.  The strings of
special tokens in a text become their ids, as in the library.  Rows are
encoded one by one: repeated rows and ids give a row each, an empty table
gives none, other columns are not read, and a text of any length is encoded
whole (it must fit one task).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.common import batches, gather, map_batches
from tomewright.session import cut_lineage, new_folder

MOST = 65_536                   # words of the lexicon
LONG = 64                       # bytes: longer words are merged with a queue and never enter the lexicon
HELD = 200_000                  # distinct pieces a counting task holds before it passes their counts on
NEVER = np.int64(1) << 40
END = "</w>"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if (model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec.get("decoder") or model.get("unk_token")
                or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges")):
            raise ValueError("needs a byte BPE with word ends and without a decoder")
        self.path, vocab = path, model["vocab"]
        cut = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.cut = regex.compile(cut)
        self.cut_or_space = regex.compile(cut + r"|\x20")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + END] for c in chars], np.int64)
        pair = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pair], np.int64)
        at = np.argsort(key)
        self.keys, self.ranks = key[at], np.arange(len(key))[at]
        self.made = np.array([vocab[a + b] for a, b in pair], np.int64)[at]
        self.rank_of = {int(k): (r, int(m)) for k, r, m in zip(self.keys, self.ranks.tolist(), self.made)}
        tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = t
        out = [(t + " ").encode() for t in tokens]
        self.raw, self.raw_off = np.frombuffer(b"".join(out), np.uint8), np.r_[0, np.cumsum([len(x) for x in out])]
        self._exact = None

    # -- words of a text

    def pieces(self, text: str) -> list[str]:
        """The text cut at spaces, line feeds and special tokens (which stay as pieces of their own)."""
        if any(s in text for s in self.special):
            parts = self.special_cut.split(text)
            return [x for k, p in enumerate(parts) for x in ([p] if k % 2 else self.pieces(p))]
        return text.replace("\n", " ").split(" ")

    def words_exact(self, piece: str) -> list[str]:
        """Words of a piece with characters that Python's Unicode tables lack: as the library normalises and cuts it."""
        if self._exact is None:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import Split
            from tokenizers import Regex
            self._exact = Tokenizer.from_file(self.path).normalizer, Split(Regex(self.cut.pattern), "removed", True)
        return [w for w, _ in self._exact[1].pre_tokenize_str(self._exact[0].normalize_str(piece))]

    def words(self, distinct: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of all pieces end to end, and the offsets of the pieces."""
        joined = " ".join("" if p in self.special else p for p in distinct)
        odd = {c for c in set(joined) if c > "\x7f" and unicodedata.category(c) == "Cn"}
        own = {k: [p] for k, p in enumerate(distinct) if p in self.special}
        if odd:
            own |= {k: self.words_exact(p) for k, p in enumerate(distinct) if not odd.isdisjoint(p)}
            joined = " ".join("" if k in own else p for k, p in enumerate(distinct))
        # lower case character by character: no final form of sigma
        found = self.cut_or_space.findall(unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower())
        if own:
            out, off, k, stop = [], [0], 0, [*found, " "]
            for w in stop:
                if w == " ":
                    out += own.get(k, ())
                    off.append(len(out))
                    k += 1
                else:
                    out.append(w)
            return out, np.array(off if distinct else [0])
        stop = np.flatnonzero(np.fromiter((w == " " for w in found), bool, len(found)))
        off = np.r_[0, stop - np.arange(len(stop)), len(found) - len(stop)] if distinct else np.zeros(1, np.int64)
        return [w for w in found if w != " "], off

    # -- merging

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging a with b (rank NEVER where they don't merge)."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), self.made[at]

    def merge_equal(self, sym: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words of equal length (rows of symbols) -> (rows, ids) by length of the result."""
        out, rows = [], np.arange(len(sym))
        if sym.shape[1] == 1:
            return [(rows, sym)]
        rank, made = self.pairs(sym[:, :-1], sym[:, 1:])
        while True:
            best = rank.argmin(axis=1)
            go = rank[np.arange(len(sym)), best] < NEVER
            if not go.all():
                out.append((rows[~go], sym[~go]))
            if not go.any():
                return out
            rows, sym, rank, made, best = rows[go], sym[go], rank[go], made[go], best[go]
            every, m = np.arange(len(sym)), best[:, None]
            sym[every, best] = made[every, best]
            col = np.arange(sym.shape[1] - 1)
            sym = np.take_along_axis(sym, col + (col > m), axis=1)
            if sym.shape[1] == 1:
                return [*out, (rows, sym)]
            col = np.arange(sym.shape[1] - 1)
            src = col + (col >= m)
            rank, made = np.take_along_axis(rank, src, axis=1), np.take_along_axis(made, src, axis=1)
            for side in (best - 1, best):               # the pairs beside the merged symbol
                ok = np.flatnonzero((side >= 0) & (side < sym.shape[1] - 1))
                rank[ok, side[ok]], made[ok, side[ok]] = self.pairs(sym[ok, side[ok]], sym[ok, side[ok] + 1])

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: a queue of pairs over a linked list."""
        sym = self.inner[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(hit[0], i, hit[1]) for i in range(n - 1) if (hit := self.rank_of.get(sym[i] << 32 | sym[i + 1]))]
        heapq.heapify(queue)
        while queue:
            rank, i, made = heapq.heappop(queue)
            j = right[i]
            if sym[i] < 0 or j < 0 or (rank, made) != self.rank_of.get(sym[i] << 32 | sym[j]):
                continue
            sym[i], sym[j], right[i] = made, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (hit := self.rank_of.get(sym[p] << 32 | sym[q])):
                    heapq.heappush(queue, (hit[0], p, hit[1]))
        return np.array([s for s in sym if s >= 0], np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (not empty) end to end, and the offsets of the words."""
        size = np.fromiter((len(w) for w in words), np.int64, len(words))
        count, who, got = np.zeros(len(words), np.int64), [], []
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            if n > LONG:
                for k in at.tolist():
                    ids = self.merge_long(words[k])
                    count[k] = len(ids)
                    who.append(np.full(len(ids), k))
                    got.append(ids)
                continue
            raw = np.frombuffer(b"".join([words[k] for k in at.tolist()]), np.uint8).reshape(len(at), n)
            sym = self.inner[raw]
            sym[:, -1] = self.last[raw[:, -1]]
            for rows, ids in self.merge_equal(sym):
                count[at[rows]] = ids.shape[1]
                who.append(np.repeat(at[rows], ids.shape[1]))
                got.append(ids.ravel())
        ids, who = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (got, who))
        return ids[np.argsort(who, kind="stable")], np.r_[0, np.cumsum(count)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Tokens of each id sequence joined by spaces, in UTF-8."""
        raw, to = gather(self.raw, self.raw_off, ids)
        data, at = raw.tobytes(), to[off]
        return [data[a:max(b - 1, a)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class Automaton:
    """Minimal acyclic automaton of a word list; arcs count the words that pass before them.

    ``key`` (state << 8 | byte, ascending), ``to`` and ``before`` describe the
    arcs, ``final`` the states that end a word, ``ids[off[k]:off[k + 1]]`` the
    output of word number k.
    """

    FIELDS = (("key", np.int64), ("off", np.int64), ("to", np.int32), ("before", np.int32), ("final", np.int32), ("ids", np.int32))

    def __init__(self, **tables: np.ndarray):
        self.__dict__.update(tables)

    @classmethod
    def build(cls, words: list[bytes], ids: np.ndarray, off: np.ndarray) -> "Automaton":
        """``words`` ascending and distinct; states are shared as soon as no later word can reach them."""
        register: dict[tuple, int] = {}
        states: list[tuple[int, bool, list]] = []       # words below, final, arcs (byte, state)
        open_: list[list] = [[False, []]]               # states along the last word, not yet shared

        def close(node: list) -> int:
            sign = (node[0], tuple(node[1]))
            if (known := register.get(sign)) is None:
                known = register[sign] = len(states)
                states.append((node[0] + sum(states[s][0] for _, s in node[1]), *node))
            return known
        last = b""
        for w in [*words, b""]:
            same = 0
            while same < min(len(last), len(w)) and last[same] == w[same]:
                same += 1
            while len(open_) > same + 1:
                done = close(open_.pop())
                open_[-1][1].append((last[len(open_) - 1], done))
            open_ += [[False, []] for _ in w[same:]]
            if w:
                open_[-1][0] = True
            last = w
        root = close(open_[0])
        key, to, before, final = [], [], [], np.zeros(len(states), np.int32)
        for s, (_, end, arcs) in enumerate(states):
            n = int(end)
            final[s] = n
            for byte, t in arcs:
                key.append(s << 8 | byte)
                to.append(t)
                before.append(n)
                n += states[t][0]
        assert root == len(states) - 1
        return cls(key=np.array(key, np.int64), off=off.astype(np.int64), to=np.array(to, np.int32),
                   before=np.array(before, np.int32), final=final, ids=ids.astype(np.int32))

    def find(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of each word ``raw[off[i]:off[i + 1]]``, -1 where the automaton does not hold it."""
        n = np.diff(off)
        number, state = np.zeros(len(n), np.int64), np.full(len(n), len(self.final) - 1, np.int64)
        live = np.flatnonzero(n > 0) if len(self.key) else np.zeros(0, np.int64)
        found = np.full(len(n), -1, np.int64)
        step = 0
        while len(live):
            key = state[live] << 8 | raw[off[live] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            live, at = live[hit], at[hit]
            state[live] = self.to[at]
            number[live] += self.before[at]
            step += 1
            over = n[live] == step
            end = live[over]
            ok = self.final[state[end]] > 0
            found[end[ok]] = number[end[ok]]
            live = live[~over]
        return found

    def dump(self) -> bytes:
        """Sizes of the tables, then the tables, in one file image."""
        tables = [np.ascontiguousarray(self.__dict__[f], t) for f, t in self.FIELDS]
        return np.array([len(t) for t in tables], np.int64).tobytes() + b"".join(t.tobytes() for t in tables)

    @classmethod
    def map(cls, path: str) -> "Automaton":
        """The tables of a file, mapped read-only."""
        data = np.memmap(path, np.uint8, "r")
        at, tables = 8 * len(cls.FIELDS), {}
        for (f, t), n in zip(cls.FIELDS, data[:at].view(np.int64).tolist()):
            size = n * np.dtype(t).itemsize
            tables[f] = data[at:at + size].view(t)
            at += size
        return cls(**tables)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Tables of a tokenizer file, built once per Python worker."""
    return Vocabulary(path)


@lru_cache(maxsize=4)
def mapped(name: str) -> Automaton:
    """The automaton file that Spark has fetched for this executor."""
    from pyspark import SparkFiles
    return Automaton.map(SparkFiles.get(name))


def encode(texts: list[str], voc: Vocabulary, known: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the offsets of the texts."""
    seen: dict[str, int] = {}
    found = [voc.pieces(t) if t else [] for t in texts]
    code = np.array([seen.setdefault(p, len(seen)) for f in found for p in f], np.int64)
    text_off = np.r_[0, np.cumsum([len(f) for f in found])]
    del found
    words, piece_off = voc.words(list(seen))
    kinds: dict[str, int] = {}
    word = np.array([kinds.setdefault(w, len(kinds)) for w in words], np.int64)
    ids, off = encode_words(list(kinds), voc, known)
    # words -> pieces -> texts
    flat, to = gather(ids, off, word)
    flat, to = gather(flat, to[piece_off], code)
    return flat, to[text_off]


def encode_words(words: list[str], voc: Vocabulary, known: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words end to end: the transducer's outputs, and merges for words it does not hold."""
    data = [w.encode() for w in words]
    size = np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)
    number = known.find(np.frombuffer(b"".join(data), np.uint8), size)
    special = {k: voc.special[w] for k, w in enumerate(words) if w in voc.special}
    number[list(special)] = -1
    new = [k for k in np.flatnonzero(number < 0).tolist() if k not in special]
    ids, off = voc.merge([data[k] for k in new])
    # one table of outputs: lexicon, merged words, special tokens
    flat = np.concatenate([known.ids, ids, list(special.values())]).astype(np.int64)
    bounds = np.concatenate([known.off[:-1], known.off[-1] + off[:-1], known.off[-1] + off[-1] + np.arange(len(special) + 1)]).astype(np.int64)
    number[new] = len(known.off) - 1 + np.arange(len(new))
    number[list(special)] = len(known.off) - 1 + len(new) + np.arange(len(special))
    return gather(flat, bounds, number)


def count_words(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(word, n) of all words of all texts; tasks combine counts before the shuffle."""
    def counted(held: Counter) -> pa.RecordBatch:
        voc, out = vocabulary(model), Counter()
        words, off = voc.words(list(held))
        for w, n in zip(words, np.repeat(np.fromiter(held.values(), np.int64, len(held)), np.diff(off)).tolist()):
            out[w] += n
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["word", "n"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches(it, text):
            for t in b.column(0).to_pylist():
                if t:
                    held.update(vocabulary(model).pieces(t))
            if len(held) > HELD:
                yield counted(held)
                held = Counter()
        if held:
            yield counted(held)
    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(spark: SparkSession, counts: DataFrame, model: str, most: int = MOST) -> str:
    """Automaton of the ``most`` most frequent words up to LONG bytes; returns the name under which tasks find its file.

    Counts are grouped to sixteenths of an octave; the groups above the one that
    no longer fits are taken, so only their words reach the driver: at most
    ``most`` times LONG bytes.
    """
    voc = vocabulary(model)
    octave = F.floor(F.log2("n") * 16).cast("int")
    counts = cut_lineage(counts.where((F.octet_length("word") <= LONG) & ~F.col("word").isin(list(voc.special))).withColumn("o", octave))
    least, room = 1 << 20, most
    for r in counts.groupBy("o").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("o")).collect():      # at most 1,024 groups
        if (room := room - r["c"]) < 0:
            break
        least = r["o"]
    words = sorted(r["word"].encode() for r in counts.where(F.col("o") >= least).select("word").collect())
    data = Automaton.build(words, *voc.merge(words)).dump()
    folder = new_folder(spark)
    name = f"lexicon-{folder.rsplit('-', 1)[1]}.bin"        # a session knows a file name by one path only
    path = f"{folder}/{name}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def encode_texts(docs: DataFrame, model: str, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) -> key, ids (array of int), decoded (string)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        voc = vocabulary(model)
        ids, off = encode(b.column(1).to_pylist(), voc, mapped(lexicon))
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())),
             pa.array([d.decode() for d in voc.decode(ids, off)], pa.string())], names=[key, "ids", "decoded"])
    return map_batches(docs.select(key, text), run, text, f"`{key}` {kind}, ids array<int>, decoded string")


def digest_texts(docs: DataFrame, model: str, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) -> key, n_tokens, ids_sha256, decoded_sha256 (of what ``encode_texts`` gives, kept in the task)."""
    kind = docs.schema[key].dataType.simpleString()
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        voc = vocabulary(model)
        ids, off = encode(b.column(1).to_pylist(), voc, mapped(lexicon))
        data, at = ids.astype("<u4").tobytes(), (4 * off).tolist()
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.diff(off), pa.int64()), pa.array([sha(data[x:y]) for x, y in zip(at[:-1], at[1:])], pa.string()),
             pa.array([sha(d) for d in voc.decode(ids, off)], pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_batches(docs.select(key, text), run, text,
                       f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""SentencePiece encoding and decoding with exact n-best segmentation.

A text becomes a lattice of vocabulary pieces; a segmentation's score is the sum of its pieces' scores as the model has them.
Forward Viterbi gives every place its best score from the start; these scores are exact heuristics for a backward A* search from
the end, which yields segmentations best first and never one that is not among the n best. No piece crosses a word start, so
the lattice of a text is a chain of word lattices: a word's n best are found once and kept, and the n best of the
text are found by a best-first search over the chain that leaves the best segmentation in a few words only.

``load`` refuses a model with a piece that crosses a word start. Normal form, as the models say: a space is U+2581, and one is put before the text. A character without a piece of its
own becomes its UTF-8 byte pieces; such an edge costs ``UNKNOWN`` below the least score. Decoding undoes all this, so
decode(encode(text)) is the text, but that U+2581 becomes a space.

Ties: of equal scores the segmentation with fewer pieces comes first; of further ties the earliest changed word comes first,
then the order of the search, the same in every run.

Defined cases: null and empty texts have one segmentation, without pieces, and score 0. Texts with fewer than n segmentations have all
of them. Repeated rows each give a row; null ids are kept. Empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, small_batches, table, typed_id

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN = 10.0
NBEST = 4
CACHE_WORDS = 200_000
LONG = 256
BASE, MIX, MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1

Path = tuple[float, bytes]  # a score and ids as little-endian 32-bit integers


def load(model: str | bytes = MODEL) -> dict:
    """Pieces with ids and scores, and byte pieces, of a SentencePiece model (a file's path or its bytes)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model) if isinstance(model, str) else sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    pieces, other, raw = {}, [], {}
    for i in range(n):
        if sp.is_byte(i):
            raw[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            other.append(i)
        else:
            pieces[sp.id_to_piece(i)] = (i, sp.get_score(i))
    if across := [p for p in pieces if SPACE in p.lstrip(SPACE)]:
        raise ValueError(f"{len(across)} pieces of the model cross a word's start, like {across[0]!r}: texts can't be cut at words")
    return {"pieces": pieces, "bytes": [raw.get(b, sp.unk_id()) for b in range(256)], "skip": other}


class Segmenter:
    """N-best segmentation with a loaded vocabulary."""

    def __init__(self, vocab: dict, n: int = NBEST) -> None:
        self.n, self.pieces, self.raw = n, vocab["pieces"], vocab["bytes"]
        self.longest = max(map(len, self.pieces), default=1)
        # the least score among the pieces in use: scores near -1e9 mark pieces that merging never makes
        usual = [s for _, s in self.pieces.values() if s > -1e8]
        self.unknown = min(usual, default=0.0) - UNKNOWN
        # prefixes, so that the search for longer pieces ends early
        self.prefixes = {p[:i] for p in self.pieces for i in range(1, len(p) + 1)}
        self.names = {i: p.encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in enumerate(self.raw)}
        self.skip = frozenset(vocab["skip"])
        # line breaks and tabs that no piece holds: no piece crosses them
        letters = set().union(*self.pieces) if self.pieces else set()
        apart = "".join(c for c in "\n\r\t" if c not in letters)
        self.apart = re.compile(f"([{apart}])") if apart else None
        self.memo: dict[str, tuple[bytes, float, float]] = {}
        self.more: dict[str, list[Path]] = {}
        self._index()

    def _index(self) -> None:
        """A hash table of all prefixes of pieces: key, id or -1, score."""
        entries = sorted(self.prefixes)
        key = np.array([self._hash(p) for p in entries], np.uint64)
        ids = np.array([self.pieces.get(p, (-1, 0.0))[0] for p in entries], np.int64)
        scores = np.array([self.pieces.get(p, (-1, -np.inf))[1] for p in entries])
        self.bits = max(8, int(np.ceil(np.log2(len(entries) + 1))) + 3)
        size = 1 << self.bits
        self.slot_key, self.slot = np.zeros(size + 64, np.uint64), np.full(size + 64, -1, np.int64)
        self.probes = 1
        for e, at in enumerate((key >> np.uint64(64 - self.bits)).tolist()):
            n = 0
            while self.slot[at + n] >= 0:
                n += 1
            self.slot[at + n], self.slot_key[at + n] = e, key[e]
            self.probes = max(self.probes, n + 1)
        self.entry_id, self.entry_score = np.append(ids, -1), np.append(scores, -np.inf)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * BASE + ord(c) + 1) & MASK
        return h * MIX & MASK

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each rolling hash, -1 where no piece begins so."""
        h = h * np.uint64(MIX)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for n in range(self.probes):
            e = self.slot[at[todo] + n]
            hit = (e >= 0) & (self.slot_key[at[todo] + n] == h[todo])
            out[todo[hit]] = e[hit]
            todo = todo[~hit & (e >= 0)]
            if not len(todo):
                break
        return out

    def best_many(self, words: list[str]) -> None:
        """Puts each word's best ids, its score and what its second best loses in the memo; Viterbi over many words at a time.

        The second best segmentation has an edge off the best one; through each edge the best way is forward plus backward score.
        """
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, own in by_size.items():
            if size > 32:
                for w in own:
                    self._single(w)
            else:
                for i in range(0, len(own), 4096):
                    self._batch(own[i : i + 4096], size)

    def _single(self, word: str) -> None:
        paths = self.nbest(word, max(2, self.n))
        self.more[word] = paths
        self.memo[word] = paths[0][1], paths[0][0], paths[0][0] - paths[1][0] if len(paths) > 1 else float("inf")

    def _batch(self, words: list[str], size: int) -> None:
        """Words of one size; arrays are by place, then word, so that each step works on rows."""
        n = len(words)
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T.astype(np.uint64) + np.uint64(1)
        flat = np.arange(n * size)  # place * n + word
        h, letters = np.zeros(n * size, np.uint64), c.ravel()
        # (length, start) of the edges that any word has, with their scores and ids
        score: dict[tuple[int, int], np.ndarray] = {}
        piece: dict[tuple[int, int], np.ndarray] = {}
        odd = np.zeros(n, bool)
        for k in range(1, min(self.longest, size) + 1):
            h = h * np.uint64(BASE) + letters[flat + (k - 1) * n]
            e = self._find(h)
            s, i = np.full(n * size, -np.inf), np.full(n * size, -1, np.int32)
            s[flat], i[flat] = self.entry_score[e], self.entry_id[e]
            s, i = s.reshape(size, n), i.reshape(size, n)
            if k == 1:
                odd = (i < 0).any(axis=0)
            for at in np.flatnonzero((i >= 0).any(axis=1)).tolist():
                score[k, at], piece[k, at] = s[at], i[at]
            go = (e >= 0) & (flat < n * (size - k))
            flat, h = flat[go], h[go]
            if not len(flat):
                break
        into: list[list[int]] = [[] for _ in range(size + 1)]
        for k, at in score:
            into[at + k].append(k)
        fore, count, back = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int32), np.zeros((size + 1, n), np.int8)
        fore[0] = 0
        for t in range(1, size + 1):
            for k in into[t]:
                x, m = fore[t - k] + score[k, t - k], count[t - k] + 1
                up = (x > fore[t]) | ((x == fore[t]) & (m < count[t]))
                np.copyto(fore[t], x, where=up)
                np.copyto(count[t], m, where=up)
                np.copyto(back[t], k, where=up)
        rear = np.full((size + 1, n), -np.inf)
        rear[size] = 0
        total, second = fore[size], np.full(n, np.inf)
        on, ids = np.zeros((size + 1, n), bool), np.full((size, n), -1, np.int32)
        on[size] = True
        with np.errstate(invalid="ignore"):
            for t in range(size, 0, -1):
                for k in into[t]:
                    s = score[k, t - k]
                    through = rear[t] + s
                    np.maximum(rear[t - k], through, out=rear[t - k])
                    taken = on[t] & (back[t] == k)
                    on[t - k] |= taken
                    np.copyto(ids[t - 1], piece[k, t - k], where=taken)
                    loss = total - (fore[t - k] + through)
                    loss[taken] = np.inf
                    np.fmin(second, loss, out=second)
        mine = np.ascontiguousarray(ids.T)
        kept = mine >= 0
        ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
        data = mine[kept].astype("<i4").tobytes()
        memo, start = self.memo, 0
        for w, end, s, d, strange in zip(words, ends, total.tolist(), second.tolist(), odd.tolist(), strict=True):
            if strange:
                self._single(w)
            else:
                memo[w] = data[start:end], s, d
            start = end

    def _edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end place the edges into it: start, score, ids."""
        size = len(word)
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        pieces, prefixes = self.pieces, self.prefixes
        for a in range(size):
            for b in range(a + 1, min(size, a + self.longest) + 1):
                piece = word[a:b]
                if piece in pieces:
                    i, s = pieces[piece]
                    into[b].append((a, s, (i,)))
                elif piece not in prefixes:
                    break
            if word[a] not in pieces:
                ids = tuple(self.raw[x] for x in word[a].encode("utf-8", "surrogatepass"))
                into[a + 1].append((a, self.unknown, ids))
        return into

    def nbest(self, word: str, n: int | None = None) -> list[Path]:
        """The n best (score, ids) of a piece of text that no piece reaches out of; in order."""
        into = self._edges(word)
        size = len(word)
        # forward: (score, -pieces) of the best way to each place, exact also as to ties in the number of pieces
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-float("inf"), 0)] * size
        for b in range(1, size + 1):
            best[b] = max((best[a][0] + s, best[a][1] - len(ids)) for a, s, ids in into[b])
        # backward: a heap entry is -(score so far + forward score), pieces in all, place, number, score so far, pieces so far, ids behind
        heap = [(-best[size][0], -best[size][1], size, 0, 0.0, 0, None)]
        out: list[Path] = []
        count = 0
        while heap and len(out) < (n or self.n):
            _, _, place, _, done, have, tail = heapq.heappop(heap)
            if place == 0:
                flat: list[int] = []
                while tail:
                    flat += tail[0]
                    tail = tail[1]
                out.append((done, array("i", flat).tobytes()))
                continue
            for a, s, ids in into[place]:
                count += 1
                g, k = done + s, have + len(ids)
                heapq.heappush(heap, (-(g + best[a][0]), k - best[a][1], a, count, g, k, (ids, tail)))
        return out

    def cut(self, word: str) -> list[str]:
        """A long word, cut where no piece crosses."""
        cuts, reach, prefixes, pieces = [0], 0, self.prefixes, self.pieces
        for a in range(len(word)):
            if a and reach <= a:
                cuts.append(a)
            b = a + 1
            while b <= len(word) and word[a:b] in prefixes:
                if word[a:b] in pieces:
                    reach = max(reach, b)
                b += 1
        return [word[x:y] for x, y in zip(cuts, [*cuts[1:], len(word)], strict=True)]

    def words(self, text: str) -> list[str]:
        """The text in normal form, cut before each space that follows another character, around line breaks, and long words further."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            out = self._words_with_runs(text)
        else:
            # a space before the text, and none after a line break
            lines = self.apart.split(text) if self.apart else [text]
            out = [SPACE + p for p in lines[0].split(" ")] if lines[0] else [SPACE]
            for line in lines[1:]:
                if line:
                    first, *rest = line.split(" ")
                    out.append(first)
                    out += [SPACE + p for p in rest]
            out = [w for w in out if w] if "" in out else out
        return [x for w in out for x in (self.cut(w) if len(w) > LONG else (w,))] if max(map(len, out)) > LONG else out

    def _words_with_runs(self, text: str) -> list[str]:
        # runs of spaces stay with the word that follows
        parts = (" " + text).split(" ")[1:]
        out, run = [], SPACE
        for p in parts:
            if p:
                out.append(run + p)
                run = SPACE
            else:
                run += SPACE
        if len(run) > 1:
            out.append(run[1:])
        return [x for w in out for x in self.apart.split(w) if x] if self.apart else out

    def others(self, word: str) -> list[Path]:
        """A word's n best with the one in the memo first."""
        got = self.more.get(word)
        if got is None or got[0][1] != self.memo[word][0]:
            best = self.memo[word][0]
            got = [(self.memo[word][1], best), *[p for p in self.nbest(word) if p[1] != best]][: self.n]
            if len(self.more) > CACHE_WORDS // 8:
                self.more.clear()
            self.more[word] = got
        return got

    def learn(self, texts: list[list[str]]) -> None:
        """Finds the best segmentations of all words that are new."""
        if len(self.memo) > CACHE_WORDS:  # long words are rare: short ones stay
            self.memo = {w: x for w, x in self.memo.items() if len(w) <= 9}
            if len(self.memo) > CACHE_WORDS // 2:
                self.memo.clear()
            self.more.clear()
        self.best_many(list(set().union(*texts).difference(self.memo)))

    def encode(self, text: str | None, words: list[str] | None = None) -> tuple[tuple, list[tuple[float, dict[int, bytes]]]]:
        """Each word's best ids, and the text's n best as (score, {word number: ids where not the best}).

        ``words``: of the text, if they are learnt already.
        """
        if words is None:
            words = self.words(text or "")
            self.learn([words])
        memo = self.memo
        lists, scores, losses = zip(*[memo[w] for w in words], strict=True) if words else ((), (), ())
        total = sum(scores)
        # the n - 1 words that lose least by their second best, and their further ranks, hold all that the n best can differ in
        order = self._least(losses)
        ranks = {k: self.others(words[k]) for _, k in order}
        out: list[tuple[float, dict[int, tuple[int, ...]]]] = []
        heap: list[tuple] = [(0.0, (), -1)]
        while heap and len(out) < self.n:
            loss, picks, last = heapq.heappop(heap)
            out.append((total - loss, {k: ranks[k][r][1] for k, r in picks}))
            if picks:  # the last changed word one rank further
                k, r = picks[-1]
                if r + 1 < len(ranks[k]):
                    heapq.heappush(heap, (loss + ranks[k][r][0] - ranks[k][r + 1][0], (*picks[:-1], (k, r + 1)), last))
            for at in range(last + 1, len(order)):
                k = order[at][1]
                if len(ranks[k]) > 1:
                    heapq.heappush(heap, (loss + ranks[k][0][0] - ranks[k][1][0], (*picks, (k, 1)), at))
        return lists, out

    def _least(self, losses: tuple[float, ...]) -> list[tuple[float, int]]:
        """The n - 1 least finite losses and their places; of equals the first places."""
        many = min(self.n - 1, len(losses))
        if many < 1:
            return []
        x = np.array(losses)
        near = np.flatnonzero(x <= np.partition(x, many - 1)[many - 1])
        return [(d, k) for d, k in sorted(zip(x[near].tolist(), near.tolist(), strict=True))[:many] if d < float("inf")]

    def ids(self, lists: tuple, picks: dict[int, bytes]) -> bytes:
        """The piece ids of one of the n best, as little-endian 32-bit integers."""
        parts = list(lists)
        for k, x in picks.items():
            parts[k] = x
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        names, skip = self.names, self.skip
        numbers = array("i", ids)
        if not skip.isdisjoint(numbers):
            numbers = [i for i in numbers if i not in skip]
        text = b"".join([names[i] for i in numbers]).decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, n: int = NBEST, with_ids: bool = False) -> DataFrame:
    """Per row: id, n_pieces, score, sha256 of the best ids, ``nbest`` (score, n_pieces, sha256 of each), ``decoded`` (whether decoding gives the text back), and ``ids``.

    sha256 is over the ids as little-endian 32-bit integers. The vocabulary (bounded by the model) is broadcast.
    """
    small_batches(docs.sparkSession)
    vocab = docs.sparkSession.sparkContext.broadcast(load(model))
    schema = "id string, n_pieces long, score double, sha256 string, nbest array<struct<score:double,n_pieces:long,sha256:string>>, decoded boolean" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = Segmenter(vocab.value, n)
        for pdf in batches:
            for lo in range(0, len(pdf), 250):
                rows = []
                texts = [t if isinstance(t, str) else "" for t in pdf.text[lo : lo + 250]]
                split = [seg.words(t) for t in texts]
                seg.learn(split)
                for i, t, words in zip(pdf.id[lo : lo + 250], texts, split, strict=True):
                    lists, found = seg.encode(t, words)
                    best, each = None, []
                    for score, picks in found:
                        ids = seg.ids(lists, picks)
                        best = ids if best is None else best
                        each.append({"score": score, "n_pieces": len(ids) // 4, "sha256": hashlib.sha256(ids).hexdigest()})
                    row = [i, each[0]["n_pieces"], each[0]["score"], each[0]["sha256"], each, seg.decode(best) == t.replace(SPACE, " ")]
                    rows.append([*row, np.frombuffer(best, "<i4")] if with_ids else row)
                yield pd.DataFrame(rows, columns=["id", "n_pieces", "score", "sha256", "nbest", "decoded", *(["ids"] if with_ids else [])])

    got = docs.select(as_text(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
    return typed_id(got, docs, id_col)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, score, sha256, the n best segmentations' digests, and whether decoding gives the text back, of every document."""
    return encode_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_pieces": op2_pieces}
ORACLES: dict[str, str] = {}

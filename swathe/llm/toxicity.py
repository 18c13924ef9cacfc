"""Toxicity scores from a learned lexicon, matched with Levenshtein automata.

The lexicon (words and word stems that mark toxic documents) is learned from a bounded sample of labelled rows.
Its trie is intersected with the Levenshtein automata of its terms: a state is the set of
(trie node, edits) pairs still within the budget, made deterministic step by step as words need it, so a word is
read once, whatever the size of the lexicon, and most words leave the automaton after a few letters. A distinct word is read once
in a task while the bounded memory of words holds it. Around each match a window of words tells a quotation (quotation marks, reporting words) from
direct use. A logistic model over exact, misspelled and quoted matches gives the score.

Defined cases: null and empty texts have the score of a text without a match. Repeated rows each give a row; a null
doc_id is kept and not held out. With no labelled rows, or labels of one class only, the lexicon is empty and every score is the
smoothed share of toxic labels. Labels that are null are not used; of repeated labels of a document the largest counts, and of repeated texts of one id the first by hash is learnt from. Empty
input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_text, materialize, small_batches, table, typed_id

SAMPLE_ROWS, SAMPLE_BYTES = 6000, 256 << 20
WORD = re.compile(r"[^\W\d_]+(?:[*@$!0-9'][^\W\d_]+)*")
QUOTES = frozenset("\"“”„«»‹›‘’")
REPORTED = frozenset("said says say called quote quoted quotes wrote word term writes reported sagte wort zitat dit disait mot citation dijo palabra cita".split())
WINDOW = 6
CACHE_WORDS = 500_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Lexicon:
    """The product of a trie of terms and their Levenshtein automata, as a lazily built deterministic automaton.

    terms: term to weight; a term that ends with ``*`` is a stem and matches any word that begins with it.
    A term of fewer than four letters and a stem of fewer than ``least`` allow no edit; a stem, a term of fewer than twice ``least`` letters or one of far less
    weight than the weightiest allows one, else two. Two neighbouring letters that changed places are one edit. The last letter of a stem is never an edited one.
    """

    def __init__(self, terms: dict[str, float], least: int = 5) -> None:
        strong = max(terms.values(), default=0) - 1.5
        self.terms = sorted(terms)
        self.weights = [terms[t] for t in self.terms]
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most: list[int] = [0]  # the largest edit budget of the terms below a node
        self.budget: list[int] = []
        for i, term in enumerate(self.terms):
            stem = term.rstrip("*")
            allowed = 0 if len(stem) < (least if term.endswith("*") else least - 1) else 1 if term.endswith("*") or len(stem) < 2 * least or terms[term] < strong else 2
            self.budget.append(allowed)
            node = 0
            self.most[0] = max(self.most[0], allowed)
            for c in stem:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node].append(i)
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.next: list[dict[str, tuple[int, tuple[int, int] | None]]] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0}, {})
        self.memo: dict[str, tuple[int, int] | None] = {}

    def _state(self, pairs: dict[int, int], swapped: dict[tuple[int, str], int]) -> int:
        # letters of the term that the word lacks
        todo = list(pairs)
        while todo:
            n = todo.pop()
            for m in self.child[n].values():
                e = pairs[n] + 1
                if e <= self.most[m] and e < pairs.get(m, 9):
                    pairs[m] = e
                    todo.append(m)
        key = tuple(sorted(pairs.items())), tuple(sorted(swapped.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            whole = [(e, i) for n, e in key[0] for i in self.ends[n] if e <= self.budget[i] and not self.terms[i].endswith("*")]
            self.found.append(min(whole, default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> tuple[int, tuple[int, int] | None]:
        """The next state, and the nearest stem that ends with this letter."""
        pairs: dict[int, int] = {}
        swapped: dict[tuple[int, str], int] = {}  # (node after two letters, the second one to come)
        stems: list[tuple[int, int]] = []

        def put(n: int, e: int) -> None:
            if e <= self.most[n] and e < pairs.get(n, 9):
                pairs[n] = e

        def end(n: int, e: int) -> None:
            stems.extend((e, i) for i in self.ends[n] if e <= self.budget[i] and self.terms[i].endswith("*"))

        known, halves = self.sets[state]
        for n, e in known:
            put(n, e + 1)  # a letter too many
            for d, m in self.child[n].items():
                put(m, e + (d != c))
                if d == c:
                    end(m, e)
                elif (to := self.child[m].get(c)) is not None and e + 1 <= self.most[to]:
                    swapped[to, d] = min(e + 1, swapped.get((to, d), 9))
        for (n, d), e in halves:
            if d == c:
                put(n, e)
                end(n, e)
        out = self._state(pairs, swapped) if pairs or swapped else -1
        self.next[state][c] = out, min(stems, default=None)
        return self.next[state][c]

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term, or None."""
        state, stem = self.start, None
        for c in word:
            state, hit = s if (s := self.next[state].get(c)) is not None else self._step(state, c)
            if hit and (stem is None or hit < stem):
                stem = hit
            if state < 0:
                return stem
        return min((x for x in (self.found[state], stem) if x), default=None)

    def lookup(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """The words that match, of a set; each word is read once until the memory of words is full."""
        memo = self.memo
        if len(memo) > CACHE_WORDS:
            memo.clear()
        for w in words.difference(memo):
            memo[w] = self.match(w)
        return {w: m for w in words if (m := memo[w])}


def learn_terms(texts: list[str], toxic: list[int], least: int = 6) -> tuple[dict[str, float], Counter]:
    """Terms with weights (smoothed log odds), and in how many clean texts each word stands.

    Texts that share most of their words with an earlier one of their class count once, so that copies don't make their words terms.
    Stems are as long as they can be without losing texts.
    """
    bags = [set(words_of(t)) for t in texts]
    seen: dict[int, dict[str, int]] = {0: {}, 1: {}}
    kept = []
    for k, (bag, y) in enumerate(zip(bags, toxic, strict=True)):
        rare = sorted(bag, key=lambda w: (len(w), w))[-40:]
        old = Counter(seen[y][w] for w in rare if w in seen[y])
        if bag and not (old and old.most_common(1)[0][1] > 0.4 * len(rare)):
            kept.append(k)
            for w in rare:
                seen[y].setdefault(w, k)
    yes, no = Counter(), Counter()
    pos, neg = sum(toxic[k] for k in kept), sum(1 - toxic[k] for k in kept)
    clean: Counter = Counter()
    for k in kept:
        into = yes if toxic[k] else no
        into.update({w[:n] + "*" for w in bags[k] for n in range(4, min(len(w), 10) + 1)} | bags[k])
        if not toxic[k]:
            clean.update(bags[k])
    if not pos or not neg:
        return {}, clean

    def odds(t: str) -> float:
        return math.log((yes[t] + 0.5) / (pos + 1)) - math.log((no[t] + 0.5) / (neg + 1))

    good = {t for t, n in yes.items() if n >= max(least, 0.01 * pos) and no[t] <= 0.3 * n and odds(t) > 2}
    out: dict[str, float] = {}
    for t in sorted(good):
        if not t.endswith("*"):
            if yes[t] >= 0.9 * yes.get(t[: min(len(t), 10)] + "*", 0):
                out[t] = odds(t)
            continue
        stem = t[:-1]
        longer = max((yes[t2] for t2 in (x for x in good if x.endswith("*") and len(x) == len(t) + 1 and x.startswith(stem))), default=0)
        if longer < 0.9 * yes[t] and (stem not in good or yes[stem] < 0.9 * yes[t]):
            out[t] = odds(t)
    # a stem below another stem adds nothing
    stems = {t[:-1] for t in out if t.endswith("*")}
    return {t: w for t, w in out.items() if not any(t.rstrip("*")[:n] in stems for n in range(4, len(t.rstrip("*")) + (not t.endswith("*"))))}, clean


def features(text: str, lexicon: Lexicon, clean: dict[str, int]) -> list[float]:
    """Exact, misspelled and quoted evidence, each as a weight sum that levels off, and the strongest direct one.

    ``clean``: words known from clean texts; such a word is no misspelling.
    """
    low = text.lower()
    hits = lexicon.lookup(set(WORD.findall(low)))
    hits = {w: m for w, m in hits.items() if not (m[0] and w in clean)}
    exact = fuzzy = quoted = top = 0.0
    if hits:
        tokens = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
        for k, (w, a, b) in enumerate(tokens):
            if w not in hits:
                continue
            edits, term = hits[w]
            weight = lexicon.weights[term] / (1 + edits)
            lo, hi = max(0, k - WINDOW), min(len(tokens), k + WINDOW + 1)
            before, after = low[tokens[lo][1] : a], low[b : tokens[hi - 1][2] + 2]
            marks = sum(c in QUOTES for c in before) % 2 == 1 and any(c in QUOTES for c in after)
            if marks or any(t in REPORTED for t, _, _ in tokens[lo:k]):
                quoted += weight
            elif edits:
                fuzzy += weight
            else:
                exact += weight
                top = max(top, weight)
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), top / 4]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Logistic weights by Newton steps, the bias last; matches of any kind never lower the score."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.append(np.full(len(w) - 1, ridge), 1e-6)

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() + 0.5 * (penalty * v * v).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-4:
            to = w - size * step
            to[:-1] = np.maximum(to[:-1], 0)
            if (then := loss(to)) < now:
                break
            size /= 2
        else:
            break
        w, now, gain = to, then, now - then
        if gain < 1e-7:
            break
    return w


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[dict[str, float], dict[str, int], list[float]]:
    """Terms, known clean words and logistic weights, from ``sample_rows`` labelled rows and ``sample_bytes`` bytes of text at most.

    The rows are those with the smallest hashes of their ids, held-out ones left out, up to the one with which their texts pass the bytes; this sample alone comes to the driver.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # of the texts of one id the first by hash, whatever their order
    one = materialize(found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("m")).select("doc_id", "toxic", "m.text"))
    # in the order of the sample, as many as the bytes allow
    sized = one.select("doc_id", F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("upto"))
    rows = one.join(F.broadcast(sized.filter(F.col("upto") <= sample_bytes).select("doc_id")), "doc_id").orderBy("doc_id").toPandas()
    texts, y = rows.text.tolist(), [int(t > 0) for t in rows.toxic]
    terms, clean = learn_terms(texts, y)
    lexicon = Lexicon(terms)
    near = {w: n for w, n in clean.items() if (m := lexicon.match(w)) and m[0]}
    if not texts:
        return {}, {}, [0.0, 0.0, 0.0, 0.0, 0.0]
    weights = fit(np.array([features(t, lexicon, near) for t in texts]), np.array(y))
    # misspelled and quoted matches are rare in samples: what they lack of evidence they take from exact ones
    weights[1] = max(weights[1], 0.5 * weights[0])
    return terms, near, weights.tolist()


def score(docs: DataFrame, model: tuple[dict[str, float], dict[str, int], list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, matches) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, clean, weights = model
        lexicon = Lexicon(terms)
        w = np.array(weights)
        for pdf in batches:
            x = np.array([features(t if isinstance(t, str) else "", lexicon, clean) for t in pdf.text]).reshape(-1, len(w) - 1)
            z = np.clip(x @ w[:-1] + w[-1], -30, 30)
            yield pd.DataFrame({"id": pdf.id, "score": 1 / (1 + np.exp(-z)), "quoted": x[:, 2] > 0, "misspelled": x[:, 1] > 0})

    got = docs.select(as_text(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, score double, quoted boolean, misspelled boolean")
    return typed_id(got, docs, id_col)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    got = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return got.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "quoted", "misspelled")


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}

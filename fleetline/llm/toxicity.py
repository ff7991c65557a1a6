"""Toxicity from the nearest labelled examples.

A term vocabulary is chosen on a bounded sample of labelled rows: words and
word beginnings that toxic examples use more than others.  Every other word is
one background term, so that a vector also shows how dense the chosen terms
are, and every chosen term also feeds one shared term.  Document frequencies
are counted over all documents.

The index holds the sample's TF-IDF vectors, equal vectors merged, as an
inverted index cut into blocks with the largest weight of each term per block.
A query adds these block maxima up to bounds, visits the blocks by falling
bound and stops when no block left can enter its nearest ``NEIGHBOURS``: the
cosines found are exact.  Neighbours vote with their labels, nearer ones more,
and a logistic curve fitted on the sample's leave-one-out votes turns the vote
into a probability.  ``evidence`` lists the nearest examples.

Bounds: the sample has at most ``SAMPLE`` rows, the vocabulary ``TERMS`` terms;
both are broadcast.  All documents are counted, indexed terms are looked up and
every document is scored in narrow passes.

Defined results: texts without a word (null, empty) score the share of toxic
examples; labels without a document or with a null are not used; repeated
labels of one document count once (toxic if any says so); equal rows are scored
each; without any labels every score is 0; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, kept_columns, taken, with_kept

SAMPLE = 12_000
TERMS = 512
NEIGHBOURS = 32
BLOCK = 64
FOLDS = 5
MIN_SUPPORT = 3
TF_CAP = 5

_WORD = re.compile(r"[^\W_]+")
CACHED_WORDS = 300_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def term_forms(word: str) -> list[str]:
    """The word itself and its beginnings (marked with a star), long ones first."""
    return [word, *(word[:n] + "*" for n in range(min(8, len(word)), 3, -1))]


class TermOf(dict):
    """Number of a word's chosen term, 0 for the background."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = out = next((self.vocabulary[t] for t in term_forms(word) if t in self.vocabulary), 0)
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """At most ``size`` labelled documents ``(doc_id, text, toxic)``, spread by a hash."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # at most ``size`` ids: the documents themselves are not shuffled
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).alias("toxic"))


def choose_terms(sample: DataFrame, most: int) -> list[str]:
    """Terms whose use tells toxic examples apart (log-likelihood ratio of
    capped counts); of nested beginnings only the best one stays."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Counter(), Counter(), Counter()]
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = Counter(_WORD.findall((text or "").lower()))
                forms: Counter = Counter()
                for w, n in words.items():
                    for t in term_forms(w):
                        forms[t] += n
                uses = {t: min(n, TF_CAP) for t, n in forms.items()}
                tables[0 if toxic else 1].update(uses)
                if toxic:
                    tables[2].update(uses.keys())
        terms = list(tables[0].keys() | tables[1].keys())
        cols = [pa.array([t[x] for x in terms], pa.int64()) for t in tables]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *cols], ["term", "toxic", "clean", "docs"])

    c = sample.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long, docs long") \
        .groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"), F.sum("docs").alias("docs"))
    size = sample.agg(F.sum(F.col("toxic").cast("long")).alias("p"), F.count("*").alias("n")).first()
    p, n = size["p"] or 0, size["n"]
    if not p or p == n:
        return []
    # expected uses if toxic and clean examples used the term alike
    ea, eb = (F.col("a") + F.col("b")) * p / n, (F.col("a") + F.col("b")) * (n - p) / n
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    c = c.where((F.col("docs") >= MIN_SUPPORT) & (F.col("a") > 3 * ea)).withColumn(
        "gain", F.round(2 * (part(F.col("a"), ea) + part(F.col("b"), eb)), 6))
    ranked = c.where("gain > 15").orderBy(F.desc("gain"), F.length("term"), "term").limit(8 * most).collect()
    chosen: list[str] = []
    for r in ranked:  # at most 8 * most rows
        root = r["term"].rstrip("*")
        if not any(root.startswith(x.rstrip("*")) or x.rstrip("*").startswith(root) for x in chosen):
            chosen.append(r["term"])
    return chosen[:most]


VECTORS = "doc_id long, text_id long, terms array<int>, uses array<int>, words long"


def text_terms(text: str | None, term: TermOf) -> tuple[list[int], list[int], int]:
    """Chosen terms of a whole text, their uses, and the number of its words."""
    c = Counter([term[w] for w in _WORD.findall((text or "").lower())])
    words = sum(c.values())
    c.pop(0, None)
    keys = sorted(c)
    return keys, [c[k] for k in keys], words


def term_vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Chosen terms of every whole text with their uses, and its word count."""
    numbers = {t: i + 1 for i, t in enumerate(vocabulary)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = TermOf(numbers)
        for b in batches:
            got = [text_terms(t.as_py(), term) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([g[0] for g in got], pa.list_(pa.int32())),
                pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.int64())],
                ["doc_id", "text_id", "terms", "uses", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text") \
        .mapInArrow(vectors, VECTORS)


class BlockMaxIndex:
    """TF-IDF vectors as postings in blocks, with the largest weight of each
    term per block.  Term 0 is the background, the last one is shared."""

    def __init__(self, idf: np.ndarray, rows: list[tuple]):
        self.idf = idf
        merged: dict[tuple, list] = {}
        for terms, uses, words, toxic, doc_id in rows:
            keys, weights = self.vector(terms, uses, words)
            key = (tuple(keys), tuple(np.round(weights, 6)))
            e = merged.setdefault(key, [keys, weights, 0, 0, doc_id])
            e[2] += 1
            e[3] += int(toxic)
            e[4] = min(e[4], doc_id)
        # like vectors share a block: by leading chosen term, then by its weight
        lead = lambda e: (int(e[0][1]) if len(e[0]) > 1 else 0, float(e[1][0]))
        entries = sorted(merged.values(), key=lambda e: (*lead(e), [int(x) for x in e[0]], [float(x) for x in e[1]]))
        self.n = np.array([e[2] for e in entries], float)
        self.toxic = np.array([e[3] for e in entries], float)
        self.docs = [e[4] for e in entries]
        self.blocks = -(-len(entries) // BLOCK)
        self.weights = np.zeros((self.blocks, len(idf), BLOCK), np.float32)
        for i, (keys, weights, *_rest) in enumerate(entries):
            self.weights[i // BLOCK, keys, i % BLOCK] = weights
        self.most = self.weights.max(axis=2).T.copy() if entries else np.zeros((len(idf), 0), np.float32)

    def vector(self, terms, uses, words) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector: sorted term numbers and weights."""
        terms, uses = np.asarray(terms, np.int64), np.asarray(uses, float)
        found = uses.sum()
        keys = np.r_[0, terms, len(self.idf) - 1] if len(terms) else np.array([0])
        counts = np.r_[max(words - found, 0.0), uses, found] if len(terms) else np.array([float(words)])
        w = counts * self.idf[keys]
        size = np.sqrt((w * w).sum())
        return keys, (w / size if size else w)

    def nearest(self, keys: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and exact cosines of the ``k`` nearest, ties by entry."""
        q = weights.astype(np.float32)
        bounds = q @ self.most[keys]
        best_i, best_s = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bounds, kind="stable"):
            if len(best_s) >= k and bounds[b] < best_s[k - 1] - 1e-6:
                break
            here = (q @ self.weights[b, keys]).astype(float)
            ids = b * BLOCK + np.arange(BLOCK)
            real = ids < len(self.n)
            best_i, best_s = np.r_[best_i, ids[real]], np.r_[best_s, here[real]]
            order = np.lexsort((best_i, -best_s))[:k]
            best_i, best_s = best_i[order], best_s[order]
        return best_i, best_s

    def vote(self, terms, uses, words, k: int, without: bool | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Weighted share of toxic labels among the neighbours.  ``without``
        leaves one example of that label out of an equal vector's counts."""
        keys, weights = self.vector(terms, uses, words)
        ids, cos = self.nearest(keys, weights, k)
        if not len(ids):
            return 0.0, ids, cos
        near = 1 / (0.02 + np.sqrt(np.maximum(0, 2 - 2 * np.minimum(cos, 1))))
        n, toxic = self.n[ids].copy(), self.toxic[ids].copy()
        if without is not None:
            own = int(np.argmax(cos)) if cos.max() > 1 - 1e-6 else -1
            if own >= 0 and toxic[own] >= without and n[own] - toxic[own] >= (not without):
                n[own] -= 1
                toxic[own] -= without
        rate = self.toxic.sum() / max(self.n.sum(), 1)
        # many equal examples speak louder, but not in proportion
        loud = np.where(n > 0, np.sqrt(n) / np.maximum(n, 1), 0)
        return float((rate + (near * loud * toxic).sum()) / (1 + (near * loud * n).sum())), ids, cos


def fit_curve(votes: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over the votes' log-odds."""
    x = np.log((votes + 1e-4) / (1 - votes + 1e-4))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((toxic - p) * x).sum() - 0.1 * (a - 1), (toxic - p).sum() - 0.1 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(a + step[0], 0.05), b + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


SCORES = "score double, evidence array<struct<doc_id:long,cosine:double>>"


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, terms: int = TERMS,
                   neighbours: int = NEIGHBOURS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(doc_id, score, evidence)`` for every document, learnt from the
    given labels only; with ``keep``, these columns instead of doc_id."""
    whole, docs = docs, docs.select("doc_id", "text")
    sample = checkpointed(labelled_sample(docs, labels.select("doc_id", "toxic"), sample_size))
    vocabulary = choose_terms(sample, terms)
    vectors = checkpointed(term_vectors(docs, vocabulary))
    counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # a row per chosen term
    n_docs = vectors.count()
    df = np.zeros(len(vocabulary) + 2)
    for r in counted:
        df[r["t"]] = r["count"]
    df[0], df[-1] = n_docs, n_docs
    idf = np.log((1 + n_docs) / (1 + df)) + 0.05
    idf[-1] = idf[1:-1].mean() if vocabulary else 0.0
    learnt = term_vectors(sample, vocabulary).join(
        F.broadcast(sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "toxic")),
        ["doc_id", "text_id"]).distinct().collect()  # at most ``sample_size`` rows
    rows = sorted((r["terms"], r["uses"], r["words"], r["toxic"], r["doc_id"]) for r in learnt)
    index = BlockMaxIndex(idf, rows)
    votes = np.array([index.vote(t, u, w, neighbours, without=y)[0] for t, u, w, y, _ in rows])
    toxic = np.array([float(r[3]) for r in rows])
    a, b = fit_curve(votes, toxic) if len(rows) else (1.0, 0.0)
    held = docs.sparkSession.sparkContext.broadcast(index)

    numbers = {t: i + 1 for i, t in enumerate(vocabulary)}

    def probability(terms: list, uses: list, words: int) -> tuple[float, list]:
        ix = held.value
        if not len(ix.n):
            return 0.0, []
        if not words:  # no neighbour is nearer than another
            return float(ix.toxic.sum() / max(ix.n.sum(), 1)), []
        v, ids, cos = ix.vote(terms, uses, words, neighbours)
        s = 1 / (1 + np.exp(-(a * np.log((v + 1e-4) / (1 - v + 1e-4)) + b)))
        return float(s), [{"doc_id": ix.docs[i], "cosine": round(float(c), 6)} for i, c in zip(ids[:3], cos[:3], strict=True)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, term = None, TermOf(numbers)
        for batch in batches:
            scores, evidence = [], []
            # texts that go on have their terms found here; otherwise they are in the vectors
            rows = (text_terms(t.as_py(), term) for t in batch.column(0)) if keep else \
                zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
            for t, u, w in rows:
                if not t and w:  # texts of background words alone have one vector
                    plain = plain or probability(t, u, w)
                    s, e = plain
                else:
                    s, e = probability(t, u, w)
                scores.append(s)
                evidence.append(e)
            cols = [pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])))]
            if keep:
                yield pa.RecordBatch.from_arrays([*cols, batch.column(1), *([batch.column(0)] if "text" in keep else [])],
                                                 ["score", "evidence", "kept"] + ["text"] * ("text" in keep))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "score", "evidence"])

    if not keep:
        return vectors.select("doc_id", "terms", "uses", "words").mapInArrow(score, f"doc_id long, {SCORES}")
    asked = whole.select("text", kept_columns(whole, keep))
    return asked.mapInArrow(score, with_kept(SCORES, asked, keep)).select(*taken(keep), "score", "evidence")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(~held_out(F.col("doc_id")))

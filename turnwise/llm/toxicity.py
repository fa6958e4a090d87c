"""Operator 10. Toxicity by the nearest labelled examples.

A bounded, hash-ordered sample of labelled rows (``MAX_EXAMPLES``) gives the examples. Terms are lower-cased words and word
beginnings of four to six letters; the vocabulary holds all terms that stand in a larger share of the toxic examples than of
the others and whose presence depends on the label (G-squared). Their document frequencies are counted over the whole corpus. Examples lie in an
inverted index, ordered by their number of terms, with blocks of 64 examples and the largest weight of each term in each
block; a query scores only blocks that by these bounds can still reach its top ``NEIGHBOURS`` by TF-IDF cosine. Postings of
frequent terms lie in a dense single-precision matrix of bounded size, so a group of queries scores a span of blocks by one
product; whatever is within the rounding error of the top is then computed in double precision, so the top is exact. The
neighbours' labels, weighted by squared cosine, give a vote; a logistic curve fitted on leave-one-out votes of the examples
turns it into a score. The neighbours and cosines are the evidence. Index and vocabulary are bounded by the examples, so
they are broadcast; scoring is one pass over the corpus without a shuffle.

Defined results: a score depends on the text alone; null and empty texts, and texts without a term of the vocabulary,
get the score of an empty vote; a null id counts as held out; repeated rows give repeated results; of several labels of
one id the largest holds; null labels are ignored; without examples of both classes every score is the share of toxic
examples (a half more of two more: below 0.5 without any example). Columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import columns, scratch, short_batches, tidied, written

MAX_EXAMPLES = 30_000
NEIGHBOURS = 15
BLOCK = 64
#: Blocks and queries of one product.
SPAN, GROUP = 32, 64
#: Bytes of the matrix of frequent terms at most; a term is frequent if it is in one example of so many.
MATRIX_BYTES, FREQUENT = 64 << 20, 16
#: Pieces of more characters are not remembered.
LONG_PIECE = 64
#: A term must depend on the label by so much.
LEAST_G2 = 15.0
#: The vote of an empty neighbourhood weighs as much as a neighbour at cosine 0.3.
PRIOR = 0.09

_WORD = re.compile(r"[^\W_]+")


def terms_of(word: str) -> tuple[str, ...]:
    return (word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n))


def held_out(id_col: str) -> Column:
    """Whether a row is kept out of training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def pieces_of(text: str | None) -> list[str]:
    """Lower-cased text between white space; no word runs over it."""
    return text.lower().split() if text else []


class TermCounter:
    """Occurrences of vocabulary terms in texts; what a piece between white space stands for is looked up once per task."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary, self.known = vocabulary, {}
        self.heads = {t[1:5] for t in vocabulary if t[0] == "^"}

    def _learn(self, piece: str) -> list[int]:
        vocabulary, heads, found = self.vocabulary, self.heads, []
        for w in _WORD.findall(piece):
            if w in vocabulary or w[:4] in heads:
                found += [vocabulary[t] for t in terms_of(w) if t in vocabulary]
        if len(piece) <= LONG_PIECE:
            if len(self.known) >= 250_000:
                self.known.clear()
            self.known[piece] = tuple(found) if found else ()  # what is kept then is not traced
        return found

    def count(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        known = self.known
        for piece, n in Counter(pieces_of(text)).items():
            ids = known.get(piece)
            for i in self._learn(piece) if ids is None else ids:
                out[i] = out.get(i, 0) + n
        return out

    def present(self, text: str | None) -> list[int]:
        out: set[int] = set()
        known = self.known
        for piece in set(pieces_of(text)):
            ids = known.get(piece)
            if ids is None:
                ids = self._learn(piece)
            if ids:
                out.update(ids)
        return list(out)


@dataclass
class Layout:
    """What a worker makes of an index once: the matrix of frequent terms, its block maxima, and terms by example."""

    place: np.ndarray  # a term's row in the matrix, or -1
    matrix: np.ndarray
    peak: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    at: np.ndarray  # where an example's terms begin


@dataclass
class Index:
    """Block-max inverted index over weighted examples."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    slope: float
    offset: float
    who: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # examples of all postings, by term
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where a term's postings begin
    _made: Layout | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_made": None}

    def weigh(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + math.log(c)) * float(self.idf[t]) for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    def build(self, vectors: Iterable[dict[int, float]]) -> None:
        """Vectors are taken one by one: as dictionaries all of them are ten times as large as their postings."""
        sizes, terms, weights = array("q"), array("i"), array("d")
        for v in vectors:
            sizes.append(len(v))
            terms.extend(v)
            weights.extend(v.values())
        who = np.repeat(np.arange(len(sizes), dtype=np.int32), np.array(sizes))
        term, weight = np.array(terms), np.array(weights)
        order = np.lexsort((who, term))
        self.who, self.weight, self._made = who[order], weight[order], None
        self.at = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))

    def layout(self) -> Layout:
        if self._made is None:
            n, sizes = len(self.ids), np.diff(self.at)
            width = -(-n // BLOCK) * BLOCK
            often = np.argsort(-sizes, kind="stable")[: MATRIX_BYTES // (4 * width)]
            often = often[sizes[often] * FREQUENT >= n]
            place = np.full(len(sizes), -1)
            place[often] = np.arange(len(often))
            matrix = np.zeros((len(often), width), np.float32)
            for r, t in enumerate(often.tolist()):
                matrix[r, self.who[self.at[t] : self.at[t + 1]]] = self.weight[self.at[t] : self.at[t + 1]]
            order = np.argsort(self.who, kind="stable")
            term = np.repeat(np.arange(len(sizes)), sizes)[order]
            at = np.searchsorted(self.who[order], np.arange(n + 1))
            self._made = Layout(place, matrix, matrix.reshape(len(often), width // BLOCK, BLOCK).max(2), term, self.weight[order], at)
        return self._made

    def nearest(self, queries: list[dict[int, float]], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query the exact top k (cosine, example), best first, ties to the smaller example; only positive cosines.

        ``without`` names an example for each query that is none of its neighbours (-1: none).
        """
        if not len(self.ids) or not len(self.who):
            return [[] for _ in queries]
        out = []
        for i in range(0, len(queries), GROUP):
            group = queries[i : i + GROUP]
            out += self._nearest(group, k, np.array(without[i : i + GROUP]) if without else np.full(len(group), -1))
        return out

    def _nearest(self, queries: list[dict[int, float]], k: int, without: np.ndarray) -> list[list[tuple[float, int]]]:
        made, nq = self.layout(), len(queries)
        width = made.matrix.shape[1]
        blocks = width // BLOCK
        # what sums in single precision can be off by, for both sides of a comparison
        slack = 4 * (len(made.matrix) + 8) * 2.0**-23
        sizes = np.fromiter(map(len, queries), np.int64, nq)
        row = np.repeat(np.arange(nq), sizes)
        term = np.fromiter((t for q in queries for t in q), np.int64, len(row))
        weight = np.fromiter((w for q in queries for w in q.values()), np.float64, len(row))
        place = made.place[term]
        often = place >= 0
        frequent = np.zeros((nq, len(made.matrix)), np.float32)
        frequent[row[often], place[often]] = weight[often]
        rare = term[~often]
        size = self.at[rare + 1] - self.at[rare]
        ends = np.cumsum(size)
        i = np.repeat(self.at[rare] - ends + size, size) + np.arange(size.sum())
        scores = np.bincount(np.repeat(row[~often] * width, size) + self.who[i], np.repeat(weight[~often], size) * self.weight[i], nq * width).astype(np.float32).reshape(nq, width)
        bounds = frequent @ made.peak + scores.reshape(nq, blocks, BLOCK).max(2)
        left_out = np.flatnonzero(without >= 0)
        scores[left_out, without[left_out]] = -8.0

        # the k-th largest of the block maxima so far is a lower bound of the k-th best
        best, floor = np.zeros((nq, blocks), np.float32), np.zeros(nq, np.float32)
        starts = np.arange(0, blocks, SPAN)
        reach = np.maximum.reduceat(bounds, starts, axis=1)
        for s in np.argsort(-reach.sum(0), kind="stable").tolist():
            a, b = s * SPAN, min(blocks, (s + 1) * SPAN)
            able = reach[:, s] + slack >= floor
            scores[~able, a * BLOCK : b * BLOCK] = 0.0
            rows = np.flatnonzero(able)
            if len(rows):
                here = scores[rows, a * BLOCK : b * BLOCK] + frequent[rows] @ made.matrix[:, a * BLOCK : b * BLOCK]
                scores[rows, a * BLOCK : b * BLOCK] = here
                best[rows, a:b] = here.reshape(len(rows), b - a, BLOCK).max(2)
                if blocks >= k:
                    floor = np.maximum(np.partition(best, blocks - k, axis=1)[:, blocks - k], 0.0)

        out, dense, begin = [], np.zeros(len(self.vocabulary)), np.concatenate([[0], np.cumsum(sizes)])
        for r in range(nq):
            mine = scores[r]
            found = np.flatnonzero(mine >= floor[r] - slack) if floor[r] > slack else np.flatnonzero(mine > 0)
            if len(found) > k:
                found = found[mine[found] >= np.partition(mine[found], -k)[-k] - slack]
            found = found[mine[found] > 0]
            mark = slice(begin[r], begin[r + 1])
            dense[term[mark]] = weight[mark]
            size = made.at[found + 1] - made.at[found]
            ends = np.cumsum(size)
            i = np.repeat(made.at[found] - ends + size, size) + np.arange(size.sum())
            exact = np.bincount(np.repeat(np.arange(len(found)), size), dense[made.term[i]] * made.weight[i], len(found))
            dense[term[mark]] = 0.0
            order = np.lexsort((found, -exact))[:k]
            out.append(list(zip(exact[order].tolist(), found[order].tolist(), strict=True)))
        return out

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = PRIOR + sum(s * s for s, _ in near)
        return sum(s * s * float(self.labels[i]) for s, i in near) / total

    def score(self, vote: float) -> float:
        z = self.slope * vote + self.offset
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _g2(n1: np.ndarray, n0: np.ndarray, t1: float, t0: float) -> np.ndarray:
    """The log-likelihood ratio of presence against label."""
    total = t1 + t0

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    n = n1 + n0
    return 2 * (part(n1, n * t1 / total) + part(n0, n * t0 / total) + part(t1 - n1, (total - n) * t1 / total) + part(t0 - n0, (total - n) * t0 / total))


def _calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's steps with a slight ridge; the slope is never negative."""
    x = np.stack([votes, np.ones_like(votes)], 1)
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] >= 0 else (0.0, float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES) -> Index:
    """The index of a bounded sample of labelled rows that are not held out; document frequencies are of the whole corpus."""
    spark = docs.sparkSession
    short_batches(spark)
    texts = columns(docs, id_col, text_col)
    chosen = columns(labels, id_col, label_col).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = chosen.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y")).orderBy(F.xxhash64(id_col), id_col).limit(max_examples)
    # repeated rows and exact copies among the examples count once
    examples = texts.join(F.broadcast(chosen), id_col).where(F.length(text_col) > 0).groupBy(F.col(text_col).alias("_t")).agg(F.min(id_col).alias("_id"), F.max("_y").alias("_y"))
    path = scratch(spark, "examples")  # bounded; small files, so that all cores read them
    examples.select("_t", "_y", "_id").write.option("maxRecordsPerFile", 1000).parquet(path)
    examples = spark.read.schema(examples.select("_t", "_y", "_id").schema).parquet(path)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = {}
        totals = [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals[y > 0] += 1
                for t in {t for piece in set(pieces_of(text)) for w in _WORD.findall(piece) for t in terms_of(w)}:
                    n.setdefault(t, [0, 0])[y > 0] += 1
        n[""] = totals
        yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array([v[1] for v in n.values()], pa.int64()), pa.array([v[0] for v in n.values()], pa.int64())], names=["term", "n1", "n0"])

    counted = written(examples.select("_t", "_y").mapInArrow(tidied(presence), "term string, n1 bigint, n0 bigint").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "terms")
    t1, t0 = next(((float(r.n1), float(r.n0)) for r in counted.where("term = ''").collect()), (0.0, 0.0))
    # a term's G-squared grows with its share of toxic examples, so the least number of them that can pass bounds what is sent
    reach = np.arange(1, int(t1) + 1, dtype=float)
    passing = np.flatnonzero(_g2(reach, np.zeros_like(reach), t1, t0) >= LEAST_G2) if t1 and t0 else np.zeros(0, np.int64)
    rows = counted.where((F.col("term") != "") & (F.col("n1") > int(passing[0])) & (F.col("n1") * F.lit(t0) > F.col("n0") * F.lit(t1))).orderBy("term").collect() if len(passing) else []
    share = (t1 + 0.5) / (t1 + t0 + 2)
    empty = Index({}, np.zeros(0), np.zeros(0, np.int64), np.zeros(0), 0.0, math.log(share / (1 - share)))
    if not rows or not t0 or not t1:
        return empty
    g2 = _g2(np.array([r.n1 for r in rows], float), np.array([r.n0 for r in rows], float), t1, t0)
    vocabulary = {rows[i].term: j for j, i in enumerate(i for i in np.argsort(-g2, kind="stable").tolist() if g2[i] >= LEAST_G2)}

    def counts(vocabulary: dict[str, int], tail: int):
        """(terms, counts, then ``tail`` more columns) of the rows of a (text, ...) table that have a term."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = TermCounter(vocabulary)
            for b in batches:
                got = [counter.count(t) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([list(g) for g in got], pa.list_(pa.int32())), pa.array([list(g.values()) for g in got], pa.list_(pa.int32())), *[b.column(i + 1) for i in range(tail)]], names=["terms", "counts", "y", "id"][: 2 + tail])

        return run

    kind = dict(docs.dtypes)[id_col]
    found = examples.mapInArrow(tidied(counts(vocabulary, 2)), f"terms array<int>, counts array<int>, y int, id {kind}").toArrow()
    ids, sizes = found.column("id").to_pylist(), found.column("terms").combine_chunks().value_lengths().to_pylist()
    found = found.take(pa.array(sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i])), pa.int64()))  # examples of a block are then alike, and its bounds close

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, df, n = TermCounter(vocabulary), np.zeros(len(vocabulary) + 1, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df[counter.present(t)] += 1
                n += 1
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df)), pa.int32()), pa.array(df)], names=["t", "df"])

    df = np.zeros(len(vocabulary) + 1)
    for r in texts.select(text_col).mapInArrow(tidied(frequencies), "t int, df bigint").groupBy("t").agg(F.sum("df").alias("df")).collect():
        df[r.t] = r.df
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1
    index = Index(vocabulary, idf, np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0)
    ids, marks = [], []

    def vectors() -> Iterator[dict[int, float]]:
        for b in found.to_batches():
            for terms, n, y, x in zip(*b.columns, strict=True):
                if v := index.weigh(dict(zip(terms.as_py(), n.as_py(), strict=True))):
                    ids.append(x.as_py())
                    marks.append(y.as_py())
                    yield v

    index.build(vectors())
    index.ids, index.labels = np.array(ids), np.array(marks, float)
    shared = spark.sparkContext.broadcast(index)

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        counter, place = TermCounter(ix.vocabulary), {x: i for i, x in enumerate(ix.ids.tolist())}
        for b in batches:
            near = ix.nearest([ix.weigh(counter.count(t)) for t in b.column(0).to_pylist()], without=[place.get(x, -1) for x in b.column(2).to_pylist()])
            votes = [ix.vote(n) for n in near]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), b.column(1)], names=["vote", "y"])

    voted = examples.mapInArrow(tidied(leave_one_out), "vote double, y int").toArrow()
    votes, marked = voted.column("vote").to_numpy(), voted.column("y").to_numpy().astype(float)
    order = np.lexsort((marked, votes))  # sums then don't depend on the order of tasks
    index.slope, index.offset = _calibrate(votes[order], marked[order])
    return index


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, predicted, evidence, then ``carry``) per row; evidence: example:cosine:label of the nearest five."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(index)
    kind = dict(docs.dtypes)
    schema = ", ".join([f"`{id_col}` {kind[id_col]}", "score double", "predicted int", "evidence string", *[f"`{c}` {kind[c]}" for c in carry]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        counter = TermCounter(ix.vocabulary)
        for b in batches:
            near = ix.nearest([ix.weigh(counter.count(t)) for t in b.column(1).to_pylist()])
            scores = [ix.score(ix.vote(n)) for n in near]
            evidence = [",".join(f"{ix.ids[i]}:{s:.4f}:{int(ix.labels[i])}" for s, i in n[:5]) for n in near]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence), *[b.column(2 + i) for i in range(len(carry))]], names=[id_col, "score", "predicted", "evidence", *carry])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in carry]).mapInArrow(tidied(run), schema)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "evidence")

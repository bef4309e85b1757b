"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled first: features of tokens (the
word and its beginnings, in letters) that stand in labelled documents far more
often than in the others make up a lexicon. So do features that stand REPEATS
times or more in one document far more often if it is labelled: word parts that
are common everywhere and mark a document only by repetition. These are features
of a token only in documents that repeat them. A token of a labelled document
with a feature of the lexicon is a labelled token; all tokens of other documents are labelled as
clean. The field has two states, a weight for each feature of the lexicon, a
bias and transitions, fitted by Adam to the regularised log-likelihood of
segments of tokens. Forward and backward messages give each token's marginal.
A document's score is the probability that at least one of its tokens with a
feature is toxic, with their marginals taken as independent; tokens without one
have the same small marginal in every document and take no part in the score,
so that it doesn't grow with the length. Spans are runs of tokens over 1/2.

Tokens without a feature all have the same emission, so messages cross such a
run by a power of the transfer matrix. Powers are kept up to 256, where they no
longer change for transitions that are not nearly deterministic; up to there the
marginals are those of the full chain, and whole texts cost little more than
cutting them into words.

Bounds: at most TRAIN_ROWS labelled documents, chosen by a hash of doc_id, are
counted; the lexicon has LEXICON features at most; SEGMENTS segments at most
are collected for the fit. Which ones is decided by hashes, not by place in the
table: a document gives DOCUMENT_SEGMENTS with a feature and those that its
other features need, every feature of the lexicon gets its share of half of
SEGMENTS, and the rest is a sample of all segments.

Defined cases: null and empty texts have score 0 and no span; without labels of
both values every score is 0; several labels of a doc_id count as toxic if one
is; a null doc_id has no label and isn't held out; an empty table gives no rows;
a very long text gives its share of segments and is scored as a whole; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspark.llm.common import byte_texts, cut, fold, slices

TRAIN_ROWS = 20_000
LEXICON = 5_000
SEGMENTS = 20_000
#: Segments with a feature that a document gives, beside those for features that are in none of these.
DOCUMENT_SEGMENTS = 32
#: Tokens of a segment.
WIDTH = 24
#: A feature must be in LEAST labelled documents, RATIO times as often there as in others, and in so many
#: that labels dealt at random would all fall on them with a probability below CHANCE.
LEAST, RATIO, CHANCE = 3, 15.0, 1e-5
#: Letters of the beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6, 7)
#: Tokens of a document that must have a feature for it to count as repeated there.
REPEATS = 3
#: Marks a feature of the lexicon that holds only where it is repeated.
REPEATED = b"*"
#: Bytes of a word that are looked up first; no feature but a shorter word has fewer.
START = 4
STEPS, RATE, PENALTY = 200, 0.1, 1e-3
THRESHOLD = 0.7

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or 48 <= c <= 57 else 32 for c in range(256))
_TOKEN = re.compile(rb"[^ ]+")


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def features(word: bytes) -> list[bytes]:
    if word.isascii():
        return [b"=" + word, *[b"%d" % k + word[:k] for k in BEGINNINGS if len(word) > k]]
    letters = word.decode("utf-8", "replace")
    return [b"=" + word, *[b"%d" % k + letters[:k].encode() for k in BEGINNINGS if len(letters) > k]]


_COUNT = pa.schema([("feature", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64()), ("toxic_repeated", pa.int64()), ("clean_repeated", pa.int64())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled and other documents that each feature is in, and those that repeat it."""
    for batch in slices(batches, "text"):
        found: tuple[Counter, Counter] = Counter(), Counter()
        repeated: tuple[Counter, Counter] = Counter(), Counter()
        for text, y in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            times: Counter = Counter()
            for w, n in Counter(tokens(text)).items():
                for f in features(w):
                    times[f] += n
            found[y].update(times.keys())
            repeated[y].update([f for f, n in times.items() if n >= REPEATS])
        # A feature only in clean documents can't get into the lexicon by this batch, but its counts are needed.
        rows = [(f, found[1][f], found[0][f], repeated[1][f], repeated[0][f]) for f in found[1].keys() | found[0].keys()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _COUNT.types, strict=True)], schema=_COUNT) if rows else pa.RecordBatch.from_pylist([], schema=_COUNT)


class Field:
    """Weights of a two-state chain: state 1 is toxic; state 0 has no emission weight."""

    def __init__(self, lexicon: list[bytes]) -> None:
        self.index = {f: i for i, f in enumerate(lexicon)}
        # First bytes of the words that can have a feature: those of the feature's letters, which begin the word.
        self.starts = {f.removeprefix(REPEATED)[1:][:START] for f in lexicon}
        self.weights = np.zeros(len(lexicon))
        self.bias = 0.0
        self.transitions = np.zeros((2, 2))
        self.ready = False
        self._cache: dict[bytes, tuple[list[int], list[int]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}, "_powers": None}

    def known(self, word: bytes) -> list[int]:
        """Features of the lexicon that the token has wherever it stands."""
        return self._lookup(word)[0]

    def _lookup(self, word: bytes) -> tuple[list[int], list[int]]:
        """Features that the token always has, and those it has where they are repeated."""
        try:
            return self._cache[word]
        except KeyError:
            if len(self._cache) > 100_000:
                self._cache.clear()
            all_features = features(word)
            always = [i for f in all_features if (i := self.index.get(f)) is not None]
            found = self._cache[word] = always, [i for f in all_features if (i := self.index.get(REPEATED + f)) is not None]
            return found

    def found(self, words: list[bytes]) -> list[tuple[int, list[int]]]:
        """(token, features) of the tokens of a document that have a feature of the lexicon."""
        starts = self.starts
        some = [(t, *self._lookup(w)) for t, w in enumerate(words) if w[:START] in starts]
        times = Counter(i for _, _, repeated in some for i in repeated)
        held = [(t, always + [i for i in repeated if times[i] >= REPEATS]) for t, always, repeated in some]
        return [(t, fs) for t, fs in held if fs]

    def _transfer(self) -> tuple[list, tuple]:
        """Powers, scaled, of the matrix that passes a token without features; the last one is their limit."""
        if getattr(self, "_powers", None) is None:
            m = np.exp(self.transitions) * np.exp([0.0, self.bias])
            powers = [np.eye(2)]
            for _ in range(256):
                p = powers[-1] @ m
                powers.append(p / p.sum())
            self._powers = [tuple(map(float, p.ravel())) for p in powers]
        return self._powers

    def marginals(self, at: list[int], emissions: list[float], n: int) -> list[float]:
        """Probability of state 1 at the places ``at`` of a chain of n tokens."""
        powers = self._transfer()
        last = len(powers) - 1
        (a, b), (c, d) = np.exp(self.transitions).tolist()
        odds = [math.exp(min(e, 500.0)) for e in emissions]
        forward, before = [], None
        for k, (t, o) in enumerate(zip(at, odds, strict=True)):
            if before is None:
                if t == 0:
                    x, y = 1.0, 1.0
                else:
                    p = powers[min(t - 1, last)]
                    e = math.exp(self.bias)
                    x, y = p[0] + e * p[2], p[1] + e * p[3]
                    x, y = x * a + y * c, x * b + y * d
            else:
                p = powers[min(t - at[k - 1] - 1, last)]
                x, y = before
                x, y = x * p[0] + y * p[2], x * p[1] + y * p[3]
                x, y = x * a + y * c, x * b + y * d
            y *= o
            s = x + y
            before = (x / s, y / s)
            forward.append(before)
        out, after = [], None
        for k in range(len(at) - 1, -1, -1):
            if after is None:
                p = powers[min(n - 1 - at[k], last)]
                x, y = p[0] + p[1], p[2] + p[3]
            else:
                u, v = after
                v *= odds[k + 1]
                u, v = a * u + b * v, c * u + d * v
                p = powers[min(at[k + 1] - at[k] - 1, last)]
                x, y = p[0] * u + p[1] * v, p[2] * u + p[3] * v
            s = x + y
            after = (x / s, y / s)
            u, v = forward[k][0] * after[0], forward[k][1] * after[1]
            out.append(v / (u + v))
        return out[::-1]

    def tag(self, text: bytes) -> tuple[float, list[tuple[int, float]]]:
        """(score, [(token, marginal)]) of the tokens with a feature."""
        words = tokens(text)
        found = [(i, float(self.bias + self.weights[fs].sum())) for i, fs in self.found(words)]
        if not found or not self.ready:
            return 0.0, []
        p = self.marginals([i for i, _ in found], [e for _, e in found], len(words))
        clean = 1.0
        for x in p:
            clean *= 1 - x
        return 1 - clean, [(i, x) for (i, _), x in zip(found, p, strict=True)]

    def fit(self, segments: list[tuple[list[list[int]], list[int]]]) -> None:
        """Maximise the log-likelihood of segments, each with the features of its tokens and their states."""
        # Segments that are alike, as all without features of one length are, are taken once, with their number.
        alike = Counter((tuple(map(tuple, fs)), tuple(y)) for fs, y in segments)
        total, width = len(segments), WIDTH
        segments, times = list(alike), np.array(list(alike.values()), dtype=np.float64)
        s = len(segments)
        states, mask = np.zeros((s, width), np.int64), np.zeros((s, width), bool)
        row, col, feat = [], [], []
        for k, (token_features, y) in enumerate(segments):
            mask[k, : len(y)] = True
            states[k, : len(y)] = y
            for t, fs in enumerate(token_features):
                row += [k] * len(fs)
                col += [t] * len(fs)
                feat += fs
        row, col, feat = (np.array(x, dtype=np.int64) for x in (row, col, feat))
        n_w, place = len(self.weights), row * width + col
        theta = np.zeros(n_w + 1 + 4)
        theta[n_w] = -2.0
        seen = np.zeros_like(theta)
        np.add.at(seen, feat, states[row, col] * times[row])
        seen[n_w] = (states * mask * times[:, None]).sum()
        both = mask[:, 1:]
        np.add.at(seen, n_w + 1 + (2 * states[:, :-1] + states[:, 1:])[both], np.broadcast_to(times[:, None], both.shape)[both])
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            e = theta[n_w] + np.bincount(place, theta[feat], s * width).reshape(s, width)
            p, pairs = chain_marginals(e, theta[n_w + 1 :].reshape(2, 2), mask, times)
            p = p * times[:, None]
            expected = np.zeros_like(theta)
            expected[:n_w] = np.bincount(feat, p.ravel()[place], n_w)
            expected[n_w] = p[mask].sum()
            expected[n_w + 1 :] = pairs.ravel()
            gradient = (seen - expected) / total - PENALTY * theta
            m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
            theta += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        self.weights, self.bias, self.transitions, self.ready = theta[:n_w], float(theta[n_w]), theta[n_w + 1 :].reshape(2, 2), True


def chain_marginals(e: np.ndarray, transitions: np.ndarray, mask: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """State-1 marginals of each token of padded chains, and the expected number of each transition, chains counted ``times``.

    Messages are held as the share of state 1 in the place of both states, one row a token.
    """
    (a, b), (c, d) = np.exp(transitions)
    odds, inside = np.ascontiguousarray(np.exp(np.minimum(e, 50)).T), mask.T
    width, s = odds.shape
    forward, backward = np.zeros((width, s)), np.full((width, s), 0.5)
    forward[0] = odds[0] / (1 + odds[0])
    for t in range(1, width):
        f = forward[t - 1]
        x, y = a + f * (c - a), (b + f * (d - b)) * odds[t]
        forward[t] = np.where(inside[t], y / (x + y), f)
    for t in range(width - 2, -1, -1):
        v = backward[t + 1]
        u, v = 1 - v, v * odds[t + 1]
        x, y = a * u + b * v, c * u + d * v
        backward[t] = np.where(inside[t + 1], y / (x + y), 0.5)
    both = forward * backward
    p = (both / (both + (1 - forward) * (1 - backward))).T
    f, v = forward[:-1], backward[1:]
    u, v = 1 - v, v * odds[1:]
    x = np.stack([(1 - f) * a * u, (1 - f) * b * v, f * c * u, f * d * v])
    return p, (x / x.sum(0) * (1.0 if times is None else times))[:, inside[1:]].sum(1).reshape(2, 2)


_SEGMENT = pa.schema([("doc_id", pa.int64()), ("segment", pa.int64()), ("features", pa.list_(pa.list_(pa.int64()))), ("states", pa.list_(pa.int64()))])


def _plain(doc_id: int, featured: set[int], n: int) -> int | None:
    """One of the n segments that is not featured, by hash; None if there is none."""
    if len(featured) >= n:
        return None
    at = zlib.crc32(b"%d plain" % doc_id) % n
    return next(k % n for k in range(at, at + n) if k % n not in featured)


def _segments(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    """Segments with a known feature, within the document's share, and one other segment of each document."""
    for batch in slices(batches, "text"):
        rows = []
        for doc_id, text, y in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = tokens(text)
            known = dict(field.found(words))
            featured = {t // WIDTH for t in known}
            some = sorted(featured, key=lambda k: zlib.crc32(b"%d %d" % (doc_id, k)))
            plain = _plain(doc_id, featured, -(-len(words) // WIDTH))
            seen: set[int] = set()
            for n, k in enumerate([*some, *([] if plain is None else [plain])]):
                found = [known.get(t, []) for t in range(k * WIDTH, min((k + 1) * WIDTH, len(words)))]
                new = {f for fs in found for f in fs} - seen
                if n < DOCUMENT_SEGMENTS or new or k == plain:
                    seen |= new
                    rows.append({"doc_id": doc_id, "segment": k, "features": found, "states": [int(bool(y and f)) for f in found]})
        yield pa.RecordBatch.from_pylist(rows, schema=_SEGMENT)


def _chosen(segments: DataFrame, features: int) -> DataFrame:
    """SEGMENTS at most: first each feature's share by hash, then others by hash."""
    segments = cut(segments.withColumn("h", F.xxhash64("doc_id", "segment", "features")).dropDuplicates(["h"]))
    if segments.count() <= SEGMENTS:
        return segments
    share = max(1, SEGMENTS // 2 // features)
    by_feature = segments.select("h", F.explode(F.array_distinct(F.flatten("features"))).alias("f"))
    first = by_feature.withColumn("n", F.row_number().over(W.partitionBy("f").orderBy("h"))).filter(F.col("n") <= share)
    # At most SEGMENTS / 2 hashes, or one for each feature of the lexicon.
    first = first.select("h").distinct().withColumn("first", F.lit(True))
    chosen = segments.select("h").distinct().join(F.broadcast(first), "h", "left").orderBy(F.col("first").isNull(), "h").limit(SEGMENTS)
    return segments.join(F.broadcast(chosen.select("h")), "h", "left_semi")


def learn(docs: DataFrame, labels: DataFrame, label: str) -> Field:
    """Learn from the rows of docs (doc_id, text) that labels has a value for."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    if not counts.get(0) or not counts.get(1):
        return Field([])
    # Half of the sample at most for each value.
    space = 1 << 30
    share = F.when(F.col("y") == 1, min(1.0, TRAIN_ROWS / 2 / counts[1])).otherwise(min(1.0, TRAIN_ROWS / 2 / counts[0]))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < share * space)
    # About TRAIN_ROWS ids, each once; rows that repeat one stay where they are.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    size = dict(rows.groupBy("y").count().collect())
    if not size.get(0) or not size.get(1):
        return Field([])
    counted = ["toxic", "clean", "toxic_repeated", "clean_repeated"]
    found = rows.select("text", "y").mapInArrow(_counts, "feature binary, " + ", ".join(f"{c} long" for c in counted)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in counted])
    once = F.struct("feature", "toxic", "clean")
    repeated = F.struct(F.concat(F.lit(REPEATED), "feature").alias("feature"), F.col("toxic_repeated").alias("toxic"), F.col("clean_repeated").alias("clean"))
    found = found.select(F.inline(F.array(once, repeated)))
    ratio = (F.col("toxic") + 0.0) / size[1] / ((F.col("clean") + 0.5) / size[0])
    least = max(LEAST, math.ceil(math.log(CHANCE) / math.log(size[1] / (size[0] + size[1]))))
    lexicon = found.filter((F.col("toxic") >= least) & (ratio >= RATIO)).orderBy(F.desc("toxic"), "clean", "feature").limit(LEXICON)
    field = Field([bytes(r["feature"]) for r in lexicon.collect()])
    if not field.index:
        return field
    segments = rows.mapInArrow(partial(_segments, field=field), "doc_id long, segment long, features array<array<long>>, states array<long>")
    field.fit([(r["features"], r["states"]) for r in _chosen(segments, len(field.index)).collect()])
    return field


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))])


def spans(text: bytes, tagged: list[tuple[int, float]], least: float = 0.5) -> list[dict]:
    """Code point offsets of runs of tokens with marginals over ``least``."""
    wanted = {i: p for i, p in tagged if p > least}
    out: list[dict] = []
    if not wanted:
        return out
    last, chars, done = -2, 0, 0
    for i, m in enumerate(_TOKEN.finditer(text.translate(_WORD))):
        if i in wanted:
            chars += len(text[done : m.start()].decode("utf-8", "replace"))
            end = chars + len(text[m.start() : m.end()].decode("utf-8", "replace"))
            if last == i - 1:
                out[-1] = {"start": out[-1]["start"], "end": end, "p": max(out[-1]["p"], wanted[i])}
            else:
                out.append({"start": chars, "end": end, "p": wanted[i]})
            chars, done, last = end, m.end(), i
    return out


def _scores(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        scores, found = [], []
        for text in byte_texts(batch.column(1)):
            score, tagged = field.tag(text)
            scores.append(score)
            found.append(spans(text, tagged))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, _OUT.types[2])], schema=_OUT)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, threshold: float = THRESHOLD, label_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row of docs; held-out rows are not learned from. ``label_id`` names the column that labels go by."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held_out = fold(F.col("doc_id"), folds) == held
    train = labels.select(F.col("doc_id").cast("long"), label).filter(~held_out)
    field = learn(docs.select(F.col(label_id).cast("long").alias("doc_id"), F.col("text").cast("string")), train, label)
    scored = rows.mapInArrow(partial(_scores, field=field), "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")

"""Language identification by unigram pieces, summed over all segmentations.

Each language has probabilities for the pieces of a fixed public vocabulary. A word's probability is the sum over
all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. Probabilities
are estimated by expectation-maximisation over the words of a sample of at most about PER_LANGUAGE training
texts a language; predictions use whole texts. A score is the language's share among all learned ones, times how
certain the text is to be in a learned language at all: by how much its mean log probability per character exceeds that of
a background model of single letters, in parts of what the language's own training words reach. Words are lower-cased runs of letters of any length:
those of up to LONGEST are worked out together by length, longer ones, such as sentences of scripts without spaces, step by step.

The vocabulary is that of a public SentencePiece model of 32,000 pieces under the Apache licence 2.0 (SHA-256 of the file: dadfd56d…e134055);
its path is a parameter. Only its lower-case letter pieces are used, and none of its scores.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fresh, stage, unstage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PER_LANGUAGE, ROUNDS = 1000, 3
LONGEST, PIECE = 48, 16
#: Words, numbers and characters that a worker holds before it forgets them, and characters of texts that it takes at once.
CACHE, CELLS, CHARACTERS, TOGETHER = 600_000, 12_000_000, 20_000_000, 2_000_000
MARK = "▁"
#: Every character stands for a factor of e**SCALE, so that long words don't underflow.
SCALE, UNKNOWN = 3.0, 1e-7
#: A text counts as known if it gains more than FLOOR of its language's usual gain over the background.
FLOOR, STEEP, LEAST_GAIN = 0.45, 20.0, 0.05
#: The background holds no letter for rarer than RARE, so that a script nobody learned gains nothing from its vocabulary pieces.
END, RARE = "", 1 / 32
LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """Lower-case letter pieces of a SentencePiece model, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in pieces if len(p) <= PIECE and p == p.lower() and (x := p.removeprefix(MARK)) == "".join(LETTERS.findall(x)))


def words(text: str) -> list[str]:
    """Lower-cased words; runs of number signs alone, such as a superscript two, are none."""
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


class Pieces:
    """Ids of strings in the vocabulary by their 64-bit polynomial hash; two pieces with one hash would fail here."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]) -> None:
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        for k, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(self.BASE) + ord(c)) & (2**64 - 1)
            hashes[k] = h
        order = np.argsort(hashes)
        self.hashes, self.ids = np.append(hashes[order], np.uint64(2**64 - 1)), np.append(order + 2, 0).astype(np.int32)
        if len(np.unique(hashes)) != len(pieces):
            raise ValueError("two pieces have the same hash")

    def find(self, hashes: np.ndarray, otherwise: int) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        return np.where(self.hashes[at] == hashes, self.ids[at], np.int32(otherwise))


class Lattice:
    """Piece ids of all substrings of words of one length; id 0 is no piece, 1 an unknown character."""

    def __init__(self, index: Pieces, group: list[str]) -> None:
        self.n, self.edges, self.group = len(group[0]) + 1, [], group
        letters = np.array([MARK + w for w in group], dtype=f"<U{self.n}").view(np.uint32).reshape(len(group), self.n).T.astype(np.uint64)
        for i in range(self.n):
            hashes = np.zeros(len(group), dtype=np.uint64)
            for j in range(i + 1, min(self.n, i + PIECE) + 1):
                hashes = hashes * Pieces.BASE + letters[j - 1]
                ids = index.find(hashes, 1 if j == i + 1 else 0)
                if ids.any():
                    self.edges.append((i, j, ids))

    def forward(self, table: np.ndarray) -> list[np.ndarray]:
        alpha = [np.ones((len(self.edges[0][2]), table.shape[1]))] + [0.0] * self.n
        for i, j, ids in self.edges:
            alpha[j] = alpha[j] + alpha[i] * table[ids]
        return alpha

    def expected(self, table: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
        """Add the expected count of every piece, each word counting weight[word, language] times."""
        alpha = self.forward(table)
        beta = [0.0] * self.n + [weight / np.maximum(alpha[self.n], 1e-300)]
        for i, j, ids in reversed(self.edges):
            beta[i] = beta[i] + beta[j] * table[ids]
        for i, j, ids in self.edges:
            np.add.at(into, ids, alpha[i] * table[ids] * beta[j])


class Run:
    """A word of any length, swept in steps that are normalised for each language, so that nothing underflows."""

    def __init__(self, index: Pieces, word: str) -> None:
        letters = np.frombuffer((MARK + word).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        self.n = len(letters)
        self.ids = np.zeros((PIECE, self.n), dtype=np.int32)  # by length, less one, and begin
        hashes = np.zeros(self.n, dtype=np.uint64)
        for d in range(min(PIECE, self.n)):
            hashes = hashes[: self.n - d] * Pieces.BASE + letters[d:]
            self.ids[d, : self.n - d] = index.find(hashes, 0 if d else 1)

    def _sweep(self, columns: np.ndarray, table: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Log of the sum over all ways through the columns, one row of piece ids a step; kept gets it after every step."""
        window = np.zeros((PIECE, table.shape[1]))
        window[0], total = 1.0, np.zeros(table.shape[1])
        for ids in columns:
            new = (window * table[ids]).sum(axis=0)
            window[1:] = window[:-1] / new
            window[0] = 1.0
            total = total + np.log(new)
            if kept is not None:
                kept.append(total)
        return total

    def _ends(self) -> np.ndarray:
        ends = np.zeros((self.n, PIECE), dtype=np.int32)
        for d in range(min(PIECE, self.n)):
            ends[d:, d] = self.ids[d, : self.n - d]
        return ends

    def logs(self, probability: np.ndarray) -> np.ndarray:
        """Log probability by language."""
        return self._sweep(self._ends(), probability)

    def expected(self, probability: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
        """Add the expected count of every piece, the word counting weight[language] times."""
        alpha, beta = [np.zeros(probability.shape[1])], [np.zeros(probability.shape[1])]
        total = self._sweep(self._ends(), probability, alpha)
        self._sweep(self.ids.T[::-1], probability, beta)
        alpha, beta = np.array(alpha), np.array(beta[::-1])
        for d in range(min(PIECE, self.n)):
            at = np.flatnonzero(self.ids[d])
            ids = self.ids[d, at]
            share = np.exp(alpha[at] + beta[at + d + 1] - total) * probability[ids]
            np.add.at(into, ids, share * weight)


def apart(found: list[str], letters: dict[str, float]) -> np.ndarray:
    """Log probability of each word under the background model."""
    rare = float(np.log(RARE))
    return np.array([sum(letters.get(x, rare) for x in w) + letters.get(END, rare) for w in found])


def _by_length(found: list[str], most: int = 20_000):
    groups: dict[int, list[str]] = {}
    for w in found:
        if len(w) <= LONGEST:
            groups.setdefault(len(w), []).append(w)
    for group in groups.values():
        for i in range(0, len(group), most):
            yield group[i : i + most]


def _scaled(probability: np.ndarray, pieces: list[str]) -> np.ndarray:
    lengths = np.array([0, 1, *map(len, pieces)])
    return probability * np.exp(SCALE * lengths)[:, None]


def background(letters: dict[str, int]) -> dict[str, float]:
    """Log probabilities of letters, END for the end of a word; letters that aren't there have RARE."""
    total = max(1, sum(letters.values()))
    return {x: float(np.log(max(n / total, RARE))) for x, n in letters.items()}


class Model:
    """Without letters and gains every text counts as one in a learned language."""

    def __init__(self, languages: list[str], pieces: list[str], probability: np.ndarray, letters: dict[str, float] | None = None, gains: np.ndarray | None = None) -> None:
        self.languages, self.pieces, self.probability, self.letters, self.gains = languages, pieces, probability, letters, gains
        self.index = Pieces(pieces)
        self.table = _scaled(probability, pieces)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.characters = 0
        self.logs = np.zeros((1024, len(self.languages) + 2))

    def learn(self, found: set[str]) -> None:
        """Give new words a row: log probabilities by language, by the background, and the length with the end."""
        if len(self.rows) > min(CACHE, CELLS // (len(self.languages) + 2)) or self.characters > CHARACTERS:
            self.clear()
        new = [w for w in found if w not in self.rows]
        self.characters += sum(map(len, new))
        if len(self.rows) + len(new) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros((len(self.logs) + len(new), self.logs.shape[1]))])
        for w in [w for w in new if len(w) > LONGEST]:
            at = len(self.rows)
            run = Run(self.index, w)
            self.logs[at, :-2], self.logs[at, -2], self.logs[at, -1] = run.logs(self.probability), apart([w], self.letters or {})[0], run.n
            self.rows[w] = at
        for group in _by_length(new, max(100, min(20_000, CELLS // 100 // max(1, len(self.languages))))):
            lattice = Lattice(self.index, group)
            at = len(self.rows)
            self.logs[at : at + len(group), :-2] = np.log(np.maximum(lattice.forward(self.table)[lattice.n], 1e-300)) - SCALE * lattice.n
            self.logs[at : at + len(group), -2] = apart(group, self.letters or {})
            self.logs[at : at + len(group), -1] = lattice.n
            self.rows.update(zip(group, range(at, at + len(group)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        bags = [words(x) if x else [] for x in texts]
        if self.languages:
            self.learn(set().union(*bags))
        return [self._decide(bag) for bag in bags]

    def _decide(self, bag: list[str]) -> tuple[str, float]:
        if not bag or not self.languages:
            return "und", 0.0
        *total, apart, size = self.logs[list(map(self.rows.__getitem__, bag))].sum(axis=0)
        total = np.array(total)
        share = np.exp(np.maximum(total - total.max(), -700.0))
        share /= share.sum()
        best = int(share.argmax())
        if self.gains is None:
            return self.languages[best], float(share[best])
        gain = (total[best] - apart) / size / self.gains[best]
        return self.languages[best], float(share[best] / (1 + np.exp(min(STEEP * (FLOOR - gain), 700.0))))


def fit(counts: list[tuple[str, str, int]], pieces: list[str], rounds: int = ROUNDS, letters: dict[str, float] | None = None) -> Model:
    """Expectation-maximisation from (language, word, count) rows; languages in sorted order, each learned from its own rows alone."""
    languages = sorted({r[0] for r in counts})
    column = {x: k for k, x in enumerate(languages)}
    weights: dict[str, np.ndarray] = {}
    for lang, word, n in counts:
        weights.setdefault(word, np.zeros(len(languages)))[column[lang]] += n
    lengths = np.array([1, 1, *map(len, pieces)], dtype=float)
    start = np.exp(-SCALE * lengths)[:, None].repeat(max(1, len(languages)), axis=1)
    start[0], start[1] = 0.0, UNKNOWN
    model = Model(languages, pieces, start)
    lattices = [(Lattice(model.index, g), np.array([weights[w] for w in g])) for g in _by_length(sorted(weights))]
    runs = [(Run(model.index, w), w) for w in sorted(weights) if len(w) > LONGEST]
    for _ in range(rounds if languages else 0):
        total = np.full(start.shape, 0.0)
        for lattice, weight in lattices:
            lattice.expected(model.table, weight, total)
        for run, w in runs:
            run.expected(model.probability, weights[w], total)
        total[2:] += 0.01
        total[:2] = 0.0
        probability = total / np.maximum(total.sum(axis=0), 1e-300) * (1 - UNKNOWN)
        probability[1] = UNKNOWN
        model = Model(languages, pieces, probability)
    if letters is None:
        return model
    gained, size = np.zeros(len(languages)), np.zeros(len(languages))
    for lattice, weight in lattices:
        logs = np.log(np.maximum(lattice.forward(model.table)[lattice.n], 1e-300)) - SCALE * lattice.n
        gained += (weight * (logs - apart(lattice.group, letters)[:, None])).sum(axis=0)
        size += weight.sum(axis=0) * lattice.n
    for run, w in runs:
        gained += weights[w] * (run.logs(model.probability) - apart([w], letters)[0])
        size += weights[w] * run.n
    return Model(languages, pieces, model.probability, letters, np.maximum(gained / np.maximum(size, 1), LEAST_GAIN))


def _count(batches):
    for batch in batches:
        totals: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w, n in Counter(words(text)).items():
                totals[lang, w] += n
        rows = [(lang, w, n) for (lang, w), n in totals.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], names=["lang", "word", "n"]
        )


def _letters(batches):
    for batch in batches:
        totals: Counter = Counter()
        for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            totals[END] += n
            for x in w:
                totals[x] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["letter", "n"])


def train(docs: DataFrame, path: str = VOCABULARY, per_language: int = PER_LANGUAGE) -> Model:
    """Learn every lang of docs, from about per_language rows of each, chosen by a hash of the text.

    Each language is learned in a task of its own. Rows with a null text or lang teach nothing.
    """
    usable = docs.where("text is not null and lang is not null").select("lang", "text")
    sizes = usable.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.join(F.broadcast(sizes), "lang").where(place < F.col("share")).select("lang", "text")
    counts = stage(sample.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    letters = background({r.letter: r.n for r in counts.mapInArrow(_letters, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n")).orderBy("letter").collect()})
    pieces = vocabulary(path)

    def learn(part: pa.Table) -> pa.Table:
        rows = sorted(zip(*(part.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True))
        model = fit(rows, pieces, letters=letters)
        return pa.table({"lang": pa.array(model.languages, pa.string()), "gain": pa.array(model.gains, pa.float64()), "probability": pa.array([model.probability[:, 0]], pa.list_(pa.float64()))})

    learned = counts.groupBy("lang").applyInArrow(learn, "lang string, gain double, probability array<double>").toArrow().sort_by("lang")
    unstage(counts)
    probability = np.zeros((len(pieces) + 2, learned.num_rows))
    for k, row in enumerate(learned.column("probability")):
        probability[:, k] = row.values.to_numpy()
    return Model(learned.column("lang").to_pylist(), pieces, probability, letters, np.array(learned.column("gain").to_pylist()))


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of docs with lang_pred and lang_score (or other names): the share of that language, lowered for texts that don't look like it.

    A text that is null or has no letter is `und` with score 0. Columns of those names give way.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.probability, model.letters, model.gains))
    docs = docs.select(*[c for c in docs.columns if c.lower() not in {n.lower() for n in names}])

    def run(batches):
        found = Model(*held.value)
        for batch in batches:
            out: list[tuple[str, float]] = []
            waiting: list[str | None] = []
            size = 0
            for text in batch.column("text").cast(pa.string()):
                waiting.append(text.as_py())
                size += len(waiting[-1] or "")
                if len(waiting) >= 1000 or size >= TOGETHER:
                    out += found.predict(waiting)
                    waiting, size = [], 0
            out += found.predict(waiting)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())],
                names=[*batch.schema.names, *names],
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def keep_identified(docs: DataFrame, least: float = 0.65, path: str = VOCABULARY) -> DataFrame:
    """The rows of docs whose language is recognised with a score of `least` or more; every column is kept, whatever its name."""
    names = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    return predict(docs, train(docs, path), names).where((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).drop(*names)

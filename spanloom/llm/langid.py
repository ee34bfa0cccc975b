"""Operator 2: language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public (the lower-case pieces of a SentencePiece model); each language has a
probability for each piece, learnt by expectation-maximisation over all segmentations of its words. A word
scores the sum, over all its segmentations into pieces, of the product of their probabilities, which a
forward algorithm gives; a text scores the product over its words, and the score of a language is its share
among all (the posterior under equal priors).

Learning reads about TRAIN_DOCS documents a language (a parameter; those whose 62-bit hash of id and text lies
below that share of all, at any number of documents), and all words of them. The model has languages x pieces
numbers, whatever the corpus; more than MAX_LANGS languages are an error, as the model goes to every worker.
Scoring reads every whole text, however long, without shuffle. Words are runs of letters, lower-cased; a run of
more than MAX_WORD letters counts as several.

Defined cases: null text, or text without a letter, is ``und`` with score 0; without anything to learn from
every text is ``und``; null lang or null doc_id is not learnt from; ties go to the first language by name;
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drawn, slices, worker_state

TRAIN_DOCS, ROUNDS, MAX_WORD, CACHED, MAX_LANGS = 600, 4, 40, 300_000, 1000
FLOOR, SMOOTH = 1e-6, 200.0
WORD = re.compile(r"[^\W\d_]+")
START = "▁"


def words_of(text: str | None) -> list[str]:
    words = [w for w in WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]
    if any(len(w) > MAX_WORD for w in words):
        words = [w[i : i + MAX_WORD] for w in words for i in range(0, len(w), MAX_WORD)]
    return words


def pieces_of(path: str) -> list[str]:
    """The vocabulary's pieces made of lower-case letters, with or without the mark of a word's start."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in names if (w := p.removeprefix(START)).isalpha() and w == w.lower()} | {START})


class Pieces:
    """The vocabulary, to be looked up for all stretches of many words at once, by 64-bit hashes of their letters."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[tuple[int, int]]] = {}
        for i, piece in enumerate(pieces):
            h = np.zeros(1, np.uint64)
            for c in codes(piece):
                h = stretched(h, c)
            by.setdefault(len(piece), []).append((int(h[0]), i))
        for n, some in by.items():
            some.sort()
            self.tables[n] = np.array([h for h, _ in some], np.uint64), np.array([i for _, i in some])
        self.longest = max(by, default=1)

    def arcs(self, words: list[str]) -> np.ndarray:
        """Rows (word, first place, last place, piece); a letter that is no piece is the unknown one."""
        letters = codes("".join(f"{START}{w}" for w in words))
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, h, out = np.arange(len(letters)), np.zeros(len(letters), np.uint64), []
        for n in range(1, self.longest + 1):
            fits = place[at] + n <= sizes[word[at]]
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = stretched(h, letters[at + n - 1])
            known, index = self.tables.get(n, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            spot = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            hit = known[spot] == h if len(known) else np.zeros(len(h), bool)
            piece = np.where(hit, index[spot] if len(known) else 0, self.unknown)
            use = hit | (n == 1)
            out.append(np.stack([word[at[use]], place[at[use]], place[at[use]] + n, piece[use]], axis=1).astype(np.int32))
        return np.concatenate(out) if out else np.empty((0, 4), np.int32)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def stretched(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Hashes of stretches that are one letter longer."""
    x = (h + letter + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Lattices:
    """All segmentations of words, as arcs."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        arcs = pieces.arcs(words)
        self.arcs = arcs[np.argsort(arcs[:, 2], kind="stable")]
        cuts = np.searchsorted(self.arcs[:, 2], np.arange(1, int(self.sizes.max(initial=0)) + 2))
        self.by_end = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each word's beginnings (word, place)."""
        alpha = np.zeros((len(self.sizes), len(self.by_end) + 1))
        alpha[:, 0] = 1
        for j, rows in enumerate(self.by_end, 1):
            n, a, _, piece = self.arcs[rows].T
            alpha[:, j] = np.bincount(n, alpha[n, a] * p[piece], minlength=len(alpha))
        return alpha

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p)[np.arange(len(self.sizes)), self.sizes]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, over all segmentations of the words with their counts."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(beta)), self.sizes] = 1
        total = np.zeros(len(p))
        whole = alpha[np.arange(len(alpha)), self.sizes]
        weight = np.where(whole > 0, counts / np.where(whole > 0, whole, 1), 0)
        for rows in reversed(self.by_end):
            n, a, b, piece = self.arcs[rows].T
            through = p[piece] * beta[n, b]
            beta += np.bincount(n.astype(np.int64) * beta.shape[1] + a, through, minlength=beta.size).reshape(beta.shape)
            total += np.bincount(piece, alpha[n, a] * through * weight[n], minlength=len(p))
        return total


def learnt(counts: dict[str, Counter], pieces: list[str]) -> dict[str, np.ndarray]:
    """Each language's piece probabilities (the last: an unknown letter) from its words' counts."""
    known = Pieces(pieces)
    lattices = {lang: (Lattices(list(c), known), np.array(list(c.values()), float)) for lang, c in sorted(counts.items())}
    size = len(pieces) + 1
    model = {lang: np.full(size, 1 / size) for lang in lattices}
    for _ in range(ROUNDS):
        use = {lang: lattice.expected(model[lang], n) for lang, (lattice, n) in lattices.items()}
        pooled = sum(use.values()) + 0.1
        pooled /= pooled.sum()
        model = {lang: np.maximum((u + SMOOTH * pooled) / (u.sum() + SMOOTH), FLOOR) for lang, u in use.items()}
    return model


def fitted(docs: DataFrame, learn: Column, vocabulary: str, train_docs: int = TRAIN_DOCS) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces, and log probabilities are learnt from the rows for which ``learn`` holds."""
    bounded_batches(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & learn)
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], [], np.zeros((0, 1))
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"{len(sizes)} languages; the model is made for {MAX_LANGS} at most")
    of = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, n)])[F.col("lang")]
    chosen = usable.filter(drawn(F.xxhash64("doc_id", "text", F.lit(2)), train_docs, of))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["lang", "word", "n"])

    table = chosen.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toArrow()
    counts: dict[str, Counter] = {}
    for lang, word, n in zip(*(c.to_pylist() for c in table.columns), strict=True):
        counts.setdefault(lang, Counter())[word] = n
    pieces = pieces_of(vocabulary)
    model = learnt(counts, pieces)
    return list(model), pieces, np.stack([*model.values()]) if model else np.zeros((0, 1))


class Scorer:
    """Log likelihoods of words under each language; keeps those of words that it has met."""

    def __init__(self, langs: list[str], pieces: list[str], model: np.ndarray):
        self.langs, self.model = langs, model
        self.pieces = Pieces(pieces)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))

    def learn(self, words: list[str]) -> None:
        lattice = Lattices(words, self.pieces)
        some = np.stack([np.log(np.maximum(lattice.likelihood(p), 1e-300)) for p in self.model], axis=1)
        at = len(self.row)
        while len(self.table) < at + len(words):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at : at + len(words)] = some
        self.row.update(zip(words, range(at, at + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) for t in texts]
        if len(self.row) > CACHED:
            self.clear()
        if new := list(set().union(*split).difference(self.row)) if self.langs else []:
            for at in range(0, len(new), 20_000):
                self.learn(new[at : at + 20_000])
        out = []
        for words in split:
            if not words or not self.langs:
                out.append(("und", 0.0))
                continue
            total = self.table[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def identified(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(f"langid {number}", lambda: Scorer(*shared.value))
        for batch in slices(batches, 128):
            done = scorer.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in done], pa.string()), pa.array([s for _, s in done], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fitted(docs, remainder != 0, public_tokenizers.path("piece_bpe_32k.model"))
    return identified(docs, model).select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")

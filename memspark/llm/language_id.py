"""Language identification by unigram piece models whose segmentations are summed out.

The pieces are those of a fixed public vocabulary, and every single letter. A language gives each
piece a probability; a word's probability is the sum over all ways to cut it into pieces, found by
the forward algorithm; a text's is the product over its words. The probabilities are learned by
expectation maximisation (forward and backward sums) on a bounded sample of labelled texts. Words of up to
SHORT_WORD letters are summed many at once; longer ones (text without spaces) one by one, in logarithms and
slice by slice, over their whole length, so that no sum is cut and none underflows.

Defined cases: a text of null or without a letter is ``und`` with score 0; so is every text where no
language could be learned. Rows with a null language, and with a null id, are never learned from.
Very long texts and words count whole. Repeated rows are predicted each. Ties go to the language that sorts
first. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_bucket, fits_broadcast, in_workers, picked

#: Letters up to which words are summed many at once, and letters of a longer one looked at at once.
SHORT_WORD, SLICE = 24, 4096
START = "▁"
LETTERS = regex.compile(r"\p{L}+")
#: Chunks, and words, a worker remembers before it starts anew, and the letters in all of them.
CACHE, CACHE_LETTERS = 150_000, 6_000_000


def vocabulary_pieces(path: str) -> list[str]:
    """Lower-cased pieces of a sentencepiece file that hold letters only (with or without the word start), sorted."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_byte(i)}
    return sorted(p for p in own if LETTERS.fullmatch(p.removeprefix(START)))


def words_in(chunk: str) -> list[str]:
    return [START + run for run in LETTERS.findall(chunk.lower())]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class PieceTable:
    """Finds pieces in words by rolling hashes modulo 2**64, for many words at once."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.power = self.inverse = np.zeros(0, np.uint64)
        by: dict[int, list[int]] = {}
        for i, x in enumerate(pieces):
            by.setdefault(len(x), []).append(i)
        self.of = {}
        for n, ids in sorted(by.items()):
            prefix, _ = self._prefix("".join(pieces[i] for i in ids))
            h = self._hash(prefix, np.arange(len(ids)) * n, n)
            order = np.argsort(h)
            self.of[n] = h[order], np.array(ids, np.int64)[order]

    def _prefix(self, text: str) -> tuple[np.ndarray, int]:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        if len(code) > len(self.power):
            self.power, self.inverse = _powers(self.BASE, 2 * len(code)), _powers(self.INVERSE, 2 * len(code))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * self.power[: len(code)], dtype=np.uint64))), len(code)

    def _hash(self, prefix: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        return (prefix[start + n] - prefix[start]) * self.inverse[start]

    def edges(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of every piece in every word; a letter that is no piece counts as piece n."""
        prefix, total = self._prefix("".join(words))
        word = np.repeat(np.arange(len(words)), sizes)
        first = np.cumsum(sizes) - sizes
        inside = np.arange(total) - first[word]
        left = sizes[word] - inside
        out = []
        for n in {1: None, **self.of}:
            at = np.flatnonzero(left >= n)
            if n in self.of:
                hashes, ids = self.of[n]
                h = self._hash(prefix, at, n)
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[k] == h
                piece = np.where(hit, ids[k], self.n)
            else:
                hit, piece = np.zeros(len(at), bool), np.full(len(at), self.n)
            if n > 1:
                at, piece = at[hit], piece[hit]
            out.append((word[at], inside[at], inside[at] + n, piece))
        return tuple(np.concatenate(x) for x in zip(*out))


class Lattice:
    """All pieces in each of some words, as flat arrays sorted by where they end."""

    def __init__(self, words: list[str], table: PieceTable):
        self.n, self.sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        self.most = int(self.sizes.max()) if words else 0
        word, start, end, piece = table.edges(words, self.sizes)
        order = np.argsort(end, kind="stable")
        self.word, self.start, self.end, self.piece = word[order], start[order], end[order], piece[order]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[position, word] under one language's piece probabilities."""
        alpha = np.zeros((self.most + 1, self.n))
        alpha[0] = 1
        cut = np.searchsorted(self.end, np.arange(self.most + 2))
        for e in range(1, self.most + 1):
            s = slice(cut[e], cut[e + 1])
            alpha[e] = np.bincount(self.word[s], alpha[self.start[s], self.word[s]] * p[self.piece[s]], self.n)
        return alpha

    def total(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.sizes, np.arange(self.n)]

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts, of words that count as often as weight says."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[self.sizes, np.arange(self.n)] = 1
        order = np.argsort(-self.start, kind="stable")
        begins = -self.start[order]
        for s in range(self.most - 1, -1, -1):
            o = order[np.searchsorted(begins, -s) : np.searchsorted(begins, -s, "right")]
            beta[s] += np.bincount(self.word[o], beta[self.end[o], self.word[o]] * p[self.piece[o]], self.n)
        share = alpha[self.start, self.word] * p[self.piece] * beta[self.end, self.word] / self.total(alpha)[self.word]
        return np.bincount(self.piece, share * weight[self.word], len(p))


def _by_end(table: PieceTable, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, piece, first) of all pieces in text, sorted by where they end; those that end at e are first[e]:first[e + 1]."""
    _, start, end, piece = table.edges([text], np.array([len(text)]))
    order = np.argsort(end, kind="stable")
    return start[order], piece[order], np.searchsorted(end[order], np.arange(len(text) + 2))


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Over the first axis."""
    m = x.max(0)
    return m + np.log(np.exp(x - m).sum(0))


def long_total(table: PieceTable, word: str, logs: np.ndarray) -> np.ndarray:
    """Log probability of a word of any length, by language; logs: piece x language."""
    most = max([1, *table.of])
    done = np.zeros((1, logs.shape[1]))  # of the last positions before the slice, and its beginning
    for a in range(0, len(word), SLICE):
        known = len(done) - 1
        text = word[a - known : a + SLICE]
        start, piece, first = _by_end(table, text)
        alpha = np.concatenate((done, np.zeros((len(text) - known, logs.shape[1]))))
        for e in range(known + 1, len(text) + 1):
            s = slice(first[e], first[e + 1])
            alpha[e] = _log_sum(alpha[start[s]] + logs[piece[s]])
        done = alpha[-min(most, len(alpha)) :]
    return done[-1]


def long_expected(table: PieceTable, word: str, logs: np.ndarray) -> np.ndarray:
    """Expected piece counts of a long word under one language; of a slice's length at once."""
    out = np.zeros(len(logs))
    for a in range(0, len(word), SLICE):
        text = word[a : a + SLICE]
        start, piece, first = _by_end(table, text)
        end = np.repeat(np.arange(len(text) + 1), np.diff(first))
        forth, back = np.zeros(len(text) + 1), np.zeros(len(text) + 1)
        for e in range(1, len(text) + 1):
            s = slice(first[e], first[e + 1])
            forth[e] = _log_sum(forth[start[s]] + logs[piece[s]])
        order = np.argsort(start, kind="stable")
        begins = np.searchsorted(start[order], np.arange(len(text) + 1))
        for b in range(len(text) - 1, -1, -1):
            o = order[begins[b] : begins[b + 1]]
            back[b] = _log_sum(back[end[o]] + logs[piece[o]])
        out += np.bincount(piece, np.exp(forth[start] + logs[piece] + back[end] - forth[-1]), len(logs))
    return out


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    p: np.ndarray  # language x piece; the last piece stands for any letter the vocabulary lacks


def word_scores(model: Model, table: PieceTable, words: list[str]) -> np.ndarray:
    """log probability, word x language."""
    out = np.zeros((len(words), len(model.languages)))
    short = np.array([i for i, w in enumerate(words) if len(w) <= SHORT_WORD], np.int64)
    for a in range(0, len(short), 5_000):
        at = short[a : a + 5_000]
        part = Lattice([words[i] for i in at], table)
        for k, p in enumerate(model.p):
            out[at, k] = np.log(part.total(part.forward(p)))
    if len(short) < len(words) and model.languages:
        logs = np.log(model.p.T)
        for i, w in enumerate(words):
            if len(w) > SHORT_WORD:
                out[i] = long_total(table, w, logs)
    return out


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = 4, smooth: float = 0.1) -> Model:
    """From word counts by language. Words with a letter outside the vocabulary keep it as the unknown piece."""
    table = PieceTable(pieces)
    languages = sorted(counts)
    out = []
    for lang in languages:
        words = sorted(w for w in counts[lang] if len(w) <= SHORT_WORD)
        long = sorted(w for w in counts[lang] if len(w) > SHORT_WORD)
        weight = np.array([counts[lang][w] for w in words], float)
        p = np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
        for _ in range(rounds):
            c = np.full(len(p), smooth)
            for a in range(0, len(words), 5_000):
                c += Lattice(words[a : a + 5_000], table).expected(p, weight[a : a + 5_000])
            for w in long:
                c += counts[lang][w] * long_expected(table, w, np.log(p))
            p = c / c.sum()
        out.append(p)
    return Model(languages, pieces, np.array(out).reshape(len(languages), len(pieces) + 1))


def sample_counts(df: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held: int, max_docs_per_lang: int) -> dict[str, dict[str, int]]:
    """Word counts by language of at most max_docs_per_lang labelled texts of each, chosen by the id's hash."""
    bucket = crc_bucket("id", folds)
    labelled = picked(df, id=id_col, text=text_col, lang=lang_col).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket != held))
    first = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = labelled.select("id", "lang")
    # so few rows go to a language's ranking that one task can rank them: about four times as many as are taken, by the same hash
    share = ids.groupBy("lang").agg((F.lit(4.0 * max_docs_per_lang + 100) / F.count("*")).alias("share"))
    luck = F.xxhash64("id") / F.lit(2.0**64) + 0.5
    likely = ids.join(F.broadcast(share) if fits_broadcast(share) else share, "lang").filter(luck <= F.col("share"))
    some = likely.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= max_docs_per_lang).select("id", "lang").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[str, str], int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in words_in(text):
                    own[lang, w] = own.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.string()), pa.array([k[1] for k in own], pa.string()), pa.array(own.values(), pa.int64())], names=["lang", "word", "n"])

    # at most max_docs_per_lang ids of each language
    texts = labelled.join(F.broadcast(some) if fits_broadcast(some) else some, ["id", "lang"], "left_semi").select("lang", "text")
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in texts.transform(in_workers, count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n")).toLocalIterator():
        counts.setdefault(lang, {})[word] = n
    return counts


_scorer: dict = {}


class Scorer:
    """Scores texts; remembers the chunks (runs without white space) and words it has met, up to CACHE of each."""

    def __init__(self, model: Model):
        self.model, self.table = model, PieceTable(model.pieces)
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.letters = 0
        self.chunk_rows = np.zeros((CACHE, len(model.languages) + 1))  # the last column counts words
        self.word_rows = np.zeros((CACHE, len(model.languages)))

    def _room(self, known: dict[str, int], rows: np.ndarray, more: int) -> np.ndarray:
        need = len(known) + more
        return rows if need <= len(rows) else np.concatenate((rows, np.zeros((need, rows.shape[1]))))

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks - self.chunks.keys())
        if len(self.chunks) + len(new) > CACHE or self.letters > CACHE_LETTERS:
            self.chunks.clear()
            self.words.clear()
            self.letters = 0
            new = list(chunks)
        own = [words_in(c) for c in new]
        words = list({w for ws in own for w in ws} - self.words.keys())
        self.letters += sum(map(len, new)) + sum(map(len, words))
        self.word_rows = self._room(self.words, self.word_rows, len(words))
        start = len(self.words)
        self.word_rows[start : start + len(words)] = word_scores(self.model, self.table, words)
        self.words.update((w, start + i) for i, w in enumerate(words))
        self.chunk_rows = self._room(self.chunks, self.chunk_rows, len(new))
        start = len(self.chunks)
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter((self.words[w] for ws in own for w in ws), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(own)), size)
        rows = self.chunk_rows[start : start + len(new)]
        for k in range(len(self.model.languages)):
            rows[:, k] = np.bincount(owner, self.word_rows[flat, k], len(own))
        rows[:, -1] = size
        self.chunks.update((c, start + i) for i, c in enumerate(new))

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for a in range(0, len(texts), 256):
            part = [(t or "").split() for t in texts.slice(a, 256).to_pylist()]
            self.learn({c for cs in part for c in cs})
            get = self.chunks.__getitem__
            for cs in part:
                total = self.chunk_rows[np.fromiter(map(get, cs), np.int64, len(cs))].sum(0)
                if not total[-1] or not self.model.languages:
                    names.append("und"), scores.append(0.0)
                    continue
                p = np.exp(total[:-1] - total[:-1].max())
                k = int(p.argmax())
                names.append(self.model.languages[k]), scores.append(float(p[k] / p.sum()))
        return names, scores


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, lang_pred, score) of every row; score is the language's share of the probability."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is that of the vocabulary
    key = uuid.uuid4().hex

    # a text that is kept is sent once
    sent = [c for c in keep if c != text_col]
    place = {c: 2 + i for i, c in enumerate(sent)} | {text_col: 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorer:
            _scorer.clear()
            _scorer[key] = Scorer(shared.value)
        for b in batches:
            names, scores = _scorer[key].predict(b.column(1))
            own = [b.column(0), *(b.column(place[c]) for c in keep)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, *keep, "lang_pred", "score"])

    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep))
    return picked(df, **{id_col: id_col, "text_": text_col, **{c: c for c in sent}}).transform(in_workers, run, f"{fields}, lang_pred string, score double")


def train(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held: int = 0, max_docs_per_lang: int = 400) -> Model:
    """Learn from rows whose crc32 of the id modulo folds is not held; of each language max_docs_per_lang whole texts at most."""
    return fit(sample_counts(df, id_col, text_col, lang_col, folds, held, max_docs_per_lang), vocabulary_pieces(vocabulary))


def identify(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held: int = 0, max_docs_per_lang: int = 400, keep: tuple[str, ...] = ()) -> DataFrame:
    """Train and predict: (id, kept columns, held_out, lang_pred, score) of every row. A null id is not held out."""
    model = train(df, vocabulary, id_col, text_col, lang_col, folds, held, max_docs_per_lang)
    out = predict(df, model, id_col, text_col, keep)
    return out.select(id_col, *keep, F.coalesce(crc_bucket(id_col, folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")

"""Language ID by unigram models of pieces, marginalised over all segmentations.

A fixed public vocabulary gives the pieces. For each language the probabilities of pieces come from a few rounds of
expectation maximisation over all words of a hash-chosen sample of its labelled documents, bounded for each language. A
text's log-likelihood
is the sum over its words of the log of the sum over all segmentations, by a forward pass over characters that runs for
many words and all languages at once; words are cached. Characters outside the vocabulary cost a fixed amount.

Defined results: a text that is null or has no letter is `und` with score 0 (digits and numbers of other kinds are no
letters); words of any length are scored whole; ties go to the language that sorts first; no
training rows at all make every text `und`; repeated rows repeat; columns other than those named are passed through
(`identified`) or ignored; an empty table gives an empty result. Whole texts are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MARK = "▁"  # the vocabulary's mark of a word's start
OUTSIDE = -14.0  # log probability of a character that no piece covers
GRAIN = float(1 << 24)  # expected counts are multiples of 1 / GRAIN, so that their sums are the same in any order
NOT_LETTERS, NOT_LETTERS_IN_LINE = re.compile(r"[\W\d_]+"), re.compile(r"(?:[^\w\n]|[\d_])+")


def vocabulary(name: str = "piece_bpe_32k.model", longest: int = 5) -> dict[str, int]:
    """Pieces of a public vocabulary of up to `longest` characters, lower-cased, numbered in the vocabulary's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name) if "/" not in name else name)
    pieces: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and len(piece) <= longest and not re.search(r"[\d_]", piece) and re.fullmatch(rf"{MARK}?\w*", piece):
            pieces.setdefault(piece, len(pieces))
    return pieces


class Segments:
    """Piece numbers of all substrings of words, by length, for words of one padded width. The pieces' prefixes are the
    nodes of a tree: 0 leads nowhere, and `rows` has the children of those that have any but the root."""

    def __init__(self, pieces: dict[str, int], longest: int):
        self.longest, self.none = longest, len(pieces)
        pieces = {p: i for p, i in pieces.items() if 0 < len(p) <= longest}
        prefixes = dict.fromkeys(p[:k] for p in pieces for k in range(1, len(p) + 1))
        inner = dict.fromkeys(p[:-1] for p in prefixes if len(p) > 1)
        nodes = {p: i for i, p in enumerate([*inner, *(p for p in prefixes if p not in inner)], 1)}
        later = {c: i for i, c in enumerate(sorted({p[-1] for p in prefixes if len(p) > 1}), 1)}
        letters = later | {c: i for i, c in enumerate(sorted({p[0] for p in prefixes} - later.keys()), len(later) + 1)}
        self.inner, self.later = len(inner), len(later)
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)  # ends with one for all beyond
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.root, self.rows = np.zeros(len(letters) + 1, np.int32), np.zeros((self.inner + 1, self.later + 1), np.int32)
        for p, node in nodes.items():
            if len(p) == 1:
                self.root[letters[p]] = node
            else:
                self.rows[nodes[p[:-1]], later[p[-1]]] = node
        self.piece = np.array([self.none, *(pieces.get(p, self.none) for p in nodes)], np.int32)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """found[w, t, k]: the piece that ends after character t and has k+1 characters (`none` if there is none)."""
        lengths = np.array([len(w) for w in words])
        n, width = len(words), int(lengths.max())
        places = np.arange(width) < lengths[:, None]
        letters = np.zeros((n, width), np.int32)
        letters[places] = self.letter[np.minimum(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4"), len(self.letter) - 1)]
        found = np.full((n, width, self.longest), self.none, np.int32)
        nodes = self.root[letters]
        found[:, :, 0] = self.piece[nodes]
        letters[letters > self.later] = 0
        for k in range(1, min(width, self.longest)):
            nodes = nodes[:, :-1]
            nodes = self.rows[np.where(nodes <= self.inner, nodes, 0), letters[:, k:]]
            found[:, k:, k] = self.piece[nodes]
        return found, lengths


def forward(found: np.ndarray, lengths: np.ndarray, logs: np.ndarray, outside: float) -> np.ndarray:
    """Log of the sum over segmentations of each word, by language. logs[piece, language] ends with a row of -inf."""
    n, width, longest = found.shape
    alpha = np.full((width + 1, n, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for t in range(width):
        reach = min(t + 1, longest)
        terms = np.stack([alpha[t - k] + logs[found[:, t, k]] for k in range(reach)] + [alpha[t] + outside])
        top = terms.max(axis=0)
        alpha[t + 1] = top + np.log(np.exp(terms - top).sum(axis=0))
    return alpha[lengths, np.arange(n)]


def expected(found: np.ndarray, lengths: np.ndarray, weight: np.ndarray, logs: np.ndarray, outside: float) -> np.ndarray:
    """Expected counts of pieces under one language (logs[piece]), summed over words with weights."""
    n, width, longest = found.shape
    alpha, beta = np.full((width + 1, n), -np.inf), np.full((width + longest + 1, n), -np.inf)
    alpha[0] = 0
    beta[lengths, np.arange(n)] = 0
    for t in range(width):
        terms = np.stack([alpha[t - k] + logs[found[:, t, k]] for k in range(min(t + 1, longest))] + [alpha[t] + outside])
        top = terms.max(axis=0)
        alpha[t + 1] = top + np.log(np.exp(terms - top).sum(axis=0))
    for t in range(width - 1, -1, -1):
        terms = [logs[found[:, t + k, k]] + beta[t + k + 1] if t + k < width else np.full(n, -np.inf) for k in range(longest)]
        terms = np.stack([beta[t], *terms, outside + beta[t + 1]])
        top = terms.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            beta[t] = np.where(np.isfinite(top), safe + np.log(np.exp(terms - safe).sum(axis=0)), -np.inf)
    total, counts = alpha[lengths, np.arange(n)], np.zeros(len(logs))
    for t in range(width):
        for k in range(min(t + 1, longest)):
            share = np.exp(alpha[t - k] + logs[found[:, t, k]] + beta[t + 1] - total) * weight
            share = np.rint(share * GRAIN) / GRAIN
            ok = (t < lengths) & np.isfinite(share)
            np.add.at(counts, found[ok, t, k], share[ok])
    return counts[:-1]


def words_of(text: str) -> list[str]:
    """Runs of letters of a text, lower-cased and marked."""
    text = text.lower()
    words = [text] if text.isalpha() else NOT_LETTERS.sub(" ", text).split()
    if not all(map(str.isalpha, words)):  # numbers that are no decimal digits
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return [MARK + w for w in words]


def words_of_tokens(tokens: list[str]) -> list[list[str]]:
    """words_of each of many tokens that have no white space and are in lower case."""
    parts = [t.split() for t in NOT_LETTERS_IN_LINE.sub(" ", "\n".join(tokens)).split("\n")] if tokens else []
    return [[MARK + w for w in ws] if all(map(str.isalpha, ws)) else words_of(t) for t, ws in zip(tokens, parts, strict=True)]


def parts_by_size(words: list[str], most: int = 4_000, cells: int = 400_000) -> Iterator[tuple[int, int]]:
    """Bounds of parts of words in order of length: `most` words at most, or fewer so that the padded part stays small."""
    at = 0
    while at < len(words):
        fits = lambda n: n * len(words[at + n - 1]) <= cells  # noqa: B023, E731
        low, high = 1, min(most, len(words) - at)
        while low < high:  # the most that fit; one at least
            middle = (low + high + 1) // 2
            low, high = (middle, high) if fits(middle) else (low, middle - 1)
        yield at, at + low
        at += low


class Model:
    """Scores texts; caches the log-likelihoods of at most about `cached` white-space separated tokens. A full cache keeps
    the quarter that was used most; results do not depend on it."""

    def __init__(self, languages: list[str], logs: np.ndarray, pieces: dict[str, int], longest: int, outside: float = OUTSIDE, cached: int = 200_000):
        self.languages, self.logs, self.pieces, self.longest, self.outside, self.cached = languages, logs, pieces, longest, outside, cached
        self.segments, self.rows = Segments(pieces, longest), {}
        self.values, self.used = np.zeros((0, len(languages) + 1)), np.zeros(0, np.int64)

    def trim(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.cached // 4])
        place = np.full(len(self.used), -1)
        place[keep] = np.arange(len(keep))
        self.rows = {t: p for t, p in zip(self.rows, place.tolist(), strict=True) if p >= 0}
        self.values, self.used = self.values[keep], self.used[keep] // 2

    def learn(self, tokens: set[str]) -> None:
        """Caches the sums over each token's words by language, and in a last column the number of its words."""
        tokens = list(tokens)
        parts = dict(zip(tokens, words_of_tokens(tokens), strict=True))
        words = sorted({w for ws in parts.values() for w in ws}, key=len)
        segments, place, values = self.segments, {w: i for i, w in enumerate(words)}, [np.zeros((0, len(self.languages)))]
        for i, end in parts_by_size(words):
            values.append(forward(*segments.of(words[i:end]), self.logs, self.outside))
        known = np.concatenate(values)
        flat = np.array([place[w] for ws in parts.values() for w in ws], np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(ws) for ws in parts.values()])
        sums = np.zeros((len(parts), len(self.languages) + 1))
        np.add.at(sums[:, :-1], owner, known[flat])
        np.add.at(sums[:, -1], owner, 1)
        self.rows.update(zip(parts, range(len(self.rows), len(self.rows) + len(parts)), strict=True))
        self.values, self.used = np.concatenate([self.values, sums]), np.concatenate([self.used, np.zeros(len(sums), np.int64)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its posterior probability under equal priors."""
        languages, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [(i, t.lower().split()) for i, t in enumerate(texts) if t and not t.isspace()] if self.languages else []
        if not some:
            return languages, scores
        flat = [w for _, ws in some for w in ws]
        found = list(map(self.rows.get, flat))
        unseen = {w for w, r in zip(flat, found, strict=True) if r is None}
        if len(self.rows) + len(unseen) > self.cached:
            self.trim()
            found = list(map(self.rows.get, flat))
            unseen = {w for w, r in zip(flat, found, strict=True) if r is None}
        if unseen:
            self.learn(unseen)
            found = [self.rows[w] if r is None else r for w, r in zip(flat, found, strict=True)]
        found = np.array(found)
        self.used += np.bincount(found, minlength=len(self.used))
        sums = np.add.reduceat(self.values[found], np.cumsum([0, *(len(ws) for _, ws in some)])[:-1], axis=0)
        words, sums = sums[:, -1], sums[:, :-1]
        best = sums.argmax(axis=1)
        share = np.exp(sums - sums.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        for j, (i, _) in enumerate(some):
            if words[j]:
                languages[i], scores[i] = self.languages[best[j]], float(share[j, best[j]])
        return languages, scores


def trained(labelled: DataFrame, bound: int = 1_500, rounds: int = 3, longest: int = 5) -> Model:
    """Fits on about `bound` rows (text, lang, doc_id) of each language, chosen by a hash of doc_id; lang and text are not
    null. Words are counted by language in Spark, and each round's expected counts are summed there; every word of the
    sample takes part."""
    labelled, steps = labelled.select("doc_id", "text", "lang"), 1 << 40
    shares = [x for r in labelled.groupBy("lang").count().collect() for x in (F.lit(r["lang"]), F.lit(int(steps * min(1.0, bound / r["count"]))))]
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(steps))
    some = labelled.filter(place < F.element_at(F.create_map(*shares), F.col("lang"))) if shares else labelled

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release()
        found: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
        if found:
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": pa.array(list(found.values()), pa.int64())})

    totals = some.select("text", "lang").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    spark = labelled.sparkSession
    totals, path = shared.written_at(totals.repartition(2 * spark.sparkContext.defaultParallelism, "lang", "word"), "words")
    languages = sorted(r["lang"] for r in totals.select("lang").distinct().collect())
    pieces = vocabulary(longest=longest)
    logs = np.full((len(pieces) + 1, len(languages)), -np.log(len(pieces)))
    logs[-1] = -np.inf
    for _ in range(rounds if languages else 0):
        counts = np.zeros((len(pieces), len(languages)))
        for batch in expected_by_piece(totals, Model(languages, logs, pieces, longest)).toArrow().to_batches():
            counts[batch.column("piece").to_numpy(), batch.column("lang").to_numpy()] = batch.column("n").to_numpy()
        counts += 0.05
        logs = np.vstack([np.log(counts / counts.sum(axis=0)), np.full(len(languages), -np.inf)])
    shared.remove(spark, path)
    return Model(languages, logs, pieces, longest)


def expected_by_piece(totals: DataFrame, model: Model) -> DataFrame:
    """lang and piece (numbers) with the expected count `n` of the piece over the words (lang, word, n) of totals, where
    it is above 0. The driver gets pieces by language, never words."""
    sent = totals.sparkSession.sparkContext.broadcast((model.languages, model.logs, model.pieces, model.longest, model.outside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs, pieces, longest, outside = sent.value
        by: dict[str, list[tuple[str, int]]] = {}
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(lang, []).append((word, n))
        segments = Segments(pieces, longest)
        for j, lang in enumerate(languages):
            words = sorted(by.get(lang, []), key=lambda x: (len(x[0]), x[0]))
            counts = np.zeros(len(pieces))
            for i, end in parts_by_size([w for w, _ in words]):
                found, lengths = segments.of([w for w, _ in words[i:end]])
                counts += expected(found, lengths, np.array([n for _, n in words[i:end]], float), np.ascontiguousarray(logs[:, j]), outside)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(some), j, np.int32)), "piece": pa.array(some.astype(np.int32)), "n": pa.array(counts[some])})

    return totals.select("lang", "word", "n").mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


_models: dict[int, Model] = {}


def identified(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its posterior probability (of equal priors)."""
    place = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs, model.pieces, model.longest, model.outside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release()
        mine = _models.get(sent.id) if hasattr(sent, "id") else None
        if mine is None:
            _models.clear()
            mine = Model(*sent.value)
            if hasattr(sent, "id"):
                _models[sent.id] = mine
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                langs, scores = mine.predict(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, pred, score])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(pred, StringType()).add(score, DoubleType()))


def fitted(docs: DataFrame) -> Model:
    """The model of the documents that are not held out (crc32(doc_id as text) mod 5 is not 0)."""
    return trained(docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (shared.fold("doc_id", 5) != 0)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    found = identified(docs.select("doc_id", "text"), fitted(docs))
    return found.select("doc_id", (shared.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")

"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum, over all ways to cut it into pieces, of
the product of their probabilities (forward algorithm); that of a text is the
product over its words.  Piece probabilities are fitted by
expectation-maximisation with the forward-backward algorithm on all words of a
bounded sample of labelled rows (``per_language`` texts of each language), one task
for each language; prediction reads every row and whole text.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_of, order_id, small_batches, text_of
from .kernels import tidy

#: Labelled texts of each language that the model is fitted on.
PER_LANGUAGE = 3000
ITERATIONS = 4
#: Words of this length or more are scored one at a time, with a scale of their own.
LONG_WORD = 48
#: Probability of a character by itself where no piece fits, and the weight of a piece never seen.
FLOOR = 1e-7
UNSEEN = 0.01
#: Words whose probabilities a worker remembers.
REMEMBERED = 200_000
UNDETERMINED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
_MARK = "▁"  # begins a word in the vocabulary
#: Gain for each character, which keeps products of probabilities near 1.
_GAIN = 300.0
_MUL = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(2)
def pieces(vocabulary: str) -> list[str]:
    """The pieces of letters in a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_control(i)}
    return sorted(p for p in found if p.removeprefix(_MARK).isalpha())


def _hashes(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For m = 1, 2, ... longest: the hash of the m characters that begin at each column."""
    from .kernels import mix

    n = codes.shape[1]
    out, value = [], np.zeros(codes.shape, np.uint64)
    with np.errstate(over="ignore"):
        for m in range(1, min(longest, n) + 1):
            value = mix((value[:, : n - m + 1] + codes[:, m - 1 :]) * _MUL)
            out.append(value)
    return out


def _codes(words: list[str], width: int) -> np.ndarray:
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width).astype(np.uint64)


class Pieces:
    """Finds the pieces in words of equal length."""

    def __init__(self, names: list[str]) -> None:
        keys = np.array([_hashes(_codes([p], len(p)), len(p))[-1][0, 0] for p in names], np.uint64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.size = len(names)
        self.longest = max(map(len, names), default=0)

    def spans(self, words: list[str], width: int):
        """For m = 1, 2, ...: (words, starts) -> piece number, or ``size`` where there is none."""
        out = []
        for value in _hashes(_codes(words, width), self.longest):
            at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
            out.append(np.where(self.keys[at] == value, self.order[at], np.int32(self.size)))
        return out


def _forward(spans, table: np.ndarray, width: int) -> np.ndarray:
    """table: (pieces + 1, languages), times _GAIN ** length; -> alpha (width + 1, words, languages)."""
    n = spans[0].shape[0]
    alpha = np.zeros((width + 1, n, table.shape[1]))
    alpha[0] = 1.0
    for end in range(1, width + 1):
        total = alpha[end - 1] * (FLOOR * _GAIN)
        for m in range(1, min(len(spans), end) + 1):
            ids = spans[m - 1][:, end - m]
            hit = np.flatnonzero(ids < len(table) - 1)
            if len(hit):
                total[hit] += alpha[end - m][hit] * table[ids[hit]]
        alpha[end] = total
    return alpha


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def _log_forward(spans, table: np.ndarray, width: int) -> np.ndarray:
    """Log probability of one word of any length: alpha is scaled as it goes."""
    near: list[tuple[np.ndarray, float]] = [(np.ones(table.shape[1]), 0.0)]  # of the last positions: value, log scale
    for end in range(1, width + 1):
        scale = near[-1][1]
        total = near[-1][0] * FLOOR
        for m in range(1, min(len(spans), end) + 1):
            piece = spans[m - 1][0, end - m]
            if piece < len(table) - 1:
                value, own = near[-m]
                total = total + value * table[piece] * np.exp(own - scale) / _GAIN**m
        top = total.max()
        near.append((total / top, scale + np.log(top)))
        if len(near) > len(spans):
            near.pop(0)
    return np.log(near[-1][0]) + near[-1][1]


def fit(counts: dict[str, int], names: list[str]) -> np.ndarray:
    """Probabilities of the pieces, by expectation-maximisation on the word counts of a language.

    Words are cut into pieces anew in every round, so memory is that of one slice of words.
    Runs of LONG_WORD letters or more, which have no scale of their own here, teach nothing;
    in prediction they count like others.
    """
    finder = Pieces(names)
    gain = _GAIN ** np.array([len(p) for p in names] + [0], float)
    slices = []
    for width, at in _by_length(words := sorted(counts)).items():
        step = max(1, 60_000 // width)
        slices += [(width, [words[i] for i in at[lo : lo + step]]) for lo in range(0, len(at), step)]
    p = np.full(len(names) + 1, 1.0 / len(names))
    for _ in range(ITERATIONS):
        seen = np.zeros(len(names) + 1)
        one = (p * gain)[:, None]
        one[-1] = 0
        for width, part in slices:
            if width >= LONG_WORD:
                continue
            spans, times = finder.spans(part, width), np.array([counts[w] for w in part], float)
            alpha = _forward(spans, one, width)[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[width] = 1.0
            for start in range(width - 1, -1, -1):
                total = beta[start + 1] * (FLOOR * _GAIN)
                for m in range(1, min(len(spans), width - start) + 1):
                    total += one[spans[m - 1][:, start], 0] * beta[start + m]
                beta[start] = total
            scale = times / alpha[width]
            for m, ids in enumerate(spans, 1):
                for start in range(ids.shape[1]):
                    at = ids[:, start]
                    seen += np.bincount(at, alpha[start] * one[at, 0] * beta[start + m] * scale, len(seen))
        seen[-1] = 0
        p = (seen + UNSEEN) / (seen.sum() + UNSEEN * len(names))
    return p[:-1]


def table_of(probabilities: list[np.ndarray], names: list[str]) -> np.ndarray:
    """(pieces + 1, languages): probabilities times _GAIN ** length, the last row of zeros."""
    gain = _GAIN ** np.array([len(p) for p in names], float)
    table = np.zeros((len(names) + 1, len(probabilities)))
    for k, p in enumerate(probabilities):
        table[:-1, k] = p * gain
    return table


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case, with the mark that begins a word."""
    out = []
    for run in _LETTERS.findall(text.lower()):
        if not run.isalpha():
            run = "".join(filter(str.isalpha, run))
            if not run:
                continue
        out.append(_MARK + run)
    return out


class Scorer:
    """Log probabilities of words, remembered within a task."""

    def __init__(self, names: list[str], table: np.ndarray) -> None:
        self.finder, self.table = Pieces(names), table
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.logs = np.empty((0, self.table.shape[1]))

    def add(self, words: list[str]) -> None:
        logs = np.empty((len(words), self.table.shape[1]))
        for width, at in _by_length(words).items():
            if width >= LONG_WORD:
                for i in at:
                    logs[i] = _log_forward(self.finder.spans([words[i]], width), self.table, width)
                continue
            for lo in range(0, len(at), 20_000):
                part = at[lo : lo + 20_000]
                spans = self.finder.spans([words[i] for i in part], width)
                total = _forward(spans, self.table, width)[width]
                logs[part] = np.log(total) - width * np.log(_GAIN)
        self.logs = np.concatenate((self.logs, logs))

    def score(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log probability of each text under each language; None without letters."""
        if len(self.known) > REMEMBERED:
            self.clear()
        rows, known, old = [], self.known, len(self.known)
        for text in texts:
            counts = Counter(words_of(text)) if text else None
            if not counts:
                rows.append(None)
                continue
            ids = np.fromiter((known.setdefault(w, len(known)) for w in counts), np.int64, len(counts))
            rows.append((ids, np.fromiter(counts.values(), float, len(counts))))
        if len(known) > old:
            self.add(list(known)[old:])
        return [None if r is None else r[1] @ self.logs[r[0]] for r in rows]


@tidy
def _count_batches(batches):
    import pyarrow as pa

    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        if flat:
            lang, word, n = zip(*flat, strict=True)
            yield pa.RecordBatch.from_pydict({"lang": lang, "word": word, "n": pa.array(n, pa.int64())})


def _fit_language(key, table, vocabulary: str):
    import pyarrow as pa

    words = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
    p = fit(words, pieces(vocabulary))
    return pa.Table.from_pydict({"lang": [key[0].as_py()], "p": pa.array([p.tolist()], pa.list_(pa.float64()))})


def train(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
):
    """(languages, log priors, table) from rows with a text and a language.

    Priors are counted over all rows; pieces are fitted on about ``per_language``
    texts of each language, chosen by a hash of the id, and all their words.
    Nothing to learn from gives no languages.
    """
    small_batches(df.sparkSession)
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[lang_col]: r["n"] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.empty(0), np.zeros((1, 0))
    spread = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(spread * min(1.0, per_language / n)))])
    sample = rows.where(F.pmod(F.xxhash64(order_id(id_col)), F.lit(spread)) < share[F.col(lang_col)])
    fitted = (
        sample.select(F.col(lang_col).alias("lang"), text_of(text_col).alias("text"))
        .mapInArrow(_count_batches, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")  # the words of at most about ``per_language`` texts
        .applyInArrow(lambda key, table: _fit_language(key, table, vocabulary), "lang string, p array<double>")
        .toArrow()  # pieces of the vocabulary x languages
    )
    names = pieces(vocabulary)
    found = {k: np.array(p) for k, p in zip(fitted.column(0).to_pylist(), fitted.column(1).to_pylist(), strict=True)}
    languages, total = sorted(sizes), sum(sizes.values())
    flat = np.full(len(names), 1.0 / len(names))  # a language without a word in the sample
    return languages, np.array([np.log(sizes[k] / total) for k in languages]), table_of([found.get(k, flat) for k in languages], names)


@tidy
def _predict_batches(batches, model, vocabulary: str):
    import pyarrow as pa

    languages, prior, table = model.value
    scorer = Scorer(pieces(vocabulary), table) if languages else None
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and chars < 2_000_000:
                chars += len(texts[stop] or "")
                stop += 1
            names, scores = [], []
            for logs in scorer.score(texts[at:stop]) if scorer else [None] * (stop - at):
                if logs is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                logs = logs + prior
                best = int(np.argmax(logs))
                names.append(languages[best])
                scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_pydict(
                {"_id": ids.slice(at, stop - at), "lang_pred": names, "score": pa.array(scores, pa.float64())}
            )
            at = stop


def predict(df: DataFrame, model, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, lang_pred, score (posterior of lang_pred, 0 to 1).

    ``und`` with score 0 where the text is null, empty or has no letter, or where
    there was nothing to learn from.  Ties go to the first language by name.  A null
    id is ordered last; an empty table gives an empty result.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # pieces of the vocabulary x languages
    rows = df.select(order_id(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(
        lambda batches: _predict_batches(batches, shared, vocabulary), "_id long, lang_pred string, score double"
    )


@tidy
def _keep_batches(batches, model, vocabulary: str, text_at: int, least: float):
    import pyarrow as pa

    languages, prior, table = model.value
    scorer = Scorer(pieces(vocabulary), table) if languages else None
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        keep = []
        for logs in (x for lo in range(0, len(texts), 500) for x in (scorer.score(texts[lo : lo + 500]) if scorer else [])):
            logs = None if logs is None else logs + prior
            keep.append(logs is not None and 1.0 / np.exp(logs - logs.max()).sum() >= least)
        if keep:
            yield batch.filter(pa.array(keep))


def keep_identified(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5
) -> DataFrame:
    """The rows whose language is told with a score of ``least`` or more, with all
    their columns; the model is that of identify().  Texts without letters, null and
    empty ones go; rows with a null id and repeated rows are judged like others; an
    empty table gives an empty result."""
    model = train(df.where(fold(id_col, 3) != 1), vocabulary, id_col, text_col, lang_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # pieces of the vocabulary x languages
    at = df.columns.index(text_col)
    return df.mapInArrow(lambda batches: _keep_batches(batches, shared, vocabulary, at, least), df.schema)


def identify(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    **limits: int,
) -> DataFrame:
    """Learn from the rows whose fold (crc32 of the id, modulo 3) is not 1 and predict all:
    id, held_out, lang_pred, score.

    Only the text is an input of a prediction.  A null id is in fold 0; rows
    without text or language teach nothing; repeated rows each get a row; other
    columns are ignored; an empty table gives an empty result.
    """
    taught = df.where(fold(id_col, 3) != 1)
    model = train(taught, vocabulary, id_col, text_col, lang_col, **limits)
    out = predict(df, model, vocabulary, id_col, text_col).withColumn(id_col, id_of(F.col("_id")))
    return out.select(id_col, (fold(id_col, 3) == 1).alias("held_out"), "lang_pred", "score")

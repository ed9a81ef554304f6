"""Language identification with a blended-spectrum presence kernel.

A text's features are which byte 2-, 3- and 4-grams of its lower-cased UTF-8 it has, hashed to
2**20 slots; none is left out. The kernel of two texts is the cosine of those presence sets. Nystrom
landmarks (training texts drawn evenly from the languages) turn kernel rows into coordinates in which
one ridge regression a language, one against the rest, is solved in closed form. Scoring is two matrix
products a batch: presence by landmark features (slots that no landmark has add to a text's norm
alone), then kernel rows by weights.

Training takes at most ``max_rows`` labelled rows (or ``LEAST_ROWS`` a language, where that is more) and
``max_bytes`` of their text, each language its part, chosen by a hash of the id and spread over the languages; of a text
longer than a 64th of the bytes or a quarter of its language's part the beginning is learned from. Every language is learned. Predictions read whole texts and nothing else. A null text or one without a letter is ``und``
with score 0; where nothing could be learned every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDERS = (2, 3, 4)
TABLE_BITS = 20
#: So many rows of each language are drawn at least, as far as there are.
LEAST_ROWS = 8
LETTER = regex.compile(r"\p{L}")


def gram_slots(buf: np.ndarray, order: int) -> np.ndarray:
    """For each place the table slot of the n-gram that starts there."""
    n = len(buf) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = buf[:n].astype(np.uint32)
    for i in range(1, order):
        code = (code << np.uint32(8)) | buf[i : n + i]
    return ((code + np.uint32(order)) * np.uint32(2654435761) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.decode().lower().encode() for t in texts]


class Presence:
    """0/1 rows of the n-gram slots of texts, and how many slots each text has. ``column`` maps slots to
    columns, with the last column for all others."""

    def __init__(self, column: np.ndarray, width: int):
        self.column, self.width = column, width
        self._last = np.zeros(1 << TABLE_BITS, np.int32)

    def __getstate__(self):
        return self.column, self.width

    def __setstate__(self, state):
        self.__init__(*state)

    def slots(self, text: bytes) -> np.ndarray:
        """The distinct slots of a text's n-grams."""
        buf = np.frombuffer(text, np.uint8)
        every = np.concatenate([gram_slots(buf, o) for o in ORDERS])
        number = np.arange(len(every), dtype=np.int32)
        self._last[every] = number  # of equal slots the last stays
        return every[self._last[every] == number]

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out, size = np.zeros((len(texts), self.width + 1), np.uint8), np.zeros(len(texts))
        for i, t in enumerate(texts):
            slots = self.slots(t)
            out[i, self.column[slots]] = 1
            size[i] = len(slots)
        return out[:, : self.width], size


class Model:
    """``languages`` and, if any were learned, the arrays that score."""

    def __init__(self, languages, presence=None, landmarks=None, weights=None):
        self.languages, self.presence, self.landmarks, self.weights = languages, presence, landmarks, weights

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        """The kernel of each lower-cased text with each landmark."""
        out = [np.zeros((0, len(self.landmarks)), np.float32)]
        for lo, hi in C.slices([len(t) + 100_000 for t in texts], 1 << 22):
            rows, size = self.presence.rows(texts[lo:hi])
            out.append(rows.astype(np.float32) @ self.landmarks.T / np.sqrt(np.maximum(size, 1))[:, None].astype(np.float32))
        return np.concatenate(out)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A row of one-against-rest outputs for each lower-cased text."""
        kernel = self.kernel(texts)
        return np.concatenate([kernel, np.ones((len(texts), 1), np.float32)], axis=1) @ self.weights


def fit(texts: list[bytes], langs: list[str], landmarks: int = 96, ridge: float = 1e-2) -> Model:
    languages = sorted(set(langs))
    if not languages:
        return Model([])
    texts = lowered(texts)
    y = np.array([languages.index(x) for x in langs])
    # landmarks: evenly from the languages, in the given order
    rank = np.zeros(len(y), np.int64)
    for k in range(len(languages)):
        rank[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((y, rank))[: max(landmarks, 2 * len(languages))]
    every = Presence(np.zeros(1 << TABLE_BITS, np.int32), 0)
    known = np.unique(np.concatenate([every.slots(texts[i]) for i in chosen]))
    column = np.full(1 << TABLE_BITS, len(known), np.int32)
    column[known] = np.arange(len(known))
    presence = Presence(column, len(known))
    rows, size = presence.rows([texts[i] for i in chosen])
    z = rows.astype(np.float32) / np.sqrt(np.maximum(size, 1))[:, None].astype(np.float32)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values.max() if values.max() > 0 else values > 0
    root = vectors[:, keep] / np.sqrt(values[keep])
    model = Model(languages, presence, z)
    coordinates = np.concatenate([model.kernel(texts) @ root, np.ones((len(texts), 1))], axis=1)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # each language counts alike
    share = (1.0 / np.bincount(y, minlength=len(languages)))[y][:, None] * len(y) / len(languages)
    penalty = ridge * len(y) * np.eye(coordinates.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.solve(coordinates.T @ (share * coordinates) + penalty + 1e-9 * np.eye(len(penalty)), coordinates.T @ (share * target))
    model.weights = np.concatenate([root @ solved[:-1], solved[-1:]]).astype(np.float32)
    return model


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 4000, max_bytes: int = 64 << 20) -> Model:
    """A model of the rows that are not held out and have text and lang."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("binary").alias("t"), F.col(lang).alias("l"), C.held_out(doc_id).alias("h")).where("not h and t is not null and l is not null")
    counts = rows.groupBy("l").count().collect()  # a row for each language
    if not counts:
        return Model([])
    each = max(LEAST_ROWS, max_rows / len(counts))
    # a hashed share of each language, of about ``each`` rows; the final limits are the bounds
    shares = docs.sparkSession.createDataFrame([(r["l"], min(1.0, each / r["count"])) for r in counts], "l string, share double")
    u = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("language sample")), F.lit(1 << 30)) / (1 << 30)
    sample = rows.withColumn("u", u).join(F.broadcast(shares), "l").where("u < share").select("i", "l", "t", (F.col("u") / F.col("share")).alias("o"))
    got = C.within_bytes(sample, ["i", "l"], ["o", "l"], "t", "l", len(counts), max(max_rows, LEAST_ROWS * len(counts)), max_bytes)
    return fit([bytes(r["t"]) for r in got], [r["l"] for r in got])


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Each row of ``docs`` as struct ``row``, with lang_pred and lang_score (the best
    language's share)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 slots, and the landmarks' n-grams by the landmarks

    def make():
        m = shared.value

        def step(raw: list):
            texts = [(t or b"").decode() for t in raw]
            known = np.array([bool(m.languages) and LETTER.search(t) is not None for t in texts], bool)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            at = np.flatnonzero(known)
            if len(at):
                s = m.scores([texts[i].lower().encode() for i in at.tolist()])
                e = np.exp(4.0 * (s - s.max(axis=1, keepdims=True)))
                lang[at] = np.array(m.languages, object)[s.argmax(axis=1)]
                score[at] = np.clip(e.max(axis=1) / e.sum(axis=1), 0, 1)
            return {"lang_pred": pa.array(lang.tolist(), pa.string()), "lang_score": score}

        return step

    return C.judge_rows(docs, text, make, "lang_pred string, lang_score double")


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    told = judge(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), model)
    return told.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", F.col("lang_score").alias("score"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", C.held_out().alias("held_out"), "lang_pred", "score")

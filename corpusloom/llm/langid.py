"""Language identification with string kernels.

A text is the set of byte 1-, 2- and 3-grams of its lower-cased letters (everything else is one blank): the
blended-spectrum presence kernel of two texts is the number of grams they share, divided by the geometric mean of
their numbers of grams. The grams are those of the landmarks, a bounded sample of labelled texts. Nyström maps a text
to its kernel values with the landmarks times the inverse root of the landmarks' own kernel matrix; on that map,
one-versus-rest ridge regression is fitted in closed form. Scoring is a product of matrices per batch of texts.

Defined cases: a text that is null or has no letter gets ``und`` with score 0; so does every text where nothing
could be learned; rows that share a doc_id are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusloom.llm.common import held_out

UNKNOWN = "und"
#: Bounds of the fit: labelled rows per language and in all, landmarks per language and in all, characters of a
#: text that may be a sample row, and grams kept (those in most landmarks).
ROWS_PER_LANGUAGE, ROWS = 500, 16_384
LANDMARKS_PER_LANGUAGE, LANDMARKS = 48, 512
FIT_CHARS = 200_000
GRAMS = 16_384
RIDGE = 1e-3
#: How steeply the one-versus-rest values (about -1 to 1) turn into a score.
SHARPNESS = 4.0
ROWS_AT_ONCE = 64
#: Grams of three bytes come first, then those of two, then single bytes.
TWO, ONE, ALL = 1 << 24, (1 << 24) + (1 << 16), (1 << 24) + (1 << 16) + 256


def grams(text: str):
    """Numbers of the text's grams, with repeats."""
    import numpy as np

    b = BLANKED[np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)]
    two = (b[:-1] << 8) | b[1:]
    return np.concatenate([(two[:-1] << 8) | b[2:], two + TWO, b + ONE])


def _blanked():
    import numpy as np

    letters = set(range(ord("a"), ord("z") + 1)) | set(range(128, 256))
    return np.array([x if x in letters else 32 for x in range(256)], dtype=np.int32)


BLANKED = _blanked()


class Model:
    """Landmark rows over the kept grams, and per language the weights of the kernel values."""

    def __init__(self, kept, landmarks, languages=(), weights=None, bias=None):
        self.kept, self.landmarks = kept, landmarks  # gram numbers; presence as uint8, landmark by gram
        self.languages, self.weights, self.bias = list(languages), weights, bias

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("kept", "landmarks", "languages", "weights", "bias")}

    @cached_property
    def place(self):
        import numpy as np

        place = np.full(ALL, len(self.kept), dtype=np.int16)
        place[self.kept] = np.arange(len(self.kept))
        return place

    @cached_property
    def scaled(self):
        import numpy as np

        rows = self.landmarks.astype(np.float32)
        return (rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))).T.copy()

    def kernel(self, texts: list[str]):
        """Kernel of each text with each landmark: presence rows times landmark columns."""
        import numpy as np

        rows = np.zeros((len(texts), len(self.kept) + 1), dtype=np.float32)
        for row, text in zip(rows, texts, strict=True):
            row[self.place[grams(text)]] = 1
        rows = rows[:, :-1]
        return (rows @ self.scaled) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        import numpy as np

        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.languages or not known:
            return out
        values = SHARPNESS * (self.kernel([texts[k] for k in known]) @ self.weights + self.bias)
        values = np.exp(values - values.max(axis=1, keepdims=True))
        values /= values.sum(axis=1, keepdims=True)
        for k, best, row in zip(known, values.argmax(axis=1).tolist(), values, strict=True):
            out[k] = (self.languages[best], float(row[best]))
        return out


def sample(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text, landmark) of labelled training rows: per language those with the smallest hashes."""
    rows = docs.filter(
        ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
        & F.col("text").rlike(r"\p{L}") & (F.length("text") <= FIT_CHARS)
    ).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= ROWS_PER_LANGUAGE).orderBy("nth", "lang").limit(ROWS)
    few = few.groupBy("doc_id").agg(F.min("nth").alias("nth"), F.min("lang").alias("lang"))
    texts = docs.filter(F.length("text") <= FIT_CHARS).select("doc_id", "text")
    # Of rows that share an id the least text is learned from, so that reruns learn the same.
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "nth", "lang").agg(F.min("text").alias("text"))


def fit(docs: DataFrame) -> Model:
    """Learn from ``text`` and non-null ``lang`` of rows outside the held-out fold; the bounds are constants above.

    To the driver go the landmarks' grams and the sample's kernel values, both bounded by them.
    """
    import numpy as np
    import pandas as pd

    from corpusloom.llm.common import stored

    rows = stored(sample(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")), "language-sample")

    def presence(parts):
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "grams": [np.unique(grams(t)).astype(np.int32) for t in part["text"]]})

    marks = rows.filter(F.col("nth") <= LANDMARKS_PER_LANGUAGE).orderBy("nth", "lang", "doc_id").limit(LANDMARKS)
    marks = [np.array(r["grams"]) for r in marks.select("doc_id", "text").mapInPandas(presence, "doc_id bigint, grams array<int>").orderBy("doc_id").collect()]
    if not marks:
        return Model(np.zeros(0, np.int32), np.zeros((0, 0), np.uint8))
    number, times = np.unique(np.concatenate(marks), return_counts=True)
    kept = np.sort(number[np.lexsort((number, -times))[:GRAMS]])
    model = Model(kept, np.stack([np.isin(kept, m) for m in marks]).astype(np.uint8))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def kernels(parts):
        for part in parts:
            for k in range(0, len(part), ROWS_AT_ONCE):
                some = part.iloc[k : k + ROWS_AT_ONCE]
                yield pd.DataFrame({"doc_id": some["doc_id"], "lang": some["lang"], "k": list(shared.value.kernel(some["text"].tolist()))})

    found = rows.select("doc_id", "lang", "text").mapInPandas(kernels, "doc_id bigint, lang string, k array<float>").orderBy("doc_id").collect()
    own = np.array([np.array(r["k"], dtype=np.float64) for r in found])
    among = model.landmarks.astype(np.float64) @ model.scaled.astype(np.float64)
    among /= np.sqrt(np.maximum(model.landmarks.sum(axis=1, dtype=np.float64)[:, None], 1))
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    mapped = own @ root
    centre = mapped.mean(axis=0)
    languages = sorted({r["lang"] for r in found})
    wanted = np.where(np.array([r["lang"] for r in found])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    offset = wanted.mean(axis=0)
    moved = mapped - centre
    ridge = moved.T @ moved + RIDGE * len(found) * np.eye(moved.shape[1]) / 100
    beta = np.linalg.solve(ridge, moved.T @ (wanted - offset))
    model.languages, model.weights = languages, (root @ beta).astype(np.float32)
    model.bias = (offset - centre @ beta).astype(np.float32)
    return model


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) with ``lang_pred`` and ``score`` of the whole ``text``.
    Columns of those names in ``docs`` are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                langs, scores = zip(*shared.value.predict(part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*keep, "lang_pred", "score"],
                )

    read = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = [docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return read.mapInArrow(score, T.StructType(fields))

"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes: insult (learned word beginnings, with weights), threat, target, negation, reported speech,
other. Four weighted transducers rewrite a clause's classes: negation and reported speech mark the insults in their
reach, target turns insults near a person into aimed ones, threat keeps a threat only if its target follows. Their
composition is one transducer; the best path through it labels the clause. A document is the weights of its
labelled insults summed by label; logistic regression on these sums gives the score. So a word counts by the
clause it stands in, as far as the labels bear that out. The rows of the sample are weighted by how many labelled
rows of their kind they stand for, so the score means the same at every table size.

Defined cases: null, empty and unmatched texts get the score of a text without any match; documents without label
or with a null label teach nothing, repeated labels count as toxic if any says so; without labels of both kinds
every score is 0; rows that share a doc_id are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import held_out

#: Bounds of the fit: labelled rows of each kind, word beginnings looked at and kept.
TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
CANDIDATES, STEMS = 20_000, 1000
STEM_LENGTHS = range(3, 10)
#: Standard errors that a stem's log odds must be above 0; few of the candidates get there by chance.
SURE = 4.5
ROWS_AT_ONCE = 256
WORD = re.compile(r"[^\W\d_]+")
EDGE = re.compile(r"[.!?;:|\n]")

#: Fixed word lists of the grammar (English, German, French, Spanish).
TARGETS = frozenset(
    "you your yours yourself he him his she her they them their people du dich dir dein deine ihr euch euer sie ihn ihm "
    "tu te toi ton ta tes vous votre vos il elle eux usted ustedes tú ti tu él ella ellos".split()
)
NEGATIONS = frozenset("not no never nobody none neither nor kein keine keinen nicht nie niemals pas jamais aucun nunca jamás tampoco".split())
REPORTS = frozenset(
    "said says say wrote writes called claimed quoted sagte sagt schrieb nannte meinte dit disait écrit appelé dijo dice escribió llamó".split()
)
THREATS = frozenset(
    "kill hurt destroy shoot stab burn beat hang töte töten umbringen erschlagen schlagen tuer frapper brûler détruire matar golpear quemar destruir".split()
)
#: Labels a best path can give to a word that counts.
LABELS = ("insult", "aimed", "negated", "reported", "threat")


class Transducer:
    """Arcs (state, symbol) -> [(next state, output, weight)]; a symbol without arcs at a state passes unchanged to
    ``default(state)``. Final states have weights; paths with the largest sum win."""

    def __init__(self, arcs, final, default=lambda state: state, start=0):
        self.arcs, self.final, self.default, self.start = arcs, final, default, start

    def step(self, state, symbol):
        return self.arcs(state, symbol) or [(self.default(state), symbol, 0.0)]

    def compose(self, other: Transducer) -> Transducer:
        """Reads what this one reads and writes what ``other`` writes on this one's output."""

        def arcs(state, symbol):
            return [
                ((a, b), out, w + v)
                for a, mid, w in self.step(state[0], symbol)
                for b, out, v in other.step(state[1], mid)
            ]

        return Transducer(arcs, lambda s: self.final(s[0]) + other.final(s[1]), start=(self.start, other.start))

    def best(self, symbols: list[str]) -> list[str]:
        paths = {self.start: (0.0, ())}
        for symbol in symbols:
            nxt = {}
            for state, (weight, out) in paths.items():
                for to, written, w in self.step(state, symbol):
                    if to not in nxt or nxt[to][0] < weight + w:
                        nxt[to] = (weight + w, (out, written))
            paths = nxt
        _, out = max(((w + self.final(s), out) for s, (w, out) in paths.items()), key=lambda x: x[0])
        words = []
        while out:
            out, last = out
            words.append(last)
        return words[::-1]


NEVER = -1e9
NO_END = lambda state: 0.0


def marks_behind(trigger: str, reach: int, rewrites: dict[str, str]) -> Transducer:
    """Rewrites symbols up to ``reach`` words behind a trigger."""

    def arcs(state, symbol):
        if symbol == trigger:
            return [(reach, symbol, 0.0)]
        if state and symbol in rewrites:
            return [(state - 1, rewrites[symbol], 1.0)]
        return []

    return Transducer(arcs, NO_END, default=lambda s: max(0, s - 1))


def near_target(reach: int) -> Transducer:
    """An insult is aimed if a target stands up to ``reach`` words before or behind it. States: words since the last
    target as 1..reach counting down, 0 if none, and -k: a target is owed within k words."""

    def arcs(state, symbol):
        if symbol == "target":
            return [(reach, symbol, 0.0)]
        if state < 0:
            return [(state + 1, "aimed" if symbol == "insult" else symbol, 0.0)] if state < -1 else [(-99, symbol, NEVER)]
        if symbol == "insult":
            if state:
                return [(state - 1, "aimed", 1.0)]
            return [(0, "insult", 0.0), (-reach - 1, "aimed", 1.0)]
        return []

    return Transducer(arcs, lambda s: NEVER if s < 0 else 0.0, default=lambda s: max(0, s - 1))


def threats(reach: int) -> Transducer:
    """A threat word stays a threat if a target follows within ``reach`` words, else it is any word."""

    def arcs(state, symbol):
        if symbol == "target":
            return [(0, symbol, 0.0)]
        if symbol == "threat":
            return [(state, "other", 0.0), (reach, "threat", 1.0)] if not state else [(state - 1, "threat", 1.0)]
        if state == 1:
            return [(1, symbol, NEVER)]
        return []

    return Transducer(arcs, lambda s: NEVER if s else 0.0, default=lambda s: max(0, s - 1))


def grammar() -> Transducer:
    out = threats(4)
    out = out.compose(marks_behind("negation", 3, {"insult": "negated", "threat": "negated"}))
    out = out.compose(marks_behind("report", 6, {"insult": "reported", "threat": "reported"}))
    return out.compose(near_target(3))


class Model:
    """Word beginnings with weights, and the logistic weights of the label sums."""

    def __init__(self, stems: dict[str, float], weights=None, bias: float = 0.0):
        self.stems, self.weights, self.bias = stems, weights, bias

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights, "bias": self.bias}

    @cached_property
    def finder(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for word in {*self.stems, *THREATS}:
            found.add_word(word, len(word))
        found.make_automaton()
        return found

    @cached_property
    def grammar(self):
        return grammar()

    def stem(self, word: str) -> float:
        return max((self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if n <= len(word)), default=0.0)

    def classes(self, words: list[str]) -> list[str]:
        return [
            "insult" if self.stem(w) else "threat" if w in THREATS else "target" if w in TARGETS
            else "negation" if w in NEGATIONS else "report" if w in REPORTS else "other"
            for w in words
        ]

    def features(self, text: str | None) -> list[float]:
        """log(1 + sum of weights) of each label over the clauses that hold an insult or a threat word."""
        import math

        sums = dict.fromkeys(LABELS, 0.0)
        low, done = (text or "").lower(), -1
        for end, length in self.finder.iter(low):
            start = end - length + 1
            if start <= done or start and low[start - 1].isalpha():
                continue
            a = max(low.rfind(c, 0, start) for c in ".!?;:|\n") + 1
            edge = EDGE.search(low, end + 1)
            done = edge.start() if edge else len(low)
            words = WORD.findall(low[a:done])
            for word, label in zip(words, self.grammar.best(self.classes(words)), strict=True):
                if label in sums:
                    sums[label] += self.stem(word) or 1.0
        return [math.log1p(sums[x]) for x in LABELS]

    def score(self, text: str | None) -> float:
        import math

        if self.weights is None:
            return 0.0
        x = self.bias + sum(w * v for w, v in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def stem_counts(texts: DataFrame) -> DataFrame:
    """(stem, n): in how many different contexts a word begins so. A context is a word with its neighbours, so that
    copies of a text count once. Words give way to their beginnings after the contexts are counted."""

    def contexts(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column("text"):
                words = ["", *WORD.findall((text.as_py() or "").lower()), ""]
                found = {*zip(words[1:], words, words[2:], strict=False)}
                found = [f for f in found if f[0]]
                yield pa.RecordBatch.from_pydict({"word": [f[0] for f in found], "near": [f"{f[1]} {f[2]}" for f in found]}, schema=pa.schema([("word", pa.string()), ("near", pa.string())]))

    seen = texts.select("text").mapInArrow(contexts, "word string, near string").distinct().groupBy("word").count()
    lengths = F.sequence(F.lit(STEM_LENGTHS.start), F.least(F.length("word"), F.lit(STEM_LENGTHS.stop - 1)))
    long = seen.filter(F.length("word") >= STEM_LENGTHS.start)
    stems = long.select("count", F.explode(F.transform(lengths, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("stem"))
    return stems.groupBy("stem").agg(F.sum("count").alias("n"))


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> tuple[float, float]:
    """How much likelier toxic texts have it (log), and the root of the likelihood ratio statistic of that, which is
    about as many standard errors."""
    import math

    weight = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    share = (toxic + clean) / max(n_toxic + n_clean, 1)
    ratio = sum(x * math.log(x / (share * n)) for x, n in ((toxic, n_toxic), (clean, n_clean)) if x and n)
    return weight, math.copysign(math.sqrt(max(0.0, 2 * ratio)), weight)


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Stems whose log odds are large and sure. A stem that nearly always goes on with the same letter gives way to
    the longer one; else a longer stem stays beside a shorter one only if it is surely more toxic than the texts
    that have the shorter one alone."""
    longer: Counter[str] = Counter()
    for stem, t in toxic.items():
        longer[stem[:-1]] = max(longer[stem[:-1]], t)
    kept: dict[str, tuple[float, int, int]] = {}
    for stem in sorted(toxic, key=lambda s: (len(s), s)):
        t, c = toxic[stem], clean.get(stem, 0)
        if longer[stem] >= 0.97 * t:
            continue
        weight, sure = log_odds(t, c, n_toxic, n_clean)
        if weight < 1.0 or sure < SURE:
            continue
        shorter = next((s for n in sorted(STEM_LENGTHS, reverse=True) if n < len(stem) and (s := stem[:n]) in kept), None)
        if shorter:
            _, more, less = kept[shorter]
            if log_odds(t, c, max(0, more - t), max(0, less - c))[1] < SURE:
                continue
        kept[stem] = weight, t, c
    return {s: w for s, (w, t, _) in sorted(kept.items(), key=lambda x: (-x[1][0] * x[1][1], x[0]))[:STEMS]}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled texts outside the held-out fold; to the driver go candidate counts and label sums of the
    sample, bounded by the constants above."""
    import numpy as np
    import pandas as pd

    from corpusloom.llm.common import stored

    known = labels.select("doc_id", "toxic").filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counted = known.agg(*[F.count(F.when(F.col("toxic") == kind, 1)).alias(str(kind)) for kind in (1, 0)]).first()
    few = [
        known.filter(F.col("toxic") == kind).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(n).drop("h")
        for kind, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))
    ]
    rows = docs.select("doc_id", "text").join(F.broadcast(few[0].unionByName(few[1])), "doc_id")
    # Of rows that share an id the least text is learned from, so that reruns learn the same.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = stored(rows, "toxicity-sample")
    counts = stored(stem_counts(rows.filter("toxic = 1")).withColumnRenamed("n", "t").join(
        stem_counts(rows.filter("toxic = 0")).withColumnRenamed("n", "c"), "stem", "full"
    ).select("stem", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("c", F.lit(0)).alias("c")), "toxicity-stems")
    totals = counts.filter(F.length("stem") == STEM_LENGTHS.start).agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    n_toxic, n_clean = totals["t"] or 0, totals["c"] or 0
    if not n_toxic or not n_clean:
        return Model({})
    gain = F.col("t") / n_toxic - F.col("c") / n_clean
    top = counts.filter((F.col("t") >= 3) & (gain > 0)).orderBy(F.desc(gain), "stem").limit(CANDIDATES).collect()
    model = Model(choose({r["stem"]: r["t"] for r in top}, {r["stem"]: r["c"] for r in top}, n_toxic, n_clean))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def featured(parts):
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"], "x": [shared.value.features(t) for t in part["text"]]})

    found = rows.select("doc_id", "toxic", "text").mapInPandas(featured, "doc_id bigint, toxic int, x array<double>").orderBy("doc_id").collect()
    x = np.array([[1.0, *r["x"]] for r in found])
    y = np.array([r["toxic"] for r in found], dtype=float)
    # A row stands for all labelled rows of its kind, so that the share of toxic ones is the whole table's.
    stands = np.where(y == 1, max(1.0, counted["1"] / TOXIC_ROWS), max(1.0, counted["0"] / CLEAN_ROWS))
    stands *= len(stands) / stands.sum()
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (stands * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (stands * (y - p)) - ridge @ w)
        w += step
        if abs(step).max() < 1e-6:
            break
    model.bias, model.weights = float(w[0]), [float(v) for v in w[1:]]
    return model


def rate(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) with ``score`` and ``predicted`` of the whole ``text``.
    Columns of those names in ``docs`` are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                scores = [shared.value.score(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(scores, pa.float64())], names=[*keep, "score"])

    read = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = [docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())]
    return read.mapInArrow(score, T.StructType(fields)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Toxicity: a weighted finite-state grammar over clauses.

Words become token classes: insults and threats by a weighted lexicon of words and word beginnings, targets, negations and
reporting verbs by fixed lists. Small transducers read the classes of a clause side by side (their composition is one
table); the state at the end of the clause says what it is: an insult, one aimed at somebody, a negated or a reported one,
a threat. A document's features are the weights of its clauses by kind; a logistic regression turns them into a score.

The lexicon and the regression are learned from a bounded sample of labelled rows. Scoring is one scan without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfeat.llm.text import REMEMBERED_WORDS, by_batch, by_partition, crc_mod5, texts_of

#: Labelled rows the model is learned from, by a hash of doc_id: at most this many.
SAMPLE_ROWS = 20_000

#: Entries of the learned lexicon at most, least log-odds of an entry, and by how many standard deviations it has to stand
#: in more toxic documents than chance lets it (of very many candidates some are rare and in toxic documents only).
LEXICON, LEAST_ODDS, SURE = 5_000, 3.0, 4.0

#: Lengths of word beginnings that can be entries; whole words are too.
BEGINNINGS = range(3, 8)

# Fixed word lists of the grammar, in English, German, French and Spanish.
INSULTS = {
    "idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "loser", "losers", "pathetic", "worthless", "disgusting", "clown",
    "dumb", "fool", "vermin", "dummkopf", "abschaum", "versager", "trottel", "imbécile", "ordure", "minable", "crétin", "imbécil", "basura",
    "escoria", "perdedor",
}
THREATS = {"kill", "hurt", "destroy", "beat", "murder", "töten", "vernichten", "tuer", "détruire", "frapper", "matar", "destruir", "golpear"}
TARGETS = {
    "you", "your", "he", "she", "they", "them", "him", "people", "du", "dich", "ihr", "euch", "sie", "er", "tu", "vous", "toi", "ils",
    "elle", "tú", "ustedes", "ellos", "ella", "vosotros",
}
NEGATIONS = {"not", "no", "never", "isn't", "aren't", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "ningún"}
REPORTS = {"said", "says", "wrote", "called", "quoted", "sagte", "schrieb", "nannte", "dit", "écrit", "dijo", "escribió", "llamó"}

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
KINDS = ("plain", "aimed", "negated", "reported", "threat_aimed", "threat")

#: Used without labels: each kind's weight in the logistic regression, and the intercept last.
DEFAULT_WEIGHTS = (2.0, 2.5, 0.5, 0.5, 2.5, 1.0, -3.0)

#: Transducers by name: number of states, and the moves that leave a state (state, class) -> state.
TRANSDUCERS = {
    "insult": (2, {(0, INSULT): 1}),
    "threat": (2, {(0, THREAT): 1}),
    "target": (2, {(0, TARGET): 1}),
    # 1 to 3: one to three words after a negation; 4: an insult stood there.
    "negation": (5, {**{(s, NEGATION): 1 for s in range(4)}, **{(s, INSULT): 4 for s in (1, 2, 3)},
                     **{(s, c): s % 3 + 1 if s < 3 else 0 for s in (1, 2, 3) for c in (OTHER, THREAT, TARGET, REPORT)}}),
    # 1: a reporting verb stood before.
    "reported": (2, {(0, REPORT): 1}),
}


def compose() -> tuple[np.ndarray, list[int]]:
    """Moves of all transducers side by side, [state, class], and the kind of clause of each state; -1 for none."""
    sizes = [n for n, _ in TRANSDUCERS.values()]
    states = list(product(*map(range, sizes)))
    number = {s: i for i, s in enumerate(states)}
    moves = np.zeros((len(states), 6), np.int16)
    kinds = []
    for state in states:
        for c in range(6):
            moves[number[state], c] = number[tuple(m.get((s, c), s) for s, (_, m) in zip(state, TRANSDUCERS.values(), strict=True))]
        at = dict(zip(TRANSDUCERS, state, strict=True))
        if at["insult"]:
            kinds.append(KINDS.index("negated" if at["negation"] == 4 else "reported" if at["reported"] else "aimed" if at["target"] else "plain"))
        elif at["threat"]:
            kinds.append(KINDS.index("threat_aimed" if at["target"] else "threat"))
        else:
            kinds.append(-1)
    return moves, kinds


@dataclass
class Model:
    """Lexicon (entry -> weight; beginnings end in ``*``) and the regression's weights, intercept last."""

    lexicon: dict[str, float]
    weights: tuple[float, ...] = DEFAULT_WEIGHTS
    moves: np.ndarray = field(default_factory=lambda: compose()[0])
    kinds: list[int] = field(default_factory=lambda: compose()[1])


_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = b".!?;:|"


class Classes(dict):
    """Packed class of a word: class, 8 if it ends a clause, and 16 times its weight in hundredths."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        kind, weight = OTHER, 0.0
        for part in _WORD.findall(word.decode("utf-8", "replace").lower()):
            own, w = self.of(part)
            if own and (kind in (OTHER, TARGET) or w > weight):
                kind, weight = own, w
        value = self[word] = kind + 8 * (word[-1] in _CLAUSE_END) + 16 * round(100 * weight)
        return value

    def of(self, part: str) -> tuple[int, float]:
        for n in range(len(part), min(BEGINNINGS) - 1, -1):
            weight = self.lexicon.get(part if n == len(part) else part[:n] + "*") or (n == len(part) and self.lexicon.get(part + "*"))
            if weight:
                return (THREAT if part in THREATS else INSULT), weight
        if part in INSULTS:
            return INSULT, 3.0
        for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if part in words:
                return kind, 1.0 if kind == THREAT else 0.0
        return OTHER, 0.0


def clause_features(text: bytes, classes: Classes, model: Model) -> np.ndarray:
    """log(1 + weight) of a text's clauses of each kind."""
    out = np.zeros(len(KINDS))
    words = text.replace(b"\n", b" . ").split()
    packed = np.fromiter(map(classes.__getitem__, words), np.int64, len(words))
    marked = packed >= 16
    if not marked.any():
        return out
    ends = np.append(np.flatnonzero(packed & 8), len(words) - 1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    for k in np.unique(np.searchsorted(ends, np.flatnonzero(marked))):
        own = packed[starts[k]:ends[k] + 1]
        state = 0
        for c in (own & 7).tolist():
            state = model.moves[state, c]
        if model.kinds[state] >= 0:
            out[model.kinds[state]] += (own >> 4).sum() / 100
    return np.log1p(out)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text and toxic of labelled documents outside the held-out fold; the ids are at most ``rows``, so they are broadcast."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod5("doc_id") != 0)).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    known = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    return texts_of(docs, "doc_id").join(F.broadcast(known), "doc_id")


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and beginnings of words whose log-odds to stand in toxic documents are high."""

    def run(batches):
        seen: dict[str, list[int]] = {}
        docs = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                docs[toxic] += 1
                for word in set(_WORD.findall(text.decode("utf-8", "replace").lower())):
                    seen.setdefault(word, [0, 0])[toxic] += 1
        yield {"word": ["", *seen], "other": [docs[0], *(v[0] for v in seen.values())], "toxic": [docs[1], *(v[1] for v in seen.values())]}

    counted = by_partition(sample.select("text", "toxic"), "word string, other long, toxic long", run).groupBy("word").agg(
        F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    counted = counted.persist()
    try:
        totals = counted.where("word = ''").first()
        if totals is None or not totals.toxic or not totals.other:
            return {}
        begins = [F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in BEGINNINGS]
        entries = counted.where("word <> ''").select(F.explode(F.array_compact(F.array("word", *begins))).alias("entry"), "other", "toxic")
        odds = F.log((F.col("toxic") + 0.5) / (totals.toxic + 1.0)) - F.log((F.col("other") + 0.5) / (totals.other + 1.0))
        chance = (F.col("toxic") + F.col("other")) * (totals.toxic / (totals.toxic + totals.other))
        best = entries.groupBy("entry").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"), F.max("toxic").alias("most")).where(
            F.col("toxic") >= chance + SURE * F.sqrt(chance + 1)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
        rows = best.orderBy((F.col("odds") * F.col("toxic")).desc(), "entry").limit(LEXICON).collect()
    finally:
        counted.unpersist()
    # A beginning counts if it is that of several words, and unless a longer one says as much.
    toxic = {r.entry: r.toxic for r in rows}
    longer = {e[:-2] + "*": n for e, n in sorted(toxic.items(), key=lambda x: x[1]) if e.endswith("*")}
    return {r.entry: float(r.odds) for r in rows
            if not r.entry.endswith("*") or 2 * r.most < r.toxic and longer.get(r.entry, 0) < 0.9 * r.toxic}


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge penalty; the intercept is last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _features(df: DataFrame, model: Model, *keep: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)
    kinds = dict(df.dtypes)
    remembered: dict[str, Classes] = {}

    def run(batch):
        classes = remembered.setdefault("task", Classes(sent.value.lexicon))
        return {c: batch.column(c).to_pylist() for c in keep} | {
            "features": [clause_features(t, classes, sent.value) for t in batch.column("text").to_pylist()]}

    return by_batch(df, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", features array<double>", run)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from at most ``rows`` labelled rows whose crc32(doc_id) mod 5 is not 0.

    Without toxic and other rows among them the model is the fixed word lists with default weights.
    """
    sample = _sample(docs, labels, rows).persist()
    try:
        lexicon = _lexicon(sample)
        if not lexicon:
            return Model({})
        got = _features(sample, Model(lexicon), "doc_id", "toxic").orderBy("doc_id").collect()
    finally:
        sample.unpersist()
    return Model(lexicon, fit_weights(np.array([r.features for r in got]), np.array([float(r.toxic) for r in got])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and ``features`` of every row.

    Null and empty texts have no clauses and get the score of the intercept. Rows are scored by their text alone, so
    repeated rows agree; an empty table gives none; columns other than doc_id and text are not read.
    """
    *weights, intercept = model.weights
    total = sum((F.col("features")[i] * F.lit(w) for i, w in enumerate(weights)), F.lit(float(intercept)))
    scored = _features(texts_of(docs, "doc_id"), model, "doc_id").withColumn("score", 1 / (1 + F.exp(-total)))
    return scored.select("doc_id", F.coalesce(crc_mod5("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "features")

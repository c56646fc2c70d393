"""Quality rules: robust multivariate outliers among the statistics of documents of one language and source.

Each group's centre and covariance are its minimum-covariance-determinant estimate: from medians and median deviations,
concentration steps keep the closest share of the group and estimate anew. A step is two aggregations over a narrow table
of statistics, combined before the shuffle, so a hot group costs no more than others and nothing is gathered.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabfeat.llm.text import WordHashes, by_batch, bytes_of, free_name, keep_rows, texts_of, window_hashes
from tabfeat.session import cut_lineage

#: What counts as a symbol.
SYMBOLS = b"#*$%&|<>"

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5

#: The statistics of a document that are compared, each transformed to spread evenly.
FEATURES = ("words", "word_length", "symbols", "repeats", "capitals", "lines")

#: Least standard deviation of each of them, about its robust spread over all rows (0.9, 0.05, 0, 0, 0.17, 0 by median
#: deviations): well under what junk is away by. Repeated words and lines, which a rule or honest texts have too, count less.
FLOORS = (0.5, 0.05, 0.25, 1.0, 0.25, 1.0)

#: Share of a group that the concentration steps keep, number of steps, and tail probability of the distance that rejects.
SUPPORT, STEPS, TAIL = 0.75, 3, 1e-4

#: Added to a share and to what is left of it, so that its log-odds are finite.
SMOOTH = 0.01

#: A group's moments count against this many rows with its language's moments, so that small groups have sound ones.
PRIOR_ROWS = 50.0

#: Groups whose estimates (some 0.5 KB each) are broadcast.
MOST_GROUPS = 10_000

_WHITE = (9, 10, 11, 12, 13, 32)
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


def text_statistics(text: bytes, hashes: WordHashes) -> tuple[int, ...]:
    """The columns of the contract (words, their code points, symbols, duplicate lines, words in repeated windows), lines with a word, and capitals."""
    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - counts[0x80:0xC0].sum() - counts[list(_WHITE)].sum()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if len(words) > REPEAT_WINDOW:
        windows = window_hashes(hashes.of(words), REPEAT_WINDOW)
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        if times.max() > 1:
            cover = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(times[which] > 1)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + REPEAT_WINDOW, -1)
            repeated = int((np.cumsum(cover)[:-1] > 0).sum())
    return (len(words), int(chars), int(counts[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated, len(lines),
            int(counts[65:91].sum()))


def features_of(rows: np.ndarray) -> np.ndarray:
    """FEATURES of rows of ``text_statistics``: logarithms of lengths and log-odds of shares, which do not level off at high ones."""
    words, chars, symbols, lines_again, repeats, lines, capitals = rows.reshape(-1, 7).T.astype(float)

    def share(a, b):
        part = np.minimum(a / np.maximum(b, 1), 1.0)
        return np.log((part + SMOOTH) / (1 - part + SMOOTH))

    return np.stack([np.log1p(words), np.log(np.maximum(chars, 1) / np.maximum(words, 1)), share(symbols, chars), share(repeats, words),
                     share(capitals, chars), share(lines_again, lines)], axis=1)


def base_failed(rows: np.ndarray) -> np.ndarray:
    return (rows[:, 0] < MIN_WORDS) | (100 * rows[:, 4] > MAX_REPEAT_PERCENT * rows[:, 0])


def group_name(value: str | None) -> str:
    """Of a language or source, so that null is a name of its own."""
    return "" if value is None else f"={value}"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed and FEATURES of every row; null and empty texts have no words."""
    hashes = WordHashes()
    names = [c.split()[0] for c in _BASE.split(", ")]
    schema = f"doc_id long, lang string, source string, _lang string, _source string, {_BASE}, base_failed boolean, " + ", ".join(
        f"{f} double" for f in FEATURES)

    def run(batch):
        rows = np.array([text_statistics(t, hashes) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(names))
        out = {c: batch.column(c).to_pylist() for c in ("doc_id", "lang", "source")}
        out |= {f"_{c}": [group_name(v) for v in out[c]] for c in ("lang", "source")}
        return out | dict(zip(names, rows.T, strict=True)) | {"base_failed": base_failed(rows)} | dict(zip(FEATURES, features_of(rows).T, strict=True))

    return by_batch(texts_of(docs, "doc_id", "lang", "source"), schema, run)


def chi2_cdf(x: float, even: int) -> float:
    """Distribution function of chi-squared for an even number of degrees of freedom."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(even // 2))


def chi2_quantile(tail: float, even: int) -> float:
    """Where chi-squared has ``tail`` above it."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        middle = (low + high) / 2
        above = math.exp(-middle / 2) * sum((middle / 2) ** k / math.factorial(k) for k in range(even // 2))
        low, high = (middle, high) if above > tail else (low, middle)
    return high


def _squared_distance() -> Column:
    """Mahalanobis distance from the joined ``centre`` and ``inverse`` (upper triangle by rows)."""
    gaps = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    terms, k = [], 0
    for i in range(len(FEATURES)):
        for j in range(i, len(FEATURES)):
            terms.append(gaps[i] * gaps[j] * F.col("inverse")[k] * F.lit(1.0 if i == j else 2.0))
            k += 1
    return sum(terms[1:], terms[0])


_FIT = "_lang string, _source string, centre array<double>, inverse array<double>"


def _estimates(rows: DataFrame) -> DataFrame:
    """Centre and inverse covariance of each group of ``rows``, its moments blended with its language's."""
    p = len(FEATURES)
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    own = cut_lineage(rows.groupBy("_lang", "_source").agg(F.count("*").alias("n"), *sums, *products))
    moments = [c for c in own.columns if c not in ("_lang", "_source")]
    whole = own.groupBy("_lang").agg(*[F.sum(c).alias(f"l_{c}") for c in moments])
    floors = np.diag(np.square(FLOORS))
    # Covariance of the closest SUPPORT of a normal distribution, against that of all of it.
    consistent = SUPPORT / chi2_cdf(chi2_quantile(1 - SUPPORT, p), p + 2)

    def run(batch):
        out = {"_lang": batch.column("_lang").to_pylist(), "_source": batch.column("_source").to_pylist(), "centre": [], "inverse": []}
        for row in batch.to_pylist():
            def of(prefix, n, row=row):
                centre = np.array([row[f"{prefix}s{i}"] for i in range(p)]) / n
                second = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        second[i, j] = second[j, i] = row[f"{prefix}m{i}_{j}"] / n
                return centre, second

            (a, s), (b, t), w = of("", row["n"]), of("l_", row["l_n"]), row["n"] / (row["n"] + PRIOR_ROWS)
            centre, second = w * a + (1 - w) * b, w * s + (1 - w) * t
            spread = consistent * (second - np.outer(centre, centre)) + floors
            out["centre"].append(centre)
            out["inverse"].append(np.linalg.inv(spread)[np.triu_indices(p)])
        return out

    return cut_lineage(by_batch(own.join(whole, "_lang"), _FIT, run))


def _first_estimates(features: DataFrame) -> DataFrame:
    """Medians and median deviations, without correlations."""
    group = ["_lang", "_source"]
    medians = cut_lineage(features.groupBy(*group).agg(*[F.percentile_approx(f, 0.5).alias(f"c_{f}") for f in FEATURES]))
    deviations = features.join(medians, group).groupBy(*group).agg(
        *[F.first(f"c_{f}").alias(f"c_{f}") for f in FEATURES],
        *[F.percentile_approx(F.abs(F.col(f) - F.col(f"c_{f}")), 0.5).alias(f"d_{f}") for f in FEATURES])
    # 1.4826 times the median deviation is the standard deviation of normal values.
    inverse = [1.0 / (F.pow(1.4826 * F.col(f"d_{f}"), 2) + floor**2) if i == j else F.lit(0.0)
               for i, (f, floor) in enumerate(zip(FEATURES, FLOORS, strict=True)) for j in range(i, len(FEATURES))]
    return cut_lineage(deviations.select(*group, F.array(*[f"c_{f}" for f in FEATURES]).alias("centre"), F.array(*inverse).alias("inverse")))


def minimum_covariance(features: DataFrame) -> DataFrame:
    """Centre and inverse covariance by ``_lang`` and ``_source``: concentration steps over the table of statistics."""
    group = ["_lang", "_source"]
    fit = _first_estimates(features)
    for _ in range(STEPS):
        step = features.join(fit, group).withColumn("_d", _squared_distance())
        step = step.withColumn("_bin", F.floor(F.log1p("_d") * 200).cast("int"))
        counted = step.groupBy(*group, "_bin").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_bin"))
        all_rows = F.sum("_n").over(Window.partitionBy(*group))
        edges = counted.select(*group, "_bin", upto.alias("_upto"), all_rows.alias("_all")).where(
            F.col("_upto") >= SUPPORT * F.col("_all")).groupBy(*group).agg(F.min("_bin").alias("_edge"))
        fit = _estimates(step.join(edges, group).where("_bin <= _edge"))
    return fit


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance (squared, Mahalanobis) and kept of every row.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows. All others are kept unless their
    distance from their group has a tail probability under 1e-4 were the group normal. Null and empty texts have no words
    and fail; null languages and sources are groups of their own; repeated rows are judged alike; an empty table gives
    none. Columns other than doc_id, text, lang and source are not read.
    """
    features = cut_lineage(statistics(docs))
    fit = minimum_covariance(features)
    distance = features.join(fit, ["_lang", "_source"]).withColumn("distance", _squared_distance())
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(TAIL, len(FEATURES)))
    return distance.select("doc_id", "lang", "source", *[c.split()[0] for c in _BASE.split(", ")], "base_failed", "distance", kept.alias("kept"))


def _full(upper: list[float]) -> np.ndarray:
    """A symmetric matrix from its upper triangle by rows."""
    out = np.zeros((len(FEATURES),) * 2)
    out[np.triu_indices(len(FEATURES))] = upper
    return out + np.triu(out, 1).T


def _good(texts: list[bytes], fits: list[tuple[np.ndarray, np.ndarray]], most: float, hashes: WordHashes) -> np.ndarray:
    """Which texts pass the base rule and lie within ``most`` of the centre and inverse covariance of their group."""
    stats = np.array([text_statistics(t, hashes) for t in texts], np.int64).reshape(-1, 7)
    gaps = features_of(stats) - np.array([c for c, _ in fits]).reshape(-1, len(FEATURES))
    inverses = np.array([i for _, i in fits]).reshape(-1, len(FEATURES), len(FEATURES))
    return ~base_failed(stats) & (np.einsum("ni,nij,nj->n", gaps, inverses, gaps) <= most)


def _kept_by_fit(joined: DataFrame, columns: list[str], fit: str, most: float) -> DataFrame:
    """The kept rows of documents that have the estimates of their group beside them, in the column ``fit``."""
    hashes = WordHashes()

    def good(batch):
        fits = [(np.array(f["centre"]), _full(f["inverse"])) for f in batch.column(fit).to_pylist()]
        return _good(bytes_of(batch.column("text")), fits, most, hashes)

    return keep_rows(joined, good).select(*[F.col(f"`{c}`") for c in columns])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, each judged by itself, with all their columns.

    The estimates are one row per group; up to MOST_GROUPS of them go to every task, which judges texts where they lie.
    Beyond that each row is joined with the estimates of its own group. Either way no doc_id is looked at.
    """
    fit = minimum_covariance(cut_lineage(statistics(docs)))
    rows = fit.limit(MOST_GROUPS + 1).collect()
    most = chi2_quantile(TAIL, len(FEATURES))
    if len(rows) > MOST_GROUPS:
        lang, source, own = (free_name(docs, n) for n in ("_lang_of", "_source_of", "_fit"))
        keys = {n: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for n, c in ((lang, "lang"), (source, "source"))}
        estimates = fit.select(F.col("_lang").alias(lang), F.col("_source").alias(source), F.struct("centre", "inverse").alias(own))
        return _kept_by_fit(docs.withColumns(keys).join(estimates, list(keys), "left"), docs.columns, own, most)
    estimates = {(row._lang, row._source): (np.array(row.centre), _full(row.inverse)) for row in rows}
    sent, hashes = docs.sparkSession.sparkContext.broadcast(estimates), WordHashes()

    def good(batch):
        groups = zip(*([group_name(v) for v in batch.column(c).to_pylist()] for c in ("lang", "source")), strict=True)
        return _good(bytes_of(batch.column("text")), [sent.value[g] for g in groups], most, hashes)

    return keep_rows(docs, good)

"""Operators with a model: exact parts against brute force, the rest by accuracy on held-out rows."""

import contextlib
import io
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfeat.llm import bloom_lm, kneser_ney, toxicity, url_filter
from tabfeat.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"


def fold(doc):
    return zlib.crc32(str(doc).encode()) % 5


# ---- 3: toxicity -----------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    got = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (fold(d) == 0) for d, r in got.items())
    clean = [got[r.doc_id].predicted for r in labels if r.toxic == 0]
    assert np.mean(clean) < 0.02
    assert np.mean([got[r.doc_id].predicted for r in labels if r.toxic == 1]) > 0.6


def test_clauses_by_kind():
    model = toxicity.Model({})
    kinds = dict(zip(toxicity.KINDS, range(6)))

    def kind(text):
        f = toxicity.clause_features(text.encode(), toxicity.Classes({}), model)
        return [k for k, i in kinds.items() if f[i] > 0]

    assert kind("You are an idiot.") == ["aimed"] and kind("What an idiot!") == ["plain"]
    assert kind("This is not an idiot at all") == ["negated"] and kind("They said it was idiot talk") == ["reported"]
    assert kind("I will hurt you") == ["threat_aimed"] and kind("good words only") == []
    assert kind("no. What an idiot") == ["plain"]  # a clause ends at the full stop
    assert kind("") == []


def test_toxicity_of_odd_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    model = toxicity.learn(edge_docs, labels)  # no two classes: fixed lists
    rows = toxicity.score(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert not toxicity.score(no_docs, toxicity.learn(no_docs, labels)).count()


# ---- 6: language model -----------------------------------------------------------------------


def low(text):
    return (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()


def test_base_score_is_exact(spark, edge_docs, edge_rows):
    train = [low(t) + [None] for d, t, *_ in edge_rows if fold(d) != 1]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    got = sorted(bloom_lm.scored(edge_docs, bloom_lm.training_rows(edge_docs)).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    for r, (d, t, *_) in zip(got, sorted(edge_rows, key=lambda x: x[0]), strict=True):
        tokens = low(t) + [None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (d, len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_empty_training_and_table(spark, edge_docs, no_docs):
    rows = bloom_lm.scored(edge_docs, no_docs).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and abs(r.base_score) < 1e-6 for r in rows)
    assert not bloom_lm.scored(no_docs, no_docs).count()


def test_filter_gives_counts_back(spark, edge_docs, edge_rows):
    model = bloom_lm.learn(edge_docs, f"{spark.conf.get('spark.checkpoint.dir')}/filter-test")
    counts = Counter(w for _, t, *_ in edge_rows for w in low(t))
    words = sorted(counts, key=lambda w: (-counts[w], w))[:300]
    from tabfeat.llm.text import WordHashes

    got = model.filter().counts(WordHashes().of(words))
    want = np.array([counts[w] for w in words])
    assert model.least == 1 and np.mean(np.abs(np.log(got / want)) <= math.log(bloom_lm.BASE) + 1e-9) > 0.98


def test_score_uses_every_count(spark, edge_docs, edge_rows):
    """Pairs seen once included: scores are those of brute-force counts rounded to levels, but for false positives."""
    train = [low(t) + [None] for d, t, *_ in edge_rows if fold(d) != 1]
    words, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([None, *t], t, strict=False))
    total, vocabulary = sum(words.values()), len(words)

    def rounded(count):
        return bloom_lm._LEVEL_COUNTS[bloom_lm.level_of(np.array(count))] if count else 0.0

    def score(tokens):
        out = 0.0
        for a, b in zip([None, *tokens], tokens, strict=False):
            before = rounded(words[a])
            weight = bloom_lm.BIGRAM_WEIGHT * before / (before + bloom_lm.BIGRAM_HALF)
            single = (rounded(words[b]) + 0.5) / (total + 0.5 * (vocabulary + 1))
            out += math.log10((1 - weight) * single + weight * min(rounded(pairs[a, b]) / max(before, 1), 1.0))
        return out

    got = sorted(bloom_lm.scored(edge_docs, bloom_lm.training_rows(edge_docs)).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    for r, (d, t, *_) in zip(got, sorted(edge_rows, key=lambda x: x[0]), strict=True):
        if fold(d) != 1:
            assert r.score == pytest.approx(score(low(t) + [None]), rel=0.03)


def test_filter_grows_with_what_is_counted(spark, edge_docs):
    """No n-gram goes at any size: rare pairs are found, with questions in one slice or in all."""
    path = f"{spark.conf.get('spark.checkpoint.dir')}/filter-growth"
    small = bloom_lm.learn(edge_docs.where("doc_id < 13"), f"{path}-small")
    large = bloom_lm.learn(edge_docs, f"{path}-large")
    assert large.size > 4 * small.size
    from tabfeat.llm.text import WordHashes

    hashes, texts = WordHashes(), [r.text for r in edge_docs.where("doc_id = 13").collect()]
    pairs = np.unique(np.concatenate([bloom_lm.bigram_hashes(bloom_lm.token_hashes(t.encode(), hashes)) for t in texts]))
    for bits in (bloom_lm.LEAST_BITS, bloom_lm.SLICE_BITS):
        large.bits = bits
        assert (large.filter().counts(pairs, bloom_lm.BIGRAM) >= 1).all()
    unseen = np.arange(1, 20_000, dtype=np.uint64) * bloom_lm._PAIR
    assert (large.filter().counts(unseen, bloom_lm.BIGRAM) > 0).mean() < 0.05


# ---- 7: trusted style ------------------------------------------------------------------------


def test_probabilities_sum_to_one_and_prefer_what_was_seen(spark):
    rows = [(i, "en", ("the cat sat on the mat. " * 3 + f"word {i}").encode()) for i in range(30)]
    model = kneser_ney.train(spark.createDataFrame(rows, "doc_id long, lang string, text binary").select("lang", "text"))
    for table in model.tables.values():
        sums = (10.0 ** table.astype(float)).reshape(-1, kneser_ney.SYMBOLS).sum(1)
        assert np.allclose(sums, 1, atol=1e-4)
    assert model.perplexity("en", b"the cat sat on the mat")[1] < model.perplexity("en", b"xqz#zqx##qz")[1]
    assert model.perplexity("xx", b"the cat")[1] == model.perplexity("", b"the cat")[1]


def test_good_documents_stay(spark):
    got = {r.doc_id: r for r in QUERIES["op7_kneser_ney"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert np.mean([got[r.doc_id].kept for r in labels if r.quality == 1]) > 0.98
    assert np.mean([got[r.doc_id].kept for r in labels if r.quality == 0]) < 0.5


def test_style_of_odd_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, 1) for i in range(20, 60)], "doc_id long, quality int")
    rows = kneser_ney.classify(edge_docs, kneser_ney.learn(edge_docs, labels)).collect()
    assert len(rows) == edge_docs.count() and not any(r.kept for r in rows if r.n_symbols == 0)
    none = kneser_ney.learn(edge_docs, labels.where("quality = 0"))
    assert all(r.kept == (r.n_symbols > 0) for r in kneser_ney.classify(edge_docs, none).collect())
    assert not kneser_ney.classify(no_docs, none).count()


def test_every_language_has_its_model(spark, monkeypatch):
    """Languages beyond those that are broadcast are judged by their own texts, models and thresholds, as with all broadcast."""
    alphabets = ["abc", "def", "ghi", "jkl", "mno"]
    rows = [(100 * k + i, " ".join(letters[(i + j * j) % 3] * (1 + j % 3) for j in range(30 + i % 7)), f"l{k}", "s", None)
            for k, letters in enumerate(alphabets) for i in range(40 - k)]
    strange = [(9000 + k, "xyz zyx " * 20, f"l{k}", "s", None) for k in range(5)] + [(9100, "abc", "none", "s", None), (9101, "abc", None, "s", None)]
    docs = spark.createDataFrame(rows + strange, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    found = []
    for most in (8, 1):
        monkeypatch.setattr(kneser_ney, "RESIDENT", most)
        model = kneser_ney.learn(docs, labels)
        assert model.complete == (most == 8) and model.stored.count() == 6
        found.append(sorted(kneser_ney.classify(docs, model).collect()))
        assert {r.model for r in model.limits.collect()} == {"", *[f"l{k}" for k in range(5)]}
    for a, b in zip(*found, strict=True):
        assert a.doc_id == b.doc_id and a.kept == b.kept and a.perplexity == pytest.approx(b.perplexity, rel=1e-9)
    assert len({r.threshold for r in found[1] if r.doc_id < 9000}) == 5
    assert not any(r.kept for r in found[1] if 9000 <= r.doc_id < 9100)


def test_all_trusted_rows_train(spark, edge_docs):
    """Counts, and thresholds as percentile_disc gives them, are those of every trusted row."""
    labels = spark.createDataFrame([(i, 1) for i in range(1, 60)], "doc_id long, quality int")
    trusted = kneser_ney.trusted_texts(edge_docs, labels)
    texts = [(r.lang or "", (r.text or "").encode()) for r in edge_docs.collect()]
    assert sorted(map(tuple, ((r.lang, bytes(r.text)) for r in trusted.collect()))) == sorted(texts)
    want = Counter(int(c) for _, t in texts for c in kneser_ney.codes(t))
    assert {r.code: r.n for r in kneser_ney._counts(trusted).where("lang = ''").collect()} == want
    values = spark.range(3000).selectExpr("concat('m', id % 2) AS model", "1 + (id * id % 977) / 100 AS perplexity")
    wanted = values.groupBy("model").agg(F.expr(f"percentile_disc({kneser_ney.QUANTILE}) WITHIN GROUP (ORDER BY perplexity)").alias("cut"))
    assert sorted(kneser_ney._cut(values).collect()) == sorted(wanted.collect())


def test_training_takes_small_plans(spark, monkeypatch):
    """The orders share one branch of a plan: what the driver holds (threads, generated code, plans) grows with its exchanges."""
    rows = [(i, f"word {i} " * 20, "en", "s", None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    exchanges, written = [], kneser_ney._written

    def counted(df, *args):
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            df.explain()
        exchanges.append(said.getvalue().count("Exchange "))
        return written(df, *args)

    monkeypatch.setattr(kneser_ney, "_written", counted)
    kneser_ney.train(kneser_ney.trusted_texts(docs, labels))
    assert max(exchanges) <= 10 and sum(exchanges) <= 25, exchanges


def test_driver_gets_one_table_at_a_time(spark, monkeypatch):
    """A table has up to 10 MB, and the driver holds what it collects at once several times over."""
    rows = spark.createDataFrame([(f"l{i % 3}", b"some words of text %d" % i) for i in range(9)], "lang string, text binary")
    got, kind = [], type(rows)

    def noted(name, own):
        def run(self, *args, **more):
            out = own(self, *args, **more)
            if "table" in self.columns:
                got.append(len(out))
            return out

        monkeypatch.setattr(kind, name, run)

    for name in ("collect", "toArrow"):
        noted(name, getattr(kind, name))
    model = kneser_ney.train(rows)
    assert set(model.tables) == {"", "l0", "l1", "l2"} and got == [1] * 4


def test_tables_against_brute_force(spark):
    """Tables are those of interpolated modified Kneser-Ney, computed one n-gram at a time."""
    texts = [("en", b"the cat sat on the mat. the cat ran. " * 2), ("en", b"a dog sat, the dogs ran; 12 cats!"), ("de", b"der hund und die katze"), ("en", b"")]
    model = kneser_ney.train(spark.createDataFrame(texts, "lang string, text binary"))
    size, order = kneser_ney.SYMBOLS, kneser_ney.ORDER
    for lang in ("en", "de", ""):
        counts = {order: Counter(int(c) for name, t in texts if lang in (name, "") for c in kneser_ney.codes(t))}
        for k in range(order - 1, 0, -1):
            counts[k] = Counter(c % size**k for c in counts[k + 1])
        discounts, within = {}, {}
        for k, own in counts.items():
            t1, t2, t3, t4 = (max(1, sum(n == i for n in own.values())) for i in range(1, 5))
            y = t1 / (t1 + 2 * t2)
            raw = 1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3
            discounts[k] = [min(max(d, 0.05), most) for d, most in zip(raw, (0.95, 1.95, 2.95), strict=True)]
            within[k] = {}
            for c, n in own.items():
                within[k].setdefault(c // size, []).append(n)

        def probability(code, k, counts=counts, discounts=discounts, within=within):
            if k == 0:
                return 1 / size
            code %= size**k
            below, beside = probability(code, k - 1), within[k].get(code // size)
            if beside is None:
                return below
            n, less = counts[k][code], lambda n: discounts[k][min(n, 3) - 1]
            return ((n - less(n) if n else 0) + sum(map(less, beside)) * below) / sum(beside)

        table = model.tables[lang]
        for code in [*counts[order], *range(0, size**order, 9973)]:
            assert table[code] == pytest.approx(np.log10(probability(code, order)), rel=1e-5)


# ---- 8: URLs ---------------------------------------------------------------------------------


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def ruled(host, path):
    best = None
    for rule, says in URL_RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, says
    return best


def test_urls_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM/x?y#z", "http://www.example.com/en/1", "http://m.example.com/en/1?q=/fr/",
            "http://example.com", "http://a.net/es/", "http://net/fr/x", "http://a.net#/es/", "http://É.com/ß", "http://xcom/en/", "a://b://c/d",
            "http://" + "h" * 5000 + ".com/" + "p" * 5000, "http://a.net/fr/\nx", "http://a.net/fr/\nx"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, _ngrams int")
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        host, path = parts(u)
        best = ruled(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, best and best[0]), u
        assert rows[i].verdict == (best[1] if best else "block" if rows[i].blocked_score >= 0.5 else "allow")
    assert not url_filter.filter_urls(pages.where("page_id < 0"), URL_RULES).count()


def test_url_model_by_hosts_left_out(spark):
    """Every fourth host is judged by a model trained on the others."""
    rows = [(u, y) for us, y in ((url_filter.BLOCKED_URLS, 1), (url_filter.ALLOWED_URLS, 0)) for u in us]
    right = []
    for turn in range(2):
        model = url_filter.train(spark.createDataFrame([r for i, r in enumerate(rows) if i % 4 != turn], "url string, label int"))
        held = [r for i, r in enumerate(rows) if i % 4 == turn]
        pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
        got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, [], model).collect()}
        right += [(got[i] == "block") == bool(y) for i, (_, y) in enumerate(held)]
    assert np.mean(right) > 0.75


def test_default_labels_hold_no_host_of_the_tables(spark):
    hosts = {r[0] for sf in ("0.001", "0.01", "0.1") for r in spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").select(
        url_filter.host_and_path(url_filter.F.col("url"))[0]).distinct().collect()}
    own = {u.split("://")[1].split("/")[0] for u in url_filter.BLOCKED_URLS + url_filter.ALLOWED_URLS}
    assert not own & hosts and len(own) == 60


def test_url_model_on_unseen_urls(spark):
    urls = {"http://casino-royal.example.org/de/4": 1, "https://cheap-pills.example.net/de/9": 1, "http://spam-farm.example.org/en/9": 1,
            "http://thonan.example.org/en/9": 0, "https://blog.thered.example.net/de/12": 0, "http://library.example.org/de/44": 0}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, []).collect()}
    assert [got[i] == "block" for i in range(len(urls))] == [bool(v) for v in urls.values()]

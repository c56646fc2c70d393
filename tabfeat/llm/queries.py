"""The queries of this subpackage over the provided tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabfeat.llm import bloom_lm, decontaminate, fingerprints, kneser_ney, merkle, mixing, near_dedup, periodic_runs, quality_rules, substring_dedup, token_output, toxicity, url_filter
from tabfeat.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_suffix_array_dedup")
def repeated_strings(spark, load):
    return substring_dedup.without_repeats(load("documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op2_token_output")
def token_ids(spark, load):
    return token_output.token_digest(load("documents"), tokenizer_path(), end_id=2)


@query("op3_toxicity")
def toxic(spark, load):
    docs = load("documents")
    return toxicity.score(docs, toxicity.learn(docs, load("labels"))).select("doc_id", "held_out", "score", "predicted")


@query("op4_quality_rules")
def quality(spark, load):
    return quality_rules.judge(load("documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query("op5_near_dedup")
def near_duplicates(spark, load):
    return near_dedup.near_duplicates(load("documents"))


@query("op6_bloom_lm")
def language_model(spark, load):
    docs = load("documents")
    return bloom_lm.scored(docs, bloom_lm.training_rows(docs)).select(
        "doc_id", (bloom_lm.crc_mod5("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_kneser_ney")
def trusted_style(spark, load):
    docs = load("documents")
    return kneser_ney.classify(docs, kneser_ney.learn(docs, load("labels")))


#: The rules of the contract.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query("op8_url_filter")
def urls(spark, load):
    return url_filter.filter_urls(load("pages"), URL_RULES)


MIX_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM documents),
  sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
  weighed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    source_size * 2.0::DOUBLE AS cap FROM sources),
  capped AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM weighed),
  levels AS (SELECT a.k, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE
      - coalesce((SELECT sum(b.cap) FROM capped b WHERE b.k < a.k), 0.0)) / (SELECT sum(b.w) FROM capped b WHERE b.k >= a.k) AS level,
    a.w, a.cap FROM capped a),
  chosen AS (SELECT k, level FROM levels WHERE w * level <= cap ORDER BY k LIMIT 1),
  targets AS (SELECT c.source, c.source_size, CASE WHEN h.k IS NULL OR c.k < h.k THEN c.cap ELSE c.w * h.level END AS target
    FROM capped c LEFT JOIN chosen h ON true),
  placed AS (SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size / 2.0::DOUBLE AS middle
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN size > 0 AND middle <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed"""


@query("op9_mixing", MIX_SQL)
def mixture(spark, load):
    return mixing.mix(load("documents")).select("doc_id", "size", "source_size", "target", "taken")


LEAK_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  cut AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
  windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM cut)),
  sizes AS (SELECT DISTINCT n FROM windows),
  places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
  found AS (SELECT p.doc_id, p.n, p.i, v.item FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win),
  hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
  owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)"""


@query("op10_decontamination", LEAK_SQL)
def leaks(spark, load):
    return decontaminate.contamination(load("documents"), load("benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


# ---- 11: Merkle manifest ---------------------------------------------------------------------

#: crc32 of a doc_id in decimal, by the usual table of 256 steps.
CRC_SQL = """crc_steps AS (SELECT list(list_reduce([i] || list_value(0, 0, 0, 0, 0, 0, 0, 0), lambda x, _: CASE WHEN x & 1 = 1
    THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS steps FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
  crcs AS (SELECT doc_id, xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda x, b: xor(x >> 8, steps[(xor(x, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents), crc_steps)"""


def _tree_sql(name: str, levels: int) -> str:
    """CTEs that turn ``{name}0`` (key, pos, digest) into the runs of each level and ``{name}{levels}``, one root per key."""
    return ",\n  ".join(f"""{name}_runs{k} AS (SELECT key, pos // 16 AS pos, any_value(n) > 1 AS many, list(digest ORDER BY pos) AS m
    FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {name}{k}) GROUP BY key, pos // 16),
  {name}{k + 1} AS (SELECT key, pos, CASE WHEN many THEN sha256(array_to_string(m, '')) ELSE m[1] END AS digest FROM {name}_runs{k})"""
                        for k in range(levels))


def _climb_sql(name: str, start: str, levels: int) -> str:
    """CTEs ``{name}_up1`` on: proof and folded digest of each row of ``start`` (key, pos, folded, proof, others) above each level."""
    at, left, right = "CAST(c.pos % 16 AS BIGINT)", "array_to_string(m[1:i], '')", "array_to_string(m[i + 2:], '')"
    return ",\n  ".join(f"""{name}_up{k + 1} AS (SELECT * EXCLUDE (many, m, i) REPLACE (pos // 16 AS pos,
    CASE WHEN many THEN proof || {left} || {right} ELSE proof END AS proof,
    CASE WHEN many THEN sha256({left} || folded || {right}) ELSE folded END AS folded)
    FROM (SELECT c.*, {at} AS i, r.many, r.m FROM {start if k == 0 else f"{name}_up{k}"} c JOIN {name}_runs{k} r ON c.key = r.key AND c.pos // 16 = r.pos))"""
                        for k in range(levels))


def merkle_sql(levels: int = 6, top_levels: int = 3) -> str:
    """Enough levels for 16 million rows of a source and 4,096 sources."""
    def field(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"

    head = ", ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    return f"""WITH {CRC_SQL},
  received AS (SELECT d.*, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS got
    FROM documents d LEFT JOIN crcs USING (doc_id)),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM (SELECT doc_id, coalesce('=' || source, '') AS key,
    sha256(concat({head}, {field('text')})) AS digest, sha256(concat({head}, {field('got')})) AS folded FROM received)),
  own0 AS (SELECT key, pos, digest FROM leaves),
  {_tree_sql('own', levels)},
  all0 AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, digest FROM own{levels}),
  {_tree_sql('all', top_levels)},
  own_up0 AS (SELECT key, pos, doc_id, digest AS leaf, folded, '' AS proof FROM leaves),
  {_climb_sql('own', 'own_up0', levels)},
  all_up0 AS (SELECT '' AS key, s.pos, u.doc_id, u.leaf, s.digest AS subroot, u.folded, u.proof FROM own_up{levels} u
    JOIN (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos, digest FROM own{levels}) s ON u.key = s.key),
  {_climb_sql('all', 'all_up0', top_levels)}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM all_up{top_levels}, all{top_levels}"""


@query("op11_merkle_manifest", merkle_sql())
def manifest(spark, load):
    return merkle.audit(load("documents"), merkle.lowered_where(5))


# ---- 12: periodic runs -----------------------------------------------------------------------

RUNS_SQL = rf"""WITH {CRC_SQL},
  texts AS (SELECT d.doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, crc % 10 = 0 AS chosen, crc // 10 AS g
    FROM documents d LEFT JOIN crcs USING (doc_id)),
  tails AS (SELECT *, len(w) AS n, CASE WHEN chosen AND len(w) > 0 THEN g % len(w) ELSE len(w) END AS a FROM texts),
  periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM tails),
  words AS (SELECT doc_id, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM periods)),
  pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
  stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
    GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
  runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretches GROUP BY doc_id, s, l),
  listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS list FROM runs GROUP BY doc_id),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) AS k FROM runs) WHERE k = 1),
  rest AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words v
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = v.doc_id AND v.i >= r.s + r.q AND v.i < r.s + r.l) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
  CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN rest USING (doc_id)"""


@query("op12_periodic_runs", RUNS_SQL)
def repeated_stretches(spark, load):
    return periodic_runs.periodic_runs(load("documents"), implant=True).drop("runs")


# ---- 13: fingerprints ------------------------------------------------------------------------


@query("op13_fingerprints")
def prints(spark, load):
    return fingerprints.fingerprints(load("documents")).select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text("signature").alias("fingerprint"),
        fingerprints.as_text("edited").alias("edited_fingerprint"), "near_edited", "near_next")


@query("fingerprint_heads")
def heads(spark, load):
    """Every document with the smallest one that heads a band of it and is similar."""
    docs = load("documents")
    return fingerprints.band_heads(fingerprints.fingerprints(docs), docs)

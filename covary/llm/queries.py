"""One query per operator, with the parameters of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covary.llm import (decontaminate, exact_dedup, langid, merkle, records, sanitise, search, simhash, suffix_dedup,
                        token_counts, toxicity, url_rules)
from covary.llm.bpe import bpe_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return simhash.near_groups(docs, words=4, radius=4, seed=42).select(
        "doc_id", "fingerprint", "component_id", "component_size", "kept")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(_table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), nameless=True)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf_digest([*[F.col(c) for c in fields[:-1]], F.translate("text", UPPER, LOWER)])
    probe = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered)
    return merkle.verified(docs, fields, probe)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.personal_data(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_bpe_round_trip, op3_token_counts, op4_token_records,
    op5_suffix_dedup, op6_language_id, op7_toxicity, op8_exact_dedup, op9_url_filters, op10_decontamination,
    op11_ranked_search, op12_merkle_manifest, op13_pii)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "chr(32), ''), chr(9), ''), chr(10), ''), chr(11), ''), chr(12), ''), chr(13), '')"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def _merkle_sql(levels: int = 5, top: int = 2) -> str:
    """Up to 16 ** levels rows of a source and 16 ** top sources: one CTE per
    level with each node's siblings to the left and right."""
    def leaf(text: str) -> str:
        parts = [f"CASE WHEN {v} IS NULL THEN '-' ELSE CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR) END"
                 for v in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    crc = ("xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda p: "
           "CAST(ascii(substr(CAST(doc_id AS VARCHAR), p, 1)) AS BIGINT)), lambda c, b: "
           "list_reduce(range(8), lambda h, i: xor(h >> 1, 3988292384 * (h & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)")
    ctes = [f"d AS (SELECT *, row_number() OVER () AS r, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN "
            f"{leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS probe FROM documents)",
            "s AS (SELECT source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents))",
            "l AS (SELECT d.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, "
            "count(*) OVER (PARTITION BY tree) AS n FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)",
            "a0 AS (SELECT tree, rank, n, leaf AS h FROM l)"]

    def grow(name: str, k: int) -> list[str]:
        run = "PARTITION BY tree, rank // 16 ORDER BY rank ROWS BETWEEN"
        return [f"{name}s{k} AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') "
                f"ELSE '' END AS bef, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') "
                f"ELSE '' END AS aft FROM {name}{k})",
                f"{name}{k + 1} AS (SELECT tree, rank // 16 AS rank, any_value((n + 15) // 16) AS n, "
                f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY rank)) ELSE any_value(h) END AS h "
                f"FROM {name}{k} GROUP BY tree, rank // 16)"]

    for k in range(levels):
        ctes += grow("a", k)
    ctes.append(f"b0 AS (SELECT 0 AS tree, tree AS rank, count(*) OVER () AS n, h FROM a{levels})")
    for k in range(top):
        ctes += grow("b", k)
    joins, proof = "", ""
    for name, k in [("a", k) for k in range(levels)] + [("b", k) for k in range(top)]:
        t = f"{name}s{k}"
        joins += (f" JOIN {t} ON {t}.tree = l.tree AND {t}.rank = l.rank // {16 ** k}" if name == "a" else
                  f" JOIN {t} ON {t}.rank = l.tree // {16 ** k}")
        proof += (" || " if proof else "") + f"{t}.bef || {t}.aft"
    ctes.append(f"p AS (SELECT l.doc_id, l.leaf, a{levels}.h AS subroot, b{top}.h AS root, sha256({proof}) AS proof_sha256, "
                "coalesce(l.probe, l.leaf) AS f0, "
                + ", ".join(f"{n}s{k}.n AS {n}n{k}, {n}s{k}.bef AS {n}b{k}, {n}s{k}.aft AS {n}a{k}"
                            for n, c in (("a", levels), ("b", top)) for k in range(c))
                + f" FROM l{joins} JOIN a{levels} ON a{levels}.tree = l.tree CROSS JOIN b{top})")
    last = "p"
    for i, (n, k) in enumerate([("a", k) for k in range(levels)] + [("b", k) for k in range(top)], 1):
        ctes.append(f"f{i} AS (SELECT *, CASE WHEN {n}n{k} > 1 THEN sha256({n}b{k} || f{i - 1} || {n}a{k}) ELSE f{i - 1} END AS f{i} FROM {last})")
        last = f"f{i}"
    return (f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, "
            f"{last} = root AS verified FROM {last}")


# The path stops at the first ? or #; RE2 has no look-ahead and needs none here.
ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp,
                  {"replace(" * 6}coalesce(text, ''), {BLANKS} AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-cp, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256,
       CAST(cp AS BIGINT) AS code_points
FROM d JOIN g USING (norm)""",
    "op9_url_filters": r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, strpos(url, '://') > 0 AS ok,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS pa,
         translate(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h0,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS tail FROM pages),
refs AS (
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                             '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS ref FROM p WHERE ok
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
                             '(?is)\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*[''"]?([^"''\s>]+)', 1) FROM p WHERE ok),
target AS (
  SELECT url, replace(ref, '&amp;', '&') AS ref, regexp_extract(url, '(?s)^(.*?):', 1) AS scheme,
         regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1) AS folder FROM refs WHERE ref <> ''),
pair AS (
  SELECT url AS a, CASE WHEN strpos(ref, '://') > 0 THEN ref WHEN starts_with(ref, '//') THEN scheme || ':' || ref
         WHEN starts_with(ref, '/') THEN root || ref
         ELSE root || (CASE WHEN folder = '' THEN '/' ELSE folder END) || ref END AS b FROM target),
node AS (
  SELECT u, translate(regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            || regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS n
  FROM (SELECT a AS u FROM pair UNION SELECT b FROM pair)),
edge AS (
  SELECT x.n AS a, y.n AS b FROM pair JOIN node x ON pair.a = x.u JOIN node y ON pair.b = y.u WHERE x.n <> y.n
  UNION SELECT y.n, x.n FROM pair JOIN node x ON pair.a = x.u JOIN node y ON pair.b = y.u WHERE x.n <> y.n),
reach(a, b) AS (SELECT a, a FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
known AS (
  SELECT n, arg_max(verdict, length(rh || rp)) AS verdict
  FROM (SELECT n, regexp_extract(n, '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(n, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS pa
        FROM (SELECT DISTINCT n FROM node)) JOIN rules ON (h = rh OR ends_with(h, '.' || rh)) AND starts_with(pa, rp)
  GROUP BY n),
alias AS (SELECT a AS n, min(verdict) AS verdict FROM reach JOIN known ON reach.b = known.n GROUP BY a),
own AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM p JOIN rules ON ok AND (h = rh OR ends_with(h, '.' || rh)) AND starts_with(pa, rp) GROUP BY page_id)
SELECT p.page_id, CASE WHEN ok THEN h ELSE '' END AS host, CASE WHEN ok THEN pa ELSE '' END AS path, own.rule AS rule,
       coalesce(own.verdict, alias.verdict, 'allow') AS verdict
FROM p LEFT JOIN own ON own.page_id = p.page_id LEFT JOIN alias ON alias.n = h0 || tail""",
    "op11_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
t AS (SELECT r, doc_id, unnest(w) AS term FROM d),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT r, count(*) AS n FROM t GROUP BY r),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
       FROM tf, g GROUP BY term, docs),
m AS (SELECT r, 100 - 75 + ((75 * n * docs) // terms) AS m FROM n, g),
q AS (SELECT q, item_id, unnest(w) AS term
      FROM (SELECT row_number() OVER () AS q, item_id, {_words('text')} AS w FROM benchmark)),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10""",
    "op12_merkle_manifest": _merkle_sql(),
}

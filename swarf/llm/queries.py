"""One registered query for each operator, with production parameters over whole tables, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarf.llm import exact_dedup, fill_in_middle, lexical, line_dedup, mixing, pii, quality_model, quality_rules, secrets, sentencepiece, sharding, simhash, substring_dedup
from swarf.llm.common import read

SHARDS = 40
#: For the registered query alone; a real run passes a secret.
PII_KEY = "a key for tests"
#: Where the public tokenizers' files lie on every machine.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), carry=False).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """ledger: the folder of a ledger to go on with; the registered query scans all blobs anew."""
    versions = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("path"), "text")
    found = secrets.scan_into(versions, ledger) if ledger else secrets.scan(versions)[0]
    counts = [secrets.counted(F.col("found"), r).alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(secrets.listed(F.col("found"), secrets.BASE), 256).alias("base_sha256"), secrets.listed(F.col("found"), secrets.RULES).alias("spans"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.classify(docs, quality_model.train(docs, read(spark, sf_dir, "labels"))).drop("row")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), PII_KEY)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(read(spark, sf_dir, "documents"), MODEL_FILE)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents"), carry=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mixing, op2_substring_dedup, op3_secrets, op4_exact_dedup, op5_quality_classifier, op6_sharding, op7_pii, op8_simhash, op9_quality_rules, op10_sentencepiece, op11_line_dedup, op12_lexical_search, op13_fill_in_middle)
    return {f.__name__: f for f in (*ops, pipeline)}


W = r"[^\x20\x09-\x0D]+"

ORACLE = {
    "op1_mixing": rf"""
        WITH d AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
                     coalesce(len(regexp_extract_all(text, '{W}')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
        a AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 2 AS cap FROM s),
        b AS (SELECT *, row_number() OVER o AS k, (sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) - cap)::BIGINT AS capped,
                (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws, (sum(source_size) OVER ())::BIGINT AS total
              FROM a WINDOW o AS (ORDER BY cap / w, no_source, source)),
        c AS (SELECT *, 2 * cap * ws <= (3 * total - 2 * capped) * w AS is_full, (3 * total - 2 * capped) / (2 * ws) AS lvl FROM b),
        t AS (SELECT no_source, source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
                (first_value(lvl) OVER (ORDER BY is_full, k)) * w END AS target FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY no_source, source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rank FROM d),
        x AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
                ('0x' || substr(md5('mix/' || no_source::VARCHAR || '/' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
              FROM r JOIN t USING (no_source, source))
        SELECT doc_id, size, source_size, target, ((floor(rate * (rank + 1) + u) - floor(rate * rank + u)) * size)::BIGINT AS taken FROM x""",
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS points FROM documents),
        r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op11_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT row, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM d),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        s AS (SELECT key, true AS shared FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
        r AS (SELECT row, count(*) AS n_lines, count(shared) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (shared IS NULL), '') AS kept FROM k LEFT JOIN s USING (key) GROUP BY row)
        SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN r USING (row)""",
    "op12_lexical_search": r"""
        WITH p AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM documents),
        t AS (SELECT row, term, count(*) AS tf FROM p GROUP BY ALL),
        d AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM p GROUP BY row),
        s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
        f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, s),
        i AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        q AS (SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
        m AS (SELECT row, doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM d, s),
        x AS (SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
          FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item, row),
        r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        h AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d FROM d),
        f AS (SELECT *, least(a, b) AS one, greatest(a, b) AS two, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substr(text, 1, one) AS pre, substr(text, one + 1, two - one) AS mid, substr(text, two + 1) AS suf FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN one END AS prefix_chars, CASE WHEN form <> 'plain' THEN two - one END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}


def _secrets_sql() -> str:
    """Spans in RE2: the lengths of what lies between matches and of the matches add up to code point offsets."""
    kinds = []
    for k, r in enumerate(secrets.RULES):
        pat = r.pattern.replace("'", "''")
        kinds.append(
            f"SELECT row, {k} AS k, '{r.kind}' AS kind, list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT, 'n': length(m[i]), 'g': length(g[i])}}) AS spans "
            f"FROM (SELECT row, regexp_extract_all(text, '{pat}', 0) AS m, regexp_extract_all(text, '{pat}', {r.group}) AS g, string_split_regex(text, '{pat}') AS p FROM d)"
        )
    least = "CASE kind " + " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secrets.RULES) + " END"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in secrets.BASE)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        m AS (SELECT row, k, kind, unnest(spans) AS x FROM ({" UNION ALL ".join(kinds)})),
        s AS (SELECT row, k, kind, x.s AS a, x.s + x.n AS b, kind || ':' || x.s || ':' || (x.s + x.n) AS span FROM m WHERE x.g >= {least})
        SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (k < {len(secrets.BASE)}), '')) AS base_sha256,
          coalesce(string_agg(span, ',' ORDER BY a, k), '') AS spans
        FROM d LEFT JOIN s USING (row) GROUP BY row"""


def _rules_sql() -> str:
    """Repeated windows by counting them exactly, and the distances of both histograms as sums over their bins."""
    limits, classes = quality_rules.Limits(), list(quality_rules.CLASSES.values())
    known = [f"n_chars - length(regexp_replace(text, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for p in classes]
    listed = "[" + ", ".join(f"'{w}'" for w in quality_rules.WORDS) + "]"
    near = lambda k, n, least, limit, slack: f"({n} < {least} OR {k} <= {limit}::DOUBLE + {slack}::DOUBLE / sqrt(greatest({n}, 1)))"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    alone = ", ".join(f"('{k}', {i + 1})" for k, at in quality_rules.ALONE.items() for i in at)
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, length(text) AS n_chars, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{W}')) AS ls FROM d),
        g AS (SELECT row, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        r AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1) GROUP BY row),
        b AS (SELECT w.*, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, n_chars - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (row)),
        f AS (SELECT *, n_words < {limits.base_words} OR 100 * n_repeat_words > {limits.base_repeat_percent} * n_words AS base_failed, [{", ".join(known)}] AS cs, list_transform({listed}, lambda c: len(list_filter(list_transform(ws, lambda x: lower(x)), lambda x: x = c))) AS cw FROM b),
        h AS (SELECT row, lang, base_failed, 'c' AS kind, unnest(list_append(cs, n_chars - list_sum(cs)))::DOUBLE AS v, generate_subscripts(list_append(cs, 0), 1) AS k FROM f
          UNION ALL SELECT row, lang, base_failed, 'w', unnest(list_append(cw, n_words - list_sum(cw)))::DOUBLE, generate_subscripts(list_append(cw, 0), 1) FROM f),
        s AS (SELECT lang, kind, k, coalesce(sum(v) FILTER (NOT base_failed), 0) AS own, count(*) FILTER (NOT base_failed) AS n FROM h GROUP BY ALL),
        t AS (SELECT lang, kind, k, CASE WHEN n >= {limits.least_docs} THEN own ELSE sum(own) OVER (PARTITION BY kind, k) END AS q FROM s),
        a AS (SELECT row, kind, v / nullif(sum(v) OVER (PARTITION BY row, kind), 0) AS p, q / nullif(sum(q) OVER (PARTITION BY row, kind), 0) AS q FROM h JOIN t USING (lang, kind, k)),
        z AS (SELECT row, kind, coalesce(sqrt(greatest(sum(({part("p", "q")} + {part("q", "p")}) / 2), 0)), 0) AS dist FROM a WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY row, kind),
        e AS (SELECT lang, k, q / nullif(sum(q) OVER (PARTITION BY lang), 0) AS q FROM t WHERE kind = 'w' AND lang IN ({", ".join(f"'{k}'" for k in quality_rules.COMMON)})),
        o AS (SELECT row, lang, sum(v) AS n FROM (SELECT row, k, v FROM h WHERE kind = 'w') JOIN (SELECT * FROM (VALUES {alone}) AS l(lang, k)) USING (k) GROUP BY ALL),
        m AS (SELECT row, k, sum(n * q) AS q FROM o JOIN e USING (lang) WHERE q IS NOT NULL GROUP BY ALL),
        u AS (SELECT row, v / nullif(sum(v) OVER (PARTITION BY row), 0) AS p, q / nullif(sum(q) OVER (PARTITION BY row), 0) AS q FROM (SELECT row, k, v FROM h WHERE kind = 'w') JOIN m USING (row, k)),
        v AS (SELECT row, sqrt(greatest(sum(({part("p", "q")} + {part("q", "p")}) / 2), 0)) AS dist FROM u WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY row),
        y AS (SELECT f.*, coalesce(c.dist, 0) AS dc, least(coalesce(x.dist, 0), v.dist) AS dw FROM f LEFT JOIN z c ON c.row = f.row AND c.kind = 'c' LEFT JOIN z x ON x.row = f.row AND x.kind = 'w' LEFT JOIN v ON v.row = f.row)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND {near("dc", "n_chars", limits.least_chars, limits.chars, limits.chars_slack)} AND {near("dw", "n_words", limits.least_words, limits.words, limits.words_slack)} AS kept FROM y"""


def oracle_sql() -> dict[str, str]:
    return ORACLE | {"op3_secrets": _secrets_sql(), "op9_quality_rules": _rules_sql()}

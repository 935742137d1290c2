"""The queries of this subpackage over the given tables, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltascope.llm import (
    jaccard, language, licenses, line_dedup, packing, personal_data, pieces, quality as quality_rules, ranked_search, secrets,
    token_counts, vector_codes,
)
from deltascope.llm.common import ship_package
from deltascope.llm.digest_index import DigestIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


@query(rf"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
        FROM documents WHERE text IS NOT NULL),
    worded AS (
        SELECT doc_id, i, line, lead(i) OVER d AS next_i, lead(line) OVER d AS next_line FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    chunks AS (
        SELECT doc_id, i AS first, next_i AS last, line || chr(10) || next_line AS body FROM worded WHERE next_i IS NOT NULL
        UNION ALL SELECT doc_id, i, i, line FROM worded WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {line_dedup.LONG_LINE}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS r FROM chunks),
    cut AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM ranked WHERE r > 1),
    rest AS (
        SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (c.i IS NULL) AS clean_text, count(*) AS n_lines, count(c.i) AS n_removed_lines
        FROM lines l LEFT JOIN cut c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(clean_text, '') END AS clean_text,
           coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines
    FROM documents d LEFT JOIN rest ON d.doc_id = rest.doc_id""")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(_documents(spark, folder).select("doc_id", "text"))
    return cleaned.select("_doc.doc_id", "clean_text", "n_lines", "n_removed_lines")


STOP_WORD_LIST = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))


@query(rf"""
    WITH split AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
        FROM documents),
    places AS (
        SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM split WHERE len(w) >= 3),
    windows AS (
        SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) AS times FROM places),
    covered AS (
        SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM windows WHERE times > 1) GROUP BY doc_id),
    counted AS (
        SELECT s.doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars,
               len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
               len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines,
               len(list_filter(w, lambda x: lower(x) IN ({STOP_WORD_LIST}))) AS stops,
               len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]'))) AS bullets,
               len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS dots
        FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
    base AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               greatest(n_words, 1)::DOUBLE AS w, greatest(n_lines, 1)::DOUBLE AS l
        FROM counted)
    SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND word_chars / w >= 2 AND word_chars / w <= 16 AND n_symbols / w <= 0.25 AND stops / w >= 0.02
           AND n_dup_lines / l <= 0.5 AND bullets / l <= 0.9 AND dots / l <= 0.3 AS kept
    FROM base""")
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.quality(_documents(spark, folder).select("doc_id", "text"))
    return judged.select(
        "_doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _secret_sql() -> str:
    """Spans of every rule, from the texts between and inside its matches."""
    parts = []
    for order, rule in enumerate(secrets.RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""
        SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, length(hits[i]) AS n,
               list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT doc_id, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}, 0) AS hits,
                   regexp_extract_all(t, {pattern}, {rule.group}) AS groups
            FROM texts WHERE regexp_matches(t, {pattern})))
        WHERE length(groups[i]) >= {rule.least}""")
    name = "kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT"
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({" UNION ALL ".join(parts)}),
    joined AS (
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex, string_agg({name}, ',' ORDER BY start, o) AS spans,
               string_agg({name}, ',' ORDER BY start, o) FILTER (o < {len(secrets.BASE_RULES)}) AS base
        FROM spans GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts t LEFT JOIN joined j ON t.doc_id = j.doc_id"""


@query(_secret_sql())
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(_documents(spark, folder).select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE_RULES]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "_doc.doc_id", *map(number, base),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query("""
    WITH digests AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM digests WINDOW g AS (PARTITION BY text_sha256)""")
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = DigestIndex(spark).add(_documents(spark, folder).select("doc_id", "text"))
    return verdicts.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_documents(spark, folder).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


@query()
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, folder).select("doc_id", "text"), words=3, percent=90)


@query()
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(_documents(spark, folder).select("doc_id", "text"))

    def labels(column):
        return F.array_join(F.array_sort(F.array_distinct(column)), ",")

    places = F.transform("base", lambda b: b["first"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat("base.label", "found.label")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.score"), F.lit(0.0))).alias("score"),
    )


@query()
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder).select("doc_id", "text", "lang")
    model = language.train(documents)
    predicted = language.identify(documents.select("doc_id", "text"), model)
    return predicted.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query()
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder).select("doc_id", "text")
    encoded = pieces.encode(documents, tokenizer_path("piece_bpe_32k.model"), verify_every=1, decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
        F.xxhash64("decoded").alias("decoded_hash"), "parity",
    )


@query()
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, folder).select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def _personal_sql() -> str:
    """Spans of every kind, from the texts between and inside its matches."""
    luhn = """list_sum(list_transform(range(1, length(d) + 1), lambda i:
        CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INT WHEN d[i]::INT > 4 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END)) % 10 = 0"""
    turned = "replace(hit, ' ', '')[5:] || replace(hit, ' ', '')[:4]"
    rest = f"""list_reduce(list_prepend(0, list_transform(range(1, length({turned}) + 1), lambda i: ascii(({turned})[i]))), lambda total, c:
        CASE WHEN c < 58 THEN (total * 10 + c - 48) % 97 ELSE (total * 100 + c - 55) % 97 END)"""
    checks = {
        "ip": f"regexp_matches(hit, '{personal_data.ADDRESS_RANGE}')",
        "card": f"CASE WHEN length(d) BETWEEN 14 AND 19 THEN {luhn} ELSE false END",
        "phone": "length(d) BETWEEN 10 AND 15",
        "iban": f"{rest} = 1",
        "bank": "hit <> '000000000' AND list_sum(list_transform(range(1, 10), lambda i: hit[i]::INT * [3, 7, 1][(i - 1) % 3 + 1])) % 10 = 0",
    }
    parts = []
    for order, kind in enumerate(personal_data.KINDS):
        pattern = f"'{kind.pattern}'"
        near = f"(regexp_matches(right(before, {personal_data.BEFORE}), '{kind.context()}') OR regexp_matches(left(after, {personal_data.AFTER}), '{kind.context()}'))"
        fits = [checks.get(kind.name, "true")]
        if kind.alone:
            fits.append("NOT regexp_matches(right(before, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]')")
        if not kind.base and kind.score < personal_data.LEAST_SCORE:
            fits.append(near)
        parts.append(f"""
        SELECT doc_id, {order} AS o, '{kind.name}' AS kind, start, length(hit) AS n,
               CASE WHEN {near} THEN {min(100, kind.score + personal_data.BOOST)} ELSE {kind.score} END AS score
        FROM (SELECT doc_id, hits[i] AS hit, regexp_replace(hits[i], '[^0-9]', '', 'g') AS d, gaps[i] AS before, gaps[i + 1] AS after,
                     list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS start
              FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
                  SELECT doc_id, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}, 0) AS hits
                  FROM texts WHERE regexp_matches(t, {pattern}))))
        WHERE {" AND ".join(f"({f})" for f in fits)}""")
    name = "kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT"
    base = [k.name for k in personal_data.KINDS if k.base]
    counted = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({" UNION ALL ".join(parts)}),
    joined AS (
        SELECT doc_id, {counted}, string_agg({name}, ',' ORDER BY start, o) AS spans,
               string_agg(score, ',' ORDER BY start, o) AS scores, string_agg({name}, ',' ORDER BY start, o) FILTER (o < {len(base)}) AS base
        FROM spans GROUP BY doc_id)
    SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)},
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
    FROM texts t LEFT JOIN joined j ON t.doc_id = j.doc_id"""


@query(_personal_sql())
def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.find_personal_data(_documents(spark, folder).select("doc_id", "text"))
    base = [k.name for k in personal_data.KINDS if k.base]

    def result(spans):
        def listed(some):
            return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

        return F.struct(
            *[F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in base],
            F.sha2(listed(F.filter(spans, lambda s: s["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"),
            listed(spans).alias("spans"), F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
        )

    return found.select("_doc.doc_id", F.inline(F.transform(F.array("spans"), result)))


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    distance = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""
    a{turn} AS MATERIALIZED (
        SELECT p.vec_id, p.a, min({distance}::BIGINT * {entries} + c.e) AS least FROM cut p JOIN c{turn} c ON p.a = c.a GROUP BY p.vec_id, p.a)""")
        if turn < rounds:
            steps.append(f"""
    s{turn} AS (
        SELECT a, e, i, sum(x) AS s, count(*) AS n FROM (
            SELECT p.a, k.least % {entries} AS e, unnest(p.x) AS x, unnest(range(1, len(p.x) + 1)) AS i
            FROM cut p JOIN a{turn} k ON p.vec_id = k.vec_id AND p.a = k.a)
        GROUP BY a, e, i),
    m{turn} AS (SELECT a, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{turn} GROUP BY a, e),
    c{turn + 1} AS MATERIALIZED (SELECT c.a, c.e, coalesce(m.x, c.x) AS x FROM c{turn} c LEFT JOIN m{turn} m ON c.a = m.a AND c.e = m.e)""")
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cut AS MATERIALIZED (SELECT vec_id, a, v[a * len(v) // {parts} + 1:(a + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS r(a)),
    first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
    c0 AS MATERIALIZED (SELECT cut.a, first.e, cut.x FROM cut JOIN first ON cut.vec_id = first.vec_id),
    {",".join(steps)},
    coded AS (
        SELECT vec_id, string_agg(printf('%02x', (least % {entries})::INT), '' ORDER BY a) AS code, sum(least // {entries})::BIGINT AS error
        FROM a{rounds} GROUP BY vec_id),
    book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY a, e)) AS codebooks_sha256 FROM c{rounds})
    SELECT k.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM kept k JOIN coded ON k.vec_id = coded.vec_id, book"""


@query(_codes_sql())
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    found = vector_codes.compress(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return found.codes.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


@query(rf"""
    WITH split AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
        FROM documents WHERE text IS NOT NULL),
    lengths AS (SELECT doc_id, len(w)::BIGINT AS n FROM split WHERE len(w) > 0),
    totals AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS length FROM lengths),
    counted AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM split) GROUP BY doc_id, term),
    asked AS (
        SELECT item_id, term, count(*)::BIGINT AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
    weights AS (
        SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals),
    valued AS (
        SELECT c.doc_id, c.term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // length)) AS value
        FROM counted c JOIN lengths l ON c.doc_id = l.doc_id, totals),
    scored AS (
        SELECT item_id, doc_id, sum(times * w * value)::BIGINT AS score
        FROM asked a JOIN weights t ON a.term = t.term JOIN valued v ON a.term = v.term GROUP BY item_id, doc_id)
    SELECT item_id, rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
    WHERE rank <= {ranked_search.TOP}""")
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(_documents(spark, folder).select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet"))

"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat_format, collocations, decontaminate, divergence, html_extract, neighbours, ngram_join, pii, quality_rules, sharding, spm_sample, substring_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classify(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classify(_table(spark, sf_dir, "documents"), width=3, num=90, den=100, count=True)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op6_spm_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_sample.segmentations(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of op7_quality_rules before any rule, which SQL can express."""
    out = quality_rules.text_statistics(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.collapse(_table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return out.drop("text")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return neighbours.score(docs, neighbours.train(docs, _table(spark, sf_dir, "labels")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_pii": op3_pii,
    "op4_ngram_join": op4_ngram_join,
    "op4_ngram_links": op4_ngram_links,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_spm_sample": op6_spm_sample,
    "op7_quality_rules": op7_quality_rules,
    "op7_text_statistics": op7_text_statistics,
    "op8_chat_format": op8_chat_format,
    "op9_decontamination": op9_decontamination,
    "op10_html_extract": op10_html_extract,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_quality_neighbours": op12_quality_neighbours,
    "op13_collocations": op13_collocations,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _names(shards: tuple[str, ...], slots: list[int]) -> str:
    return ",".join(shards[i] for i in slots)


ORACLES: dict[str, str] = {
    "op2_sharding": f"""
        WITH slots AS (SELECT string_split('{_names(sharding.SHARDS, sharding.fill_table(sharding.SHARDS))}', ',') AS names),
        placed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 13))::BIGINT % {sharding.TABLE_SIZE} AS slot FROM documents)
        SELECT doc_id, slot, names[slot + 1] AS shard FROM placed, slots
    """,
    "op7_text_statistics": """
        WITH words AS (
            SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r,
                   [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w,
                   [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
            FROM documents),
        starts AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words),
        windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM starts),
        twice AS (SELECT r, unnest(range(i, i + 8)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1),
        covered AS (SELECT r, count(DISTINCT p) AS n FROM twice GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
        FROM words LEFT JOIN covered USING (r)
    """,
    "op4_ngram_join": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM words),
        sizes AS (SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.a, twoway.b FROM reach JOIN twoway ON reach.b = twoway.a)
        SELECT sizes.doc_id, n AS n_shingles, min(reach.b) AS component_id FROM sizes JOIN reach ON reach.a = sizes.doc_id GROUP BY sizes.doc_id, n
    """,
    "op5_substring_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        bytes AS (SELECT doc_id, n, unnest(range(n)) AS i, h FROM d WHERE n > 0),
        strings AS (SELECT doc_id, i, CASE WHEN i + 50 <= n THEN substr(h, 2 * i + 1, 100) END AS s, substr(h, 2 * i + 1, 2) AS byte FROM bytes),
        first AS (SELECT s, min(doc_id) AS first_id FROM strings WHERE s IS NOT NULL GROUP BY s),
        hits AS (SELECT doc_id, i, byte, CASE WHEN first_id < doc_id THEN i END AS hit FROM strings LEFT JOIN first USING (s)),
        gone AS (SELECT doc_id, i, byte, coalesce(max(hit) OVER (PARTITION BY doc_id ORDER BY i) >= i - 49, false) AS gone FROM hits),
        runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS new_run FROM gone),
        whole AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (new_run) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM runs GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN whole USING (doc_id)
    """,
    "op8_chat_format": """
        WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        bodies AS (
            SELECT conv_id, row_number() OVER o AS pos,
                   '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS body
            FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
        prefixes AS (
            SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                   string_agg(body, '') OVER (PARTITION BY conv_id ORDER BY pos) AS text
            FROM bodies),
        whole AS (
            SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, text
            FROM prefixes WHERE pos = n_turns GROUP BY n_turns, text)
        SELECT conv_id, n_turns, n_copies, text FROM whole w
        WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos < p.n_turns AND p.pos = w.n_turns AND p.text = w.text)
    """,
    "op11_divergence_audit": f"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        words AS (
            SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM d),
        kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS nl FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
        sums AS (SELECT lang, source, sum(n)::HUGEINT AS ng FROM c GROUP BY lang, source),
        groups AS (SELECT DISTINCT lang, source FROM d),
        g AS (SELECT lang, source, coalesce(ng, 0)::HUGEINT AS ng FROM groups LEFT JOIN sums USING (lang, source)),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.ng + 5 * l.v) AS p,
                   1 + (1000000000::HUGEINT * (k.total + 5)) // (l.nl + 5 * l.v) AS q
            FROM g JOIN langs l USING (lang) JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        apart AS (
            SELECT a.lang, a.source AS a, b.source AS b, sum(abs(a.p - b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.a = a.source AND x.b = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
    "op13_collocations": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        f1 AS (SELECT lang, x, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(w) AS x FROM words) GROUP BY ALL),
        f2 AS (SELECT lang, x, y, count(*)::HUGEINT AS f FROM (SELECT lang, unnest([[w[i], w[i + 1]] FOR i IN range(1, len(w))]) AS p, p[1] AS x, p[2] AS y FROM words) GROUP BY ALL HAVING f >= 10),
        f3 AS (SELECT lang, x, y, z, count(*)::HUGEINT AS f FROM (SELECT lang, unnest([[w[i], w[i + 1], w[i + 2]] FOR i IN range(1, len(w) - 1)]) AS p, p[1] AS x, p[2] AS y, p[3] AS z FROM words) GROUP BY ALL HAVING f >= 10),
        longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
        two AS (
            SELECT p.lang, p.x || ' ' || p.y AS phrase, p.f AS a, u.f AS l, v.f AS r, (1000000 * p.f * p.f) // (u.f * v.f) AS score
            FROM f2 p JOIN f1 u ON u.lang = p.lang AND u.x = p.x JOIN f1 v ON v.lang = p.lang AND v.x = p.y
            LEFT JOIN longer g ON g.lang = p.lang AND g.x = p.x AND g.y = p.y WHERE g.f IS NULL OR 100 * g.f < 50 * p.f),
        cuts AS (
            SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, u.f AS l1, q.f AS r1, p.f AS l2, v.f AS r2,
                   (1000000 * t.f * t.f) // (u.f * q.f) AS s1, (1000000 * t.f * t.f) // (p.f * v.f) AS s2
            FROM f3 t JOIN f1 u ON u.lang = t.lang AND u.x = t.x JOIN f2 q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
            JOIN f2 p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN f1 v ON v.lang = t.lang AND v.x = t.z),
        three AS (SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END AS l, CASE WHEN s2 < s1 THEN r2 ELSE r1 END AS r, least(s1, s2) AS score FROM cuts),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (FROM two UNION ALL FROM three))
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}

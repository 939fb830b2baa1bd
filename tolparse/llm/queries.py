"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gif, hidden_markov, html_text, line_dedup, merkle, mixing, multi_index, packing, piece_counts, quality, ranked_search, simhash, url_filter
from .common import fold, spread, table, word_count, written

#: (action, host, path) of the URL rules.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: The rules of the SQL as it stands; its word for net/de/ is not the contract's (README).
_SQL_RULES = [("block" if (h, p) == ("net", "/de/") else a, h, p) for a, h, p in URL_RULES]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "n_chars"))
    machine = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.scores(docs, machine)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(spread(table(spark, sf_dir, "embeddings", "vec_id", "embedding")), F.col("vec_id") % 50 == 0)


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(written(gif.text_media(spread(table(spark, sf_dir, "documents", "doc_id", "text"))), "media"))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, sf_dir, "documents", "doc_id", "text")), tokenizer_path("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(table(spark, sf_dir, "documents", "doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_documents(spread(table(spark, sf_dir, "documents", "doc_id", "text")), fold(7) == 2)


def op9_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.piece_counts(spread(table(spark, sf_dir, "documents", "doc_id", "text")), tokenizer_path("piece_bpe_32k.model"))


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.systematic_sample(written(docs, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    return merkle.verified(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spread(table(spark, sf_dir, "documents", "doc_id", "text"))).drop("text")


QUERIES = {f.__name__: f for f in (op1_html_text, op2_quality, op3_multi_index, op4_gif_media, op5_harmonic_packing, op6_simhash, op7_url_filter, op8_hidden_markov, op9_piece_counts, op10_systematic_mix, op11_ranked_search, op12_merkle, op13_line_dedup)}

_URL_PARTS = """
    SELECT page_id, lower_host AS host, regexp_extract(substr(rest, length(lower_host) + 1), '^[^?#]*') AS path FROM (
        SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_host FROM (
            SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages))
"""
_FITS = " ".join(
    f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{a} {h}{p}'"
    for a, h, p in sorted(_SQL_RULES, key=lambda r: -len(r[1] + r[2]))
)

ORACLES = {
    "op7_url_filter": f"""
        SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, coalesce(split_part(fit, ' ', 1), 'allow') AS verdict
        FROM (SELECT page_id, host, path, CASE {_FITS} END AS fit FROM ({_URL_PARTS}))
    """,
    "op10_systematic_mix": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS nr FROM d GROUP BY source),
        c AS (SELECT *, (nr % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
        l AS (
            SELECT *, cap / weight AS fills,
                (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(weight) OVER (ORDER BY cap / weight, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
        t AS (
            SELECT source, source_size, coalesce(least(cap, (SELECT level FROM l WHERE fills > level ORDER BY fills, nr LIMIT 1) * weight), cap) AS target,
                (('0x' || substr(md5('7:' || coalesce('s' || source, 'n')), 1, 4))::BIGINT + 0.5::DOUBLE) / 65536.0::DOUBLE AS shift FROM l),
        r AS (
            SELECT doc_id, d.source, size, source_size, target, shift,
                CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate,
                row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)) * 8 + (4 * (substr(rpad(substr(bin(size), 2, 3), 3, '0'), 1, 1)::INT) + 2 * (substr(rpad(substr(bin(size), 2, 3), 3, '0'), 2, 1)::INT) + (substr(rpad(substr(bin(size), 2, 3), 3, '0'), 3, 1)::INT)),
                    (((coalesce(doc_id, 0) % 1000003 + 1000003) % 1000003) * 7919 + size * 104729) % 1048576, doc_id, size)::DOUBLE AS rank
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, ((floor(rate * rank + shift) - floor(rate * (rank - 1.0) + shift)) * size)::BIGINT AS taken FROM r
    """,
    "op11_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        q AS (
            SELECT DISTINCT r, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS r, item_id, text FROM benchmark)),
        s AS (SELECT count(*) FILTER (len(ws) > 0) AS nn, sum(len(ws))::BIGINT AS l FROM d),
        p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
        x AS (
            SELECT q.r AS qr, item_id, p.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // l)))))::BIGINT AS score
            FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
        SELECT item_id, rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id, r)::INT AS rank FROM x WHERE score > 0) WHERE rank <= 50
    """,
    "op12_merkle": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, lang, e[1] || e[2] || e[3] || e[4] || e[5] AS plain, e[1] || e[2] || e[3] || f || e[5] AS changed, coalesce(crc % 7 = 0, false) AS tampered FROM (
                SELECT doc_id, lang, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS e,
                    coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS f,
                    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM documents)),
        leaves AS (
            SELECT r, doc_id, lang, sha256(plain) AS leaf, sha256(CASE WHEN tampered THEN changed ELSE plain END) AS other,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(plain)) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d),
        up(lang, level, idx, digest, n) AS (
            SELECT lang, 0, idx, leaf, n FROM leaves
            UNION ALL SELECT lang, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), max((n + 1) // 2) FROM up WHERE n > 1 GROUP BY lang, level, idx // 2),
        subroots AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
        over(level, idx, digest, n) AS (
            SELECT 0, idx, digest, n FROM subroots
            UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), max((n + 1) // 2) FROM over WHERE n > 1 GROUP BY level, idx // 2),
        sides AS (
            SELECT r, v.level AS level, CASE WHEN u.digest IS NULL THEN '-' WHEN (l.idx >> v.level) & 1 = 1 THEN 'L' || u.digest ELSE 'R' || u.digest END AS side
            FROM leaves l JOIN (SELECT DISTINCT lang, level FROM up WHERE n > 1) v ON l.lang IS NOT DISTINCT FROM v.lang
            LEFT JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.level = v.level AND u.idx = xor(l.idx >> v.level, 1)
            UNION ALL SELECT r, 1000 + v.level, CASE WHEN u.digest IS NULL THEN '-' WHEN (s.idx >> v.level) & 1 = 1 THEN 'L' || u.digest ELSE 'R' || u.digest END
            FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT DISTINCT level FROM over WHERE n > 1) v ON true
            LEFT JOIN over u ON u.level = v.level AND u.idx = xor(s.idx >> v.level, 1)),
        paths AS (SELECT r, list(side ORDER BY level) AS sides FROM sides GROUP BY r),
        out AS (
            SELECT doc_id, leaf, s.digest AS subroot, (SELECT digest FROM over WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(sides, lambda x: substr(x, 2)), ''), '')) AS proof_sha256,
                list_reduce(list_prepend(other, coalesce(sides, [])), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN substr(x, 2) || a WHEN 'R' THEN a || substr(x, 2) ELSE a END)) AS folded_root
            FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths p ON p.r = l.r)
        SELECT *, folded_root = root AS verified FROM out
    """,
    "op13_line_dedup": r"""
        WITH l AS (
            SELECT r, doc_id, generate_subscripts(ls, 1) AS nr, unnest(ls) AS line FROM (
                SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 2),
        g AS (SELECT r, doc_id, nr, line, s.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS dropped FROM k LEFT JOIN s USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT dropped), '')) AS kept_sha256 FROM g GROUP BY r, doc_id
    """,
}

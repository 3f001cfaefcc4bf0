"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import load


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import identify, train

    docs = load(spark, sf_dir, "documents")
    # A null id hashes as an empty text: held out, so that it is never learned from.
    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    model = train(docs.select("doc_id", "text", "lang").where(remainder != 0))
    return identify(docs.select("doc_id", (remainder == 0).alias("held_out"), "text"), model).drop("text")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import groups_of_copies

    return groups_of_copies(load(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licences import scan_licences

    return scan_licences(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import BASE, joined, personal_data

    found = personal_data(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_secret", "n_term")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lm_scoring import score, train

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    good = load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = score(docs, *train(docs, good))
    # Sums of doubles depend on their order in the last digits.
    return found.select("doc_id", "n_tokens", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("target_loss", "background_loss", "score")])


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from tessera.llm.packing import pack

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(load(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minmax_dedup import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"), width=3, similarity=(85, 100)).drop("text_md5")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.covertree_dedup import near_vectors

    return near_vectors(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), cosine=0.98)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mixed

    return mixed(load(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import balanced_shards

    found = balanced_shards(load(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def llm_language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1's result what SQL can say: the fold of each document, and whether it has no language."""
    return op1_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"))


def llm_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4's result what SQL can say: the base spans."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9's result what SQL can say: sizes and targets, and that each source's words come within its largest document of the target."""
    found = op9_mixing(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    by_source = found.groupBy("source").agg(F.sum("size").alias("size"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 4).alias("target"), (F.abs(F.sum("taken") - F.max("target")) <= F.max("size")).alias("near"))
    return by_source


QUERIES = {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_licence_scan, op4_pii, op5_lm_scoring, op6_packing, op7_minhash_near_dedup, op8_embedding_near_dedup, op9_mixing, op10_sharding, llm_language_folds, llm_base_spans, llm_mix_targets)}

#: CRC-32 of the UTF-8 bytes of {0}, by the table of its polynomial.
CRC_TABLE = """
        poly(i, k, c) AS (
            SELECT i, 0, i FROM range(256) t(i) UNION ALL
            SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM poly WHERE k < 8
        ), crc_table AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8)"""
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, crc_table.t[1 + (xor(a, b) & 255)])))"

SPAN_KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([ -]?[0-9])+"), ("phone", r"\+[0-9][ ().0-9-]+[0-9]"))


def spans_sql(rank: int, kind: str, pattern: str) -> str:
    """Rows (doc_id, kind, rank, start, stop, value, digits) of all matches: a split's pieces and the matches give their places."""
    length = "list_sum(list_transform({0}, lambda x: length(x)))"
    return f"""
        SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(list_transform(range(1, len(m) + 1), lambda i: {length.format("p[1:i]")} + coalesce({length.format("m[1:i-1]")}, 0))) AS start,
               unnest(m) AS value, regexp_replace(value, '[^0-9]', '', 'g') AS digits
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM texts)"""


LUHN = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substring(reverse(digits), i, 1)::INT WHEN 2 * substring(reverse(digits), i, 1)::INT > 9 THEN 2 * substring(reverse(digits), i, 1)::INT - 9 ELSE 2 * substring(reverse(digits), i, 1)::INT END)) % 10 = 0"

ORACLES = {
    "llm_language_folds": f"""
        WITH RECURSIVE {CRC_TABLE}
        SELECT doc_id, {CRC.format("coalesce(doc_id::VARCHAR, '')")} % 5 = 0 AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS undetermined FROM documents, crc_table
    """,
    "llm_base_spans": f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({" UNION ALL ".join(spans_sql(i, k, p) for i, (k, p) in enumerate(SPAN_KINDS))}),
        valid AS (
            SELECT doc_id, kind, rank, start, start + length(value) AS stop FROM found
            WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN list_max(list_transform(string_split(value, '.'), lambda x: x::HUGEINT)) <= 255
                  WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND {LUHN} ELSE length(digits) BETWEEN 9 AND 15 END
        )
        SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _ in SPAN_KINDS)},
               sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '')) AS base_sha256
        FROM texts LEFT JOIN valid USING (doc_id) GROUP BY doc_id
    """,
    "llm_mix_targets": r"""
        WITH RECURSIVE words AS (
            SELECT source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM documents
        ), sizes AS (
            SELECT source, sum(n)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) AS k, 1 + (k - 1) % 3 AS weight FROM words GROUP BY source
        ), rounds(i, full_sources) AS (
            SELECT 0, []::BIGINT[]
            UNION ALL
            SELECT i + 1, coalesce((
                SELECT list(s.k ORDER BY s.k) FROM sizes s, (
                    SELECT (SELECT sum(size) FROM sizes) - coalesce(sum(3 * size) FILTER (list_contains(full_sources, k)), 0) AS open_words, sum(weight) FILTER (NOT list_contains(full_sources, k)) AS open_weight FROM sizes) o
                WHERE list_contains(full_sources, s.k) OR open_words * s.weight / open_weight > 3 * s.size), [])
            FROM rounds WHERE i < 64
        ), last AS (SELECT coalesce(full_sources, []) AS full_sources FROM rounds ORDER BY i DESC LIMIT 1),
        open AS (
            SELECT full_sources, (SELECT sum(size) FROM sizes) - coalesce(sum(3 * size) FILTER (list_contains(full_sources, k)), 0) AS words, sum(weight) FILTER (NOT list_contains(full_sources, k)) AS weight
            FROM sizes, last GROUP BY full_sources
        )
        SELECT source, size, size AS source_size, round(CASE WHEN list_contains(full_sources, k) THEN 3.0 * size ELSE words * sizes.weight / open.weight END, 4) AS target, true AS near FROM sizes, open
    """,
    "op5_lm_scoring": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS place, doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
                   list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w
            FROM documents
        ), steps AS (
            SELECT place, good, unnest(list_zip(list_prepend(' ', w[:-2]), w)) AS s FROM docs WHERE len(w) > 0
        ), pairs AS (
            SELECT s[1] AS v, s[2] AS x, count(*) AS n, count(*) FILTER (good) AS g FROM steps GROUP BY ALL
        ), words AS (SELECT x, sum(n) AS n, sum(g) AS g FROM pairs GROUP BY ALL),
        before AS (SELECT v, sum(n) AS n, sum(g) AS g FROM pairs GROUP BY ALL),
        total AS (
            SELECT CASE WHEN sum(g) = 0 THEN sum(n) ELSE sum(g) END::DOUBLE AS t, t / sum(n) AS f, sum(g) = 0 AS none, 0.5 * (count(*) + 2) AS size FROM words
        ), logs AS (
            SELECT p.v, p.x, ln((f * p.n + 50 * (f * w.n + 0.5) / (t + size)) / (f * b.n + 50)) AS lb,
                   CASE WHEN none THEN lb ELSE ln((p.g + 50 * (w.g + 0.5) / (t + size)) / (b.g + 50)) END AS lt
            FROM pairs p JOIN words w ON p.x = w.x JOIN before b ON p.v = b.v, total
        ), losses AS (
            SELECT place, -avg(lt) AS target, -avg(lb) AS background FROM steps JOIN logs ON s[1] = v AND s[2] = x GROUP BY place
        )
        SELECT doc_id, len(w) AS n_tokens, round(target, 6) + 0.0 AS target_loss, round(background, 6) + 0.0 AS background_loss,
               round(target - background, 6) + 0.0 AS score
        FROM docs LEFT JOIN losses USING (place)
    """,
    "op10_sharding": f"""
        WITH RECURSIVE {CRC_TABLE}, sized AS (
            SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents
        ), together AS (
            SELECT *, min(doc_id) OVER same AS first_id, sum(size) OVER same AS bytes, count(*) OVER same AS n FROM sized WINDOW same AS (PARTITION BY t)
        ), led AS (
            SELECT *, n > 1 AND bytes <= 0.05 * (SELECT sum(size) FROM sized) / 16 AS whole, md5(t) AS h FROM together
        ), laid AS (
            SELECT *, sum(size) OVER (ORDER BY first_id NULLS FIRST, h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS start,
                   row_number() OVER (ORDER BY first_id NULLS FIRST, h, doc_id NULLS FIRST) AS place FROM led
        ), placed AS (
            SELECT *, ((CASE WHEN whole THEN 2 * min(start) OVER (PARTITION BY t) + bytes ELSE 2 * start + size END) * 16
                       // (2 * (SELECT sum(size) FROM sized)))::INT AS shard FROM laid
        )
        SELECT doc_id, size::BIGINT AS size, {CRC.format("p.t")} AS text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard
        FROM placed p, crc_table
    """,
    "op7_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
        ), items AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach(a, b) AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least_of AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
        SELECT d.doc_id, len(s) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
        FROM sets d LEFT JOIN least_of USING (doc_id)
    """,
    "op8_embedding_near_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach(a, b) AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        )
        SELECT v.vec_id, coalesce((SELECT count(*) FROM links WHERE a = v.vec_id), 0) AS n_links,
               least(v.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = v.vec_id), v.vec_id)) AS component_id,
               least(v.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = v.vec_id), v.vec_id)) = v.vec_id AS kept
        FROM embeddings v
    """,
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}

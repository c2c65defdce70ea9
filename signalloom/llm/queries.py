"""The registered queries of the text operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import alignment, chat, decontaminate, embedding, language, lexical, lm, minhash, mixing, secret_scan, suffix, toxicity, warc
from signalloom.llm.common import cut, pick, remainder, table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


CHAT_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
placed AS (
    SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
        24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))
            + 2 * len(regexp_extract_all(role, '[%\n]')) + len(regexp_extract_all(role, '<\\*\|')) AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM rows),
marked AS (SELECT *, pos = 1 AND role = 'system' AS sys, CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE tokens END AS counted FROM placed),
summed AS (
    SELECT *, sum(counted) OVER (PARTITION BY conv_id ORDER BY pos) AS until,
        greatest(1, 1024 - 256 - max(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id)) AS room
    FROM marked),
labelled AS (
    SELECT *, until - counted AS since, (until - counted) // room AS cell,
        CASE WHEN NOT sys AND (until - 1) // room <> (until - counted) // room THEN pos ELSE 0 END AS own
    FROM summed),
opened AS (
    SELECT *, coalesce(NOT lag(sys) OVER w AND (cell <> lag(cell) OVER w OR own <> lag(own) OVER w), false) AS opens
    FROM labelled WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
spans AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS span FROM opened),
reached AS (
    SELECT *, CASE WHEN sys THEN max(span) OVER (PARTITION BY conv_id) ELSE greatest(span, coalesce(max(CASE WHEN opens THEN span END)
        OVER (PARTITION BY conv_id ORDER BY since RANGE BETWEEN CURRENT ROW AND 256 FOLLOWING), span)) END AS last
    FROM spans)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars * (last - span + 1))::BIGINT AS formatted_chars
FROM reached GROUP BY conv_id
"""


@query("op9_chat_windows", CHAT_SQL)
def op9_chat_windows(spark, sf_dir):
    said = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    control = "'<|im_end|><|im_start|>assistant ok'"
    extra = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"{control} AS text")
    return chat.conversation_digests(chat.format_windows(said.unionByName(extra)))


@query("op5_mix_sources")
def op5_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


WARC_SQL = """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM rows),
firsts AS (SELECT h, min(page_id) AS first FROM hashed GROUP BY h),
bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
    4 * strpos('0123456789abcdef', substr(h, i, 1)) - 3, 4)), 'string_agg', '') AS b FROM hashed JOIN firsts USING (h))
SELECT page_id, n::BIGINT AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
          + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM bits
"""


@query("op2_warc_archives", WARC_SQL)
def op2_warc_archives(spark, sf_dir):
    folder, manifest = warc.write_archives(pick(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    read = warc.read_archives(folder, manifest, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


EMBEDDING_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id)::BIGINT AS n_links, min(reach.b) AS component_id, vec_id = min(reach.b) AS kept
FROM embeddings JOIN reach ON reach.a = vec_id GROUP BY vec_id
"""


@query("op7_embedding_neardup", EMBEDDING_SQL)
def op7_embedding_neardup(spark, sf_dir):
    return embedding.near_duplicates(pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = pick(table(spark, sf_dir, "labels"), "doc_id", "toxic")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.where(~held_out), labels)
    scored = toxicity.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_language")
def op6_language(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out))
    found = language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op10_decontaminate")
def op10_decontaminate(spark, sf_dir):
    """Every document that holds a passage of an item, with the item and the errors."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = decontaminate.find(docs, pick(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    pairs = found.select("doc_id", F.explode(F.arrays_zip("item_ids", "distances")).alias("m"))
    return pairs.select("doc_id", F.col("m")["item_ids"].alias("item_id"), F.col("m")["distances"].alias("distance"))


@query("op8_lm_score")
def op8_lm_score(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    docs = docs.withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
    training = docs.where(~F.col("held_out"))
    counts, known = lm.count_words(training)
    return lm.score(docs, ["doc_id", "held_out"], counts, known, lm.train(training, known))


NEARDUP_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
twice AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, twice.b FROM reach JOIN twice ON reach.b = twice.a)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op4_minhash_neardup", NEARDUP_SQL)
def op4_minhash_neardup(spark, sf_dir):
    return minhash.near_duplicates(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), size=4, similarity=0.8)


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(pick(table(spark, sf_dir, "documents"), "doc_id", "text")).drop("kept")


LEXICAL_SQL = r"""
WITH term_rows AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM term_rows GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
held AS (SELECT doc_id, term, count(*) AS tf FROM term_rows SEMI JOIN wanted USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY term),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op13_lexical_search", LEXICAL_SQL)
def op13_lexical_search(spark, sf_dir):
    return lexical.search(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), pick(table(spark, sf_dir, "benchmark"), "item_id", "text"), k=10)


def _secret_sql() -> str:
    kinds, any_ = secret_scan.KINDS, secret_scan._ANY
    quoted = lambda p: p.replace("'", "''")
    found = " UNION ALL ".join(f"""
    SELECT doc_id, '{kind}' AS kind, {place} AS place, unnest(string_split_regex(t, '{quoted(p)}')) AS gap, unnest(regexp_extract_all(t, '{quoted(p)}', 0)) AS m,
        unnest(regexp_extract_all(t, '{quoted(p)}', {group})) AS held, unnest(range(len(regexp_extract_all(t, '{quoted(p)}', 0)))) AS i
    FROM texts""" for place, (kind, p, group) in enumerate([*((k, p, g) for k, (p, g, _) in kinds.items()), (secret_scan.RANDOM, any_, 3)]))
    least = " ".join(f"WHEN '{k}' THEN {n}" for k, (_, _, n) in kinds.items())
    k, added = len(secret_scan.ALPHABET), secret_scan.ADDED
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS stop FROM found WHERE m IS NOT NULL),
spans AS (SELECT * FROM placed WHERE length(held) >= CASE kind {least} ELSE {secret_scan.LEAST} END),
hashes AS (SELECT DISTINCT md5(t) AS h FROM texts JOIN documents USING (doc_id) WHERE text IS NOT NULL ORDER BY h LIMIT {secret_scan.SAMPLE_DOCS}),
words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{secret_scan.RUN}{{6,}}')) AS v FROM documents WHERE md5(text) <= (SELECT max(h) FROM hashes)),
secrets AS (SELECT DISTINCT regexp_replace(held, '[^A-Za-z0-9+/_-]', '', 'g') AS v FROM spans WHERE kind <> '{secret_scan.RANDOM}'),
samples AS (
    SELECT 0 AS label, v FROM words WHERE NOT (regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]'))
    UNION ALL (SELECT 1, v FROM secrets WHERE regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') ORDER BY md5(v), v LIMIT {secret_scan.SAMPLE_STRINGS})),
pairs AS (SELECT label, unnest(list_transform(range(1, length(v) + 1), lambda i: struct_pack(a := substr(v, i - 1, CASE WHEN i = 1 THEN 0 ELSE 1 END), b := substr(v, i, 1)))) AS p FROM samples),
counts AS (SELECT p.a AS a, p.b AS b, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM pairs GROUP BY ALL),
chars AS (SELECT unnest(string_split('{secret_scan.ALPHABET}', '')) AS c),
chains AS (SELECT a.c AS a, b.c AS b, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1 FROM (SELECT c FROM chars UNION ALL SELECT '') a CROSS JOIN chars b LEFT JOIN counts ON counts.a = a.c AND counts.b = b.c),
ratios AS (
    SELECT a, b, CASE WHEN sum(n0) OVER () > 0 AND sum(n1) OVER () > 0 THEN ln((n1 + {added})::DOUBLE / (sum(n1) OVER w + {added * k})::DOUBLE) - ln((n0 + {added})::DOUBLE / (sum(n0) OVER w + {added * k})::DOUBLE) ELSE 0 END AS r
    FROM chains WINDOW w AS (PARTITION BY a)),
runs AS (SELECT DISTINCT m AS v FROM spans WHERE kind = '{secret_scan.RANDOM}'),
steps AS (SELECT v, unnest(list_transform(range(1, length(v) + 1), lambda i: struct_pack(a := substr(v, i - 1, CASE WHEN i = 1 THEN 0 ELSE 1 END), b := substr(v, i, 1)))) AS p FROM runs),
judged AS (SELECT v FROM steps JOIN ratios ON a = p.a AND b = p.b GROUP BY v HAVING sum(r) > {secret_scan.MARGIN}),
kept AS (
    SELECT doc_id, kind, place, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS said
    FROM spans WHERE kind <> '{secret_scan.RANDOM}' OR m IN (SELECT v FROM judged))
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(said, ',' ORDER BY start, place) FILTER (kind <> '{secret_scan.RANDOM}'), '')) AS base_sha256,
    coalesce(string_agg(said, ',' ORDER BY start, place), '') AS spans
FROM documents LEFT JOIN kept USING (doc_id) GROUP BY doc_id
"""


@query("op12_secret_scan", _secret_sql())
def op12_secret_scan(spark, sf_dir):
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.fit(secret_scan.labelled(docs.select("text")))).select("doc_id", "spans")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.RANDOM)
    return found.select("doc_id", *[of(k) for k in secret_scan.KINDS], F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
                        secret_scan.written(F.col("spans")).alias("spans"))


#: Folder of the public tokenizers' files; the driver reads them.
TOKENIZERS = "/opt/tokenizers"


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark, sf_dir, tokenizers: str = TOKENIZERS):
    files = alignment.Tokenizers.read(f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    aligned = alignment.align(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), files)
    return alignment.rate(aligned, cut(alignment.pair_counts(aligned, files.n_ids_b()), "pairs"))

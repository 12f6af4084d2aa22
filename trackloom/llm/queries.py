"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import centroids, chat, exact_dedup, fingerprints, hilbert, language_id, mixing, ngram_join, packing, quality, repair, url_filters, warc
from trackloom.llm._common import short_reads, table

Query = Callable[[SparkSession, str], DataFrame]

#: The rules that the query judges pages by.
URL_RULES: tuple[url_filters.Rule, ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), language_id.fold(F.col("doc_id"), 3) == 1
    model = quality.fit(docs, table(spark, sf_dir, "labels"), trainable=~held_out)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizer())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AND row_number() OVER (PARTITION BY coalesce(d.text, ''), d.doc_id) = 1 AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d
JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g
  ON coalesce(d.text, '') = g.t
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), language_id.fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs, trainable=~held_out)
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # chunks so small that most of these pages have several
    return warc.round_trip(table(spark, sf_dir, "pages"), chunk=4096)


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
best AS (SELECT html AS h, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN b.best <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b.best <> p.page_id THEN b.best END AS refers_to
FROM p LEFT JOIN best b ON p.html = b.h
"""


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


OP8_SQL = r"""
WITH people AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
r AS (
  SELECT c.conv_id, p.perspective, c.turn, c.role AS speaker, regexp_replace(coalesce(c.text, ''), '<(\\*)\|', '<\\\1\1|', 'g') AS said,
         CASE WHEN c.role = 'system' THEN 'system' WHEN c.role = p.perspective THEN 'assistant' ELSE 'user' END AS shown_as
  FROM conversations c JOIN people p ON c.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (
  SELECT *, '<|im_start|>' || shown_as || CASE WHEN shown_as = 'user' THEN ' name=' || regexp_replace(regexp_replace(coalesce(speaker, 'unknown'), '<(\\*)\|', '<\\\1\1|', 'g'), '\s', '_', 'g') ELSE '' END || chr(10) AS header
  FROM r)
SELECT conv_id, perspective, turn, speaker, shown_as, header || said || '<|im_end|>' || chr(10) AS segment,
       shown_as = 'assistant' AS train, CASE WHEN shown_as = 'assistant' THEN length(header) END::BIGINT AS mask_start,
       CASE WHEN shown_as = 'assistant' THEN length(said) ELSE 0 END::BIGINT AS mask_length
FROM h
"""


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_reads(spark)
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         (CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM s0),
s2 AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM s1),
s3 AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM s2 WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, least(cap, w * coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 'inf'::DOUBLE)) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM s4),
s6 AS (SELECT *, target - whole * source_size AS need FROM s5),
o AS (SELECT *, pow(2.0::DOUBLE, round(log2(1.0::DOUBLE / length(bin(size))) * 16) / 16) AS own FROM d),
c0 AS (SELECT o.source, s.need, own, sum(size) AS words FROM o JOIN s6 s ON o.source IS NOT DISTINCT FROM s.source WHERE size > 0 GROUP BY ALL),
c1 AS (
  SELECT *, (need - coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(own * words) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
  FROM c0 WINDOW w AS (PARTITION BY source ORDER BY own DESC)),
c2 AS (SELECT source, coalesce(arg_max(c, own) FILTER (WHERE c * own <= 1), 'inf'::DOUBLE) AS c FROM c1 GROUP BY source),
k AS (
  SELECT o.doc_id, o.source, o.size, s.source_size, s.target, s.whole, s.need, o.u, least(greatest(coalesce(c2.c, 0) * own, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS p
  FROM o JOIN s6 s ON o.source IS NOT DISTINCT FROM s.source LEFT JOIN c2 ON o.source IS NOT DISTINCT FROM c2.source),
q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q, need > 0 AND size > 0 AS drawable FROM k),
r AS (SELECT *, drawable AND sum(CASE WHEN drawable THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= need AS drawn FROM q),
g AS (SELECT source, any_value(need) - coalesce(sum(size) FILTER (WHERE drawn), 0) AS gap FROM r GROUP BY source),
f AS (SELECT r.source, arg_min(doc_id, (abs(size - gap), q, doc_id)) AS filler FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source WHERE drawable AND NOT drawn AND abs(size - gap) < gap GROUP BY r.source)
SELECT r.doc_id, r.source, size, source_size, target, (whole + CASE WHEN drawn OR r.doc_id = f.filler THEN 1 ELSE 0 END)::BIGINT AS copies,
       ((whole + CASE WHEN drawn OR r.doc_id = f.filler THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r LEFT JOIN f ON r.source IS NOT DISTINCT FROM f.source
"""


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Every distance in full, in SQL."""
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM v ORDER BY sha256('2:' || vec_id) NULLS LAST, q LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c FROM (
    SELECT r, c, list_sum(list_transform(list_zip(v.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i} m)
  GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(n.q, m.q) AS q FROM c{i} m LEFT JOIN (
    SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS q FROM (
      SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS i FROM v JOIN a{i} a USING (r)) GROUP BY c, i) GROUP BY c) n USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.q, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY a.c) AS centroid_size
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} m USING (c)"""


def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards_by_curve(table(spark, sf_dir, "documents"))


#: crc AS: t, the list of the remainders of the 256 bytes; and the checksum of a text, by that list.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"


def _crc(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, crc.t[xor(a & 255, b) + 1]), 4294967295), 4294967295)"


def _op12_sql(shards: int = 24, bits: int = 8) -> str:
    """Cells by running counts of values, the curve one bit a step, shards by rank."""
    digits, following = hilbert.curve_tables(3)
    parts = [
        _CRC_TABLE,
        f"""d AS MATERIALIZED (
  SELECT doc_id, lang, source, md5(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc("coalesce(text, '')")}::BIGINT AS crc
  FROM documents, crc)""",
        "n AS (SELECT count(*) AS n FROM d)",
    ]
    for c in ("lang", "source", "size"):
        parts.append(f"cell_{c} AS (SELECT v, coalesce(sum(m) OVER (ORDER BY v NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << bits} // n AS cell FROM (SELECT {c} AS v, count(*) AS m FROM d GROUP BY 1), n)")
    parts.append("""h0 AS (
  SELECT d.*, a.cell AS x, b.cell AS y, c.cell AS z, 0::BIGINT AS curve, 0 AS o
  FROM d JOIN cell_lang a ON d.lang IS NOT DISTINCT FROM a.v JOIN cell_source b ON d.source IS NOT DISTINCT FROM b.v JOIN cell_size c ON d.size = c.v)""")
    for i in range(bits):
        k = bits - 1 - i
        at = f"o * 8 + ((x::BIGINT >> {k}) & 1) + 2 * ((y::BIGINT >> {k}) & 1) + 4 * ((z::BIGINT >> {k}) & 1) + 1"
        parts.append(f"h{i + 1} AS (SELECT * EXCLUDE (curve, o), curve * 8 + {digits}[{at}] AS curve, {following}[{at}] AS o FROM h{i})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (r * {shards} // n)::INTEGER AS shard, r - ((r * {shards} // n) * n + {shards - 1}) // {shards} AS slot, NULL::INTEGER AS grown_shard, curve
FROM (SELECT *, row_number() OVER (ORDER BY curve, h, doc_id NULLS FIRST, size, crc) - 1 AS r FROM h{bits}), n"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def _op13_sql() -> str:
    """One row a step: the cheapest edits to each of the four grammar states, as (cost, edits), or null."""
    least = lambda *w: "list_min(list_filter([" + ", ".join(w) + "], lambda x: x IS NOT NULL))"
    add = lambda s, cost, letter: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'e': {s}.e || '{letter}'}} END"
    keep = lambda s, i, to: f"CASE WHEN NOT gone AND initial = '{i}' THEN {add(s, 'open', 'K')} END"
    rerole = lambda s: f"CASE WHEN NOT gone THEN {add(s, '3 + open', 'R')} END"
    drop = lambda s: add(s, 4, "D")
    return f"""WITH RECURSIVE {_CRC_TABLE},
hit AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc),
rows AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM (
    SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END))
    FROM hit WHERE k <> 0)),
faults AS MATERIALIZED (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM rows),
input AS MATERIALIZED (SELECT conv_id, i, role, text, initial, blank OR again AS gone, CASE WHEN open THEN 3 ELSE 0 END AS open FROM faults),
ids AS MATERIALIZED (SELECT DISTINCT conv_id FROM conversations),
bare AS (SELECT {{'c': 0::BIGINT, 'e': ''}} AS w),
way(conv_id, i, w0, w1, w2, w3) AS (
  SELECT conv_id, 0::BIGINT, w, CASE WHEN false THEN w END, {{'c': 3::BIGINT, 'e': 'I'}}, {{'c': 6::BIGINT, 'e': 'II'}} FROM ids, bare
  UNION ALL
  SELECT conv_id, i, w0, w1, {least('w2', add('w0', 3, 'I'), add('w1', 3, 'I'), add('w3', 3, 'I'))}, {least('w3', add('w2', 3, 'I'), add('w0', 6, 'II'), add('w1', 6, 'II'))} FROM (
    SELECT y.conv_id, r.i, {drop('w0')} AS w0, {least(drop('w1'), keep('w0', 's', 1))} AS w1,
           {least(drop('w2'), keep('w0', 'u', 2), keep('w1', 'u', 2), keep('w3', 'u', 2), rerole('w0'), rerole('w1'), rerole('w3'))} AS w2,
           {least(drop('w3'), keep('w2', 'a', 3), rerole('w2'))} AS w3
    FROM way y JOIN input r ON y.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = y.i + 1)),
best AS MATERIALIZED (SELECT conv_id, i AS n, {least('w0', 'w3')} AS w FROM way QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
edits AS MATERIALIZED (
  SELECT conv_id, p, substr(w.e, p, 1) AS letter, length(replace(substr(w.e, 1, p), 'I', '')) AS at FROM (SELECT *, unnest(range(1, length(w.e) + 1)) AS p FROM best)),
lines AS MATERIALIZED (
  SELECT e.conv_id, e.p, letter, role, coalesce(text, '') AS text, letter = 'K' AND initial = 's' AS leads
  FROM edits e LEFT JOIN input r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.at = r.i AND letter <> 'I' WHERE letter <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t
  FROM (SELECT *, count(*) FILTER (WHERE NOT leads) OVER (PARTITION BY conv_id ORDER BY p) AS place FROM lines) GROUP BY conv_id),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate,
         count(*) FILTER (WHERE NOT blank AND NOT again AND open) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       b.w.c::BIGINT AS cost, b.w.e AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids c JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN stats s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id"""


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_url_filters": op3_url_filters,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_language_id": op6_language_id,
        "op7_warc": op7_warc,
        "op8_chat_perspectives": op8_chat_perspectives,
        "op9_document_fingerprints": op9_document_fingerprints,
        "op10_mix_sources": op10_mix_sources,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_hilbert_shards": op12_hilbert_shards,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op7_warc": OP7_SQL, "op8_chat_perspectives": OP8_SQL, "op10_mix_sources": OP10_SQL, "op11_centroid_clustering": _op11_sql(), "op12_hilbert_shards": _op12_sql(), "op13_conversation_repair": _op13_sql()}

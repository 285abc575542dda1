"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.llm import divergence, exact_dedup, langid, line_dedup, minhash, mixing, mtree, ngram_join, packing, pii, repair, toxicity, warc

UPPER, LOWER = exact_dedup.UPPER, exact_dedup.LOWER
#: ASCII white space, in SQL.
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.find_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_checksums(packing.pack(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.learn(docs, labels.filter(langid.remainder(F.col("doc_id"), 5) != 0))
    out = toxicity.score(docs, index)
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_inner_products(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_spans(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return out.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    # In a stated order, so that reruns agree row by row.
    return out.select("doc_id", "size", "source_size", "target", "taken").orderBy("doc_id", "size", "source_size", "taken")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs.filter(langid.remainder(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return langid.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(table(spark, sf_dir, "conversations")), present=F.col("here"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, sf_dir, "documents"))


def queries() -> dict:
    named = [op1_line_dedup, op2_exact_dedup, op3_packing, op4_toxicity, op5_mtree, op6_pii, op7_warc, op8_mixing, op9_langid, op10_minhash, op11_divergence, op12_repair, op13_ngram_join]
    return {f.__name__: f for f in named}


#: Turns from the last to the first carry the cheapest (cost, audit) from each state of the grammar.
_REPAIR = r"""
    WITH RECURSIVE raw AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
    ), told AS (
        SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),
            lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: z::BIGINT)), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295::BIGINT) % 20 AS kind FROM raw
    ), after AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM told, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS ini,
               NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM after
    ), doubled AS (
        SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
               lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS odd FROM placed
    ), turns AS (
        SELECT *, blank OR dup AS dead, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM doubled
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
               count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE odd) AS illegal, count(*) AS n
        FROM turns GROUP BY conv_id
    ), walk AS (
        SELECT conv_id, n + 1 AS i, [{'c': 0, 'a': ''}, {'c': 4, 'a': 'II'}, {'c': 2, 'a': 'I'}, {'c': 0, 'a': ''}] AS st FROM counted
        UNION ALL
        SELECT conv_id, i, [list_sort([b[1], {'c': 2 + u.c, 'a': 'I' || u.a}])[1], list_sort([b[2], {'c': 2 + u.c, 'a': 'I' || u.a}])[1], u, list_sort([b[4], {'c': 2 + b[3].c, 'a': 'I' || b[3].a}])[1]]
        FROM (SELECT *, list_sort([b[3], {'c': 2 + b[4].c, 'a': 'I' || b[4].a}])[1] AS u FROM (
            SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda s: list_sort(list_concat([{'c': 3 + st[s].c, 'a': 'D' || st[s].a}], CASE WHEN dead THEN [] ELSE
                list_concat([{'c': 2 + extra + st[CASE s WHEN 3 THEN 4 ELSE 3 END].c, 'a': 'R' || st[CASE s WHEN 3 THEN 4 ELSE 3 END].a}],
                    CASE WHEN ini = (CASE s WHEN 3 THEN 'a' ELSE 'u' END) THEN [{'c': extra + st[CASE s WHEN 3 THEN 4 ELSE 3 END].c, 'a': 'K' || st[CASE s WHEN 3 THEN 4 ELSE 3 END].a}]
                         WHEN ini = 's' AND s = 1 THEN [{'c': extra + st[2].c, 'a': 'K' || st[2].a}] ELSE [] END) END))[1]) AS b
            FROM (SELECT t.conv_id, t.i, t.ini, t.dead, CASE WHEN t.cut THEN 1 ELSE 0 END AS extra, w.st FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i - 1)))
    ), found AS (
        SELECT conv_id, st[1].c AS cost, st[1].a AS audit FROM walk WHERE i = 1
    ), letters AS (
        SELECT conv_id, audit, p, audit[p] AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM found)
    ), numbered AS (
        SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS place, count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY conv_id) AS total
        FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)
    ), lines AS (
        SELECT n.conv_id, p, CASE WHEN letter IN ('I', 'R') THEN CASE WHEN (place + 1 + total) % 2 = 0 THEN 'user' ELSE 'assistant' END ELSE role END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END AS line
        FROM numbered n LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM n.conv_id AND t.i = n.i WHERE letter <> 'D'
    ), texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS whole FROM lines GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM c.conv_id
      LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL; the other queries are tested against brute force, held-out accuracy or round trips."""
    return {
        "op1_line_dedup": f"""
            WITH lines AS (
                SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
                FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)
            ), keyed AS (
                SELECT *, translate(trim(line, {SPACE}), '{UPPER}', '{LOWER}') AS key FROM lines
            ), seen AS (
                SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
                GROUP BY key HAVING count(DISTINCT doc_id) >= 5
            ), marked AS (
                SELECT k.*, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN seen s USING (key)
            )
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
            FROM marked GROUP BY doc_id""",
        "op2_exact_dedup": f"""
            WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
            FROM t WINDOW w AS (PARTITION BY text)""",
        "op5_mtree": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                WHERE embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            ), scored AS (
                SELECT q.vec_id AS query_id, c.vec_id,
                       CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
            ), ranked AS (
                SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
            )
            SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
        "op11_divergence": r"""
            WITH d AS (
                SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
            ), said AS (
                SELECT row, lang, source, translate(word, 'UPPER', 'LOWER') AS term FROM (
                    SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM d)
            ), kept AS (
                SELECT lang, term, count(*) AS total FROM said GROUP BY lang, term HAVING count(DISTINCT row) >= 10
            ), langs AS (
                SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
            ), groups AS (SELECT DISTINCT lang, source FROM d), counts AS (
                SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL
            ), sizes AS (
                SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL
            ), shares AS (
                SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                       1 + CAST(1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * l.v) AS BIGINT) AS p,
                       1 + CAST(1000000000::HUGEINT * (k.total + 2) // (l.n + 2 * l.v) AS BIGINT) AS q
                FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
                LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
            ), pairs AS (
                SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
                FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
            ), parts AS (
                SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
                FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
                UNION ALL
                SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
            ), ranked AS (
                SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
            )
            SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""".replace("UPPER", UPPER).replace("LOWER", LOWER),
        "op12_repair": _REPAIR,
    }

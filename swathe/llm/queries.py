"""One registered query per operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.llm.chat import CONTROLS, chat_digests, format_chats
from swathe.llm.collocations import collocations
from swathe.llm.decontaminate import contaminated_by
from swathe.llm.lexical import rank_documents
from swathe.llm.neighbours import nearest
from swathe.llm.ngram_join import ngram_components
from swathe.llm.packing import pack_documents
from swathe.llm.quality import resample
from swathe.llm.secrets import BASE, find_secrets
from swathe.llm.slots import shard_documents
from swathe.llm.token_counts import token_counts
from swathe.llm.token_files import read_token_files, write_token_files
from swathe.llm.warc import normalise_archives, read_records, write_archives
from swathe.sources.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op9_token_counts")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"))


@query("op1_ngram_join", """
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'),
                   lambda x: x <> '') AS w FROM documents),
         s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4
                      THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 3], ' ')
                      for i in range(1, len(w) - 2)]) END AS s FROM d),
         g AS (SELECT doc_id, unnest(s) AS g FROM s),
         shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
                    FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
         links AS (SELECT a, b FROM shared x JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
                   WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
         reach AS (SELECT doc_id AS a, doc_id AS b FROM d
                   UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id
    FROM s JOIN reach r ON r.a = s.doc_id GROUP BY ALL""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_components(table(spark, sf, "documents"))


@query("op5_token_files")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    index = write_token_files(table(spark, sf, "documents"))
    return read_token_files(index).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_packing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


@query("op2_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
         f AS (SELECT *, CASE WHEN payload_bytes >= 100
                         THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first < page_id THEN first END AS refers_to FROM f""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    archives = write_archives(table(spark, sf, "pages"))
    records = read_records(normalise_archives(archives))

    def key(name: str):
        return F.expr(f"try_cast(substr(rtrim('>', {name}), 13) AS bigint)")  # <urn:record:KEY>

    # A response's figures come from the payload read back, a revisit's from its own header.
    return records.select(
        key("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.substring_index("payload_digest", ":", -1)).alias(
            "payload_digest"),
        "record_type", key("refers_to").alias("refers_to"))


@query("op3_secrets")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    def of(*kinds: str) -> str:
        return f"filter(spans, s -> s.kind IN ({', '.join(map(repr, kinds))}))"

    def joined(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"

    return find_secrets(table(spark, sf, "documents")).selectExpr(
        "doc_id", *(f"cast(size({of(k)}) AS bigint) AS n_{k}" for k in BASE),
        f"sha2({joined(of(*BASE))}, 256) AS base_sha256", f"{joined('spans')} AS spans")


_CONTROL = "|".join("".join(f"\\{c}" if c in "[]" else c for c in w[0]) + r"\\*" + "".join(
    f"\\{c}" if c in "[]" else c for c in w[1:]) for w in CONTROLS)


@query("op10_chat", f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
               FROM conversations
               UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
               UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
         t AS (SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4
                      ELSE 17 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END
                      + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS n FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), ''
                  ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END) AS BIGINT)
             AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                           FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(3 + sum(n) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    chats = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                 "conv_id long, turn long, role string, text string")
    return chat_digests(stage(format_chats(chats.unionByName(more)), "chats"))


@query("op7_quality")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return resample(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_decontamination")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated_by(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_neighbours")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0")).select(
        F.col("query_id").cast("long").alias("query_id"), "rank", "vec_id", "score")


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op11_lexical_search", rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, {_LOWER}),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
         s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words
               FROM d WHERE len(terms) > 0),
         i AS (SELECT item_id, term, count(*) AS r FROM (
                   SELECT item_id, unnest(regexp_extract_all(translate(text, {_LOWER}),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                   FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
         t AS (SELECT doc_id, n, term, count(*) AS tf FROM (
                   SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
               WHERE term IN (SELECT term FROM i) GROUP BY ALL),
         w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)
                                                 / (2 * count(*) + 1))) AS BIGINT) AS w
               FROM t, s GROUP BY term),
         x AS (SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) //
                   (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) AS BIGINT) AS score
               FROM i JOIN t USING (term) JOIN w USING (term), s GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)
                         AS INTEGER) AS rank, doc_id, score
    FROM x WHERE score > 0 QUALIFY rank <= 10""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_slot_shards")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(table(spark, sf, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot")


@query("op13_collocations", f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                      translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece
               FROM documents),
         w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
               FROM p),
         g AS (SELECT lang, 1 AS k, unnest(w) AS g FROM w
               UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])
               FROM w
               UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]
                                                 for i in range(1, len(w) - 1)]) FROM w),
         f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
         n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
         c AS (SELECT lang, k, g, f, string_split(g, ' ') AS s FROM f WHERE k > 1 AND f >= 10),
         cuts AS (SELECT lang, k, g, f, cut, s,
                         array_to_string(s[:cut], ' ') AS a, array_to_string(s[cut + 1:], ' ') AS b
                  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
         scored AS (SELECT u.lang, u.k, u.g, u.f, u.cut, l.f AS l, r.f AS r,
                           (1000000 * u.f::HUGEINT * u.f) // (l.f::HUGEINT * r.f) AS score
                    FROM cuts u JOIN f l ON l.lang = u.lang AND l.k = u.cut AND l.g = u.a
                    JOIN f r ON r.lang = u.lang AND r.k = u.k - u.cut AND r.g = u.b),
         least AS (SELECT * FROM scored
                   QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
         longer AS (SELECT lang, g, max(f) AS f FROM (
                        SELECT lang, f, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS g
                        FROM c WHERE k = 3) GROUP BY lang, g)
    SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY x.score DESC, x.f DESC, x.g)
             AS rank, x.g AS phrase, x.f AS a, x.l, x.r, n.n, CAST(x.score AS BIGINT) AS score
    FROM least x JOIN n ON n.lang = x.lang LEFT JOIN longer y ON y.lang = x.lang AND y.g = x.g
    WHERE y.f IS NULL OR 100 * y.f < 50 * x.f QUALIFY rank <= 2000""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))

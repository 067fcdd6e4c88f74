"""The registered queries of the operators, and SQL twins where SQL can express them."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metagauge.llm import chat
from metagauge.llm.decontaminate import find_items, hit_words
from metagauge.llm.fingerprints import compare_with_edits
from metagauge.llm.near_dedup import near_duplicates
from metagauge.llm.neighbours import nearest
from metagauge.llm.pieces import round_trip
from metagauge.llm.quality import judge
from metagauge.llm.repeats import cut_repeats, words_in
from metagauge.llm.runs import find_runs
from metagauge.llm.sharding import shard_by_bytes
from metagauge.llm.tables import shared_folder, table
from metagauge.llm.token_counts import count_tokens
from metagauge.llm.token_files import read_token_files, write_token_files
from metagauge.llm.vectors import finite
from metagauge.llm.whitening import whiten


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies: in ``$TOKENIZERS_DIR``, else where the package says."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations"))
    spelled = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.array(
            *[
                F.struct(F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("content"))
                for role in ("user", "assistant")
            ]
        ).alias("messages"),
    )
    return chat.digests(chat.format_turns(turns.unionByName(chat.canonical_turns(spelled))))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.size("spans").cast("long").alias("n_spans")
    return cut.select("row.doc_id", "n_words", words_in().alias("n_removed"), n, "spans", "row.text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder, end_id=0)
    return read_token_files(spark, folder)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"),
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def echoed(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word is read at each place: in a tenth of the documents a stretch is read again and again to the end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), reading=echoed)
    digests = "runs_sha256", "collapsed_sha256"
    return found.select("row.doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """Each entry in 64ths, rounded down, plus a million; beyond 2**62 such numbers stay at it."""
    in_64ths = lambda c: F.greatest(F.least(c.cast("double") * 64, F.lit(2.0**62)), F.lit(-(2.0**62)))
    return vectors.withColumn("x", F.transform("embedding", lambda c: F.floor(in_64ths(c)) + 1_000_000))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(finite("embedding"))
    return whiten(whole_numbers(vectors).select("vec_id", "x"), components=16, weight="one")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_token_counts": op5_token_counts,
    "op6_fingerprints": op6_fingerprints,
    "op7_sharding": op7_sharding,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontamination": op9_decontamination,
    "op10_near_dedup": op10_near_dedup,
    "op11_runs": op11_runs,
    "op12_whitening": op12_whitening,
    "op13_neighbours": op13_neighbours,
}

def _escaped_in_sql(column: str) -> str:
    out = rf"replace({column}, '\', '\0')"
    for control in chat.CONTROL:
        out = f"replace({out}, '{control}', '{chat._SPELLED[control[0]]}{control[1:]}')"
    return out


#: crc32 of the decimal id, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT),
                             list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda s, b: list_reduce(list_prepend(xor(s, b), [CAST(0 AS BIGINT) for i in range(8)]),
                                         lambda t, u: xor(t >> 1, (t & 1) * 3988292384))))"""
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_chat_format": rf"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), whole AS (
            SELECT conv_id,
                count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                sum(8 + length(replace({_escaped_in_sql("role")}, chr(10), '\3')) + 1 + length({_escaped_in_sql("text")}) + 8)
                    AS chars
            FROM said GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
            sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
        FROM whole""",
    "op9_decontamination": rf"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), items AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item, least(10, len(w)) AS n, list_slice(w, p, p + least(10, len(w)) - 1) AS win
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM items WHERE len(w) > 0)
        ), places AS (
            SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
                  FROM docs JOIN (SELECT DISTINCT n FROM windows) ON len(w) >= n)
        ), hits AS (SELECT doc_id, p, places.n, item FROM places JOIN windows USING (n, win)),
        hit_words AS (
            SELECT doc_id, count(DISTINCT q) AS n_hit
            FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
        ), hit_items AS (
            SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names
            FROM hits GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op10_near_dedup": rf"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[p] || ' ' || w[p + 1] END AS shingle
            FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS p FROM docs WHERE len(w) > 0)
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
            FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * common >= 80 * (p.n + q.n - common)
        ), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached AS (
            SELECT doc_id, doc_id AS other FROM docs
            UNION SELECT doc_id, b FROM reached JOIN ways ON other = a
        )
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
        FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    # Runs are where the same five words stand q words apart again and again; the least q of a stretch is its period.
    "op11_runs": rf"""
        WITH given AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC32} AS h FROM documents
        ), numbered AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM given),
        docs AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END] for i in range(n)]
                ELSE w END AS w
            FROM numbered
        ), places AS (
            SELECT doc_id, n, unnest(range(n - 4)) AS i, unnest([hash(w[j + 1 : j + 5]) for j in range(n - 4)]) AS five
            FROM docs WHERE n >= 6
        ), pairs AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q FROM places x JOIN places y
                ON x.doc_id = y.doc_id AND x.five = y.five AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
        ), islands AS (
            SELECT doc_id, q, min(i) AS start, max(i) + 5 + q - min(i) AS length
            FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
            GROUP BY doc_id, q, island
        ), runs AS (
            SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q)
            GROUP BY doc_id, start, length
        ), highest AS (
            SELECT * FROM runs
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1
        ), told AS (
            SELECT doc_id, count(*) AS n_runs,
                string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
            FROM runs GROUP BY doc_id
        ), dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
        left_over AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
            FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM docs SEMI JOIN told USING (doc_id))
                ANTI JOIN dropped USING (doc_id, i)
            GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, array_to_string(w, ' '))) AS collapsed_sha256
        FROM docs LEFT JOIN highest USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
}

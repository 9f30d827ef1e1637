"""One registered query per operator, with production parameters over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.registry import Query
from .common import shared_folder, table

LLM: dict[str, Query] = {}


def add(name: str, sql: str | None = None):
    def put(fn):
        LLM[name] = Query(fn, sql)
        return fn

    return put


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@add("op2_token_files")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from .token_files import ids_crc32, read_token_files, write_token_files

    path = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(spark, path).mapInArrow(ids_crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")


@add("op4_best_fit_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from .packing import cut_documents, pack

    return pack(cut_documents(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json")))


@add("op5_rendezvous_sharding")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from .sharding import shard

    out = shard(table(spark, sf, "documents"), [1.0] * 24, grown=[1.0] * 25)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP9 = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(CAST(size AS HUGEINT) * size) AS DOUBLE) AS squares, max(size) AS longest FROM sized GROUP BY 1),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS most FROM per),
levels AS (
  SELECT *, most / weight AS fills_at, (1.5::DOUBLE * (SELECT sum(source_size) FROM per) - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
water AS (SELECT level FROM levels WHERE fills_at > level ORDER BY fills_at, source LIMIT 1),
targets AS (SELECT *, coalesce(least(most, (SELECT level FROM water) * weight), most) AS target FROM levels),
rated AS (
  SELECT s.*, source_size, target, coalesce(target / nullif(source_size, 0), 0.0) AS ratio, coalesce(squares / nullif(source_size, 0), 0.0) AS middle, longest
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
rests AS (SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, ratio - floor(ratio) AS rest, greatest(longest - middle, middle, 1.0) AS reach FROM rated),
drawn AS (
  SELECT *, rest + 0.5::DOUBLE * least(rest, 1 - rest) * (size - middle) / reach AS p,
    (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM rests),
ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) * (1 - p) / greatest(p, 1e-300), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM drawn)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM ranked"""


@add("op9_pareto_mix", OP9)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@add("op7_kneser_ney_quality")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from .perplexity import quality

    out = quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "lowest", "highest", "keep", "stretch", "stretch_limit")


@add("op1_partenum_jaccard_join")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf, "documents"), shingle=4, percent=85)


@add("op10_hyperplane_near_vectors")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from .near_vectors import near_vectors

    return near_vectors(table(spark, sf, "embeddings"))


@add("op6_posting_list_neighbours")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@add("op8_bilstm_crf_personal_data")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from .pii import find_spans
    from .tagger import KINDS

    found = find_spans(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    return found.select(
        "doc_id", *[(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )


@add("op3_repeated_substrings")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from .substrings import repeated_substrings

    return repeated_substrings(table(spark, sf, "documents")).drop("spans")


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    near = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
    assign = f"SELECT vec_id, label, a.p, any_value(x) AS x, min({near} * {entries} + e) AS k FROM cut a JOIN book{{}} b ON a.p = b.p GROUP BY vec_id, label, a.p"
    text = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS c, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, label, p, c[p * w + 1 : (p + 1) * w] AS x FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM cut QUALIFY e < {entries})"""
    for r in range(rounds):
        text += f""",
near{r} AS MATERIALIZED ({assign.format(r)}),
sums{r} AS (SELECT p, k % {entries} AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM near{r}, unnest(range(1, len(x) + 1)) t(i) GROUP BY 1, 2, 3),
means{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM sums{r} GROUP BY 1, 2),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM book{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.e = b.e)"""
    return text + f""",
last AS MATERIALIZED ({assign.format(rounds)}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', k % {entries}), '' ORDER BY p) AS code, CAST(sum(k // {entries}) AS BIGINT) AS error FROM last GROUP BY 1, 2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""


@add("op11_orchard_vector_codes", _op11())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from .codes import vector_codes

    return vector_codes(table(spark, sf, "embeddings")).drop("label")


OP12 = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * c.q[i])) AS BIGINT) AS score
  FROM kept a JOIN kept c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""


@add("op12_zone_map_hard_negatives", OP12)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    vectors = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@add("op13_chunk_reuse_bpe")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from .chunk_reuse import encode_documents

    out = encode_documents(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"), decoded=True)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

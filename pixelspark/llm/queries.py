"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


QUERIES["op6_minhash_near_dedup"] = op6_minhash_near_dedup
ORACLES["op6_minhash_near_dedup"] = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
  from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
    else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end sh
  from w
), n as (select doc_id, len(sh)::bigint n from s),
e as (select doc_id, unnest(sh) g from s),
common as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select c.a, c.b from common c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * c.c >= 80 * (x.n + y.n - c.c)),
edge2 as (select a, b from link union all select b, a from link),
reach(id, node) as (select doc_id, doc_id from documents union select r.id, b.b from reach r join edge2 b on b.a = r.node)
select n.doc_id, n.n n_shingles, min(r.node)::bigint component_id, min(r.node) = n.doc_id kept
from n join reach r on r.id = n.doc_id group by n.doc_id, n.n
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


QUERIES["op2_pii"] = op2_pii


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenfiles import encode_round_trip

    return encode_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


QUERIES["op5_token_files"] = op5_token_files


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(_table(spark, sf_dir, "documents")).drop("shards")


def mixing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the splitting tree of ``op8_mixing`` decides: for each source and shard, the times a document is taken there, and their words."""
    from .mixing import shard_counts

    return shard_counts(_table(spark, sf_dir, "documents"))


QUERIES["op8_mixing"] = op8_mixing
QUERIES["mixing_shards"] = mixing_shards
ORACLES["op8_mixing"] = r"""
with d as (
  select doc_id, coalesce('s' || source, 'n') k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, md5(coalesce(doc_id::varchar, '')) h from documents
), s as (
  select k, sum(size)::double source_size, sum(size)::double * 2 most, [3.0, 1.0, 2.0][(row_number() over (order by k = 'n', k) - 1) % 3 + 1]::double w from d group by k
), lv as (
  select *, (1.5 * sum(source_size) over () - coalesce(sum(most) over up, 0)) / (sum(w) over () - coalesce(sum(w) over up, 0)) l
  from s window up as (order by most / w, k rows between unbounded preceding and 1 preceding)
), t as (
  select k, source_size, least(most, coalesce(w * max(case when most > l * w then l end) over (), most)) target from lv
), b as (
  select k, substr(h, 1, 3) blk, sum(size) words from d group by 1, 2
), p as (
  select b.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end passes,
    coalesce(sum(words) over (partition by k order by md5('0|' || k || '|' || blk), blk rows between unbounded preceding and 1 preceding), 0) before_words
  from b join t using (k)
), f as (
  select d.doc_id, d.size, p.source_size, p.target, p.passes, p.words, p.target - p.passes * p.source_size - p.before_words short,
    coalesce(sum(d.size) over (partition by d.k, p.blk order by substr(h, 4), d.size rows between unbounded preceding and 1 preceding), 0) ahead
  from d join p on p.k = d.k and p.blk = substr(d.h, 1, 3)
)
select doc_id, size, source_size::bigint source_size, target,
  (size * (passes + case when short <= 0 then 0 when short >= words then 1 when ahead + size / 2 <= short then 1 else 0 end))::bigint taken from f
"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_report

    return line_report(_table(spark, sf_dir, "documents"), pairs=True)


QUERIES["op1_line_dedup"] = op1_line_dedup


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


QUERIES["op9_exact_top_k"] = op9_exact_top_k
ORACLES["op9_exact_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op10_decontaminate"] = op10_decontaminate


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op3_quality"] = op3_quality


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(_table(spark, sf_dir, "documents"))


QUERIES["op7_language_id"] = op7_language_id


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import language_model_scores

    return language_model_scores(_table(spark, sf_dir, "documents"))


QUERIES["op4_hmm_scores"] = op4_hmm_scores


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align_tokenizers

    return align_tokenizers(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op11_token_alignment"] = op11_token_alignment


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import component_rows, whiten_vectors

    return component_rows(whiten_vectors(_table(spark, sf_dir, "embeddings"), most=32, scale=64.0, shift=1_000_000))


QUERIES["op12_whitening"] = op12_whitening


def op13_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .chunkbpe import digests, encode_chunks

    return digests(encode_chunks(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decode=True))


QUERIES["op13_chunk_bpe"] = op13_chunk_bpe

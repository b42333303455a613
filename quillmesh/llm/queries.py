"""The queries of the training-data problems. Only ``__spark_entry__.py`` takes them up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import history, mixing, names, neighbours, packing, passages, subjects, wrappers
from quillmesh.session import materialize, table

#: Batches that p1_found delivers the pages in.
BATCHES = 3


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "doc_chunks").select(F.lit("doc_chunks").alias("tab"), F.col("raw_doc_id").alias("id"), F.col("n").cast("int").alias("n"), "embedding")
    chats = table(spark, d, "chat_memory").select(F.lit("chat_memory").alias("tab"), "id", F.lit(0).alias("n"), "embedding")
    return chunks.unionByName(chats)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The waiting records, then the pages in BATCHES batches in order of id, against a history that grows with them."""
    past = history.History(spark)
    past.seed_urls(table(spark, d, "seen_urls"))
    url = past.accept_urls(table(spark, d, "url_batches"))
    words = materialize(history.body_words(table(spark, d, "raw_docs")), "words")
    cuts = words.agg(F.percentile_approx("id", [k / BATCHES for k in range(1, BATCHES)]).alias("at")).first().at or []
    page = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = words.where((F.lit(True) if low is None else F.col("id") > low) & (F.lit(True) if high is None else F.col("id") <= high))
        now = past.accept(part)
        page = now if page is None else page.unionByName(now)
    page = page.groupBy("id_b").agg(F.min("id_a").alias("id_a"))
    url = url.select(F.lit("url").alias("kind"), F.lit(0).cast("long").alias("id_a"), F.col("rec_id").alias("id_b"))
    return url.unionByName(page.select(F.lit("page").alias("kind"), "id_a", "id_b"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return wrappers.furniture_lines(table(spark, d, "raw_docs"))


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    return wrappers.main_bodies(table(spark, d, "raw_docs")).select(F.col("id").alias("raw_doc_id"), "body")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return passages.audit_passages(table(spark, d, "raw_docs"), table(spark, d, "doc_chunks"))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return passages.split_documents(table(spark, d, "raw_docs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_pairs(names.link_names(names.names_in(table(spark, d, "feed_items"))))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.neighbours_within(_vectors(spark, d), 0.9)
    a, b = F.struct("id", "n"), F.struct(F.col("id_b").alias("id"), F.col("n_b").alias("n"))
    pair = near.select(F.col("tab").alias("table_name"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return pair.select("table_name", F.col("a.id").alias("id_a"), F.col("a.n").alias("n_a"), F.col("b.id").alias("id_b"), F.col("b.n").alias("n_b"))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar rows of every row whose id is divisible by 100, against all rows."""
    v = _vectors(spark, d)
    return neighbours.nearest(v, v.where("id % 100 = 0"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "pack_limits")
    return packing.fill(packing.pack(table(spark, d, "documents"), limits), limits)


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    return mixing.documents(p7_mixed(spark, d))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(materialize(mixing.mix(table(spark, d, "documents"), targets), "mixed"), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.label_documents(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(materialize(p8_found(spark, d), "subjects"), table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p2_bodies, p3_found, p3_split, p4_found, p5_found, p5_nearest, p6_packed, p6_fill, p7_mixed, p7_documents, p7_shares, p8_found, p8_composition)}


_BLANKS = "' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || chr(160) || chr(8232) || chr(8233) || chr(12288)"
_USABLE = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_VECTORS = f"""(select distinct 'doc_chunks' as t, raw_doc_id as id, n, embedding::double[] as v from doc_chunks where {_USABLE} union all select distinct 'chat_memory', id, 0, embedding::double[] from chat_memory where {_USABLE})"""

SQL = {
    "p3_found": f"""with s as (select raw_doc_id, n, text from doc_chunks where raw_doc_id is not null and n is not null), top as (select raw_doc_id, max(n) as top from s group by 1),
      pair as (select s.raw_doc_id, s.n, s.text as b, p.text as a from s join s p on p.raw_doc_id = s.raw_doc_id and p.n = s.n - 1 where s.n > 1),
      o as (select raw_doc_id, n, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: right(a, k) = left(b, k))), 0) as shared from pair)
      select raw_doc_id, n from s where length(text) > 2500
      union select raw_doc_id, n from o where shared < 80 or shared > 400
      union select s.raw_doc_id, s.n from s join top using (raw_doc_id) where n < top and regexp_matches(right(rtrim(text, {_BLANKS}), 1), '[\\p{{L}}\\p{{Nd}},]')
      union select raw_doc_id, i::int from (select raw_doc_id, unnest(range(1, top + 1)) as i from top) h where not exists (select 1 from s where s.raw_doc_id = h.raw_doc_id and s.n = h.i)
      union select id, 0 from raw_docs d where length(markdown) > 2500 and not exists (select 1 from s where s.raw_doc_id = d.id)""",
    "p5_found": f"""with v as {_VECTORS}, p as (select a.t, a.id as ia, a.n as na, b.id as ib, b.n as nb, list_cosine_similarity(a.v, b.v) as sim from v a join v b on a.t = b.t and (a.id, a.n) <> (b.id, b.n)),
      k as (select *, row_number() over (partition by t, ia, na order by sim desc, ib, nb) as rank from p)
      select distinct t as table_name, least((ia, na), (ib, nb))[1] as id_a, least((ia, na), (ib, nb))[2]::int as n_a, greatest((ia, na), (ib, nb))[1] as id_b, greatest((ia, na), (ib, nb))[2]::int as n_b from k where rank <= 10 and sim >= 0.9""",
}


def oracle_sql() -> dict[str, str]:
    return SQL

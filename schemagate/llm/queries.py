"""Named queries of this package over the sample tables, and the SQL that must give the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemagate.llm import brown, centroids, kdshards, merkle, mixing, neardup, nearest, pieces, planes, quality, secrets, toxicity, vectordup
from schemagate.llm.common import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/token-planes-{uuid4().hex}"
    planes.write_ids(load(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return planes.read_digests(spark, folder)


@query()
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, their number, and whether they decode to it."""
    encoded = pieces.encode_texts(load(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"), "ids", "round_trip")


NEAR_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i+3], ' '))) as g from w where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from common c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * k >= 80 * (x.n + y.n - k)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join both_ways l on r.b = l.a),
part as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, p.component_id, d.doc_id = p.component_id as kept
from documents d left join n using (doc_id) join part p using (doc_id)
"""


@query(NEAR_SQL)
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "documents"), width=4, percent=80)


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query()
def op7_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(load(spark, sf_dir, "documents"))


VECTOR_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
part as (select a as vec_id, min(b) as component_id from reach group by a),
n as (select a as vec_id, count(*) as n from links group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, p.component_id, e.vec_id = p.component_id as kept
from embeddings e left join n using (vec_id) join part p using (vec_id)
"""


@query(VECTOR_SQL)
def op8_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_duplicate_vectors(load(spark, sf_dir, "embeddings"), threshold=0.98)


MIX_SQL = r"""
with d as (select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as weight, row_number() over (order by source nulls last) as place, 3 * source_size as most from s),
l as (select *, ((sum(source_size) over ()) - coalesce(sum(most) over (order by most / weight, place rows between unbounded preceding and 1 preceding), 0))::double
       / (sum(weight) over (order by most / weight, place rows between current row and unbounded following))::double as level from w),
t as (select *, least(most::double, (max(case when level * weight <= most then level end) over ()) * weight) as target from l),
e as (select *, floor(target + 0.5)::bigint as budget, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as epochs from t),
p as (select d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size as rest,
       coalesce(sum(d.size) over (partition by d.source order by d.key, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from p
"""


@query(MIX_SQL)
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(load(spark, sf_dir, "documents")).drop("source")


@query()
def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def _centroid_sql(clusters: int = 40, rounds: int = 5) -> str:
    """The rounds written out one after another."""
    nearest = """a{k} as materialized (select vec_id, row_id, x, dist, c, centre from (
  select v.*, m.c, m.centre, (list_inner_product(x, x) - 2 * list_inner_product(x, centre) + list_inner_product(centre, centre))::bigint as dist,
         row_number() over (partition by row_id order by dist, m.c) as place from v cross join m{k} m) where place = 1)"""
    moved = """n{k} as (select c, i, floor(sum(x[i]) / count(*)) as mean from a{k}, range(1, 65) r(i) group by all),
m{n} as materialized (select m.c, coalesce((select list(mean order by i) from n{k} n where n.c = m.c), centre) as centre from m{k} m)"""
    steps = ["""v as materialized (select vec_id, row_number() over () as row_id, list_transform(embedding, lambda e: floor(256 * e::double)) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)""",
             f"m0 as materialized (select row_number() over (order by h, x) - 1 as c, x as centre from (select sha256('2:' || vec_id) as h, x from v order by 1, 2 limit {clusters}))"]
    for k in range(rounds):
        steps += [nearest.format(k=k), moved.format(k=k, n=k + 1)]
    steps.append(nearest.format(k=rounds))
    return f"""with {", ".join(steps)}
select vec_id, c::int as cluster, dist as distance, sum(dist) over (partition by c)::bigint as cluster_inertia, sum(dist) over ()::bigint as inertia,
       sha256(array_to_string(list_transform(centre, lambda e: e::bigint), ',')) as centroid_sha256 from a{rounds}"""


@query(_centroid_sql())
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(load(spark, sf_dir, "embeddings"))


@query()
def op12_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: DuckDB has no crc32."""
    plan = kdshards.shard_documents(load(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _merkle_sql(levels: int = 7, upper: int = 3) -> str:
    """Levels written out: trees of up to 8^levels leaves and 8^upper languages."""
    field = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')".format
    head = " || ".join(map(field, merkle.FIELDS[:-1]))
    # crc32 of the id's digits: each is followed by eight steps of a bit
    steps = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {steps}), lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end))"
    ctes = [f"""d as materialized (select doc_id, coalesce('=' || lang, '') as tree, sha256({head} || {field("text")}) as h,
  sha256({head} || {field(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")}) as lowered, {crc} % 3 = 0 as tampered from documents)""",
            """l as materialized (select *, case when tampered then lowered else h end as t, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as i from d)""",
            "n0 as materialized (select tree, i, h, count(*) over (partition by tree) as m from l)"]

    def rounds(name: str, n: int) -> None:
        for k in range(n):
            ctes.append(f"""{name}s{k} as materialized (select tree, i, m, coalesce(string_agg(h, '') over (partition by tree, i // 8 order by i rows between unbounded preceding and 1 preceding), '') as lo,
  coalesce(string_agg(h, '') over (partition by tree, i // 8 order by i rows between 1 following and unbounded following), '') as hi from {name}n{k})""")
            ctes.append(f"{name}n{k + 1} as materialized (select tree, i // 8 as i, case when m > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h, (m + 7) // 8 as m from {name}n{k} group by tree, m, i // 8)")

    rounds("", levels)
    ctes.append(f"un0 as materialized (select '' as tree, row_number() over (order by tree) - 1 as i, h, count(*) over () as m, tree as name from n{levels})")
    rounds("u", upper)
    ctes.append("f0 as (select l.doc_id, l.tree, l.i, l.h as leaf, l.t, un0.i as u, un0.h as subroot, '' as proof from l join un0 on un0.name = l.tree)")
    for k in range(levels + upper):
        name, key, on = ("", f"f.i // {8**k}", "s.tree = f.tree and ") if k < levels else ("u", f"f.u // {8 ** (k - levels)}", "")
        ctes.append(f"""f{k + 1} as materialized (select f.doc_id, f.tree, f.i, f.leaf, f.u, f.subroot, f.proof || s.lo || s.hi as proof, case when s.m > 1 then sha256(s.lo || f.t || s.hi) else f.t end as t
  from f{k} f join {name}s{k if k < levels else k - levels} s on {on}s.i = {key})""")
    return f"""with {", ".join(ctes)}
select doc_id, leaf, subroot, root.h as root, sha256(proof) as proof_sha256, t as folded_root, t = root.h as verified from f{levels + upper}, un{upper} root"""


@query(_merkle_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(load(spark, sf_dir, "documents"))

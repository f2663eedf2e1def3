"""Registered queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilscan.llm import (
    decontaminate,
    grid_order,
    jaccard,
    merkle,
    neighbours,
    packing,
    resample,
    secrets,
    surrogates,
    templates,
    token_files,
    toxicity,
    warc,
)
from veilscan.llm.common import bounded
from veilscan.llm.tokens import default_tokenizer

#: Longest sequence, and the ids that end a document, of the two tokenizing queries.
CAPACITY, PACK_END, FILE_END = 2048, 0, 2


#: The registered query's key: public, for repeatable results on test tables. A job on real data passes its own secret.
EXAMPLE_KEY = "example"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extracted(table(spark, sf_dir, "pages"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), jaccard.Rule(words=3, num=90, den=100))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(table(spark, sf_dir, "documents"), EXAMPLE_KEY)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), default_tokenizer(), FILE_END)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.archived(table(spark, sf_dir, "pages"))
    return archive.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), PACK_END, CAPACITY)


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_order.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_surrogates": op5_surrogates,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_secrets": op9_secrets,
    "op10_packing": op10_packing,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_importance_resampling": op13_importance_resampling,
}

#: Unsigned CRC-32 of a column's UTF-8 bytes (reflected polynomial 0xEDB88320), as DuckDB list functions.
CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), cast(2 * i + 1 as int), 2))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)"""


def merkle_sql(levels: int = 15) -> str:
    """Runs of three, level by level, for up to 3 ** levels documents of a source and as many sources."""
    fields = " || ".join(
        f"case when {c} is null then '-' else octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar) end" for c in ("doc_id", "source", "lang", "n_chars")
    )
    text = "case when {0} is null then '-' else octet_length(encode({0})) || ':' || {0} end"
    parts = [f"""leaves as (
  select doc_id, source, sha256({fields} || {text.format('text')}) as leaf, text is not null and contains(text, chr(10)) and {CRC32.format('cast(doc_id as varchar)')} % 2 = 0 as forged,
         sha256({fields} || {text.format("replace(text, chr(10), '')")}) as other from documents),
l0 as (select source, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as r, leaf as h, count(*) over (partition by source) as n from leaves),
seat as (select doc_id, source, leaf, if(forged, other, leaf) as f, forged, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as r from leaves)"""]

    def climb(prefix: str, by: str) -> None:
        for k in range(levels):
            parts.append(f"""{prefix}{k}_runs as (select {by}, r // 3 as r, list(h order by r) as hs, any_value(n) as n from {prefix}{k} group by {by}, r // 3)""")
            parts.append(f"""{prefix}{k + 1} as (select {by}, r, if(n > 1, sha256(array_to_string(hs, '')), hs[1]) as h, (n + 2) // 3 as n from {prefix}{k}_runs)""")

    def prove(prefix: str, by: str, rows: str, out: str) -> None:
        """Each row's siblings, and what its forged digest folds to."""
        at = rows
        for k in range(levels):
            parts.append(f"""{out}{k} as (
  select a.* replace (a.r // 3 as r,
           if(n > 1, a.proof || array_to_string(hs[:a.r % 3] || hs[a.r % 3 + 2:], ''), a.proof) as proof,
           if(n > 1, sha256(array_to_string(hs[:a.r % 3] || [a.f] || hs[a.r % 3 + 2:], '')), a.f) as f)
  from {at} a join {prefix}{k}_runs b on a.{by} is not distinct from b.{by} and a.r // 3 = b.r)""")
            at = f"{out}{k}"

    climb("l", "source")
    parts.append("p as (select *, '' as proof from seat)")
    prove("l", "source", "p", "q")
    parts.append(f"""s0 as (select 0 as one, row_number() over (order by source nulls first) - 1 as r, h, count(*) over () as n, source from l{levels}),
t0 as (select one, r, h, n from s0)""")
    climb("t", "one")
    parts.append(f"u as (select q.* exclude (r), s.r, s.h as subroot, 0 as one from q{levels - 1} q join s0 s on q.source is not distinct from s.source)")
    prove("t", "one", "u", "v")
    return f"""with {", ".join(parts)}
select doc_id, leaf, subroot, t.h as root, sha256(proof) as proof_sha256, f as folded_root, f = t.h as verified from v{levels - 1} cross join t{levels} t
"""


ORACLE: dict[str, str] = {
    "op11_embedding_near_dedup": """
with recursive part as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from part a join part b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id, vec_id as r from embeddings union select reach.vec_id, links.b from reach join links on reach.r = links.a),
least as (select vec_id, min(r) as component_id from reach group by vec_id),
n as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join least using (vec_id) left join n on n.a = e.vec_id
""",
    "op12_merkle_manifest": merkle_sql(),
    "op13_importance_resampling": f"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
wanted as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as g from benchmark),
grams as (select doc_id, unnest(w) as g from words),
buckets as (select g, {CRC32.format('g')} % 10000 as b from (select distinct g from (select g from grams union all select g from wanted))),
raw as (select b, count(*) as s from grams join buckets using (g) group by b),
aim as (select b, count(*) as t from wanted join buckets using (g) group by b),
sums as (select (select count(*) from grams) as s_all, (select count(*) from wanted) as t_all),
gain as (
  select b, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000) / ((coalesce(s, 0) + 1)::double * (t_all + 10000)))) as bigint) as gain
  from (select distinct b from buckets) left join raw using (b) left join aim using (b) cross join sums),
weights as (select doc_id, sum(gain) as weight from grams join buckets using (g) join gain using (b) group by doc_id),
scores as (
  select doc_id, len(w) as n, cast(coalesce(weight, 0) as bigint) as weight,
         cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296))) as bigint) as score
  from words left join weights using (doc_id)),
places as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n_all from scores where n >= 20)
select doc_id, cast(n as bigint) as n_features, weight, score, cast(if(rank <= n_all * 10 // 100, rank, null) as bigint) as rank
from scores left join places using (doc_id)
""",
    "op3_ngram_jaccard_join": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') w from documents),
grams as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from grams a join grams b on a.s = b.s and a.doc_id < b.doc_id group by all),
pairs as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * k >= 90 * (x.n + y.n - k)),
links as (select a, b from pairs union all select b, a from pairs),
reach as (
  select doc_id, doc_id as r from documents
  union
  select reach.doc_id, links.b from reach join links on reach.r = links.a)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, min(r) as component_id
from reach left join sizes using (doc_id) group by doc_id, n
""",
    "op7_decontamination": r"""
with words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from (select doc_id, coalesce(text, '') as text from documents)),
items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark where text is not null and item_id is not null),
item_windows as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i
        from items where len(w) > 0)),
sizes as (select distinct n from item_windows),
doc_windows as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where len(w) >= n)),
found as (select doc_id, i, n, item_id from doc_windows join item_windows using (n, s)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
of_items as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (doc_id) left join of_items using (doc_id)
""",
    "op8_warc": """
with p as (select page_id, coalesce(html, '') as payload, octet_length(encode(coalesce(html, ''))) as n from pages),
o as (select *, max(page_id) over (partition by payload) as owner from p)
select page_id, cast(n as bigint) as payload_bytes, sha1(payload) as payload_digest,
       case when n < 1000 or page_id = owner then 'response' else 'revisit' end as record_type,
       case when n < 1000 or page_id = owner then null else owner end as refers_to
from o
""",
}

"""The corpus operators' queries with production parameters, and DuckDB SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, chat, codes, decontaminate, language, lines, minhash, resampling, sentencepiece, suffixes, token_files, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(column: str):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))  # a null id: 0


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_and_decode(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = _crc("doc_id") % 4
    model = language.learn_languages(docs, fold != 2)
    found = language.predict_languages(docs, model)
    return found.select("doc_id", (_crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.learn_toxicity(docs, labels, _crc("doc_id") % 3 != 1)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id", (_crc("doc_id") % 3 == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenize(spark, _table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.report(_table(spark, sf_dir, "pages"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_minhash_dedup, op3_sentencepiece, op4_chat_format, op5_suffix_dedup, op6_language_id, op7_decontaminate, op8_vector_dedup, op9_toxicity,
        op10_token_files, op11_importance_resampling, op12_arc_to_warc, op13_vector_codes,
    )
}



def _codes_sql(rounds: int = 4) -> str:
    """Chained rounds of assigning and averaging, as common table expressions."""

    def assigned(i):
        return f"""a{i} as materialized (select vec_id, label, part, min(struct_pack(d := d, entry := entry)) as near from (
    select x.vec_id, x.label, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from x join b{i} b on x.part = b.part) group by all)"""

    def averaged(i):
        return f"""b{i + 1} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from b{i} b left join (
    select part, entry, list(c order by place) as v from (
      select x.part, a.near.entry as entry, place, floor(sum(x.v[place]) / count(*))::bigint as c
      from x join a{i} a on x.vec_id = a.vec_id and x.part = a.part, (select unnest(range(1, 17)) as place) group by x.part, a.near.entry, place)
    group by part, entry) m on b.part = m.part and b.entry = m.entry)"""

    chain = [part(i) for i in range(rounds) for part in (assigned, averaged)] + [assigned(rounds)]
    return f"""
with w as (select vec_id, label, list_transform(embedding::double[], lambda c: floor(1024 * c)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
x as (select vec_id, label, part, v[part * 16 + 1 : part * 16 + 16] as v from w, range(4) p(part)),
b0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v from x where vec_id in (select vec_id from w order by vec_id limit 256)),
{",".join(chr(10) + c for c in chain)},
s as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds}),
c as (select vec_id, label, string_agg(lpad(lower(to_hex(near.entry)), 2, '0'), '' order by part) as code, sum(near.d)::bigint as error from a{rounds} group by vec_id, label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from c, s
"""


ORACLE = {
    "op13_vector_codes": _codes_sql(),
    "op12_arc_to_warc": """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
f as (select body, min(page_id) as first from p where octet_length(body) >= 100 group by body)
select page_id, octet_length(p.body)::bigint as payload_bytes, sha256(p.body) as payload_digest, case when page_id <> first then 'revisit' else 'response' end as record_type,
  case when page_id <> first then first end as refers_to, true as verified
from p left join f on p.body = f.body
""",
    "op8_vector_dedup": r"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a, v b
  where a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id, vec_id as seen from embeddings union select r.vec_id, l.b from r, l where l.a = r.seen),
c as (select vec_id, min(seen) as component_id from r group by vec_id),
d as (select a as vec_id, count(*) as n_links from l group by a)
select e.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, component_id = e.vec_id as kept
from embeddings e join c on c.vec_id = e.vec_id left join d on d.vec_id = e.vec_id
""",
    "op1_line_dedup": r"""
with d as (select doc_id, text, string_split(text, chr(10)) as l from documents),
w as (select doc_id, l, unnest(range(len(l) - 2)) as pos from d where len(l) >= 3),
k as (select doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] as said from w
  where length(l[pos + 1]) + length(l[pos + 2]) + length(l[pos + 3]) > 0),
f as (select doc_id, pos, row_number() over (partition by said order by doc_id, pos) as nth from k),
c as (select distinct doc_id, unnest(range(pos, pos + 3)) as line from f where nth > 1),
x as (select doc_id, unnest(l) as said, unnest(range(len(l))) as line from d),
r as (select x.doc_id, count(c.line) as n_removed,
    string_agg(x.said, chr(10) order by x.line) filter (where c.line is null) as kept
  from x left join c on x.doc_id = c.doc_id and x.line = c.line group by x.doc_id)
select d.doc_id, coalesce(len(l), 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
  case when d.text is not null then sha256(coalesce(kept, '')) end as kept_sha256
from d left join r on d.doc_id = r.doc_id
""",
    "op7_decontaminate": r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bs as (select item_id, w, least(len(w), 10) as n from bw where len(w) > 0),
bx as (select distinct item_id, n, array_to_string(w[p + 1 : p + n], ' ') as said from (select *, unnest(range(len(w) - n + 1)) as p from bs)),
dx as (select doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') as said
  from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as p from dw, (select distinct n from bs) where len(w) >= n)),
h as (select doc_id, item_id, dx.n, p from dx join bx on dx.n = bx.n and dx.said = bx.said),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from h) group by doc_id),
i as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from h group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join c on dw.doc_id = c.doc_id left join i on dw.doc_id = i.doc_id
""",
    "op11_importance_resampling": r"""
with recursive steps as (select i, 0 as done, i::bigint as c from range(256) t(i)
  union all select i, done + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from steps where done < 8),
tab as (select list(c order by i) as t from steps where done = 8),
words as (select 0 as target, row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all select 1, row_number() over (), null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
runs as (select target, row, array_to_string(w[p + 1 : p + n], ' ') as said, count(*) as times
  from (select target, row, w, n, unnest(range(len(w) - n + 1)) as p from words, (values (1), (2), (3)) v(n) where len(w) >= n) group by all),
distinct_runs as (select said, hex(encode(said)) as x from (select distinct said from runs)),
coded as (select said, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::bigint), 4294967295) % 10000 as bucket from distinct_runs, tab),
hits as (select target, row, bucket, times from runs join coded on runs.said = coded.said),
counts as (select bucket, sum(times) filter (where target = 0) as s, sum(times) filter (where target = 1) as t from hits group by bucket),
sums as (select coalesce(sum(s), 0) as ss, coalesce(sum(t), 0) as tt from counts),
gains as (select bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * (ss::double + 10000) / ((coalesce(s, 0)::double + 1) * (tt::double + 10000))))::bigint as gain from counts, sums),
weights as (select row, sum(times)::bigint as n_features, sum(times * gain)::bigint as weight from hits join gains on hits.bucket = gains.bucket where target = 0 group by row),
scored as (select doc_id, words.row, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296.0::double)))::bigint as score
  from words left join weights on words.row = weights.row where target = 0),
placed as (select row, row_number() over (order by score desc, doc_id, row) as rank, count(*) over () as n from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 5 * n // 100 then rank end as rank
from scored left join placed on scored.row = placed.row
""",
    "op4_chat_format": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  sum(23 + length(regexp_replace(role, '([<\[])(!*)(\||/?s>|unk>|/?INST\]|<SYS>>|</SYS>>)', '\1!\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(!*)(\||/?s>|unk>|/?INST\]|<SYS>>|</SYS>>)', '\1!\2\3', 'g')))::bigint as formatted_chars
from rows group by conv_id
""",
}

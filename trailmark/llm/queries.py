"""The subpackage's queries, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .importance import resample
from .language_id import held_out, identify, train
from .mixing import mix_plan
from .ngram_join import ngram_components
from .piece_sampling import sample_encode
from .progressive_jpeg import from_media, store_media
from .quality import judge, train as train_quality
from .ranked_search import rank_documents
from .token_count import token_counts
from .token_store import read_documents, write_store
from .url_filter import judge_urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_documents(spark, sf_dir).select("doc_id", "source", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them went with later copies of maximal repeated runs, and the SHA-256 of what is left."""
    docs = line_dedup(_documents(spark, sf_dir).select("doc_id", "text"), whole=True)
    removed = F.aggregate("_removed", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.size(F.split(text, "\n", -1)).alias("n_lines_left"), removed.alias("n_removed"), F.sha2(text, 256).alias("left_sha256"))


def op1_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_encode(_documents(spark, sf_dir), 2, digest=True)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    judged = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_media(store_media(_documents(spark, sf_dir).select("doc_id", "text")), keep=("doc_id", "n_bytes", "payload_bytes"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_store(_documents(spark, sf_dir).select("doc_id", "text")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_documents(spark, sf_dir).select("doc_id", "text"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    net = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return judge(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


QUERIES = {"op12_quality_classifier": op12_quality_classifier, "op13_importance_resampling": op13_importance_resampling, "op11_ranked_search": op11_ranked_search, "op4_ngram_join": op4_ngram_join, "op5_progressive_jpeg": op5_progressive_jpeg, "op7_token_store": op7_token_store, "op6_language_id": op6_language_id, "op8_url_filter": op8_url_filter, "op1_sample_pieces": op1_sample_pieces, "op10_token_counts": op10_token_counts, "op2_exact_dedup": op2_exact_dedup, "op3_source_mix": op3_source_mix, "op9_line_dedup": op9_line_dedup}

ORACLES = {
    "op2_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
        from d join g using (t)""",
    "op3_source_mix": r"""
        with sized as (
            select doc_id, case when source is null then '1' else '0' || source end as k, md5(coalesce(cast(doc_id as varchar), '')) as h,
                cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
            from documents),
        r as (
            select doc_id, k, h, size, cast('0x' || substr(h, 1, 7) as bigint) % 256 as salt,
                case when size < 16 then size else len(bin(size)) * 8 + ((size >> (len(bin(size)) - 4)) & 7) end as c
            from sized),
        t as (select k, sum(size)::bigint as s from r group by k),
        w as (select k, s, (row_number() over (order by k) - 1) % 3 + 1 as w from t),
        l as (
            select *, cast(sum(s) over () - coalesce(sum(3 * s) over (order by s / w, k rows between unbounded preceding and 1 preceding), 0) as double)
                / cast(sum(w) over () - coalesce(sum(w) over (order by s / w, k rows between unbounded preceding and 1 preceding), 0) as double) as level
            from w),
        f as (select level from l where 3.0::double * s >= level * w order by s / w, k limit 1),
        q as (select l.k, l.s, least(3.0::double * l.s, coalesce(f.level * l.w, 3.0::double * l.s)) as target from l left join f on true),
        e as (
            select k, s, target, least(cast(floor((case when s > 0 then target / s else 0 end) * 16777216 + 0.5) as bigint), 3 * 16777216) as step,
                cast('0x' || substr(md5('17:' || k), 1, 6) as bigint) as u
            from q),
        p as (
            select r.doc_id, r.size, e.s, e.target, e.step, e.u,
                row_number() over (partition by r.k order by r.c, r.salt, r.size, r.h, r.doc_id) as n
            from r join e using (k))
        select doc_id, size, s as source_size, target, ((u + n * step) >> 24) - ((u + (n - 1) * step) >> 24) as copies,
            (((u + n * step) >> 24) - ((u + (n - 1) * step) >> 24)) * size as taken
        from p""",
    "op9_line_dedup": r"""
        with lines as (
            select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n
            from documents where text is not null),
        c as (
            select *, sum(w) over (partition by doc_id order by n) as upto
            from (select *, coalesce(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')), 0) as w from lines)),
        runs as (
            select a.doc_id, a.n, min(b.n) as last
            from c a join c b on a.doc_id = b.doc_id and b.n >= a.n and b.upto >= a.upto - a.w + 50
            group by a.doc_id, a.n
            union
            select b.doc_id, max(a.n) as n, b.n as last
            from c a join c b on a.doc_id = b.doc_id and b.n >= a.n and b.upto >= a.upto - a.w + 50
            group by b.doc_id, b.n),
        named as (
            select r.doc_id, r.n, r.last, md5(string_agg(c.line, chr(10) order by c.n)) as name
            from runs r join c on c.doc_id = r.doc_id and c.n between r.n and r.last
            group by r.doc_id, r.n, r.last),
        later as (select * from (select *, row_number() over (partition by name, last - n order by doc_id, n) as place from named) where place > 1),
        gone as (select distinct c.doc_id, c.n from c join later l on c.doc_id = l.doc_id and c.n between l.n and l.last),
        remain as (
            select c.doc_id, count(*) as k, string_agg(c.line, chr(10) order by c.n) as t
            from c anti join gone g on c.doc_id = g.doc_id and c.n = g.n group by c.doc_id),
        lost as (select doc_id, count(*) as k from gone group by doc_id)
        select d.doc_id, cast(coalesce(r.k, 1) as int) as n_lines_left, cast(coalesce(l.k, 0) as int) as n_removed, sha256(coalesce(r.t, '')) as left_sha256
        from documents d left join remain r using (doc_id) left join lost l using (doc_id)""",
    "op11_ranked_search": r"""
        with found as (
            select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from documents),
        tf as (select doc_id, term, count(*) as tf from found group by doc_id, term),
        size as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
        total as (select count(*) as docs, sum(n)::bigint as terms from size),
        m as (select doc_id, 100 - 75 + (75 * n * docs) // terms as m from size, total),
        w as (select term, floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tf group by term), total),
        asked as (
            select item_id, term, count(*) as times
            from (
                select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
                from benchmark)
            group by item_id, term),
        scored as (
            select a.item_id, tf.doc_id, sum(a.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)))::bigint as score
            from asked a join tf using (term) join w using (term) join m on m.doc_id = tf.doc_id
            group by a.item_id, tf.doc_id)
        select item_id, rank, doc_id, score
        from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
        where rank <= 10""",
    "op13_importance_resampling": r"""
        with split as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
        own as (select doc_id, word, count(*) as c from (select doc_id, unnest(words) as word from split) group by all),
        asked as (
            select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
        crc as (
            select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
        spelt as (select word, hex(encode(word)) as x from (select word from own union select word from asked)),
        bytes as (select word, list_transform(range(length(x) // 2), lambda i: cast('0x' || substr(x, cast(2 * i + 1 as bigint), 2) as bigint)) as b from spelt),
        hashed as (
            select word, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[cast((xor(c, x) & 255) + 1 as bigint)])), 4294967295) % 10000 as bucket
            from bytes, crc),
        s as (select bucket, sum(c) as s from own join hashed using (word) group by bucket),
        t as (select bucket, count(*) as t from asked join hashed using (word) group by bucket),
        gains as (
            select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select sum(s) from s) + 10000)::double / ((coalesce(s, 0) + 1)::double * (coalesce((select sum(t) from t), 0) + 10000)::double)))::bigint as gain
            from s full join t using (bucket)),
        weights as (
            select doc_id, sum(c)::bigint as n, floor(sum(c * gain)::double / sum(c))::bigint as weight
            from own join hashed using (word) join gains using (bucket) group by doc_id),
        scored as (
            select d.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296)))::bigint as score
            from split d left join weights using (doc_id)),
        ranked as (
            select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n
            from scored)
        select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank
        from ranked""",
}

"""The registered queries of this subpackage and, where SQL can say it, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_mixture
from .context_tree import score_documents
from .cover_tree import top_k
from .hilbert import hilbert_shards
from .line_dedup import LEAST_PASSAGE, TOKEN, repeated_passages
from .mixing import mix
from .ngram_join import jaccard_components
from .semi_markov import find_personal_data
from .spaced_seeds import contaminated
from .store import read_table
from .warc import archive_round_trip


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, Jaccard of 0.85 or more, over all documents."""
    return jaccard_components(read_table(spark, sf_dir, "documents"), words=4, p=85, q=100).drop("text_key")


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with their best alignment."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards along the curve, counts at most one apart."""
    placed = hilbert_shards(read_table(spark, sf_dir, "documents"), shards=16, law="rows")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def op4_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data of every document."""
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_spans")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of over 50 words that documents share, those that go and those that stay, with their places."""
    found = repeated_passages(read_table(spark, sf_dir, "documents"), least=LEAST_PASSAGE)
    return found.select("doc_id", "word", "start", "stop", "words", "kept", "kept_doc_id", "kept_word", "copies")


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's predicted language, learned from the labels of three quarters of them."""
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", language_mixture.held_out(2, 4))
    model = language_mixture.learn(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return language_mixture.predict(docs.select("doc_id", "held_out", "text"), model)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and the shards to which the tree deals them."""
    rows = mix(read_table(spark, sf_dir, "documents"))
    shards = F.expr("array_join(transform(copies, c -> c.shard), ',')")
    return rows.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op8_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back and merged by URL key and time."""
    return archive_round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability under the unigram base and the context tree."""
    return score_documents(read_table(spark, sf_dir, "documents"), language_mixture.held_out(2, 7))


def op10_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector."""
    return top_k(read_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_spaced_seed_decontamination": op2_spaced_seed_decontamination,
    "op3_hilbert_sharding": op3_hilbert_sharding,
    "op4_semi_markov_pii": op4_semi_markov_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_mixture": op6_language_mixture,
    "op7_mixing": op7_mixing,
    "op8_warc_index_merge": op8_warc_index_merge,
    "op9_context_tree_scoring": op9_context_tree_scoring,
    "op10_cover_tree_search": op10_cover_tree_search,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"

_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
        with recursive w as (select doc_id, {_WORDS.format(_LOWER.format("text"))} as ws from documents),
        g as (
            select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s from w),
        n as (select doc_id, count(*) as n from g group by doc_id),
        pairs as (select a.doc_id as u, b.doc_id as v, count(*) as c from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        links as (select u, v from pairs join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
        both_ways as (select u, v from links union select v, u from links),
        reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, both_ways.v from reach join both_ways on both_ways.u = reach.r)
        select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r) as component_id
        from documents d join reach on reach.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n""",
    "op5_line_dedup": f"""
        with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*(?:{TOKEN})') as ps from documents),
        p as (select rid, doc_id, unnest(ps) as piece, generate_subscripts(ps, 1) - 1 as word from d where len(ps) >= {LEAST_PASSAGE}),
        t as (select rid, doc_id, word, ltrim(piece, {_BLANKS}) as token, sum(length(piece)) over (partition by rid order by word)::bigint as stop from p),
        l as (select rid, doc_id, list({_LOWER.format("token")} order by word) as ts, list(stop - length(token) order by word) as starts, list(stop order by word) as stops from t group by rid, doc_id),
        k as (select rid, doc_id, ts, starts, stops, unnest(range(0, len(ts) - {LEAST_PASSAGE - 1})) as word from l),
        w as (select rid, doc_id, word::int as word, starts[word + 1] as start, stops[word + {LEAST_PASSAGE}] as stop, md5(array_to_string(ts[word + 1:word + {LEAST_PASSAGE}], ' ')) as line from k),
        s as (select line, count(*) as copies from w group by line having count(distinct rid) > 1),
        f as (select w.*, copies, first_value(rid) over o as kept_rid, first_value(doc_id) over o as kept_doc_id, first_value(word) over o as kept_word
            from w join s using (line) window o as (partition by line order by doc_id nulls last, word, rid)),
        i as (select *, kept_word - word as shift, word - row_number() over (partition by rid, kept_rid, kept_word - word order by word) as island from f)
        select doc_id, min(word) as word, min(start) as start, max(stop) as stop, (count(*) + {LEAST_PASSAGE - 1})::int as words, rid = kept_rid and shift = 0 as kept, kept_doc_id,
            min(kept_word) as kept_word, min(copies) as copies from i group by rid, doc_id, kept_rid, kept_doc_id, shift, island""",
    "op7_mixing": f"""
        with b as (select doc_id, source, len({_WORDS.format("text")})::bigint as size, md5('tidemark|' || doc_id) as draw from documents),
        s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from b group by source),
        l as (select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
            / sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as level from s),
        t as (select source, source_size, least(source_size * 3.0::double, weight * max(level) over ()) as target from l),
        n as (select b.*, t.source_size, t.target, round(t.target)::bigint as quota, coalesce(b.source, chr(0)) as name, greatest(1, ceil((select sum(round(target)) from t) / 4096))::bigint as wide,
            (sum(size) over (partition by b.source order by draw, doc_id rows unbounded preceding) - size)::bigint as pos from b join t on b.source is not distinct from t.source),
        k as (select name, source_size, quota, pos // wide as block, sum(size) as words, min(pos) as block_start, md5('tidemark|' || name || '|' || (pos // wide)) as lot
            from n where size > 0 group by name, source_size, quota, block),
        q as (select *, words as w, coalesce(sum(words) over (partition by name order by lot, block rows between unbounded preceding and 1 preceding), 0) as ahead,
            unnest(range(0, (quota - 1) // source_size + 1)) as pass from k where quota > 0),
        d as (select *, least(words, greatest(0, quota - pass * source_size - ahead)) as take from q where quota - pass * source_size - ahead > 0),
        e as (select *, row_number() over (partition by name order by pass, lot, block) as nth from d),
        n0 as (select name, nth as ball, 0 as shard from e),
        {"".join(f"""
        n{i + 1} as (select name, ball, shard * 2 + if(row_number() over (partition by shard order by md5('tidemark|{i}|' || shard || '|' || name || '|' || ball), name, ball) * 2
            <= count(*) over (partition by shard), 0, 1) as shard from n{i}),""" for i in range(4))}
        c as (select name, shard, sum(count(*)) over (partition by name order by shard) as upto, count(*) as n from n4 group by name, shard),
        x as (select e.name, block, block_start, pass, c.shard, take from e join c on e.name = c.name and nth > upto - c.n and nth <= upto),
        y as (select n.doc_id, x.pass, x.shard, case when n.size = 0 then 0 else greatest(0, least(n.size, take - (n.pos - block_start))) end as words
            from n join x on n.name = x.name and n.pos // n.wide = x.block where n.size > 0 or x.pass = 0),
        z as (select doc_id, sum(words)::bigint as taken, string_agg(shard::varchar, ',' order by pass) as shards from y
            where words > 0 or doc_id in (select doc_id from n where size = 0) group by doc_id)
        select n.doc_id, n.size, n.source_size, n.target, coalesce(taken, 0)::bigint as taken, coalesce(shards, case when n.source_size = 0 then '0' else '' end) as shards
        from n left join z on n.doc_id = z.doc_id""",
    "op8_warc_index_merge": """
        with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
        f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id from p)
        select page_id, payload_bytes, payload_digest, case when first_id < page_id then 'revisit' else 'response' end as record_type,
            case when first_id < page_id then first_id end as refers_to from f""",
    "op10_cover_tree_search": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
}

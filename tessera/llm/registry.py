"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.session import Scratch

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS") or str(Path(public_tokenizers.__file__).parent)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard import near_groups

    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import chat_windows, digests

    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], own.schema)
    return digests(chat_windows(own.union(extra)))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import bpe_round_trip

    out = bpe_round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    out = pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import read_archives, write_archives

    path = Scratch(spark, "warc").path("archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    out = read_archives(spark, path)
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_ngram_jaccard, op3_chat_formatting, op4_bpe_round_trip, op5_embedding_dedup, op6_exact_dedup, op7_packing, op8_toxicity, op9_warc, op10_token_counts)}

def _words(pattern: str) -> str:
    """DuckDB's words of a text, A to Z in lower case; null counts as empty."""
    return f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"


def _license_sql() -> str:
    from tessera.llm.licenses import CONTAINMENT, PHRASES, STRIDE, TEMPLATES, families

    every = [(label, p, True) for p, label in PHRASES.items()] + [(label, t, False) for label, t in TEMPLATES]
    family = families([t for _, t, _ in every], CONTAINMENT)
    rows = ", ".join(f"({i}, '{label}', '{t}', {phrase}, {family[i]})" for i, (label, t, phrase) in enumerate(every))
    return rf"""
        with d as materialized (select row_number() over () as r, doc_id, {_words("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} as words from documents),
        t(template, label, spelled, phrase, family) as (values {rows}),
        tw as (select distinct template, unnest(string_split(spelled, ' ')) as w from t where not phrase),
        sizes as (select template, count(*) as size from tw group by 1),
        w as materialized (select r, unnest(words) as w, unnest(range(len(words))) as pos from d),
        places as (select w.r, w.pos, p.label from w join (select label, string_split(spelled, ' ') as own from t where phrase) p on w.w = p.own[1]
                   join d on d.r = w.r where d.words[w.pos + 1 : w.pos + len(p.own)] = p.own),
        b as (select r, w, pos // {STRIDE} * {STRIDE} as start from w where w in (select w from tw)
              union all select r, w, (pos // {STRIDE} - 1) * {STRIDE} from w where pos >= {STRIDE} and w in (select w from tw)),
        held as (select r, start, template, count(distinct w) as n from b join tw using (w) group by all),
        rated as (select r, start, family, max({{'share': n::double / size, 'words': n, 'label': label}}) as best from held join sizes using (template) join t using (template)
                  where n >= ceil({CONTAINMENT} * size - 1e-9) group by all),
        beside as (select *, lag(start) over o as s0, lag(best) over o as b0, lead(start) over o as s1, lead(best) over o as b1 from rated window o as (partition by r, family order by start)),
        found as (select r, best.label as label, best.share as share from beside
                  where not coalesce(start - s0 <= {STRIDE} and (b0.share, b0.words) > (best.share, best.words), false)
                    and not coalesce(s1 - start <= {STRIDE} and (b1.share, b1.words) > (best.share, best.words), false)),
        base as (select r, count(*) as n, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as labels from places group by 1),
        own as (select r, string_agg(distinct label, ',' order by label) as labels, max(share) as score from (select r, label, share from found union all select r, label, 1.0 from places) group by 1)
        select d.doc_id, len(d.words)::bigint as n_words, coalesce(base.n, 0)::bigint as n_base, base.first_word, base.last_word, coalesce(base.labels, '') as base_labels,
               coalesce(own.labels, '') as labels, coalesce(own.score, 0.0)::double as score
        from d left join base using (r) left join own using (r)"""


_REACHED = """
        c(r, least) using key (r) as (select r, id from {nodes}
            union select e.y, min(c.least) from c join {edges} e on e.x = c.r join recurring.c o on o.r = e.y where c.least < o.least group by e.y)"""

ORACLE_SQL = {
    "op1_license_scan": _license_sql(),
    "op2_ngram_jaccard": rf"""
        with recursive d as materialized (select row_number() over () as r, doc_id as id, {_words("[^\\x20\\x09-\\x0D]+")} as w from documents),
        s as materialized (select r, id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else [array_to_string(w[i : i + 2], ' ') for i in range(1, len(w) - 1)] end) as own from d),
        t as materialized (select r, len(own) as n, unnest(own) as x from s),
        e as materialized (select a.r as x, b.r as y from t a join t b using (x) where a.r <> b.r group by a.r, b.r having 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
        {_REACHED.format(nodes="s", edges="e")}
        select s.id as doc_id, len(s.own)::bigint as n_shingles, c.least as component_id from s join c using (r)""",
    "op5_embedding_dedup": rf"""
        with recursive v as materialized (select row_number() over () as r, vec_id as id, embedding::double[] as e from embeddings),
        u as materialized (select r, [x / sqrt(list_sum([y * y for y in e])) for x in e] as e from v
                           where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
        e as materialized (select a.r as x, b.r as y from u a join u b on a.r <> b.r and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) >= 0.9),
        {_REACHED.format(nodes="v", edges="e")}
        select v.id as vec_id, coalesce(n, 0)::bigint as n_links, c.least as component_id, v.id = c.least as kept
        from v join c using (r) left join (select x as r, count(*) as n from e group by 1) using (r)""",
    "op6_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               row_number() over (partition by coalesce(text, '') order by doc_id desc) = 1 as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages)
        select page_id, strlen(html)::bigint as payload_bytes,
               array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::bigint >> k) & 31) + 1, 1) for k in [15, 10, 5, 0]], '') for i in range(8)], '') as payload_digest,
               if(page_id = max(page_id) over w, 'response', 'revisit') as record_type,
               if(page_id = max(page_id) over w, null, max(page_id) over w) as refers_to
        from p window w as (partition by html)""",
}

"""The registered queries of this subpackage: thin uses of its operators, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, decontaminate, licenses, manifest, neighbours, orderhash, packing, quality, resample, sharding, simhash, substrings, warc
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return marked.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    read = warc.read_archives(warc.capture_history(manifest), manifest.count())
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return sharding.feistel_shards(docs, ["doc_id", "size", "text_crc32"], 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    manifest = binary.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return binary.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.near_duplicates(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return substrings.without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audited(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_neighbours, op3_simhash, op4_quality, op5_licenses, op6_warc, op7_decontaminate, op8_sharding, op9_token_files,
        op10_substrings, op11_manifest, op12_resample, op13_fingerprints,
    )
}


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit, as DuckDB has no function for it."""
    bits = f"list_transform(range(8 * octet_length(encode({text}))), lambda i: get_bit(encode({text})::bit, ((i // 8) * 8 + 7 - i % 8)::int)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"


def manifest_sql(source_levels: int = 5, top_levels: int = 3) -> str:
    """The manifest level by level: enough levels for 16^5 rows a source and 16^3 sources."""
    f = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}, '-')"
    parts = [f"""d as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n,
            sha256({f('doc_id')} || {f('source')} || {f('lang')} || {f('n_chars')} || {f('text')}) as leaf,
            case when {crc32_sql('doc_id::varchar')} % 5 = 0 then sha256({f('doc_id')} || {f('source')} || {f('lang')} || {f('n_chars')} || {f("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) else leaf end as other
        from documents)""", "s0 as (select source as g, i, n, leaf as h from d)"]  # fmt: skip

    def climb(s: str, most: int) -> None:
        for k in range(most):
            runs = f"select g, i // 16 as i, any_value(n) as n, string_agg(h, '' order by i) as hs, any_value(h) as one from {s}{k} group by g, i // 16"
            parts.append(f"{s}{k + 1} as (select g, i, (n + 15) // 16 as n, case when n > 1 then sha256(hs) else one end as h from ({runs}))")

    def path(s: str, most: int, ident: str, at: str) -> str:
        """Siblings of a leaf with place ``at`` in group ``ident``, a list of (left, right) from the leaf up."""
        return ", ".join(f"(select [coalesce(string_agg(h, '' order by i) filter (where i < {at} // {16**k}), ''), coalesce(string_agg(h, '' order by i) filter (where i > {at} // {16**k}), ''), (any_value(n) > 1)::varchar] from {s}{k} x where x.g is not distinct from {ident} and x.i // 16 = {at} // {16 ** (k + 1)})" for k in range(most))

    climb("s", source_levels)
    parts.append(f"t0 as (select 0 as g, row_number() over (order by encode(g) nulls first) - 1 as i, count(*) over () as n, h, g as source from s{source_levels})")
    climb("t", top_levels)
    parts.append(f"top as (select source, h as subroot, [{path('t', top_levels, '0', 't0.i')}] as above from t0)")
    parts.append(f"p as (select d.doc_id, leaf, other, subroot, list_filter([{path('s', source_levels, 'd.source', 'd.i')}] || above, lambda x: x[3] = 'true') as steps from d join top on top.source is not distinct from d.source)")
    folded = "list_reduce(list_prepend([other, '', ''], steps), lambda a, b: [sha256(b[1] || a[1] || b[2]), '', ''])[1]"
    parts.append(f"f as (select *, (select h from t{top_levels}) as root, {folded} as folded_root from p)")
    proof = "sha256(array_to_string(list_transform(steps, lambda x: x[1] || x[2]), ''))"
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, root, {proof} as proof_sha256, folded_root, folded_root = root as verified from f"


RESAMPLE_SQL = f"""
    with texts as (select doc_id, false as wanted, coalesce(text, '') as text from documents union all select null, true, coalesce(text, '') from benchmark),
    w as (select doc_id, wanted, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from texts),
    f as (select doc_id, wanted, unnest(ws) as x from w union all
        select doc_id, wanted, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from w),
    k as (select x, {crc32_sql('x')} % 10000 as bucket from (select distinct x from f)),
    n as (select bucket, count(*) filter (where not wanted) as s, count(*) filter (where wanted) as t from f join k using (x) group by bucket),
    a as (select sum(s)::double as s_all, sum(t)::double as t_all from n),
    g as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain from n, a),
    m as (select doc_id, count(*) as n_features, floor(sum(gain) / count(*))::bigint as weight from f join k using (x) join g using (bucket) where not wanted group by doc_id),
    d as (select w.doc_id, len(ws) >= 20 as fit, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
            ('0x' || substring(sha256('7:' || w.doc_id), 1, 8))::bigint as h from w left join m using (doc_id) where not wanted),
    r as (select *, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))))::bigint as score from d),
    o as (select *, row_number() over (partition by fit order by score desc, doc_id) as place, count(*) over (partition by fit) as many from r)
    select doc_id, n_features, weight, score, case when fit and place <= 25 * many // 100 then place end as rank from o"""


ORACLES: dict[str, str] = {
    "op6_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
        d as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from p),
        k as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as keeper from d)
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id < keeper then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id < keeper then keeper end as refers_to
        from k""",
    "op10_substrings": """
        with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') as ws from documents),
        g as (select doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') as win from w, unnest(range(1, len(ws) - 11)) t(i)),
        f as (select doc_id, i from (select *, min(doc_id) over (partition by win) as least from g) where doc_id > least),
        c as (select distinct doc_id, i + j as pos from f, range(0, 13) r(j)),
        a as (select w.doc_id, t.pos, w.ws[t.pos] as word, c.pos is not null as cut
              from w, unnest(range(1, len(ws) + 1)) t(pos) left join c on c.doc_id = w.doc_id and c.pos = t.pos)
        select w.doc_id, cast(len(w.ws) as bigint) as n_words,
               cast(count(*) filter (where a.cut) as bigint) as n_removed,
               sha256(coalesce(string_agg(a.word, ' ' order by a.pos) filter (where not a.cut), '')) as kept_sha256
        from w left join a on a.doc_id = w.doc_id group by w.doc_id, w.ws""",
    "op11_manifest": manifest_sql(),
    "op12_resample": RESAMPLE_SQL,
}

"""Registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm import (byte_bpe, cover_tree, decontaminate, fill_in_middle, hidden_markov, language_id, license_scan,
                         merkle, near_dedup, quality, recompression, secret_scan, token_count)
from farebox.llm.common import documents, held_out, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes the ids; digests of both."""
    return byte_bpe.encode(documents(spark, sf_dir), decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other vectors, by inner product, of every hundredth vec_id."""
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a third of the ids is held out from learning."""
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held)
    return quality.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and Markov spans of secrets in every document."""
    docs = documents(spark, sf_dir)
    found = secret_scan.scan(docs, *secret_scan.models(docs))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.span_text(F.col("spans")).alias("spans"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that start earlier elsewhere."""
    return recompression.substring_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    found = decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_items"),
                        F.transform("matches", lambda m: m["item_id"]).alias("items"),
                        F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0)).alias("similarity"),
                        (F.size("matches") > 0).alias("contaminated"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document; its smallest doc_id is kept."""
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wordings in every document."""
    found = license_scan.scan(documents(spark, sf_dir))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), "score")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every document."""
    return token_count.token_counts(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a fourth of the ids is held out from learning."""
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"), 4, 2)
    return language_id.predict(docs, language_id.fit(docs, held)).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, and the text rebuilt from it."""
    made = fill_in_middle.transform(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaf, subroot, root, proof and tampered version's root of every document."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return merkle.manifest(documents(spark, sf_dir)).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document; a tenth of the ids is held out from learning."""
    scored = hidden_markov.language_model_scores(documents(spark, sf_dir), held_out(F.col("doc_id"), 10, 0))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_exact_top_k, op3_quality, op4_secret_scan, op5_substring_dedup, op6_decontaminate,
    op7_near_dedup, op8_license_scan, op9_token_count, op10_language_id, op11_fill_in_middle, op12_merkle_manifest,
    op13_hidden_markov, pipeline)}

ORACLE = {
    "op2_exact_top_k": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) q from embeddings
          where vec_id is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
          select a.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint score
          from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0)
        select * from (
          select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as "rank", vec_id, score
          from scored) where "rank" <= 10""",
    "op5_substring_dedup": """
        with w as (
          select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') words
          from documents),
        windows as (
          select doc_id, i, array_to_string(words[i:i + 19], ' ') seq
          from (select doc_id, words, unnest(range(1, len(words) - 18)) i from w where len(words) >= 20)),
        earliest as (select seq, min((doc_id, i)) f from windows group by seq),
        covered as (
          select distinct doc_id, unnest(range(i, i + 20)) pos
          from windows join earliest using (seq) where (doc_id, i) > f),
        each as (select doc_id, unnest(words) word, unnest(range(1, len(words) + 1)) pos from w),
        kept as (
          select e.doc_id, count(*) n, string_agg(e.word, ' ' order by e.pos) t
          from each e left join covered c on e.doc_id = c.doc_id and e.pos = c.pos where c.pos is null group by e.doc_id)
        select w.doc_id, len(words)::bigint n_words, len(words)::bigint - coalesce(n, 0) n_removed,
          sha256(coalesce(t, '')) kept_sha256
        from w left join kept on w.doc_id = kept.doc_id""",
    "op6_decontaminate": """
        with d as (
          select doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') words from documents),
        b0 as (
          select item_id, list_filter(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') words from benchmark where item_id is not null and text is not null),
        b as (select row_number() over () k, item_id, words, len(words) n, least(5, len(words)) z from b0 where len(words) > 0),
        item as (
          select k, z, n - z + 1 span, n, sh, count(*) c
          from (select k, z, n, array_to_string(words[i:i + z - 1], ' ') sh
                from (select *, unnest(range(1, n - z + 2)) i from b)) group by all),
        own as (
          select doc_id, z, i, array_to_string(words[i:i + z - 1], ' ') sh
          from (select doc_id, words, z, unnest(range(1, len(words) - z + 2)) i
                from d join (select distinct z from b) on len(words) >= z)),
        starts as (                                  -- a document shorter than the item is one window
          select distinct doc_id, k, z, span, least(span, len(words) - z + 1) width, s from (
            select own.doc_id, k, item.z, span, n, unnest(range(greatest(1, i - span + 1), i + 1)) s
            from own join item on own.z = item.z and own.sh = item.sh)
          join d using (doc_id) where s + n - 1 <= len(words) or (s = 1 and len(words) < n)),
        seen as (
          select w.doc_id, w.k, w.span, w.width, w.s, own.sh, count(*) c
          from (select *, unnest(range(s, s + width)) i from starts) w
          join own on own.doc_id = w.doc_id and own.z = w.z and own.i = w.i group by all),
        likes as (
          select doc_id, k, sum(least(seen.c, item.c))::double / (span + width - sum(least(seen.c, item.c))) similarity
          from seen join item using (k, span, sh) group by doc_id, k, span, width, s),
        found as (
          select doc_id, item_id, max(similarity) similarity from likes join b using (k)
          where similarity >= 0.75 group by doc_id, item_id),
        per as (
          select doc_id, count(*) n_items, list(item_id order by item_id) items, max(similarity) similarity
          from found group by doc_id)
        select d.doc_id, len(words)::bigint n_words, coalesce(n_items, 0)::bigint n_items,
          coalesce(items, []::bigint[]) items, coalesce(similarity, 0.0::double) similarity, n_items is not null contaminated
        from d left join per on d.doc_id = per.doc_id""",
    "op7_near_dedup": """
        with recursive w as (
          select doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') words from documents),
        s as (
          select distinct doc_id, array_to_string(words[i:i + 4], ' ') sh
          from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) i from w where len(words) > 0)),
        n as (select doc_id, count(*) n from s group by doc_id),
        common as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
        links as (
          select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
        either_way as (select a, b from links union all select b, a from links),
        reach(doc_id, r) as (
          select doc_id, doc_id from w union select reach.doc_id, e.b from reach join either_way e on reach.r = e.a),
        comp as (select doc_id, min(r) component_id from reach group by doc_id)
        select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, w.doc_id = component_id kept
        from w left join n on n.doc_id = w.doc_id join comp on comp.doc_id = w.doc_id""",
    "op11_fill_in_middle": """
        with h as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::varchar, '')) x from documents),
        g as (select doc_id, t, length(t) n, ('0x' || x[1:8])::bigint h1, ('0x' || x[9:16])::bigint h2,
            ('0x' || x[17:24])::bigint h3, ('0x' || x[25:32])::bigint h4 from h),
        c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
            case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end form from g),
        p as (select *, substring(t, 1, a) prefix, substring(t, a + 1, b - a) middle, substring(t, b + 1) suffix from c)
        select doc_id, n::bigint n, form, case when form <> 'plain' then a end prefix_chars,
          case when form <> 'plain' then b - a end middle_chars,
          sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) output_sha256,
          sha256(t) restored_sha256 from p""",
    "op12_merkle_manifest": """
        with recursive d as (
          select dense_rank() over (order by source nulls first) - 1 j, doc_id, text,
            coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
              || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') head,
            xor(4294967295, list_reduce(                                            -- crc32, bit by bit
              list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
              lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
                lambda x, bit: xor(x >> 1, 3988292384 * (x & 1))))) % 2 = 0 tampered
          from documents),
        e as (
          select j, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf,
            case when tampered and text is not null
              then sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) end other from d),
        l as (
          select row_number() over () k, j, doc_id, leaf, coalesce(other, leaf) other,
            row_number() over (partition by j order by doc_id nulls first, leaf) - 1 i from e),
        nodes(level, j, i, digest) as (
          select 0, j, i, leaf from l
          union all
          select level + 1, j, i // 3, sha256(string_agg(digest, '' order by i))
          from (select *, count(*) over (partition by j) c from nodes) where c > 1 group by level, j, i // 3),
        subroots as (select j, max(level) height, arg_max(digest, level) subroot from nodes group by j),
        tops(level, i, digest) as (
          select 0, j, subroot from subroots
          union all
          select level + 1, i // 3, sha256(string_agg(digest, '' order by i))
          from (select *, count(*) over () c from tops) where c > 1 group by level, i // 3),
        top as (select max(level) height, arg_max(digest, level) root from tops),
        low as (select k, j, unnest(range(height)) level, i from l join subroots using (j)),
        high as (select j, unnest(range(top.height)) level from subroots, top),
        steps as (
          select k, low.level, string_agg(n.digest, '' order by n.i) filter (n.i < low.i // (3 ** low.level)::bigint) a,
            string_agg(n.digest, '' order by n.i) filter (n.i > low.i // (3 ** low.level)::bigint) b
          from low join nodes n on n.j = low.j and n.level = low.level and n.i // 3 = low.i // (3 ** (low.level + 1))::bigint
          group by k, low.level
          union all
          select k, s.height + h.level, h.a, h.b
          from l join subroots s using (j) join (
            select high.j, high.level, string_agg(t.digest, '' order by t.i) filter (t.i < high.j // (3 ** high.level)::bigint) a,
              string_agg(t.digest, '' order by t.i) filter (t.i > high.j // (3 ** high.level)::bigint) b
            from high join tops t on t.level = high.level and t.i // 3 = high.j // (3 ** (high.level + 1))::bigint
            group by high.j, high.level) h using (j)),
        fold(k, level, digest) as (
          select k, 0, other from l
          union all
          select fold.k, fold.level + 1, sha256(coalesce(a, '') || digest || coalesce(b, ''))
          from fold join steps on steps.k = fold.k and steps.level = fold.level),
        folded as (select k, arg_max(digest, level) folded_root from fold group by k),
        proofs as (select k, string_agg(coalesce(a, '') || coalesce(b, ''), '' order by level) proof from steps group by k)
        select doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) proof_sha256, folded_root, folded_root = root verified
        from l join subroots using (j) join folded using (k) left join proofs using (k), top""",
}

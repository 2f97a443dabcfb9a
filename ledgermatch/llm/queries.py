"""One query per operator over the test tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm import balltree, credentials, decontaminate, langid, lines, mixing, periodic, perspectives, quality, repeats, simhash, toxicity, warc
from ledgermatch.llm.shared import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_packages(table(spark, sf_dir, "pages"))
    return warc.read_packages(manifest, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"), "doc_id")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", (F.col("n_removed") > 0).alias("repeated"),
        "shares_passage",
    )


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2("row.text", 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == credentials.ORDER[kind])).cast("long")
    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in credentials.BASE),
        F.sha2(credentials.as_text(F.col("base")), 256).alias("base_sha256"),
        credentials.as_text(F.col("all_spans")).alias("spans"),
    )


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.perspectives(table(spark, sf_dir, "conversations"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op12_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which each tenth repeats its words with a period that its doc_id gives (none without doc_id)."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(crc % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD2})"), F.lit(1)))
    told = docs.select("doc_id", "text", words.alias("words"), F.floor(crc / 10).alias("g"))
    n = F.size("words")
    shaped = told.withColumn("a", F.col("g") % F.greatest(n, F.lit(1))).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    periodic_text = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i))), " ")
    return shaped.select("doc_id", F.when(n > 0, periodic_text).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_with_periods(table(spark, sf_dir, "documents")), "doc_id")
    best = periodic.strongest(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_quality, op3_simhash, op4_decontaminate, op5_repeats, op6_lines, op7_secrets, op8_perspectives, op9_mixing, op10_toxicity,
        op11_langid, op12_balltree, op13_periodic,
    )
}

WORD4 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD2 = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {
    "op1_warc": """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), q as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as first_id from p
)
select page_id, payload_bytes, payload_digest, case when first_id is distinct from page_id and first_id is not null then 'revisit' else 'response' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from q""",
    "op4_decontaminate": f"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD4}') as w from documents
), b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD4}') as w from benchmark
), g as (
  select item, k, list_slice(w, pos, pos + k - 1) as gram
  from (select item, w, least(10, len(w)) as k, unnest(range(1, greatest(1, len(w) - 9) + 1)) as pos from b where len(w) > 0)
), widths as (select distinct k from g
), x as (
  select doc_id, pos, k, list_slice(w, pos, pos + k - 1) as gram from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as pos from d, widths where len(w) >= k)
), hits as (select x.doc_id, x.pos, x.k, g.item from x join g on x.gram = g.gram and x.k = g.k
), words as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(pos, pos + k)) as p from hits) group by doc_id
), items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as listed from hits group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
    "op6_lines": r"""
with l as (
  select doc_id, pos, line, regexp_matches(line, '[^ \t-\r]') as worded
  from (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null))
), w as (
  select doc_id, pos, line, lead(line) over u as line2, lead(line, 2) over u as line3, lead(pos) over u as at2, lead(pos, 2) over u as at3
  from l where worded window u as (partition by doc_id order by pos)
), r as (
  select *, row_number() over (partition by line, line2, line3 order by doc_id, pos) as n from w where at3 is not null
), gone as (
  select distinct doc_id, pos from (select doc_id, unnest([pos, at2, at3]) as pos from r where n > 1)
), k as (
  select l.doc_id, count(*) as n_lines, count(gone.pos) as n_removed, coalesce(string_agg(line, chr(10) order by l.pos) filter (where gone.pos is null), '') as kept
  from l left join gone on gone.doc_id = l.doc_id and gone.pos = l.pos group by l.doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(kept) as kept_sha256 from documents d left join k using (doc_id)""",
    "op12_balltree": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, t, count(*) as c from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark
  ) group by item_id, t
), s as (select count(*) as nn, cast(sum(len(w)) as bigint) as ll from d where len(w) > 0
), tf as (
  select doc_id, n, t, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as t from d) where t in (select t from b) group by doc_id, n, t
), weight as (
  select t, cast(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) as bigint) as weight from tf, s group by t
), scored as (
  select item_id, doc_id, cast(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll)))) as bigint) as score
  from tf join weight using (t) join b using (t), s group by item_id, doc_id
), ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scored where score > 0
)
select * from ranked where rank <= 20""",
    "op8_perspectives": r"""
with t as (
  select conv_id, turn, role, role = 'system' as shared, text, (row_number() over (partition by conv_id order by turn, role, text) - 1) // 1024 as part
  from (select conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '\s+', '_', 'g') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations)
), s as (
  select t.*, perspective, not shared and role = perspective as own,
    '<|im_start|>' || case when shared then role when role = perspective then 'assistant' else 'user name=' || role end || chr(10) as heading
  from t join (select distinct conv_id, role as perspective from t where not shared) p using (conv_id)
), o as (
  select *, heading || text || '<|im_end|>' || chr(10) as said,
    coalesce(sum(length(heading) + length(text) + 11) over (partition by conv_id, perspective, part order by turn, role, text rows between unbounded preceding and 1 preceding), 0) + length(heading) as head,
    row_number() over (partition by conv_id, perspective, part order by turn, role, text) as n
  from s
)
select conv_id, perspective, part, count(*) as n_turns, count(*) filter (where own) as n_masked, string_agg(said, '' order by n) as rendered,
  coalesce(string_agg(cast(head as bigint) || ':' || cast(head + length(text) + 10 as bigint), ',' order by n) filter (where own), '') as mask
from o group by conv_id, perspective, part""",
}

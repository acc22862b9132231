"""The queries of these operators over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.conversation_trie import prefix_trie, turn_rows, with_heads
from weftline.llm.decontaminate import leaks
from weftline.llm.hard_negatives import hard_negatives, usable
from weftline.llm.hilbert import hilbert_shards
from weftline.llm.language import identify, train, training_sample
from weftline.llm.minhash import near_duplicates
from weftline.llm.mixing import mix
from weftline.llm.order_minhash import edited_fingerprints
from weftline.llm.quality import quality
from weftline.llm.secret_scan import RULES as SECRET_RULES
from weftline.llm.secret_scan import scan_all
from weftline.llm.token_trees import count_through_edits, read_ranks
from weftline.llm.urls import LABELLED, RULES, filter_urls
from weftline.llm.wrappers import extract

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Mixing: three invented domains by the last digit of the source's name, with weights 3, 2
# and 1; English counts four times another language; the sources of a language count alike.
def mix_levels() -> dict[str, Column]:
    last = F.substring(F.coalesce("source", F.lit("0")), -1, 1)
    domain = F.concat(F.lit("d"), (F.ascii(last) % 3).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mix_weights() -> list[Column]:
    domain = F.when(F.col("domain") == "d0", 3).when(F.col("domain") == "d1", 2).otherwise(1)
    return [domain, F.when(F.col("lang") == "en", 4).otherwise(1), F.lit(1)]


def rough_tokens() -> Column:
    """About four bytes a token."""
    return F.call_function("div", F.octet_length("text") + 3, F.lit(4))


@_query
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    drawn = mix(table(spark, folder, "documents"), mix_levels(), mix_weights(), rough_tokens(), F.col("doc_id"),
                fraction=1.0, max_epochs=3, seed=17)
    return drawn.select("doc_id", "domain", "lang", "source", "epoch", "tokens", "take")


def _shared(name: str, above: str, path: str, parent: str, weight: str) -> str:
    """SQL for one level of budgets, from the level above it."""
    by = f"partition by {above} order by cap / w, {path.rsplit(', ', 1)[-1]}"
    return f"""
{name}_own as (select {path}, sum(supply)::hugeint as cap, max({weight})::hugeint as w from leaf group by {path}),
{name}_in as (select o.*, p.given as budget from {name}_own o join {parent}),
{name}_sum as (select *,
    greatest(budget - coalesce(sum(cap) over ({by} rows between unbounded preceding and 1 preceding), 0), 0)::hugeint as room,
    (sum(w) over ({by} rows between current row and unbounded following))::hugeint as ws from {name}_in),
{name}_open as (select *, (cap * ws <= room * w) as is_full from {name}_sum),
{name}_first as (select *, min(case when not is_full then {{'r': cap / w, 'l': room, 's': ws}} end)
    over (partition by {above}) as f from {name}_open),
{name} as (select {path}, (case when is_full then cap else (f.l * w) // f.s end)::hugeint as given from {name}_first)"""


ORACLES["op1_mix_sources"] = f"""
with rows as (select doc_id, 'd' || (ascii(right(source, 1)) % 3) as domain, lang, source,
    (strlen(text) + 3) // 4 as tokens from documents),
leaf as (select domain, lang, source, sum(tokens)::hugeint as held, sum(tokens)::hugeint * 3 as supply,
    case domain when 'd0' then 3 when 'd1' then 2 else 1 end as w1, case lang when 'en' then 4 else 1 end as w2, 1 as w3
    from rows where tokens > 0 group by all),
root as (select sum(held)::hugeint as given from leaf),
{_shared("l1", "1", "domain", "root p on true", "w1")},
{_shared("l2", "domain", "domain, lang", "l1 p using (domain)", "w2")},
{_shared("l3", "domain, lang", "domain, lang, source", "l2 p using (domain, lang)", "w3")},
plan as (select domain, lang, source, given // held as full_, given % held as part from l3 join leaf using (domain, lang, source) where given > 0),
ordered as (select *, coalesce(sum(tokens) over (partition by domain, lang, source
    order by md5('17|' || full_ || '|' || doc_id), doc_id::varchar rows between unbounded preceding and 1 preceding), 0)::hugeint as start
    from rows join plan using (domain, lang, source) where tokens > 0),
drawn as (select *, unnest(range((full_ + 1)::bigint)) as epoch from ordered),
taken as (select doc_id, domain, lang, source, epoch::int as epoch, tokens::bigint as tokens,
    (case when epoch < full_ then tokens else greatest(0, least(tokens, part - start)) end)::bigint as take from drawn)
select * from taken where take > 0"""


@_query
def op2_html_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@_query
def op3_token_counts(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Two edits a document: its middle forty characters give way to its first twenty, then three words go to its quarter."""
    n = F.length("text")
    edit = lambda start, stop, put: F.struct(
        start.cast("long").alias("start"), stop.cast("long").alias("stop"), put.alias("put"))
    edits = F.array(edit(F.expr("length(text) div 2"), F.expr("length(text) div 2 + 40"), F.substring("text", 1, 20)),
                    edit(F.expr("length(text) div 4"), F.expr("length(text) div 4"), F.lit(" three added words")))
    docs = table(spark, folder, "documents").select("doc_id", "text", F.when(n.isNotNull(), edits).alias("edits"))
    return count_through_edits(docs, read_ranks(vocabulary)).drop("text", "edits")


@_query
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_key")


def trusted(spark: SparkSession, folder: str) -> DataFrame:
    """The documents labelled good."""
    return table(spark, folder, "labels").where("quality = 1").select("doc_id")


@_query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return quality(docs, trusted(spark, folder), keep=["doc_id", "lang"])


@_query
def op8_minhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


# Sets are met once each, however many documents have them.
ORACLES["op8_minhash_near_duplicates"] = """
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end as s from words),
named as (select doc_id, len(s)::bigint as n, case when len(s) = 0 then 'd' || doc_id else md5(array_to_string(s, chr(10))) end as k, s from sets),
reps as (select k, any_value(n) as n, any_value(s) as s, min(doc_id) as least from named group by k),
runs as (select k, n, unnest(s) as run from reps where n > 0),
links as (select a.k as a, b.k as b from runs a join runs b on a.run = b.run and a.k <> b.k group by a.k, b.k, a.n, b.n
    having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select k as a, k as b from reps union select r.a, l.b from reach r join links l on l.a = r.b),
roots as (select r.a as k, min(least) as component_id from reach r join reps on reps.k = r.b group by r.a)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from named join roots using (k)"""


@_query
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return filter_urls(pages, RULES, LABELLED).select("page_id", "host", "path", "rule", "verdict", "score")


SHARD_DIMS = (["lang", "source"], ["size"])


@_query
def op7_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = hilbert_shards(docs, *SHARD_DIMS, 8, order=["text_crc32", "doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"),
                         F.lit(None).cast("int").alias("grown_shard"))


@_query
def op9_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(table(spark, folder, "documents"))


@_query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    learn = docs.where("not held_out and lang is not null and text is not null").select("doc_id", "text", "lang")
    network = train(training_sample(learn, F.xxhash64("doc_id", "text")))
    return identify(docs.select("doc_id", "held_out", "text"), network).select("doc_id", "held_out", "lang_pred", "score")


HEAD_TURNS = 5


@_query
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations that begin with up to five turns of the one whose id ends in 00, as a trie."""
    rows = turn_rows(table(spark, folder, "conversations"))
    count = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_TURNS + 1)).cast("int")
    rebuilt = with_heads(rows, F.col("conv_id") - F.col("conv_id") % 100, count, HEAD_TURNS)
    return prefix_trie(rebuilt).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# CRC-32 of a decimal number, eight steps for each of its bytes.
_CRC32 = """(list_reduce(list_concat([4294967295::bigint], flatten([[ascii(x) + 256::bigint, 0, 0, 0, 0, 0, 0, 0]
    for x in string_split(conv_id::varchar, '')])),
    lambda s, b: (xor(xor(s, case when b > 0 then b - 256 else 0 end) >> 1, (xor(s, case when b > 0 then b - 256 else 0 end) & 1) * 3988292384))))"""

ORACLES["op11_conversation_trie"] = f"""
with own as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
    from conversations where conv_id is not null),
ids as (select conv_id, conv_id - conv_id % 100 as donor, (xor({_CRC32}, 4294967295) % 6) as h from (select distinct conv_id from own)),
given as (select i.conv_id, o.pos, o.role, o.text from ids i join own o on o.conv_id = i.donor and o.pos <= i.h),
heads as (select conv_id, count(*) as n from given group by conv_id),
turns as (select * from given union all
    select o.conv_id, o.pos - i.h + coalesce(n, 0), o.role, o.text from own o join ids i using (conv_id) left join heads using (conv_id) where o.pos > i.h),
hashed as (select conv_id, pos, length(text) as size, md5(length(role) || ':' || role || text) as t from turns),
paths as (select conv_id, pos as depth, size, md5(string_agg(t, '') over (partition by conv_id order by pos)) as node,
    md5(coalesce(string_agg(t, '') over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), '')) as parent from hashed
    union all select conv_id, 0, 0, md5(''), null from ids),
ends as (select conv_id, max(depth) as depth from paths group by conv_id),
ended as (select node, string_agg(conv_id::varchar, ',' order by conv_id) as ids, min(conv_id) as one from ends join paths using (conv_id, depth) group by node),
nodes as (select node, depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size from paths group by node, depth),
children as (select parent as node, count(*) as n from nodes where parent is not null group by parent),
leaves as (select p.node, count(*) as n from nodes l join ended e on e.node = l.node join paths p on p.conv_id = e.one
    where l.node not in (select node from children) group by p.node),
above as (select p.node, sum((n.n_convs - 1) * n.size) as saved from nodes n join paths p on p.conv_id = n.conv_id and p.depth <= n.depth group by p.node)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, l.n as n_leaves,
    a.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n left join nodes u on u.node = n.parent left join children c on c.node = n.node left join leaves l on l.node = n.node
    left join above a on a.node = n.node left join ended e on e.node = n.node"""


@_query
def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_all(table(spark, folder, "documents"), keep=["doc_id"])
    listed = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in SECRET_RULES], F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def _spans_sql(place: int, rule) -> str:
    """SQL for one rule's spans: the text is cut before each match, found by its length."""
    pattern = rule.pattern.replace("'", "''").removeprefix("(?i)")
    flags = ", 'i'" if rule.pattern.startswith("(?i)") else ""
    parts = lambda group: f"regexp_extract_all(text, '{pattern}', {group}{flags})"
    return f"""
f{place} as (select doc_id, unnest({parts(0)}) as hit, unnest({parts(rule.counted)}) as counted,
    generate_subscripts({parts(0)}, 1) as k, text from docs),
m{place} as (select doc_id, k, hit, counted, length(string_split_regex(text, '{pattern}'{flags})[k]) as gap from f{place}),
s{place} as (select doc_id, {place} as place, '{rule.kind}' as kind, counted, length(hit) as n,
    (sum(gap + length(hit)) over (partition by doc_id order by k))::bigint as stop from m{place})"""


ORACLES["op12_secret_scan"] = f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),{",".join(_spans_sql(i, r) for i, r in enumerate(SECRET_RULES))},
spans as ({" union all ".join(f"select doc_id, place, kind, stop - n as start, stop from s{i} where length(counted) >= {r.least}" for i, r in enumerate(SECRET_RULES))}),
listed as (select doc_id, {", ".join(f"count_if(place = {i}) as n_{r.kind}" for i, r in enumerate(SECRET_RULES))},
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) as spans from spans group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in SECRET_RULES)},
    sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from documents d left join listed using (doc_id)"""


@_query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(table(spark, folder, "embeddings").withColumn("label", moved))
    return hard_negatives(rows, "vec_id % 100 = 0")


ORACLES["op13_hard_negatives"] = """
with rows as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
    from rows a, rows r where a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (select p.*, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank
    from positives p join scores s on s.anchor_id = p.anchor_id and not s.same
        and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 5"""

"""The registered queries of the text operators and their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lineage import scratch_path, written
from . import (
    bpe_chunks, chat_format, exact_dedup, language_id, line_dedup, near_dedup, packing, period_runs,
    quality_rules, token_files, toxicity, url_reputation, whitening,
)
from .common import crc32_mod, table
from .url_reputation import Rule

# Fixed values of the contract.
RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id",
        (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        "predicted",
        F.size("passages").alias("n_passages"),
    )


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.range(0, 2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digest(chat_format.examples(talks.unionByName(extra)))


OP2_SQL = r"""
with talks as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, row_number() over w as pos, count(*) over (partition by conv_id) as n,
    sum(14
      + length(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), chr(10), '\n'))
      + length(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e'))
      - 1) over (w rows unbounded preceding) as upto
  from talks
  window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(case when role = 'assistant' or pos = n then upto else 0 end))::bigint as formatted_chars
from sized group by conv_id
"""


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(docs, path, end_id=1)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_dedup.classes(docs)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op6_bpe_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe_chunks.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = scratch_path(spark, "token-files")
    token_files.write(docs, out, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.digest(spark, out)


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes: a page is bad if its label says low quality or toxic. The table
    ``labels`` names rows by doc_id; it is read as the id of the page."""
    outcomes = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"),
        F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"),
    )
    pages = table(spark, folder, "pages").select("page_id", "url")
    found = url_reputation.judge(pages, outcomes, RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


LISTED_SUFFIXES = ", ".join(f"'{s}'" for s in url_reputation.SUFFIXES)

OP7_SQL = rf"""
with urls as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages
), names as (
  select distinct host, rtrim(regexp_replace(split_part(host, '@', -1), ':[0-9]*\z', ''), '.') as name from urls
), parts as (
  select host, name, string_split(name, '.') as l, array_to_string(l[-2:], '.') in ({LISTED_SUFFIXES}) as listed,
    regexp_matches(name, '^(?:[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}|\[[0-9a-f:.]*\])\z') as address
  from names
), hosts as (
  select host, case when address then name when listed then array_to_string(l[-3:], '.')
    else array_to_string(l[-2:], '.') end as domain,
    case when address then '[ip]' when listed then array_to_string(l[-2:], '.') else l[-1] end as suffix
  from parts
), h as (
  select host, count(*)::double as n, sum(greatest(1 - quality, toxic))::double as bad
  from urls join labels on page_id = doc_id
  where greatest(1 - quality, toxic) is not null group by host
), d as (
  select domain, any_value(suffix) as suffix, sum(n) as n, sum(bad) as bad from h join hosts using (host) group by domain
), s as (
  select suffix, sum(n) as n, sum(bad) as bad from d group by suffix
), o as (
  select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) as m from s
), sp as (
  select coalesce(case when sum(n*m*(1-m)) - sum(m*(1-m)) > 1e-9 then least(greatest(
    (sum(n*m*(1-m)) - sum(m*(1-m))) / greatest(sum(n*pow(bad/n-m,2)) - sum(m*(1-m)), 1e-12) - 1, 1), 1000) end, 10) as p
  from s, o
), sm as (
  select suffix, (p*m + bad)/(p + n) as m, p + n as k from s, o, sp
), dj as (
  select d.*, m from d join sm using (suffix)
), dp as (
  select coalesce(case when sum(n*m*(1-m)) - sum(m*(1-m)) > 1e-9 then least(greatest(
    (sum(n*m*(1-m)) - sum(m*(1-m))) / greatest(sum(n*pow(bad/n-m,2)) - sum(m*(1-m)), 1e-12) - 1, 1), 1000) end, 10) as p
  from dj
), dm as (
  select domain, (p*m + bad)/(p + n) as m, p + n as k from dj, dp
), hj as (
  select h.host, n, bad, m from h join hosts using (host) join dm using (domain)
), hp as (
  select coalesce(case when sum(n*m*(1-m)) - sum(m*(1-m)) > 1e-9 then least(greatest(
    (sum(n*m*(1-m)) - sum(m*(1-m))) / greatest(sum(n*pow(bad/n-m,2)) - sum(m*(1-m)), 1e-12) - 1, 1), 1000) end, 10) as p
  from hj
), hm as (
  select host, (p*m + bad)/(p + n) as m, p + n as k from hj, hp
), bounds as (
  select hosts.host, coalesce(
    hm.m - 1.645*sqrt(hm.m*(1-hm.m)/(hm.k+1)), dm.m - 1.645*sqrt(dm.m*(1-dm.m)/(dm.k+1)),
    sm.m - 1.645*sqrt(sm.m*(1-sm.m)/(sm.k+1)), o.m - 1.645*sqrt(o.m*(1-o.m)/11)) as b
  from hosts left join hm using (host) left join dm using (domain) left join sm using (suffix), o
), rules(rule, rhost, rpath, said) as (
  values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits as (
  select page_id, urls.host, path, arg_max(rule, length(rule)) as rule, arg_max(said, length(rule)) as said
  from urls left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by all
)
select page_id, host, path, rule, coalesce(said, case when b > 0.5 then 'block' else 'allow' end) as verdict
from fits join bounds using (host)
"""


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = written(quality_rules.features(docs, carry=["doc_id", "lang"]), "quality")
    refs = quality_rules.references(found, F.col("_row.lang"))
    return quality_rules.judged(found, ["doc_id"], refs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


CLASS_LIST, WORD_LIST = range(len(quality_rules.CLASSES)), quality_rules.WORDS


def _distance_sql(counts: str, kind: str) -> str:
    """Least distance of a list of counts from the references of a kind."""
    return f"""(select sqrt(greatest(min(d), 0)) from (
      select list_sum(list_transform(list_zip({counts}, r.{kind}), lambda z:
        (case when z[1] > 0 then z[1]/list_sum({counts}) * log2(z[1]/list_sum({counts}) / ((z[1]/list_sum({counts}) + z[2]/list_sum(r.{kind}))/2)) else 0 end
         + case when z[2] > 0 then z[2]/list_sum(r.{kind}) * log2(z[2]/list_sum(r.{kind}) / ((z[1]/list_sum({counts}) + z[2]/list_sum(r.{kind}))/2)) else 0 end) / 2)) as d
      from refs r where list_sum(r.{kind}) > 0))"""


OP9_SQL = rf"""
with t as (
  select doc_id, lang, coalesce(text, '') as x,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), counted as (
  select doc_id, lang, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) as n_dup_lines,
    [length(regexp_replace(x, '[^a-z]', '', 'g')), length(regexp_replace(x, '[^\x20\x09-\x0D]', '', 'g')),
     length(regexp_replace(x, '[^A-Z]', '', 'g')), length(regexp_replace(x, '[^0-9]', '', 'g')),
     length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')), length(regexp_replace(x, '[\x00-\x7F]', '', 'g')),
     length(regexp_replace(x, '[a-zA-Z0-9#*$%&|<>\x20\x09-\x0D]|[^\x00-\x7F]', '', 'g'))]::double[] as c,
    list_transform({WORD_LIST}, lambda k: len(list_filter(w, lambda v: v = k or v = upper(k[1]) || k[2:])))::double[] as listed,
    w
  from t
), f as (
  select *, list_append(listed, len(w) - list_sum(listed)) as k from counted
), refs as (
  select lang, [{", ".join(f"sum(c[{i + 1}])" for i in CLASS_LIST)}] as rc,
    [{", ".join(f"sum(k[{i + 1}])" for i in range(len(WORD_LIST) + 1))}] as rk
  from f where lang in ('de', 'en', 'es', 'fr') group by lang
), g as (
  select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as gram
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from f)
), rep as (
  select doc_id, count(distinct i + o)::bigint as n from (
    select doc_id, i, count(*) over (partition by doc_id, gram) as m from g), (values (0), (1), (2)) as v(o)
  where m > 1 group by doc_id
), told as (
  select f.*, coalesce(rep.n, 0) as n_repeat_words,
    case when list_sum(c) >= 200 then {_distance_sql("c", "rc")} end as char_distance,
    case when n_words >= 50 then {_distance_sql("k", "rk")} end as word_distance
  from f left join rep using (doc_id)
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(char_distance, 0) <= 0.27
    and coalesce(word_distance, 0) <= 0.28 as kept
from told
"""


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = exact_dedup.mark(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id is not distinct from min(doc_id) over w as kept, text_sha256
from (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents)
window w as (partition by text_sha256)
"""


def repeated(key: Column, text: Column) -> Column:
    """The contract's planted runs: with h the key's checksum, where h % 10 = 0
    the words from the one numbered a on repeat with a period p."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def planted(ws: Column) -> Column:
        n = F.size(ws)
        a, times = (g % n).cast("int"), (3 + g % 8).cast("int")
        p = F.floor((n - a) / times).cast("int") + 1
        again = F.slice(F.flatten(F.array_repeat(F.slice(ws, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(ws, F.lit(1), a), again), " ")).otherwise(text)

    # a one-element array binds the words, so they are split once
    return F.when(h % 10 == 0, F.transform(F.array(words), planted)[0]).otherwise(text)


def op11_period_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = period_runs.find(docs.select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p")))
    )
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        F.col("best.s").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("-1000 * best.n div best.p").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    error = whitening.identity_error(rows, model, 32)
    shares = F.array(*[F.lit(float(e)) for e in model.explained[:32]]).cast("array<double>")
    return whitening.transform(rows, model, 32).select(
        "vec_id",
        "deviation",
        F.posexplode("whitened").alias("_k", "whitened"),
    ).select(
        "vec_id",
        (F.col("_k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    index = line_dedup.LineIndex.scratch(spark, min_docs=10, min_chars=1).insert(docs)
    return index.dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP13_SQL = """
with docs as (
  select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), numbered as (
  select row, doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from docs
), keyed as (
  select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
  from numbered
), many as (
  select key from keyed where length(key) >= 1 group by key having count(distinct row) >= 10
)
select doc_id, count(*) as n_lines, count(many.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (many.key is null), '')) as kept_sha256
from keyed left join many on keyed.key = many.key
group by row, doc_id
"""

LLM_REGISTRY = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_chat_format": (op2_chat_format, OP2_SQL),
    "op3_best_fit_packing": (op3_best_fit_packing, None),
    "op4_near_dedup": (op4_near_dedup, None),
    "op5_language_id": (op5_language_id, None),
    "op6_bpe_chunks": (op6_bpe_chunks, None),
    "op8_token_files": (op8_token_files, None),
    "op7_url_filter": (op7_url_filter, OP7_SQL),
    "op9_quality_rules": (op9_quality_rules, OP9_SQL),
    "op10_exact_dedup": (op10_exact_dedup, OP10_SQL),
    "op11_period_runs": (op11_period_runs, None),
    "op12_whitening": (op12_whitening, None),
    "op13_line_dedup": (op13_line_dedup, OP13_SQL),
}

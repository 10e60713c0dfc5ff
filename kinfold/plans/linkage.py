"""Queries of blocking, retrieval, unions, evaluation, decisions, profiling, sampling and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import channels as C
from ..operators import decide, dense, matcher, metrics, pair_texts, sampling, validate
from ..sources import tsv
from . import testdata as D

QUERIES: dict = {}
SQL: dict[str, str] = {}
STOP = D.STOP


def query(sql: str | None = None, *ctes: str, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = D.sql(sql, *ctes)
        return f

    return register


# ---- Keys -------------------------------------------------------------------------------------------------------

def one_key(channel: str, ktype: str, kval: str, when: str) -> str:
    return f"SELECT entity_id, src, country, '{channel}' AS channel, {ktype} AS ktype, {kval} AS kval FROM kr WHERE ({when}) AND ({kval}) IS NOT NULL AND ({kval}) <> ''"


def spread(channel: str, ktype: str, values: str, when: str = "true") -> str:
    return f"SELECT entity_id, src, country, '{channel}' AS channel, {ktype} AS ktype, unnest({values}) AS kval FROM kr WHERE {when}"


LIGHT_LIST = f"not list_contains({STOP},w)"
KR = rf"""kr as (select *, [w for w in legal_words if length(w)>=3 and {LIGHT_LIST}] as nt, postals[1] as p, [w for w in string_split(rom,' ') if length(w)>=4 and {LIGHT_LIST}] as jt, (string_split(clean_addr,' ')) as caw,
  [w for w in digits if length(w)<=5 and w<>'0'] as hd, [w for w in digits if w<>'0'][1] as n0, [w for w in digits if regexp_full_match(w,'[0-9]{{5,6}}')][1] as cp,
  [w for w in name_words if length(w)>=5][1:2] as kw, array_to_string([lower(substr(w,1,1)) for w in name_words if regexp_matches(w,'^[\pL\pN]')],'') as acr0,
  [w for w in string_split(clean_addr,' ') if length(w)>=4 and {LIGHT_LIST}][-1] as place,
  list_distinct([w for w in string_split(clean_addr,' ') if length(w)>=3 and not regexp_full_match(w,'[0-9]+') and not list_contains({D.ADDRESS_STOP},w)]) as at_unordered,
  [w for w in string_split(clean_addr,' ') if length(w)>=3 and not regexp_full_match(w,'[0-9]+') and not list_contains({D.ADDRESS_STOP},w)] as at_all from rec),
kr2 as (select *, [v for v, i in at_all if list_position(at_all, v) = i] as ato from kr)"""
acr = r"case when len(name_words)>=2 and length(acr0) between 2 and 6 then acr0 when len(name_words)=1 and length(name_words[1]) between 2 and 5 and regexp_full_match(name_words[1],'\pL+') then name_words[1] end"
squeezed = lambda x: f"array_to_string([substr({x},i::int,1) for i in range(1,length({x})+1) if i=1 or substr({x},i::int,1)<>substr({x},(i-1)::int,1)],'')"
KEY_SQL = {
    "A": one_key("A", "'legal'", "legal_name", "true"),
    "C": " UNION ALL ".join([one_key("C", "'postal'", "cp", "true"), one_key("C", "'num_word'", "digits[1]||'_'||addr_words3[1]", "len(digits)>0 and len(addr_words3)>0"),
                             one_key("C", "'addr_words'", "addr_words3[1]||'_'||addr_words3[2]", "not (len(digits)>0 and len(addr_words3)>0) and len(addr_words3)>=2")]),
    "E": " UNION ALL ".join([one_key("E", "'drop0'", "nt[2]||'_'||nt[3]", "len(nt)>=3"), one_key("E", "'drop1'", "nt[1]||'_'||nt[3]", "len(nt)>=3"),
                             one_key("E", "'drop2'", "nt[1]||'_'||nt[2]", "len(nt)>=3"), one_key("E", "'pair'", "nt[1]||'_'||nt[2]", "len(nt)=2")]),
    "F": one_key("F", "'addr_w1'", "addr_words4[2]", "true") + " UNION ALL " + one_key("F", "'addr_w2'", "addr_words4[3]", "true"),
    "G": one_key("G", "'snk'", "substr(replace(legal_name,' ',''),1,8)", "length(replace(legal_name,' ',''))>=5"),
    "H": " UNION ALL ".join([spread("H", "'num_post5'", "[d||'_'||substr(cp,1,5) for d in hd[1:2] if d<>cp]", "cp is not null and len(hd)>0"),
                             spread("H", "'num_post3'", "[d||'_'||substr(cp,1,3) for d in hd[1:2] if d<>cp]", "cp is not null and len(hd)>0"),
                             one_key("H", "'num_pair'", "hd[1]||'_'||hd[2]", "not (cp is not null and len(hd)>0) and len(hd)>=2")]),
    "I": " UNION ALL ".join([spread("I", "'landmark'", rf"[lower(w) for w in regexp_extract_all(addr,'(?i)\b(?:near|opp|opposite|behind|beside|adj|adjacent|next\s+to|opp\.)\s+([a-zA-Z0-9]+)',1) if length(w)>=4 and not list_contains({STOP},lower(w))]"),
                             one_key("I", "'addr_edge'", "addr_words4[1]||'_'||addr_words4[-1]", "len(addr_words4)>=4"), one_key("I", "'addr_edge2'", "addr_words4[2]||'_'||addr_words4[-1]", "len(addr_words4)>=4")]),
    "J": " UNION ALL ".join([one_key("J", "'rom_exact'", "rom", "true"), one_key("J", "'rom_snk'", "substr(replace(rom,' ',''),1,8)", "length(replace(rom,' ',''))>=5"),
                             one_key("J", "'rom_pair'", "jt[1]||'_'||jt[2]", "len(jt)>=2"), one_key("J", "'rom_word'", "jt[1]", "len(jt)=1")]),
    "K": " UNION ALL ".join([spread("K", "'sqz'", f"[x for x in [case when {squeezed('w')}<>w and length({squeezed('w')})>=4 then {squeezed('w')} end for w in kw] if x is not null]"),
                             spread("K", "case when p is not null then 'del_'||substr(p,1,2) else 'del_rare' end",
                                    "flatten([list_concat([w],[substr(w,1,(i-1)::int)||substr(w,(i+1)::int) for i in range(1,length(w)+1)]) for w in kw if length(w) between 6 and 12 and (p is not null or length(w)>=8)])")]),
    "L": one_key("L", "'acr_p3'", f"({acr})||'_'||substr(p,1,3)", "p is not null") + " UNION ALL " + one_key("L", "'acr_city'", f"({acr})||'_'||place", "p is null"),
    "H1": spread("H1", "'h1'", "list_distinct([n0||'_'||w for w in ato[1:3]])", "n0 is not null").replace("FROM kr ", "FROM kr2 "),
    "H2": spread("H2", "'h2'", "list_distinct([w||'_'||n0 for w in nt[1:2]])", "n0 is not null"),
    "H3": spread("H3", "'h3'", "list_distinct([n0||'_'||w for w in ato[-2:]])", "n0 is not null").replace("FROM kr ", "FROM kr2 "),
    "H4": spread("H4", "'h4'", "list_distinct(flatten([[w||'_'||v for v in ato[-2:]] for w in nt[1:2]]))").replace("FROM kr ", "FROM kr2 "),
}


def _keys_query(name: str):
    return lambda spark, sf_dir: C.channel_keys(D.noisy_records(spark, sf_dir), [name]).select("entity_id", "country", "ktype", "kval")


for _n in ("A", "C", "E", "F", "G", "H", "I", "J", "K", "L", "H1", "H2", "H3", "H4"):
    QUERIES[f"blk_{_n.lower()}"] = _keys_query(_n)
    if _n in KEY_SQL:
        SQL[f"blk_{_n.lower()}"] = D.sql(f"SELECT entity_id, country, ktype, kval FROM ({KEY_SQL[_n]})", KR)

VOCAB = """df as (select token, count(*) as df from (select distinct entity_id, unnest(name_tokens) as token from rec where src<>'S1') group by 1),
vocab as (select token, df, ln(((select count(*) from rec where src<>'S1')+1)/(df+1)) as idf from df where df between 2 and 80)"""
GRAMS = "grams as (select entity_id, src, country, unnest(g) as gram, generate_subscripts(g,1) as pos from (select *, case when legal_name='' then [] else [substr(' '||legal_name||' ',i::int,3) for i in range(1,length(legal_name)+1)] end as g from rec))"
GRAM_VOCAB = """gdf as (select gram as token, count(distinct entity_id) as df from grams where src<>'S1' group by 1),
gvocab as (select token, df, ln(((select count(*) from rec where src<>'S1')+1)/(df+1)) as idf from gdf where df between 3 and 80)"""


def name_vocabulary(recs: DataFrame) -> DataFrame:
    return C.vocabulary(recs, F.col("name_tokens"), 2, 80)


def gram_vocabulary(recs: DataFrame) -> DataFrame:
    return C.vocabulary(recs, T.ngrams(F.col("legal_name")), 3, 80)


@query("SELECT token, df FROM df", VOCAB)
def idx_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.document_frequency(D.noisy_records(spark, sf_dir), F.col("name_tokens"))


@query("SELECT token, df, round(idf, 9) AS idf FROM vocab", VOCAB)
def idx_idf(spark, sf_dir):
    return name_vocabulary(D.noisy_records(spark, sf_dir)).withColumn("idf", F.round("idf", 9))


@query("SELECT token, df FROM vocab", VOCAB)
def flt_df_range(spark, sf_dir):
    return name_vocabulary(D.noisy_records(spark, sf_dir)).select("token", "df")


@query("SELECT token, df FROM gdf WHERE df BETWEEN 3 AND 160", GRAMS, GRAM_VOCAB)
def flt_df_range_ngram2x(spark, sf_dir):
    return C.document_frequency(D.noisy_records(spark, sf_dir), T.ngrams(F.col("legal_name"))).where("df between 3 and 160")


BKEYS = """toks as (select entity_id, src, country, unnest(name_tokens) as token, generate_subscripts(name_tokens,1) as pos from rec),
bkeys as (select entity_id, src, country, 'B' as channel, 'tok' as ktype, token as kval from (select toks.*, idf, row_number() over (partition by entity_id order by round(idf,12) desc, pos) as r from toks join vocab using (token)) where r<=3)"""
DKEYS = "dkeys as (select entity_id, src, country, 'D' as channel, 'tok' as ktype, gram as kval from (select grams.*, idf, row_number() over (partition by entity_id order by round(idf,12) desc, pos) as r from grams join gvocab on gram=token) where r<=2)"


@query("SELECT entity_id, country, ktype, kval FROM bkeys", VOCAB, BKEYS)
def blk_b(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    return C.rare_keys(recs, "B", F.col("name_tokens"), name_vocabulary(recs), 3).select("entity_id", "country", "ktype", "kval")


@query("SELECT entity_id, token AS kval FROM (SELECT entity_id, token, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS r FROM toks JOIN vocab USING (token)) WHERE r<=3", VOCAB, BKEYS)
def blk_b_first3(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    flat = name_vocabulary(recs).withColumn("idf", F.lit(1.0))
    return C.rare_keys(recs, "B", F.col("name_tokens"), flat, 3).select("entity_id", "kval")


@query("SELECT entity_id, country, ktype, kval FROM dkeys", GRAMS, GRAM_VOCAB, DKEYS)
def blk_d(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    return C.rare_keys(recs, "D", T.ngrams(F.col("legal_name")), gram_vocabulary(recs), 2).select("entity_id", "country", "ktype", "kval")


@query("SELECT entity_id, arg_min(gram,pos)||'_'||arg_max(gram,pos) AS kval FROM grams JOIN gvocab ON gram=token GROUP BY 1 HAVING count(*)>=2", GRAMS, GRAM_VOCAB)
def blk_d_pair(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    grams = recs.select("entity_id", F.posexplode(T.ngrams(F.col("legal_name"))).alias("pos", "token")).join(gram_vocabulary(recs).select("token"), "token")
    return grams.groupBy("entity_id").agg(F.concat(F.min_by("token", "pos"), F.lit("_"), F.max_by("token", "pos")).alias("kval"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


GRAMS4 = "grams4 as (select entity_id, src, country, unnest(g) as gram, generate_subscripts(g,1) as pos from (select *, case when length(legal_name)<2 then [] else [substr(' '||legal_name||' ',i::int,4) for i in range(1,length(legal_name))] end as g from rec))"
GRAM4_VOCAB = """gdf4 as (select gram as token, count(distinct entity_id) as df from grams4 where src<>'S1' group by 1),
gvocab4 as (select token, df, ln(((select count(*) from rec where src<>'S1')+1)/(df+1)) as idf from gdf4 where df between 2 and 80)"""
DKEYS4 = DKEYS.replace("dkeys", "dkeys4").replace("grams", "grams4").replace("gvocab", "gvocab4").replace("'D'", "'D4'")


def four_gram_vocabulary(recs: DataFrame) -> DataFrame:
    return C.vocabulary(recs, T.ngrams(F.col("legal_name"), 4), 2, 80)


def relaxed_keys(recs: DataFrame) -> DataFrame:
    """Two rarest 3-grams and two rarest 4-grams of a record."""
    three = C.rare_keys(recs, "D", T.ngrams(F.col("legal_name")), gram_vocabulary(recs), 2)
    return three.unionByName(C.rare_keys(recs, "D4", T.ngrams(F.col("legal_name"), 4), four_gram_vocabulary(recs), 2))


@query("SELECT entity_id, channel, kval FROM dkeys UNION ALL SELECT entity_id, channel, kval FROM dkeys4", GRAMS, GRAM_VOCAB, DKEYS, GRAMS4, GRAM4_VOCAB, DKEYS4)
def blk_d_relaxed(spark, sf_dir):
    return relaxed_keys(D.noisy_records(spark, sf_dir)).select("entity_id", "channel", "kval")


# ---- Postings, candidate pairs, unions --------------------------------------------------------------------------

LEXICAL = ["A", "C", "E", "F", "G", "H", "I", "J", "K", "L"]
CROSS = ["H1", "H2", "H3", "H4"]
NAMES = [*LEXICAL, *CROSS]


def all_keys(spark, sf_dir, names=NAMES, rare=True) -> DataFrame:
    """The keys of the named channels, and of the two that need a vocabulary."""
    return D.stored(spark, sf_dir, f"keys-{''.join(names)}-{rare}", lambda: _all_keys(spark, sf_dir, names, rare))


def _all_keys(spark, sf_dir, names, rare) -> DataFrame:
    recs = D.noisy_records(spark, sf_dir)
    out = C.channel_keys(recs, names)
    if rare:
        out = out.unionByName(C.rare_keys(recs, "B", F.col("name_tokens"), name_vocabulary(recs), 3)).unionByName(C.rare_keys(recs, "D", T.ngrams(F.col("legal_name")), gram_vocabulary(recs), 2))
    return out


EVERY = ["B", "D", *NAMES]
CAPS = "(case channel " + " ".join(f"when '{n}' then {C.CHANNELS[n].cap}" for n in EVERY) + " end)"
BITS = "(case channel " + " ".join(f"when '{n}' then {1 << C.CHANNELS[n].bit}" for n in EVERY) + " end)"
WHOLE = "channel in ('H1','H2','H3','H4')"
ALL_KEYS = "keys as (" + " UNION ALL ".join(KEY_SQL[n] for n in NAMES) + " UNION ALL SELECT * FROM bkeys UNION ALL SELECT * FROM dkeys)"
RANKED = f"""ranked as (select *, row_number() over (partition by channel,country,ktype,kval order by src, entity_id) as pos, count(*) over (partition by channel,country,ktype,kval) as len, {CAPS} as cap from keys where src<>'S1'),
post as (select channel,country,ktype,kval,entity_id as cand_id, pos, len from ranked where (not {WHOLE} and pos<=cap) or ({WHOLE} and len<=cap))"""
MET = "(" + " + ".join(f"(len<={c})::int*{1 << 4 * j}" for j, c in enumerate(C.COMPOSITE_CAPS)) + ")"
PAIRS = f"""pairs as (select k.entity_id as s1_id, cand_id, bit_or(({BITS.replace('channel', 'k.channel')}*case when k.{WHOLE} then {MET} else 1 end)::bigint) as mask, sum(case when k.{WHOLE} then 0 else 1 end)::bigint as hits
  from keys k join post p on k.channel=p.channel and k.country=p.country and k.ktype=p.ktype and k.kval=p.kval where k.src='S1' group by 1,2)"""
BASE = (KR, VOCAB, BKEYS, GRAMS, GRAM_VOCAB, DKEYS, ALL_KEYS, RANKED)
PAIR_BASE = (*BASE, PAIRS)


@query("SELECT channel, country, ktype, kval, cand_id FROM post", *BASE)
def idx_postings(spark, sf_dir):
    return C.postings(all_keys(spark, sf_dir), EVERY).drop("n")


@query("SELECT channel, country, ktype, kval FROM ranked WHERE channel in ('H1','H2','H3','H4') GROUP BY ALL HAVING count(*)>150", *BASE)
def idx_overflow_drop(spark, sf_dir):
    return all_keys(spark, sf_dir, CROSS, False).where("src <> 'S1'").groupBy("channel", "country", "ktype", "kval").count().where("count > 150").drop("count")


_CAPS = (5, *C.COMPOSITE_CAPS)


@query(f"SELECT channel, cap, count(*) AS keys, sum((n<=cap)::int)::bigint AS kept, sum((n>cap)::int)::bigint AS pruned FROM (SELECT channel,country,ktype,kval,count(*) AS n FROM ranked WHERE {WHOLE} GROUP BY ALL), unnest({list(_CAPS)}) AS u(cap) GROUP BY 1,2", *BASE)
def idx_overflow_stats(spark, sf_dir):
    sizes = all_keys(spark, sf_dir, CROSS, False).where("src <> 'S1'").groupBy("channel", "country", "ktype", "kval").agg(F.count(F.lit(1)).alias("n"))
    tried = sizes.select("channel", "n", F.explode(F.array(*map(F.lit, _CAPS))).alias("cap"))
    return tried.groupBy("channel", "cap").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") <= F.col("cap")).alias("kept"), F.count_if(F.col("n") > F.col("cap")).alias("pruned"))


def pair_table(spark, sf_dir) -> DataFrame:
    return D.stored(spark, sf_dir, "pairs", lambda: C.candidate_pairs(all_keys(spark, sf_dir), EVERY))


@query("SELECT * FROM pairs", *PAIR_BASE)
def join_hits(spark, sf_dir):
    return pair_table(spark, sf_dir)


@query("SELECT s1_id, cand_id, hits FROM pairs WHERE mask & 1 <> 0", *PAIR_BASE)
def join_capped_prefix(spark, sf_dir):
    return pair_table(spark, sf_dir).where(F.col("mask").bitwiseAND(1) != 0).select("s1_id", "cand_id", "hits")


mask_of = C.mask_of
CROSS_MASK = mask_of([f"{n}@300" for n in CROSS])


@query(f"SELECT s1_id, cand_id FROM pairs WHERE mask & {CROSS_MASK} <> 0", *PAIR_BASE)
def join_freq_bounded(spark, sf_dir):
    return C.candidate_pairs(all_keys(spark, sf_dir, CROSS, False), CROSS).select("s1_id", "cand_id")


# Names of the 33 candidate sets, and the channels that each unites.
ALL_LEXICAL = "ABCDEFGHIJKL"
UNIONS = {
    "A": "A", "A+B": "AB", "A+B+C": "ABC", "A+B+C+D": "ABCD", "A+B+C+D+E": "ABCDE", "A+B+C+D+E+F": "ABCDEF", "A+B+C+D+E+F+G": "ABCDEFG",
    "Channel_H_Standalone": "H", "Channel_I_Standalone": "I", "A-G+H": "ABCDEFGH", "A-G+H+I": "ABCDEFGHI", "Channel_J_Standalone": "J", "A-G+H+I+J": "ABCDEFGHIJ",
    "Channel_K_Standalone": "K", "A-G+H+I+J+K": "ABCDEFGHIJK", "Channel_L_Standalone": "L", "A-G+H+I+J+K+L": ALL_LEXICAL,
}
UNIONS |= {f"H{n}_Standalone@150": [f"H{n}@150"] for n in (1, 2, 3, 4)} | {f"A-L+H{n}@150": [*ALL_LEXICAL, f"H{n}@150"] for n in (1, 2, 3, 4)}
UNIONS |= {f"A-L+{k}@{cap}": [*ALL_LEXICAL, *(f"H{n}@{cap}" for n in v)] for cap in C.COMPOSITE_CAPS for k, v in {"H1-4": (1, 2, 3, 4), "H1+H4": (1, 4), "H1+H2+H4": (1, 2, 4), "H1+H3+H4": (1, 3, 4)}.items()}
UNIONS = {k: mask_of(v) for k, v in UNIONS.items()}
UNION_V1 = {k: mask_of(v) for k, v in {"A": "A", "B": "B", "C": "C", "D": "D", "A+B": "AB", "A+B+C": "ABC", "A+B+C+D": "ABCD"}.items()}
UNION_MATCHER = {k: mask_of(v) for k, v in {"A": "A", "A+B": "AB", "A+B+C": "ABC", "A-E": "ABCDE", "A-G": "ABCDEFG"}.items()}


def union_counts(spark, sf_dir, unions) -> DataFrame:
    """union_name, s1_id, n_cand, n_rec, n_true, also for entities without candidates: one aggregation for all unions."""
    recs = D.noisy_records(spark, sf_dir)
    truth = D.truth(recs)
    marked = pair_table(spark, sf_dir).join(truth.withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "left")
    inside = {u: F.col("mask").bitwiseAND(F.lit(m).cast("long")) != 0 for u, m in unions.items()}
    columns = [c for i, u in enumerate(unions) for c in (F.sum(inside[u].cast("long")).alias(f"c{i}"), F.sum((inside[u] & F.col("t").isNotNull()).cast("long")).alias(f"r{i}"))]
    wide = recs.where("src = 'S1'").select(F.col("entity_id").alias("s1_id")).join(marked.groupBy("s1_id").agg(*columns), "s1_id", "left").fillna(0)
    n_true = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    rows = F.explode(F.array(*[F.struct(F.lit(u).alias("union_name"), F.col(f"c{i}").alias("n_cand"), F.col(f"r{i}").alias("n_rec")) for i, u in enumerate(unions)]))
    return wide.join(n_true, "s1_id", "left").fillna(0, ["n_true"]).select("s1_id", "n_true", rows.alias("u")).select("s1_id", "n_true", "u.*")


def unions_sql(unions) -> str:
    values = ", ".join(f"('{u}', {m}::bigint)" for u, m in unions.items())
    return f"""un(union_name, um) as (values {values}),
s1 as (select entity_id as s1_id, coalesce(n_true,0) as n_true from rec left join (select s1_id, count(*) as n_true from truth group by 1) q on q.s1_id=entity_id where src='S1'),
uc as (select un.union_name, s1.s1_id, n_true, count(p.cand_id) as n_cand, count(tr.cand_id) as n_rec from un cross join s1 left join pairs p on p.s1_id=s1.s1_id and (p.mask & um)<>0
  left join truth tr on tr.s1_id=p.s1_id and tr.cand_id=p.cand_id group by 1,2,3)"""


VOLUME = "sum(n_cand)::bigint AS total, round(avg(n_cand),6) AS average, floor(quantile_cont(n_cand,0.5))::bigint AS median, floor(quantile_cont(n_cand,0.95))::bigint AS p95, floor(quantile_cont(n_cand,0.99))::bigint AS p99, max(n_cand) AS most"
COVERAGE = """sum(n_rec)::bigint AS recovered, round(sum(n_rec)/sum(n_true),6) AS recall, sum((n_true=0 or n_rec=n_true)::int)::bigint AS full_coverage, sum((n_true>0 and n_rec=0)::int)::bigint AS zero_coverage,
sum((n_true>0 and n_rec>0 and 2*n_rec<n_true)::int)::bigint AS below_half, sum((n_true>0 and 2*n_rec>=n_true and n_rec<n_true)::int)::bigint AS above_half"""


def coverage(counts: DataFrame) -> DataFrame:
    n, t = F.col("n_rec"), F.col("n_true")
    flag = lambda c: F.sum(c.cast("long"))
    return counts.groupBy("union_name").agg(
        F.sum(n).alias("recovered"), F.round(F.sum(n) / F.sum(t), 6).alias("recall"), flag((t == 0) | (n == t)).alias("full_coverage"), flag((t > 0) & (n == 0)).alias("zero_coverage"),
        flag((t > 0) & (n > 0) & (2 * n < t)).alias("below_half"), flag((t > 0) & (2 * n >= t) & (n < t)).alias("above_half"),
    )


def volume(counts: DataFrame) -> DataFrame:
    n = F.col("n_cand")
    q = F.percentile(n, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return counts.groupBy("union_name").agg(F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("average"), q.alias("q"), F.max(n).alias("most")).select(
        "union_name", "total", "average", *[F.floor(F.col("q")[i]).cast("long").alias(a) for i, a in enumerate(("median", "p95", "p99"))], "most")


for _name, _unions in (("union_nested", UNIONS), ("union_v1", UNION_V1), ("union_matcher5", UNION_MATCHER)):
    QUERIES[_name] = lambda spark, sf_dir, u=_unions: coverage(union_counts(spark, sf_dir, u))
    SQL[_name] = D.sql(f"SELECT union_name, {COVERAGE} FROM uc GROUP BY 1", *PAIR_BASE, unions_sql(_unions))
SMALL = {k: UNIONS[k] for k in ("A", "A+B+C+D+E+F+G", "A-G+H+I+J+K+L", "A-L+H1-4@150", "A-L+H1-4@300")}
QUERIES["agg_coverage"] = lambda spark, sf_dir: coverage(union_counts(spark, sf_dir, SMALL))
SQL["agg_coverage"] = D.sql(f"SELECT union_name, {COVERAGE} FROM uc GROUP BY 1", *PAIR_BASE, unions_sql(SMALL))
QUERIES["agg_volume"] = lambda spark, sf_dir: volume(union_counts(spark, sf_dir, SMALL))
SQL["agg_volume"] = D.sql(f"SELECT union_name, {VOLUME} FROM uc GROUP BY 1", *PAIR_BASE, unions_sql(SMALL))


@query("SELECT union_name, (list(n_cand ORDER BY n_cand))[(count(*)*0.5)::int+1] AS median, (list(n_cand ORDER BY n_cand))[floor(count(*)*0.95)::int+1] AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY union_name ORDER BY s1_id) AS rn FROM uc) WHERE rn%20=0 GROUP BY 1".replace("(count(*)*0.5)::int", "floor(count(*)*0.5)::int"), *PAIR_BASE, unions_sql(SMALL))
def agg_volume_nearest(spark, sf_dir):
    """The value at place floor(n * q) of every twentieth entity's number of candidates, found in a histogram of them."""
    every20th = sampling.ranked(entities(spark, sf_dir).select("s1_id"), "s1_id").where("rank % 20 = 0").select("s1_id")
    sizes = union_counts(spark, sf_dir, SMALL).join(every20th, "s1_id", "left_semi").groupBy("union_name", "n_cand").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("union_name")
    upto, total = F.sum("n").over(by.orderBy("n_cand")), F.sum("n").over(by)
    found = [F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col("n_cand"))).alias(a) for a, q in (("median", 0.5), ("p95", 0.95))]
    return sizes.withColumns({"upto": upto, "total": total}).groupBy("union_name").agg(*found)


@query("SELECT union_name, round(avg(case when n_true=0 then 1.0 when n_rec=0 then 0.0 else 1.25*(n_rec/n_true)/(0.25+n_rec/n_true) end),6) AS oracle_f05 FROM uc GROUP BY 1", *PAIR_BASE, unions_sql(SMALL))
def agg_oracle_f05(spark, sf_dir):
    r = F.col("n_rec") / F.col("n_true")
    best = F.when(F.col("n_true") == 0, 1.0).when(F.col("n_rec") == 0, 0.0).otherwise(1.25 * r / (0.25 + r))
    return union_counts(spark, sf_dir, SMALL).groupBy("union_name").agg(F.round(F.avg(best), 6).alias("oracle_f05"))


SPACE = "(SELECT sum(a.n*b.n) FROM (SELECT country, count(*) n FROM rec WHERE src='S1' GROUP BY 1) a JOIN (SELECT country, count(*) n FROM rec WHERE src<>'S1' GROUP BY 1) b USING (country))"


@query(f"SELECT {SPACE}::bigint AS pair_space", name="join_cross_count")
def pair_space(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    a, b = (recs.where(c).groupBy("country").agg(F.count(F.lit(1)).alias(n)) for c, n in (("src = 'S1'", "x"), ("src <> 'S1'", "y")))
    return a.join(b, "country").agg(F.sum(F.col("x") * F.col("y")).alias("pair_space"))


RECOVERED = "rc as (select t.s1_id, t.cand_id, substr(t.cand_id,1,2) as src, r.country, coalesce(p.mask,0) as mask, (coalesce(p.mask,0)<>0)::int as found, count(*) over (partition by t.s1_id) as n_true from truth t join rec r on r.entity_id=t.s1_id left join pairs p on p.s1_id=t.s1_id and p.cand_id=t.cand_id)"


def recovered(spark, sf_dir) -> DataFrame:
    recs = D.noisy_records(spark, sf_dir)
    t = D.truth(recs).join(recs.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id").join(pair_table(spark, sf_dir), ["s1_id", "cand_id"], "left")
    n = D.truth(recs).groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    return t.join(n, "s1_id").select("s1_id", "cand_id", F.substring("cand_id", 1, 2).alias("src"), "country", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"), F.col("mask").isNotNull().cast("long").alias("found"), "n_true")


@query("SELECT src, case when country='en' then 'en' else 'other' end AS region, case n_true when 1 then '1' when 2 then '2' else '3-4' end AS cardinality, count(*) AS links, sum(found)::bigint AS recovered, round(avg(found),6) AS recall FROM rc GROUP BY 1,2,3", *PAIR_BASE, RECOVERED)
def agg_breakdown(spark, sf_dir):
    region = F.when(F.col("country") == "en", "en").otherwise("other")
    return recovered(spark, sf_dir).groupBy("src", region.alias("region"), T.cardinality(F.col("n_true")).alias("cardinality")).agg(F.count(F.lit(1)).alias("links"), F.sum("found").alias("recovered"), F.round(F.avg("found"), 6).alias("recall"))


@query("SELECT src, country, sum(found)::bigint AS recovered, round(sum(found)/(SELECT sum(found) FROM rc),6) AS share FROM rc GROUP BY 1,2", *PAIR_BASE, RECOVERED)
def agg_share_breakdown(spark, sf_dir):
    r = recovered(spark, sf_dir)
    total = r.agg(F.sum("found").alias("n")).scalar()
    return r.groupBy("src", "country").agg(F.sum("found").alias("recovered")).select("src", "country", "recovered", F.round(F.col("recovered") / total, 6).alias("share"))


LEXICAL_MASK = UNIONS["A-G+H+I+J+K+L"]
MISSED = f"missed as (select s1_id, cand_id, country, src, n_true from rc where mask & {LEXICAL_MASK} = 0)"


@query("SELECT t.s1_id, t.cand_id FROM truth t WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.s1_id=t.s1_id AND p.cand_id=t.cand_id AND p.mask & 1 <> 0)", *PAIR_BASE)
def join_left_anti(spark, sf_dir):
    found = C.candidate_pairs(all_keys(spark, sf_dir, ["A"], False), ["A"])
    return D.truth(D.noisy_records(spark, sf_dir)).join(found, ["s1_id", "cand_id"], "left_anti")


def missed_pairs(spark, sf_dir) -> DataFrame:
    """Missed links with both records."""
    recs = D.noisy_records(spark, sf_dir)
    m = recovered(spark, sf_dir).where(F.col("mask").bitwiseAND(F.lit(LEXICAL_MASK).cast("long")) == 0)
    a, b = recs.select(F.col("entity_id").alias("s1_id"), F.struct("*").alias("a")), recs.select(F.col("entity_id").alias("cand_id"), F.struct("*").alias("b"))
    return m.join(a, "s1_id").join(b, "cand_id")


AUDIT = f"""md as (select m.*, a, b, [w for w in a.name_tokens if list_contains(b.name_tokens,w)] as nshared, [w for w in a.addr_words3x if list_contains(b.addr_words3x,w)] as ashared from missed m
 join (select *, {D.words_sql('clean_addr', 'length(w)>=3', D.NOT_DIGITS)} as addr_words3x from rec) a on a.entity_id=m.s1_id join (select *, {D.words_sql('clean_addr', 'length(w)>=3', D.NOT_DIGITS)} as addr_words3x from rec) b on b.entity_id=m.cand_id)"""
TAXONOMY_SQL = r"""case when regexp_matches(a.legal_name||b.legal_name,'[^\x00-\x7F]') then 'multilingual_transliteration' when a.addr='' or b.addr='' or len(string_split(a.addr,' '))<=1 or len(string_split(b.addr,' '))<=1 then 'missing_address_components'
when len(nshared)=0 and (length(a.legal_name)<=5 or length(b.legal_name)<=5) then 'extreme_name_abbreviation' when len(nshared)=0 then 'heavy_spelling_or_ocr_typo' else 'address_variation_different_locality' end"""


def missed_kinds(spark, sf_dir) -> DataFrame:
    """Missed links with the class that their records fall into."""
    a, b = (lambda x: F.col(f"a.{x}")), (lambda x: F.col(f"b.{x}"))
    shared = F.size(F.array_intersect(a("name_tokens"), b("name_tokens")))
    short = lambda x: (x == "") | (F.size(F.split(x, " ")) <= 1)
    kind = (
        F.when(T.is_non_ascii(F.concat(a("legal_name"), b("legal_name"))), "multilingual_transliteration").when(short(a("addr")) | short(b("addr")), "missing_address_components")
        .when((shared == 0) & ((F.length(a("legal_name")) <= 5) | (F.length(b("legal_name")) <= 5)), "extreme_name_abbreviation").when(shared == 0, "heavy_spelling_or_ocr_typo")
        .otherwise("address_variation_different_locality")
    )
    return missed_pairs(spark, sf_dir).select("s1_id", "cand_id", kind.alias("category"))


MOST = 30  # postings of a token that a probe reads


def rarest(recs: DataFrame, tokens, vocab: DataFrame, top: int) -> DataFrame:
    """The records of S1 with their `top` rarest tokens and the weight of each; a token that a record repeats counts as often."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("idf"), "pos")
    spread = recs.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"), "entity_id", "country", F.posexplode(tokens).alias("pos", "token")).join(vocab.select("token", "idf"), "token")
    return spread.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("s1_id", "country", "token", "idf")


def bounded_postings(recs: DataFrame, tokens, most: int = MOST) -> DataFrame:
    """The first `most` candidate records of every token within a country; a record that repeats a token takes several places."""
    held = recs.where("src <> 'S1'").select(F.col("entity_id").alias("cand_id"), "src", "country", F.posexplode(tokens).alias("at", "token"))
    return held.withColumn("r", F.row_number().over(Window.partitionBy("country", "token").orderBy("src", "cand_id", "at"))).where(F.col("r") <= most).select("country", "token", "cand_id")


def weighted(recs: DataFrame, parts) -> DataFrame:
    """s1_id, cand_id, score, rank: summed weights of shared rare tokens; parts are (tokens, vocabulary, top, factor)."""
    met = None
    for tokens, vocab, top, factor in parts:
        part = rarest(recs, tokens, vocab, top).join(bounded_postings(recs, tokens), ["country", "token"]).select("s1_id", "cand_id", (F.col("idf") * factor).alias("w"))
        met = part if met is None else met.unionByName(part)
    scores = met.groupBy("s1_id", "cand_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id")))


def word_scores(recs: DataFrame) -> DataFrame:
    return weighted(recs, [(F.col("name_tokens"), name_vocabulary(recs), 5, 1.0)])


def char_scores(recs: DataFrame) -> DataFrame:
    three, four = T.ngrams(F.col("legal_name")), T.ngrams(F.col("legal_name"), 4)
    return weighted(recs, [(three, gram_vocabulary(recs), 6, 1.0), (four, four_gram_vocabulary(recs), 4, 1.5)])


def _met_sql(tokens: str, vocab: str, column: str, top: int, factor: float) -> str:
    return f"""select f.entity_id as s1_id, h.entity_id as cand_id, f.idf*{factor} as w
 from (select * from (select x.*, idf, row_number() over (partition by entity_id order by round(idf,12) desc, pos) as r from {tokens} x join {vocab} on {column}=token where src='S1') where r<={top}) f
 join (select * from (select *, row_number() over (partition by country, {column} order by src, entity_id, pos) as r from {tokens} where src<>'S1') where r<={MOST}) h on f.country=h.country and f.{column}=h.{column}"""


TOKS2 = "toks2 as (select entity_id, src, country, unnest(name_tokens) as tk, generate_subscripts(name_tokens,1) as pos from rec)"
SCORES = "select *, row_number() over (partition by s1_id order by score desc, cand_id) as rank from (select s1_id, cand_id, round(sum(w),6) as score from ({}) group by 1,2)"
WORD_SCORES = f"wsc as ({SCORES.format(_met_sql('toks2', 'vocab', 'tk', 5, 1.0))})"
CHAR_SCORES = f"csc as ({SCORES.format(_met_sql('grams', 'gvocab', 'gram', 6, 1.0) + ' union all ' + _met_sql('grams4', 'gvocab4', 'gram', 4, 1.5))})"


@query("SELECT * FROM wsc WHERE rank<=20", VOCAB, TOKS2, WORD_SCORES)
def topk_word_tfidf(spark, sf_dir):
    return word_scores(D.noisy_records(spark, sf_dir)).where("rank <= 20")


@query("SELECT * FROM csc WHERE rank<=50", GRAMS, GRAM_VOCAB, GRAMS4, GRAM4_VOCAB, CHAR_SCORES)
def topk_char_tfidf(spark, sf_dir):
    return char_scores(D.noisy_records(spark, sf_dir)).where("rank <= 50")


# Names of the 14 sets of the frontier; A, B and C, relaxed grams (D), word scores and character scores up to a rank.
FRONTIER = {
    "Baseline_A_B_C": ("abc",), "Channel_D_RelaxedCharNgram": ("d",), "Channel_E_Word_TFIDF_Top10": ("word10",), "Channel_E_Word_TFIDF_Top20": ("word20",),
    "Channel_F_Char_TFIDF_Top5": ("char5",), "Channel_F_Char_TFIDF_Top10": ("char10",), "Channel_F_Char_TFIDF_Top20": ("char20",), "Channel_F_Char_TFIDF_Top50": ("char50",),
    "Union_ABC_plus_RelaxedNgram": ("abc", "d"), "Union_ABC_plus_CharTFIDF_Top10": ("abc", "char10"), "Union_ABC_plus_CharTFIDF_Top20": ("abc", "char20"),
    "Union_ABC_plus_CharTFIDF_Top50": ("abc", "char50"), "Full_Frontier_ABC_Ngram_CharTFIDF_Top20": ("abc", "d", "char20"), "Full_Frontier_ABC_Ngram_CharTFIDF_Top50": ("abc", "d", "char50"),
}
FLAGS = {"abc": "mask & 7 <> 0", "d": "relaxed", "word10": "wr <= 10", "word20": "wr <= 20", **{f"char{k}": f"cr <= {k}" for k in (5, 10, 20, 50)}}
_FRONTIER_SQL = f"""rk as (select distinct k.entity_id as s1_id, p.entity_id as cand_id from (select * from dkeys union all select * from dkeys4) k
 join (select *, row_number() over (partition by channel,country,kval order by src, entity_id, pos) as r from
   (select entity_id, src, country, 'D' as channel, gram as kval, pos from grams where src<>'S1' union all select entity_id, src, country, 'D4', gram, pos from grams4 where src<>'S1')) p
 on k.channel=p.channel and k.country=p.country and k.kval=p.kval where k.src='S1' and r<=15),
fr as (select s1_id, cand_id, bit_or(mask) as mask, bool_or(relaxed) as relaxed, min(wr) as wr, min(cr) as cr from (
  select s1_id, cand_id, mask, false as relaxed, null::bigint as wr, null::bigint as cr from pairs union all select s1_id, cand_id, 0, true, null, null from rk
  union all select s1_id, cand_id, 0, false, rank, null from wsc where rank<=20 union all select s1_id, cand_id, 0, false, null, rank from csc where rank<=50) group by 1,2),
ft as (select fr.*, t.cand_id is not null as t from fr left join truth t using (s1_id, cand_id))"""


@query(" UNION ALL ".join(f"SELECT '{u}' AS union_name, count(*) FILTER (WHERE {w}) AS candidates, count(*) FILTER (WHERE t AND ({w})) AS recovered, (SELECT count(*) FROM rec WHERE src='S1') - count(DISTINCT s1_id) FILTER (WHERE {w}) AS without FROM ft"
                          for u, parts in FRONTIER.items() for w in [" or ".join(f"coalesce({FLAGS[x]}, false)" for x in parts)]),
       *PAIR_BASE, GRAMS4, GRAM4_VOCAB, DKEYS4, TOKS2, WORD_SCORES, CHAR_SCORES, _FRONTIER_SQL)
def union_v2(spark, sf_dir):
    """Candidates, recovered links and entities without candidates of 14 sets: one table of pairs with flags, one aggregation."""
    recs = D.noisy_records(spark, sf_dir)
    none = F.lit(None).cast("int")
    held = None
    for channel, n in (("D", 3), ("D4", 4)):
        part = bounded_postings(recs, T.ngrams(F.col("legal_name"), n), 15).select("country", F.lit(channel).alias("channel"), F.col("token").alias("kval"), "cand_id")
        held = part if held is None else held.unionByName(part)
    relaxed = relaxed_keys(recs).where("src = 'S1'").select(F.col("entity_id").alias("s1_id"), "country", "channel", "kval").join(held, ["country", "channel", "kval"]).select("s1_id", "cand_id").distinct()

    def part(df, mask=F.lit(0).cast("long"), d=F.lit(False), wr=none, cr=none):
        return df.select("s1_id", "cand_id", mask.alias("mask"), d.alias("relaxed"), wr.alias("wr"), cr.alias("cr"))

    every = part(pair_table(spark, sf_dir), mask=F.col("mask")).unionByName(part(relaxed, d=F.lit(True)))
    every = every.unionByName(part(topk_word_tfidf(spark, sf_dir), wr=F.col("rank"))).unionByName(part(topk_char_tfidf(spark, sf_dir), cr=F.col("rank")))
    merged = every.groupBy("s1_id", "cand_id").agg(F.bit_or("mask").alias("mask"), F.bool_or("relaxed").alias("relaxed"), F.min("wr").alias("wr"), F.min("cr").alias("cr"))
    marked = merged.join(D.truth(recs).withColumn("t", F.lit(True)), ["s1_id", "cand_id"], "left")
    inside = {u: F.coalesce(F.expr(" or ".join(f"coalesce({FLAGS[x]}, false)" for x in parts)), F.lit(False)) for u, parts in FRONTIER.items()}
    per = marked.groupBy("s1_id").agg(*[c for i, w in enumerate(inside.values()) for c in (F.count_if(w).alias(f"c{i}"), F.count_if(w & F.col("t").isNotNull()).alias(f"r{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(u).alias("union_name"), F.col(f"c{i}").alias("c"), F.col(f"r{i}").alias("r")) for i, u in enumerate(inside)]))
    total = entities(spark, sf_dir).count()
    return per.select(rows.alias("x")).groupBy("x.union_name").agg(F.sum("x.c").alias("candidates"), F.sum("x.r").alias("recovered"), (F.lit(total) - F.count_if(F.col("x.c") > 0)).alias("without"))


# ---- Exact joins ------------------------------------------------------------------------------------------------

MODES = {
    "raw_name": ("name",), "base_name": ("base_name",), "clean_name": ("clean_name",), "legal_name": ("legal_name",), "raw_address": ("addr",), "clean_address": ("clean_addr",),
    "clean_pair": ("clean_name", "clean_addr"), "legal_pair": ("legal_name", "clean_addr"),
}


def exact_pairs(recs: DataFrame, fields, cap: int | None) -> DataFrame:
    value = F.concat_ws("\u0001", *[F.expr(f) for f in fields])
    full = F.lit(True)
    for f in fields:
        full = full & (F.expr(f) != "")
    keyed = recs.where(full).select("entity_id", "src", "country", value.alias("v"))
    held = keyed.where("src <> 'S1'")
    if cap:
        held = held.withColumn("pos", F.row_number().over(Window.partitionBy("country", "v").orderBy("src", "entity_id"))).where(F.col("pos") <= cap)
    return keyed.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"), "country", "v").join(held.select(F.col("entity_id").alias("cand_id"), "country", "v"), ["country", "v"]).select("s1_id", "cand_id")


def exact_sql(fields, cap: int | None) -> str:
    full = " and ".join(f"{f}<>''" for f in fields)
    same = " and ".join(f"a.f{i}=b.f{i}" for i in range(len(fields)))
    cols = ", ".join(f"{f} as f{i}" for i, f in enumerate(fields))
    limit = f" and b.pos<={cap}" if cap else ""
    k = f"(select entity_id, src, country, {cols}, row_number() over (partition by (src='S1'), country, {', '.join(fields)} order by src, entity_id) as pos from rec where {full})"
    return f"select a.entity_id as s1_id, b.entity_id as cand_id from {k} a join {k} b on a.country=b.country and {same} where a.src='S1' and b.src<>'S1'{limit}"


for _mode, _fields in MODES.items():
    QUERIES[f"join_exact_{_mode}"] = lambda spark, sf_dir, f=_fields: exact_pairs(D.noisy_records(spark, sf_dir), f, 50)
    SQL[f"join_exact_{_mode}"] = D.sql(exact_sql(_fields, 50))
BASELINE = {"name": ("clean_name",), "address": ("clean_addr",), "pair": ("clean_name", "clean_addr")}
for _mode, _fields in BASELINE.items():
    QUERIES[f"join_baseline_{_mode}"] = lambda spark, sf_dir, f=_fields: exact_pairs(D.noisy_records(spark, sf_dir), f, None)
    SQL[f"join_baseline_{_mode}"] = D.sql(exact_sql(_fields, None))


def dealt_join(a: DataFrame, b: DataFrame, on: list[str], by: tuple[str, str], block: int = 1024) -> DataFrame:
    """a joined to b. Rows of a key with many pairs are dealt, by hashes of the columns `by`, into blocks of about `block` rows a side, and each two blocks meet by themselves: no task has a whole key."""
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = a.select(*on, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*on, F.lit(0).alias("x"), F.lit(1).alias("y"))).groupBy(*on).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    hot = F.broadcast(both.where(F.col("x") * F.col("y") > block * block // 4).select(*on, blocks("x").alias("_x"), blocks("y").alias("_y")))

    def dealt(side: DataFrame, id_: str, own: str, other: str) -> DataFrame:
        found = side.join(hot, on, "left").withColumn("_own", F.coalesce(F.pmod(F.xxhash64(id_), F.col(own)).cast("int"), F.lit(0)))
        spread = found.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
        return spread.drop("_x", "_y").withColumnsRenamed({"_own": own, "_other": other}).repartition(n, *on, "_x", "_y")

    return dealt(a, by[0], "_x", "_y").join(dealt(b, by[1], "_y", "_x"), [*on, "_x", "_y"]).drop("_x", "_y")


def either_uncapped(recs: DataFrame, block: int = 1024) -> DataFrame:
    """All pairs of one country with equal cleaned names or addresses, each once.

    Pairs with equal names come from the join of names alone, so none has to be looked for among the others. Only pairs of ids that several records share can repeat, and are made distinct.
    """
    n = int(recs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = recs.select("entity_id", "src", "country", "clean_name", "clean_addr").repartition(n, "entity_id").distinct().withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("entity_id")) > 1)

    def met(which_a: str, which_b: str) -> DataFrame:
        a = rows.where(f"src = 'S1' and {which_a}").select(F.col("entity_id").alias("s1_id"), "country", "clean_name", "clean_addr")
        b = rows.where(f"src <> 'S1' and {which_b}").select(F.col("entity_id").alias("cand_id"), "country", "clean_name", "clean_addr")
        named = [x.where("clean_name <> ''").drop("clean_addr") for x in (a, b)]
        placed = [x.where("clean_addr <> ''").withColumnRenamed("clean_name", name) for x, name in ((a, "_n"), (b, "_m"))]
        by_name = dealt_join(*named, ["country", "clean_name"], ("s1_id", "cand_id"), block)
        by_address = dealt_join(*placed, ["country", "clean_addr"], ("s1_id", "cand_id"), block).where(~F.coalesce((F.col("_n") == F.col("_m")) & (F.col("_n") != ""), F.lit(False)))
        return by_name.select("s1_id", "cand_id").unionByName(by_address.select("s1_id", "cand_id"))

    out = met("not many", "not many")
    if rows.where("many").limit(1).count():
        out = out.unionByName(met("many", "true").unionByName(met("not many", "many")).distinct())
    return out


def either(spark, sf_dir, cap) -> DataFrame:
    recs = D.noisy_records(spark, sf_dir)
    if cap is None:
        return either_uncapped(recs)
    return exact_pairs(recs, ("clean_name",), cap).unionByName(exact_pairs(recs, ("clean_addr",), cap)).distinct()


for _name, _cap in (("join_exact_clean_name_or_address", 50), ("join_baseline_name_or_address", None)):
    QUERIES[_name] = lambda spark, sf_dir, c=_cap: either(spark, sf_dir, c)
    SQL[_name] = D.sql(f"{exact_sql(('clean_name',), _cap)} union {exact_sql(('clean_addr',), _cap)}")
QUERIES["set_union"], SQL["set_union"] = QUERIES["join_exact_clean_name_or_address"], SQL["join_exact_clean_name_or_address"]


# ---- Evaluation and decisions -----------------------------------------------------------------------------------

def entities(spark, sf_dir) -> DataFrame:
    return D.noisy_records(spark, sf_dir).where("src = 'S1'").select(F.col("entity_id").alias("s1_id"), "country")


COUNTS = "ec as (select s.entity_id as s1_id, s.country, (select count(*) from truth t where t.s1_id=s.entity_id) as n_true, (select count(*) from pr where pr.s1_id=s.entity_id) as n_pred, (select count(*) from pr join truth t using (s1_id, cand_id) where pr.s1_id=s.entity_id) as tp from rec s where src='S1')"
F05 = "(case when n_true=0 and n_pred=0 then 1.0 when n_true=0 or n_pred=0 or tp=0 then 0.0 else 1.25*(tp/n_pred)*(tp/n_true)/(0.25*tp/n_pred+tp/n_true) end)"
EVALUATION = f"""count(*) AS entities, sum(tp)::bigint AS tp, sum(n_pred-tp)::bigint AS fp, sum(n_true-tp)::bigint AS fn, sum(n_pred)::bigint AS predicted, sum(n_true)::bigint AS true_links, sum((n_true=0)::int)::bigint AS singletons,
sum((n_true=0 and n_pred=0)::int)::bigint AS singletons_correct, sum((n_true=0 and n_pred>0)::int)::bigint AS singletons_merged, sum((n_pred>0)::int)::bigint AS with_predictions, max(n_pred) AS max_predictions, round(avg({F05}),6) AS macro_f05,
round(coalesce(avg(case when n_pred>0 then case when n_true=0 then 0.0 else tp/n_pred end end),0),6) AS macro_precision, round(coalesce(avg(case when n_true>0 then case when n_pred=0 then 0.0 else tp/n_true end end),0),6) AS macro_recall,
sum(({F05}=0)::int)::bigint AS bin_0, sum(({F05}>0 and {F05}<0.5)::int)::bigint AS bin_low, sum(({F05}>=0.5 and {F05}<0.8)::int)::bigint AS bin_mid, sum(({F05}>=0.8 and {F05}<1)::int)::bigint AS bin_high, sum(({F05}=1)::int)::bigint AS bin_1,
round(case when sum(n_pred)>0 then sum(tp)/sum(n_pred) else 0.0 end,6) AS pooled_precision, round(case when sum(n_true)>0 then sum(tp)/sum(n_true) else 0.0 end,6) AS pooled_recall,
round(case when sum(tp)>0 then 1.25*(sum(tp)/sum(n_pred))*(sum(tp)/sum(n_true))/(0.25*sum(tp)/sum(n_pred)+sum(tp)/sum(n_true)) else 0.0 end,6) AS pooled_f05, round(case when sum((n_true=0)::int)>0 then sum((n_true=0 and n_pred=0)::int)/sum((n_true=0)::int) else 0.0 end,6) AS singleton_accuracy"""
PREDICTED = f"pr as ({exact_sql(('legal_name',), 50)})"


def legal_counts(spark, sf_dir) -> DataFrame:
    recs = D.noisy_records(spark, sf_dir)
    s1 = recs.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"), "country")
    return metrics.entity_counts(s1, D.truth(recs), exact_pairs(recs, ("legal_name",), 50)).join(s1, "s1_id")


@query(f"SELECT s1_id, n_true, n_pred, tp, round({F05},9) AS f05 FROM ec", PREDICTED, COUNTS)
def agg_entity_metrics(spark, sf_dir):
    return metrics.entity_metrics(legal_counts(spark, sf_dir)).select("s1_id", "n_true", "n_pred", "tp", F.round("f05", 9).alias("f05"))


@query(f"SELECT {EVALUATION} FROM ec", PREDICTED, COUNTS)
def agg_macro_f05(spark, sf_dir):
    return metrics.evaluate(legal_counts(spark, sf_dir))


SCORE = "sc as (select s1_id, cand_id, round(hits*mask%97/100.0 + 0.03*(hits%2),4) as score from pairs)"


def scored(spark, sf_dir) -> DataFrame:
    """Pairs with a stand-in score that both engines work out alike."""
    return pair_table(spark, sf_dir).select("s1_id", "cand_id", F.round((F.col("hits") * F.col("mask") % 97) / 100.0 + 0.03 * (F.col("hits") % 2), 4).alias("score"))


@query("SELECT s1_id, cand_id, score FROM sc WHERE score>=0.5", *PAIR_BASE, SCORE)
def dec_threshold(spark, sf_dir):
    return decide.by_threshold(scored(spark, sf_dir))


SQL["flt_threshold"], QUERIES["flt_threshold"] = SQL["dec_threshold"], dec_threshold
_MARGIN = "SELECT s1_id, cand_id, score FROM (SELECT *, max(score) OVER (PARTITION BY s1_id) AS top FROM sc) WHERE top>=0.7 AND score>=0.6 AND score>=top-0.1"


@query(_MARGIN, *PAIR_BASE, SCORE)
def dec_null_margin(spark, sf_dir):
    return decide.by_null_margin(scored(spark, sf_dir), 0.6, 0.7, 0.1)


@query("SELECT s1_id, cand_id, score FROM (SELECT *, max(score) OVER (PARTITION BY s1_id) AS top FROM sc) WHERE top>=0.7", *PAIR_BASE, SCORE)
def flt_null_margin(spark, sf_dir):
    return decide.by_null_margin(scored(spark, sf_dir), 0.0, 0.7, 9.0)


@query("SELECT s1_id, max(score) AS top FROM sc GROUP BY 1", *PAIR_BASE, SCORE)
def win_top_score(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("s1_id").agg(F.max("score").alias("top"))


GRID = """grid as (select (row_number() over (order by a.i, b.i, d.i) - 1)::int as cfg, a.v/100 as tau, (a.v+b.v)/100 as tau_null, d.v as delta
 from (select unnest(range(45,100,5)) as v, unnest(range(11)) as i) a, (select unnest([0,5,10,15,20]) as v, unnest(range(5)) as i) b, (select unnest([0.0::double,0.03,0.05,0.10,0.15,0.20,1.0]) as v, unnest(range(7)) as i) d where a.v+b.v<=100),
nt as (select s1_id, count(*) as n_true from truth group by 1),
tops as (select sc.*, max(score) over (partition by sc.s1_id) as top, t.cand_id is not null as hit from sc left join truth t on t.s1_id=sc.s1_id and t.cand_id=sc.cand_id),
tried as (select cfg, s1_id, count(*) as n_pred, sum(hit::int) as tp from tops join grid on top>=tau_null and score>=tau and score>=top-delta group by 1,2),
per as (select cfg, sum(case when coalesce(n_true,0)=0 or tp=0 then 0.0 else 1.25*(tp/n_pred)*(tp/n_true)/(0.25*tp/n_pred+tp/n_true) end) as f, sum((n_true is null)::int) as merged, sum(tp) as tp, sum(n_pred) as n_pred from tried left join nt using (s1_id) group by 1)"""


@query("SELECT cfg, tau, tau_null, delta, round((coalesce(f,0)+(SELECT count(*) FROM rec WHERE src='S1' AND entity_id NOT IN (SELECT s1_id FROM nt))-coalesce(merged,0))/(SELECT count(*) FROM rec WHERE src='S1'),6) AS macro_f05, coalesce(tp,0)::bigint AS tp, coalesce(n_pred,0)::bigint AS n_pred FROM grid LEFT JOIN per USING (cfg)", *PAIR_BASE, SCORE, GRID)
def cal_grid(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    return decide.calibrate(scored(spark, sf_dir), recs.where("src = 'S1'").select(F.col("entity_id").alias("s1_id")), D.truth(recs))


@query("SELECT p.s1_id, p.cand_id, (t.cand_id is not null)::double AS label FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, pos ORDER BY hits DESC, cand_id) AS rk, sum(pos::int) OVER (PARTITION BY s1_id) AS np FROM (SELECT p.*, t.cand_id is not null AS pos FROM pairs p LEFT JOIN truth t USING (s1_id, cand_id))) p LEFT JOIN truth t USING (s1_id, cand_id) WHERE pos OR rk <= CASE WHEN NOT EXISTS (SELECT 1 FROM truth q WHERE q.s1_id=p.s1_id) THEN 8 ELSE greatest(3, 5*np) END", *PAIR_BASE)
def ml_trainset(spark, sf_dir):
    return matcher.training_set(pair_table(spark, sf_dir), D.truth(D.noisy_records(spark, sf_dir))).select("s1_id", "cand_id", "label")


QUERIES["win_hard_negatives"] = lambda spark, sf_dir: ml_trainset(spark, sf_dir).where("label = 0").select("s1_id", "cand_id")
SQL["win_hard_negatives"] = SQL["ml_trainset"].replace("SELECT p.s1_id, p.cand_id, (t.cand_id is not null)::double AS label", "SELECT p.s1_id, p.cand_id").replace("WHERE pos OR rk", "WHERE NOT pos AND rk")


@query("SELECT s1_id, cand_id, label FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, label ORDER BY md5('42|'||s1_id||'|'||cand_id)) AS rk, sum(label) OVER (PARTITION BY s1_id) AS np FROM (SELECT p.s1_id, p.cand_id, (t.cand_id is not null)::double AS label FROM pairs p LEFT JOIN truth t USING (s1_id, cand_id))) WHERE label=1 OR rk<=greatest(2,4*np)", *PAIR_BASE)
def smp_random_neg(spark, sf_dir):
    return matcher.random_negatives(pair_table(spark, sf_dir), D.truth(D.noisy_records(spark, sf_dir))).select("s1_id", "cand_id", "label")


def lexical_pairs(spark, sf_dir) -> DataFrame:
    """Candidates of the channels A to L."""
    return pair_table(spark, sf_dir).where(F.col("mask").bitwiseAND(F.lit(LEXICAL_MASK).cast("long")) != 0)


def featured(spark, sf_dir, pairs: DataFrame, legacy: bool = False) -> DataFrame:
    """Pairs with their features. A pair travels with one text of each side."""
    texts = D.stored(spark, sf_dir, f"texts-{legacy}", lambda: (pair_texts.with_legacy_text if legacy else pair_texts.with_text)(D.noisy_records(spark, sf_dir)).select("entity_id", "text"))
    s1 = F.startswith("entity_id", F.lit("S1"))
    a, b = (texts.where(c).withColumnRenamed("entity_id", key) for c, key in ((s1, "s1_id"), (~s1, "cand_id")))
    return pair_texts.featured(pairs, a, b, legacy)


@query("SELECT coalesce(sum((full_cov and kept<n_true)::int),0)::bigint AS damaged, sum((n_true=0 and n_pred>0)::int)::bigint AS merged FROM (SELECT s1_id, n_true, coalesce(n_pred,0) AS n_pred, coalesce(kept,0) AS kept, n_true>0 AND coalesce(n_rec,0)=n_true AS full_cov FROM (SELECT entity_id AS s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id=entity_id) AS n_true FROM rec WHERE src='S1') e LEFT JOIN (SELECT sc.s1_id, count(*) FILTER (WHERE score>=0.5) AS n_pred, count(t.cand_id) FILTER (WHERE score>=0.5) AS kept, count(t.cand_id) AS n_rec FROM sc LEFT JOIN truth t USING (s1_id, cand_id) GROUP BY 1) USING (s1_id))", *PAIR_BASE, SCORE)
def agg_damaged(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    truth = D.truth(recs)
    s = scored(spark, sf_dir).join(truth.withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "left")
    kept = F.col("score") >= 0.5
    per = s.groupBy("s1_id").agg(F.count_if(kept).alias("n_pred"), F.count_if(kept & F.col("t").isNotNull()).alias("kept"), F.count("t").alias("n_rec"))
    e = recs.where("src = 'S1'").select(F.col("entity_id").alias("s1_id")).join(truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true")), "s1_id", "left").join(per, "s1_id", "left").fillna(0)
    full = (F.col("n_true") > 0) & (F.col("n_rec") == F.col("n_true"))
    return e.agg(F.count_if(full & (F.col("kept") < F.col("n_true"))).alias("damaged"), F.count_if((F.col("n_true") == 0) & (F.col("n_pred") > 0)).alias("merged"))


# ---- Frequent values, sets, pools --------------------------------------------------------------------------------

_STEPS = (2, 5, 10, 50, 100, 500, 1000)
_CROSSED = "+".join(f"(n>={s})::int" for s in _STEPS)


@query(f"SELECT p_name, n, {_CROSSED} AS crossed FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_name LIMIT 10")
def agg_frequent_samples(spark, sf_dir):
    crossed = sum((F.col("n") >= s).cast("int") for s in _STEPS)
    return D.table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).select("p_name", "n", crossed.alias("crossed")).orderBy(F.desc("n"), "p_name").limit(10)


QUERIES["srt_most_common"] = lambda spark, sf_dir: agg_frequent_samples(spark, sf_dir).select("p_name", "n")
SQL["srt_most_common"] = "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10"
TRUTH_KINDS = "tk as (select entity_id as s1_id, country, (select count(*) from truth t where t.s1_id=entity_id and t.cand_id like 'S2%') as s2, (select count(*) from truth t where t.s1_id=entity_id and t.cand_id like 'S3%') as s3 from rec where src='S1')"


@query("SELECT matches, n, sum(n) OVER (ORDER BY matches)::bigint AS running FROM (SELECT s2+s3 AS matches, count(*) AS n FROM tk GROUP BY 1)", TRUTH_KINDS)
def win_cumulative(spark, sf_dir):
    n = D.truth(D.noisy_records(spark, sf_dir)).groupBy("s1_id").agg(F.count(F.lit(1)).alias("matches"))
    per = entities(spark, sf_dir).join(n, "s1_id", "left").fillna(0, ["matches"]).groupBy("matches").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("running", F.sum("n").over(Window.orderBy("matches").rowsBetween(Window.unboundedPreceding, 0)))


@query("SELECT country, sum((src='S1')::int)::bigint AS s1, sum((src<>'S1')::int)::bigint AS pool, round(sum((src<>'S1')::int)/sum((src='S1')::int),6) AS ratio FROM rec GROUP BY 1")
def agg_country_pool(spark, sf_dir):
    one = F.count_if(F.col("src") == "S1")
    return D.noisy_records(spark, sf_dir).groupBy("country").agg(one.alias("s1"), F.count_if(F.col("src") != "S1").alias("pool"), F.round(F.count_if(F.col("src") != "S1") / one, 6).alias("ratio"))


# ---- Sets, samples, rows ----------------------------------------------------------------------------------------

def names_of(recs, src) -> DataFrame:
    return recs.where((F.col("src") == src) & (F.col("clean_name") != "")).select("clean_name")


@query("SELECT clean_name FROM rec WHERE src='S1' AND clean_name<>'' INTERSECT SELECT clean_name FROM rec WHERE src='S3'")
def set_intersect(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    return names_of(recs, "S1").intersect(names_of(recs, "S3"))


@query("SELECT clean_name FROM rec WHERE src='S1' AND clean_name<>'' EXCEPT SELECT clean_name FROM rec WHERE src='S2'")
def set_except(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    return names_of(recs, "S1").subtract(names_of(recs, "S2"))


SPLIT = "sp as (select s1_id, country, n_true, case when row_number() over (partition by country, card order by md5('42|'||s1_id), s1_id) <= floor(count(*) over (partition by country, card)*0.2) then 'val' else 'train' end as fold from (select *, case n_true when 0 then 'singleton' when 1 then '1' when 2 then '2' else '3-4' end as card from (select entity_id as s1_id, country, (select count(*) from truth t where t.s1_id=entity_id) as n_true from rec where src='S1')))"


@query("SELECT s1_id, fold FROM sp", SPLIT)
def smp_stratified(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    e = recs.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"), "country").join(D.truth(recs).groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")), "s1_id", "left").fillna(0, ["n"])
    return sampling.stratified_split(e.withColumn("card", T.cardinality(F.col("n"))).drop("n"), ["country", "card"]).select("s1_id", "fold")


@query("SELECT (SELECT count(*) FROM (SELECT s1_id FROM sp WHERE fold='val' INTERSECT SELECT s1_id FROM sp WHERE fold='train'))=0 AS disjoint, (SELECT count(*) FROM sp)=(SELECT count(*) FROM rec WHERE src='S1') AS complete", SPLIT)
def set_disjoint(spark, sf_dir):
    s = smp_stratified(spark, sf_dir)
    per = s.groupBy("s1_id").agg(F.count_distinct("fold").alias("folds")).agg((F.max("folds") == 1).alias("disjoint"), F.count(F.lit(1)).alias("n"))
    n = entities(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).scalar()
    return per.select("disjoint", (F.col("n") == n).alias("complete"))


@query("SELECT entity_id FROM rec WHERE src='S1' ORDER BY md5('7|'||entity_id), entity_id LIMIT 50")
def smp_uniform(spark, sf_dir):
    return sampling.bottom_k(D.noisy_records(spark, sf_dir).where("src = 'S1'").select("entity_id"), 50, "7", "entity_id")


@query("SELECT s1_id, cand_id FROM missed ORDER BY md5('42|'||s1_id||'|'||cand_id), s1_id, cand_id LIMIT 100", *PAIR_BASE, RECOVERED, MISSED)
def smp_reservoir(spark, sf_dir):
    m = recovered(spark, sf_dir).where(F.col("mask").bitwiseAND(F.lit(LEXICAL_MASK).cast("long")) == 0).select("s1_id", "cand_id")
    return sampling.bottom_k(m, 100, "42", "s1_id", "cand_id")




@query("SELECT entity_id, name FROM rec ORDER BY entity_id LIMIT 100")
def src_limit(spark, sf_dir):
    return D.noisy_records(spark, sf_dir).select("entity_id", "name").orderBy("entity_id").limit(100)


@query(r"SELECT entity_id, array_to_string(regexp_extract_all(addr,'[0-9]+'),'|') AS found FROM rec ORDER BY entity_id LIMIT 100")
def src_sample_rows(spark, sf_dir):
    return D.noisy_records(spark, sf_dir).orderBy("entity_id").limit(100).select("entity_id", F.array_join(F.regexp_extract_all("addr", F.lit(r"(\d+)"), 1), "|").alias("found"))


@query("SELECT entity_id, name FROM rec WHERE src='S1' AND entity_id IN (SELECT s1_id FROM truth)")
def flt_ids(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    return recs.where("src = 'S1'").join(D.truth(recs).select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", "name")


SQL["join_left_semi"], QUERIES["join_left_semi"] = SQL["flt_ids"], flt_ids


@query("SELECT s1_id, cand_id, r.name AS cand_name FROM truth LEFT JOIN rec r ON r.entity_id=cand_id")
def join_left_outer(spark, sf_dir):
    recs = D.noisy_records(spark, sf_dir)
    return D.truth(recs).join(recs.select(F.col("entity_id").alias("cand_id"), F.col("name").alias("cand_name")), "cand_id", "left").select("s1_id", "cand_id", "cand_name")


@query("SELECT s1_id, cand_id FROM truth JOIN pairs USING (s1_id, cand_id)", *PAIR_BASE)
def join_truth(spark, sf_dir):
    return pair_table(spark, sf_dir).join(D.truth(D.noisy_records(spark, sf_dir)), ["s1_id", "cand_id"], "left_semi").select("s1_id", "cand_id")


@query("SELECT entity_id, clean_name, legal_name, clean_addr, array_to_string(name_words,'|') AS name_words, array_to_string(name_tokens,'|') AS name_tokens, array_to_string(addr_words,'|') AS addr_words, array_to_string(digits,'|') AS digits, array_to_string(postals,'|') AS postals FROM rec")
def prj_entity(spark, sf_dir):
    return D.noisy_records(spark, sf_dir).select("entity_id", "clean_name", "legal_name", "clean_addr", *[F.array_join(c, "|").alias(c) for c in ("name_words", "name_tokens", "addr_words", "digits", "postals")])


@query("SELECT category, s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY s1_id, cand_id) AS r FROM (SELECT src AS category, s1_id, cand_id FROM rc WHERE found=0)) WHERE r<=3", *PAIR_BASE, RECOVERED)
def win_examples3(spark, sf_dir):
    m = recovered(spark, sf_dir).where("found = 0").select(F.col("src").alias("category"), "s1_id", "cand_id")
    return m.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("s1_id", "cand_id"))).where("r <= 3").drop("r")


for _alias, _of in {"win_posting_prefix": "idx_postings", "win_top_idf": "blk_b", "join_inner_truth": "join_truth"}.items():
    QUERIES[_alias], SQL[_alias] = QUERIES[_of], SQL[_of]


# ---- Vectors ----------------------------------------------------------------------------------------------------

KNN = "SELECT query_id, item_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]),6) AS similarity FROM embeddings a JOIN embeddings b ON a.label=b.label WHERE a.vec_id%100=0)) WHERE rank<=10"


def knn_dense(spark, sf_dir) -> DataFrame:
    e = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return dense.nearest(e.where("id % 100 = 0"), e, 10, "label")


QUERIES["knn_dense"], SQL["knn_dense"] = knn_dense, KNN
QUERIES["bench_vector"] = lambda spark, sf_dir: knn_dense(spark, sf_dir).select("query_id", "item_id", "rank")
SQL["bench_vector"] = KNN.replace("SELECT query_id, item_id, similarity, rank FROM", "SELECT query_id, item_id, rank FROM", 1)


@query("SELECT coalesce(p.s1_id,d.s1_id) AS s1_id, coalesce(p.cand_id,d.cand_id) AS cand_id, coalesce(mask,0) | (case when d.s1_id is null then 0 else 4611686018427387904 end) AS mask, coalesce(hits,0) AS hits FROM pairs p FULL JOIN (SELECT s1_id, cand_id FROM truth WHERE ascii(right(cand_id,1))%2=0) d ON p.s1_id=d.s1_id AND p.cand_id=d.cand_id", *PAIR_BASE)
def union_dense(spark, sf_dir):
    found = D.truth(D.noisy_records(spark, sf_dir)).where(F.ascii(F.right("cand_id", F.lit(1))) % 2 == 0)
    return dense.union_dense(pair_table(spark, sf_dir), found)


# ---- Validation -------------------------------------------------------------------------------------------------

LINES = "ln as (select entity_id||case when truth_key%41=0 then '' else chr(9)||coalesce((select string_agg(cand_id, ',' order by cand_id) from truth t where t.s1_id=entity_id),'')||case when truth_key%17=0 then ',S1-x' when truth_key%19=0 then ',S9-x' when truth_key%23=0 then ',S2-x,S2-x' else '' end end as value from rec where src='S1' and truth_key%13<>0 union all select entity_id||chr(9) from rec where src='S1' and truth_key%29=1)"


def result_lines(spark, sf_dir) -> DataFrame:
    """A result file with one fault of each kind here and there."""
    recs = D.noisy_records(spark, sf_dir)
    s1 = recs.where("src = 'S1'")
    lists = tsv.id_lists(s1.select(F.col("entity_id").alias("s1_id")), D.truth(recs)).join(s1.select(F.col("entity_id").alias("s1_id"), "truth_key"), "s1_id")
    k = F.col("truth_key")
    extra = F.when(k % 17 == 0, ",S1-x").when(k % 19 == 0, ",S9-x").when(k % 23 == 0, ",S2-x,S2-x").otherwise("")
    body = lists.where(k % 13 != 0).select(F.concat("s1_id", F.when(k % 41 == 0, "").otherwise(F.concat(F.lit("\t"), "ids", extra))).alias("value"))
    return body.unionByName(lists.where(k % 29 == 1).select(F.concat("s1_id", F.lit("\t")).alias("value")))


PARSED = "pl as (select trim(split_part(value,chr(9),1)) as id, [trim(x) for x in string_split(split_part(value,chr(9),2),',') if trim(x)<>''] as ids, not contains(value,chr(9)) as malformed from ln), gd as (select * from pl where not malformed)"
RULES = {
    "malformed": "(SELECT count(*) FROM pl WHERE malformed)", "duplicate_row": "(SELECT count(*) FROM (SELECT id FROM gd GROUP BY 1 HAVING count(*)>1))",
    "intra_duplicate": "(SELECT count(*) FROM gd WHERE len(ids)<>len(list_distinct(ids)))", "self_match": "(SELECT count(*) FROM gd WHERE len([x for x in ids if starts_with(x,'S1-')])>0)",
    "bad_prefix": "(SELECT count(*) FROM gd WHERE len([x for x in ids if not regexp_matches(x,'^S[123]-')])>0)", "missing": "(SELECT count(*) FROM rec WHERE src='S1' AND entity_id NOT IN (SELECT id FROM gd))",
    "extra": "(SELECT count(DISTINCT id) FROM gd WHERE id NOT IN (SELECT entity_id FROM rec WHERE src='S1'))", "unknown": "(SELECT count(*) FROM (SELECT DISTINCT unnest(ids) AS x FROM gd) WHERE x NOT IN (SELECT entity_id FROM rec WHERE src<>'S1'))",
}
VAL_NAMES = {"malformed": "val_malformed", "duplicate_row": "val_dup_rows", "intra_duplicate": "val_intra_dup", "self_match": "val_self_match", "bad_prefix": "val_prefix", "missing": "val_missing", "extra": "val_extra", "unknown": "val_unknown"}


def val_all(spark, sf_dir) -> DataFrame:
    recs = D.noisy_records(spark, sf_dir)
    return validate.issues(validate.parse_lines(result_lines(spark, sf_dir)), recs.where("src = 'S1'").select(F.col("entity_id").alias("id")), recs.where("src <> 'S1'").select(F.col("entity_id").alias("id")))


for _issue, _name in VAL_NAMES.items():
    QUERIES[_name] = lambda spark, sf_dir, i=_issue: val_all(spark, sf_dir).where(F.col("issue") == i)
    SQL[_name] = D.sql(f"SELECT '{_issue}' AS issue, {RULES[_issue]} AS n", LINES, PARSED)


@query("SELECT s1_id, cand_id FROM truth EXCEPT SELECT s1_id, cand_id FROM pairs WHERE mask & 4 <> 0", *PAIR_BASE)
def val_subset_warn(spark, sf_dir):
    c = C.candidate_pairs(all_keys(spark, sf_dir, ["C"], False), ["C"])
    return validate.outside_candidates(D.truth(D.noisy_records(spark, sf_dir)), c)


SQL["set_subset"], QUERIES["set_subset"] = SQL["val_subset_warn"], val_subset_warn

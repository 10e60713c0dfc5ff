"""Reports over the noisy records: profiles, lengths, duplicates, evaluation by mode, and what retrieval misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import metrics, sampling
from ..operators.channels import at, joined, key, keys
from ..session import scratch
from ..sources import tsv
from . import linkage as L
from . import testdata as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str, *ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = D.sql(sql, *ctes)
        return f

    return register


# ---- Profiles ---------------------------------------------------------------------------------------------------

@query("SELECT *, round(n/sum(n) OVER (PARTITION BY src),6) AS share FROM (SELECT src, country, count(*) AS n, count(DISTINCT entity_id) AS ids, sum((name='')::int)::bigint AS no_name, sum((addr='')::int)::bigint AS no_address, sum((name='' and addr='')::int)::bigint AS neither FROM rec GROUP BY 1,2)")
def agg_profile(spark, sf_dir):
    """Rows, ids, missing fields and share of each country in each source."""
    n, a = F.col("name") == "", F.col("addr") == ""
    counted = D.noisy_records(spark, sf_dir).groupBy("src", "country").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("ids"), F.count_if(n).alias("no_name"), F.count_if(a).alias("no_address"), F.count_if(n & a).alias("neither"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("src")), 6))


_LENGTHS_SQL = " union all ".join(f"select src, '{k}' as field, {v} as v from rec" for k, v in {
    "name": "length(name)", "address": "length(addr)", "name_tokens": "len([w for w in string_split(clean_name,' ') if w<>''])", "address_tokens": "len([w for w in string_split(clean_addr,' ') if w<>''])"}.items())
_SHARES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


@query("SELECT src, field, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, " + ", ".join(f"quantile_disc(v,{q}) AS {k}" for k, q in _SHARES.items()) + f" FROM ({_LENGTHS_SQL}) GROUP BY 1,2")
def agg_len_stats(spark, sf_dir):
    """Six percentiles and moments of the lengths of names and addresses, in characters and in words."""
    lengths = {"name": F.length("name"), "address": F.length("addr"), "name_tokens": F.size(T.words(F.col("clean_name"))), "address_tokens": F.size(T.words(F.col("clean_addr")))}
    fields = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("v")) for k, v in lengths.items()])).alias("x")
    disc = [F.expr(f"cast(percentile_disc({q}) within group (order by v) as long)").alias(k) for k, q in _SHARES.items()]
    return D.noisy_records(spark, sf_dir).select("src", fields).select("src", "x.field", "x.v").groupBy("src", "field").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), *disc)


_POSTAL = {"en": 5, "es": 6, "fr": 5}


@query("""SELECT src, sum((addr<>'')::int)::bigint AS filled, round(sum((addr<>'' and regexp_matches(addr,'[0-9]'))::int)/sum((addr<>'')::int),6) AS digit_rate, round(sum(contains(addr,',')::int)/sum((addr<>'')::int),6) AS comma_rate,
sum((len(postals)>0)::int)::bigint AS with_postal, """ + ", ".join(f"round(sum((country='{c}' and regexp_matches(addr,'(^|[^0-9])[0-9]{{{n}}}($|[^0-9])'))::int)/sum((country='{c}')::int),6) AS {c}_postal_rate" for c, n in _POSTAL.items()) + " FROM rec GROUP BY 1")
def agg_addr_signals(spark, sf_dir):
    """Digits and commas as parts of the addresses that aren't empty, postal numbers as parts of the rows of their country."""
    a, filled = F.col("addr"), F.count_if(F.col("addr") != "")
    country = [F.round(F.count_if((F.col("country") == c) & a.rlike(rf"(?<!\d)\d{{{n}}}(?!\d)")) / F.count_if(F.col("country") == c), 6).alias(f"{c}_postal_rate") for c, n in _POSTAL.items()]
    return D.noisy_records(spark, sf_dir).groupBy("src").agg(
        filled.alias("filled"), F.round(F.count_if(a.rlike(r"\p{Nd}")) / filled, 6).alias("digit_rate"), F.round(F.count_if(F.contains(a, F.lit(","))) / filled, 6).alias("comma_rate"),
        F.count_if(F.size("postals") > 0).alias("with_postal"), *country)


_BASE_ADDR = r"trim(regexp_replace(lower(addr),'\s+',' ','g'))"
_DUP_SQL = " union all ".join(f"select src, '{k}' as field, {v} as v from rec" for k, v in {"name_base": "base_name", "name_clean": "clean_name", "address_base": _BASE_ADDR, "name_address": f"base_name||'|'||{_BASE_ADDR}"}.items())


@query(f"SELECT src, field, count(*) AS unique_values, sum(case when n>1 then n else 0 end)::bigint AS in_groups, max(n) AS largest FROM (SELECT src, field, v, count(*) AS n FROM ({_DUP_SQL}) WHERE v<>'' AND v<>'|' GROUP BY 1,2,3) GROUP BY 1,2")
def agg_dup_rate(spark, sf_dir):
    """How often names, addresses and both together repeat within a source."""
    base = T.base(F.col("addr"))
    values = {"name_base": F.col("base_name"), "name_clean": F.col("clean_name"), "address_base": base, "name_address": F.concat("base_name", F.lit("|"), base)}
    each = D.noisy_records(spark, sf_dir).select("src", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("v")) for k, v in values.items()])).alias("x")).where("x.v not in ('', '|')")
    groups = each.groupBy("src", "x.field", "x.v").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("src", "field").agg(F.count(F.lit(1)).alias("unique_values"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("in_groups"), F.max("n").alias("largest"))


_KIND = r"case when c ~ '[\x00-\x7F]' then 'ascii' when c between 'À' and 'ɏ' then 'latin_accented' else 'other' end"


@query(rf"""SELECT src, field, count(*) FILTER (WHERE regexp_matches(v,'[^\x00-\x7F]')) AS not_ascii, sum(len(string_split(v,'')))::bigint AS chars,
sum(len([c for c in string_split(v,'') if {_KIND}='latin_accented']))::bigint AS latin_accented, sum(len([c for c in string_split(v,'') if {_KIND}='other']))::bigint AS other
FROM (select src, 'name' as field, name as v from rec union all select src, 'address', addr from rec union all select src, 'either', name||addr from rec) WHERE v<>'' GROUP BY 1,2""")
def agg_nonascii(spark, sf_dir):
    """Rows whose names, addresses or either go beyond ASCII, and the kinds of their characters."""
    values = {"name": F.col("name"), "address": F.col("addr"), "either": F.concat("name", "addr")}
    each = D.noisy_records(spark, sf_dir).select("src", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("v")) for k, v in values.items()])).alias("x")).select("src", "x.field", "x.v").where("v <> ''")
    kinds = F.transform(F.split("v", ""), T.char_class)
    n = lambda kind: F.sum(F.size(F.filter(kinds, lambda k: k == kind)).cast("long")).alias(kind)
    return each.groupBy("src", "field").agg(F.count_if(T.is_non_ascii(F.col("v"))).alias("not_ascii"), F.sum(F.length("v").cast("long")).alias("chars"), n("latin_accented"), n("other"))


@query("""SELECT composition, matches, count(*) AS entities, sum(s2)::bigint AS s2_links, sum(s3)::bigint AS s3_links, sum(same)::bigint AS same_country FROM (SELECT case when s2+s3=0 then 'singleton' when s3=0 then 'S2 only' when s2=0 then 'S3 only' else 'both' end AS composition, s2+s3 AS matches, s2, s3,
 (select count(*) from truth t join rec r on r.entity_id=t.cand_id where t.s1_id=tk.s1_id and r.country=tk.country) AS same FROM tk) GROUP BY 1,2""", L.TRUTH_KINDS)
def agg_truth_profile(spark, sf_dir):
    """Entities by where their links lead and how many they have; links within a country."""
    recs = D.noisy_records(spark, sf_dir)
    countries = [recs.select(F.col("entity_id").alias(i), F.col("country").alias(c)) for i, c in (("s1_id", "a"), ("cand_id", "b"))]
    per = D.truth(recs).join(countries[0], "s1_id").join(countries[1], "cand_id", "left").groupBy("s1_id").agg(
        F.count_if(F.startswith("cand_id", F.lit("S2"))).alias("s2"), F.count_if(F.startswith("cand_id", F.lit("S3"))).alias("s3"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    e = L.entities(spark, sf_dir).select("s1_id").join(per, "s1_id", "left").fillna(0)
    kind = F.when(F.col("s2") + F.col("s3") == 0, "singleton").when(F.col("s3") == 0, "S2 only").when(F.col("s2") == 0, "S3 only").otherwise("both")
    return e.groupBy(kind.alias("composition"), (F.col("s2") + F.col("s3")).alias("matches")).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("s2").alias("s2_links"), F.sum("s3").alias("s3_links"), F.sum("same").alias("same_country"))


# ---- Evaluation -------------------------------------------------------------------------------------------------

EXACT = {**L.MODES, "clean_name_or_address": None}
_EXACT_SQL = "pr as (" + " union all ".join(f"select '{k}' as mode, * from ({L.exact_sql(v, 50)})" if v else f"select '{k}', * from ({L.exact_sql(('clean_name',), 50)} union {L.exact_sql(('clean_addr',), 50)})" for k, v in EXACT.items()) + ")"
_MODES_SQL = "(select unnest(" + str(list(EXACT)) + ") as mode)"


@query(f"SELECT mode, {L.EVALUATION} FROM ec GROUP BY 1", _EXACT_SQL, f"""np as (select mode, s1_id, count(*) as n_pred, count(t.cand_id) as tp from pr left join truth t using (s1_id, cand_id) group by 1,2), tn as (select s1_id, count(*) as n_true from truth group by 1),
ec as (select m.mode, e.entity_id as s1_id, coalesce(n_true,0) as n_true, coalesce(n_pred,0) as n_pred, coalesce(tp,0) as tp from rec e, {_MODES_SQL} m left join np on np.mode=m.mode and np.s1_id=e.entity_id left join tn on tn.s1_id=e.entity_id where src='S1')""")
def agg_exact_eval(spark, sf_dir):
    """The whole evaluation of each of nine exact modes: their pairs stacked, one aggregation."""
    recs = D.noisy_records(spark, sf_dir)
    truth, found = D.truth(recs), None
    for mode, fields in EXACT.items():
        pairs = (L.exact_pairs(recs, fields, 50) if fields else L.either(spark, sf_dir, 50)).withColumn("mode", F.lit(mode))
        found = pairs if found is None else found.unionByName(pairs)
    per = found.join(truth.withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "left").groupBy("mode", "s1_id").agg(F.count(F.lit(1)).alias("n_pred"), F.count("t").alias("tp"))
    every = L.entities(spark, sf_dir).select("s1_id", F.explode(F.array(*map(F.lit, EXACT))).alias("mode"))
    counts = every.join(per, ["mode", "s1_id"], "left").join(truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true")), "s1_id", "left").fillna(0, ["n_pred", "tp", "n_true"])
    return metrics.evaluate(counts, ["mode"])


@query(f"""SELECT union_name, sum(n_cand-n_rec)::bigint AS false_pairs, round(sum(n_rec)/sum(n_cand),6) AS purity, round(1-sum(n_cand)/{L.SPACE},6) AS reduction, sum(case when n_true=0 then n_cand else 0 end)::bigint AS singleton_burden,
(sum(n_rec)-(select sum(n_rec) from uc where union_name='A-G+H+I+J+K+L'))::bigint AS marginal_links FROM uc GROUP BY 1""", *L.PAIR_BASE, L.unions_sql(L.SMALL))
def agg_purity(spark, sf_dir):
    """Pairs that are no links, what part of the pair space is spared, pairs of entities without links, and links gained over A to L."""
    space = L.pair_space(spark, sf_dir).scalar()
    counted = L.union_counts(spark, sf_dir, L.SMALL).groupBy("union_name").agg(
        F.sum("n_cand").alias("n"), F.sum("n_rec").alias("r"), F.sum(F.when(F.col("n_true") == 0, F.col("n_cand")).otherwise(0)).alias("singleton_burden"))
    base = F.max(F.when(F.col("union_name") == "A-G+H+I+J+K+L", F.col("r"))).over(Window.partitionBy(F.lit(0)))  # a row a union
    return counted.select("union_name", (F.col("n") - F.col("r")).alias("false_pairs"), F.round(F.col("r") / F.col("n"), 6).alias("purity"), F.round(1 - F.col("n") / space, 6).alias("reduction"), "singleton_burden", (F.col("r") - base).alias("marginal_links"))


# ---- Misses -----------------------------------------------------------------------------------------------------

MISS_UNIONS = {k: L.UNIONS[k] for k in ("Channel_L_Standalone", "A-G+H+I+J+K+L", "A-L+H1-4@150", "A-L+H1-4@300")}
FLAGS = {
    "no_shared_name_tokens": "shared_names = 0", "no_shared_address_tokens": "shared_words = 0", "name_and_address_tokens_disjoint": "shared_names = 0 and shared_words = 0", "name_scripts_disjoint": "scripts_disjoint",
    "s1_name_missing": "a_name = ''", "target_name_missing": "b_name = ''", "both_names_missing": "a_name = '' and b_name = ''", "both_addresses_missing": "a_addr = '' and b_addr = ''", "s1_address_missing": "a_addr = ''",
    "target_address_missing": "b_addr = ''", "both_have_numbers_but_none_shared": "a_numbers > 0 and b_numbers > 0 and shared_numbers = 0",
}
MEANS = ("name_token_jaccard", "name_char_jaccard", "address_token_jaccard")
_WORDS = D.words_sql("clean_addr", "length(w)>=3", D.NOT_DIGITS)
_J = "(case when len(list_distinct(list_concat({0},{1})))>0 then len(list_intersect({0},{1}))/len(list_distinct(list_concat({0},{1}))) else 0.0 end)"
_CHARS = r"list_distinct([c for c in string_split({}.legal_name,'') if regexp_matches(c,'[\pL\pN]')])"
_SCRIPT = r"(case when regexp_matches({}.name,'\pL') then 'LATIN' else '' end)"
LINKS_SQL = f"""r2 as (select *, {_WORDS} as aw from rec),
lk as (select rc.s1_id, rc.cand_id, rc.src, rc.country, rc.n_true, rc.mask, b.country as b_country, case when n_true<=2 then n_true::varchar when n_true<=4 then '3-4' else '5+' end as cardinality, a.name as a_name, b.name as b_name, a.addr as a_addr, b.addr as b_addr,
 len(list_intersect(a.name_tokens,b.name_tokens)) as shared_names, len(list_intersect(a.aw,b.aw)) as shared_words, len(list_distinct(a.digits)) as a_numbers, len(list_distinct(b.digits)) as b_numbers, len(list_intersect(a.digits,b.digits)) as shared_numbers,
 {_SCRIPT.format('a')} as a_scripts, {_SCRIPT.format('b')} as b_scripts, false as scripts_disjoint, {_J.format('a.name_tokens', 'b.name_tokens')} as name_token_jaccard, {_J.format(_CHARS.format('a'), _CHARS.format('b'))} as name_char_jaccard, {_J.format('a.aw', 'b.aw')} as address_token_jaccard
 from rc join r2 a on a.entity_id=rc.s1_id join r2 b on b.entity_id=rc.cand_id),
un2 as (select * from (values {', '.join(f"('{k}', {m}::bigint)" for k, m in MISS_UNIONS.items())}) as t(union_name, um)), ms as (select union_name, lk.* from lk, un2 where lk.mask & um = 0)"""
_AUDIT = " UNION ALL ".join([
    "SELECT union_name, 'total' AS kind, 'missed_links' AS item, count(*)::double AS value FROM ms GROUP BY 1", "SELECT union_name, 'total', 'missed_s1_entities', count(DISTINCT s1_id) FROM ms GROUP BY 1",
    *[f"SELECT union_name, 'signal', '{k}', count(*) FROM ms WHERE {w} GROUP BY 1" for k, w in FLAGS.items()],
    *[f"SELECT union_name, '{k}', {c}, count(*) FROM ms GROUP BY 1, 3" for k, c in (("country", "country"), ("source", "src"), ("cardinality", "cardinality"))],
    "SELECT union_name, 'script_pair', item, n FROM (SELECT union_name, a_scripts||' -> '||b_scripts AS item, count(*) AS n, row_number() OVER (PARTITION BY union_name ORDER BY count(*) DESC, a_scripts||' -> '||b_scripts) AS r FROM ms GROUP BY 1,2) WHERE r<=100",
    *[f"SELECT union_name, 'mean', '{m}', round(avg({m}),6) FROM ms GROUP BY 1" for m in MEANS]])


def missed_links(spark, sf_dir) -> DataFrame:
    """Links that each of MISS_UNIONS lacks, with what their records have in common."""
    recs = D.noisy_records(spark, sf_dir)
    r = recs.select(
        "entity_id", "name", "addr", "name_tokens", "digits", "country", F.filter(T.words(F.col("clean_addr")), lambda w: (F.length(w) >= 3) & ~T.is_digits(w)).alias("aw"),
        F.array_distinct(F.filter(F.split("legal_name", ""), lambda c: c.rlike(r"^[\p{L}\p{N}]"))).alias("chars"), T.scripts(F.col("name")).alias("scripts"))
    a, b = r.select(F.col("entity_id").alias("s1_id"), F.struct("*").alias("a")), r.select(F.col("entity_id").alias("cand_id"), F.struct("*").alias("b"))
    lacking = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(u)) for u, m in MISS_UNIONS.items()]), lambda u: u.isNotNull())
    m = L.recovered(spark, sf_dir).select("s1_id", "cand_id", "src", "country", "n_true", F.explode(lacking).alias("union_name")).join(a, "s1_id").join(b, "cand_id")
    shared = lambda f: F.size(F.array_intersect(f"a.{f}", f"b.{f}"))
    jaccard = lambda f: F.when(F.size(F.array_union(f"a.{f}", f"b.{f}")) > 0, shared(f) / F.size(F.array_union(f"a.{f}", f"b.{f}"))).otherwise(0.0)
    return m.select(
        "union_name", "s1_id", "cand_id", "src", "country", F.col("b.country").alias("b_country"), T.cardinality(F.col("n_true")).alias("cardinality"), F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name"),
        F.col("a.addr").alias("a_addr"), F.col("b.addr").alias("b_addr"), shared("name_tokens").alias("shared_names"), shared("aw").alias("shared_words"), shared("digits").alias("shared_numbers"),
        *[F.size(F.array_distinct(f"{x}.digits")).alias(f"{x}_numbers") for x in "ab"], *[F.array_join(f"{x}.scripts", "+").alias(f"{x}_scripts") for x in "ab"],
        ((F.size("a.scripts") > 0) & (F.size("b.scripts") > 0) & (F.size(F.array_intersect("a.scripts", "b.scripts")) == 0)).alias("scripts_disjoint"),
        jaccard("name_tokens").alias("name_token_jaccard"), jaccard("chars").alias("name_char_jaccard"), jaccard("aw").alias("address_token_jaccard"))


@query(_AUDIT, *L.PAIR_BASE, L.RECOVERED, LINKS_SQL)
def agg_miss_audit(spark, sf_dir):
    """What retrieval misses under four unions: totals, signals that may overlap, breakdowns, script pairs, mean likenesses; one aggregation."""
    def row(kind: str, item: Column, value: Column = F.lit(1.0)) -> Column:
        return F.struct(F.lit(kind).alias("kind"), item.alias("item"), value.alias("value"))

    rows = [row("total", F.lit("missed_links")), *[F.when(F.expr(w), row("signal", F.lit(k))) for k, w in FLAGS.items()], row("country", F.col("country")), row("source", F.col("src")),
            row("cardinality", F.col("cardinality")), row("script_pair", F.concat("a_scripts", F.lit(" -> "), "b_scripts")), *[row("mean", F.lit(m), F.col(m)) for m in MEANS]]
    m = missed_links(spark, sf_dir)
    long = m.select("union_name", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("union_name", "x.*")
    value = F.when(F.col("kind") == "mean", F.round(F.avg("value"), 6)).otherwise(F.sum("value"))
    counted = long.groupBy("union_name", "kind", "item").agg(value.alias("value"))
    place = F.row_number().over(Window.partitionBy("union_name", "kind").orderBy(F.desc("value"), "item"))
    counted = counted.withColumn("r", place).where("kind <> 'script_pair' or r <= 100").drop("r")
    heads = m.groupBy("union_name").agg(F.count_distinct("s1_id").cast("double").alias("value"))
    return counted.unionByName(heads.select("union_name", F.lit("total").alias("kind"), F.lit("missed_s1_entities").alias("item"), "value"))


SAMPLE = 5000  # the report's sample of misses, chosen by md5
_TSV = {
    "s1_id": "s1_id", "true_target_id": "cand_id", "target_source": "src", "s1_country": "country", "target_country": "b_country", "cardinality_bucket": "cardinality", "name_missing_s1": "a_name = ''",
    "name_missing_target": "b_name = ''", "name_token_jaccard": "round(name_token_jaccard, 6)", "name_shared_token_count": "shared_names", "name_char_jaccard": "round(name_char_jaccard, 6)", "name_scripts_s1": "a_scripts",
    "name_scripts_target": "b_scripts", "name_scripts_disjoint": "scripts_disjoint", "address_token_jaccard": "round(address_token_jaccard, 6)", "address_shared_token_count": "shared_words", "number_count_s1": "a_numbers",
    "number_count_target": "b_numbers", "shared_number_count": "shared_numbers", "address_missing_s1": "a_addr = ''", "address_missing_target": "b_addr = ''",
}


@query("SELECT " + ", ".join(f"({v}) AS {k}" for k, v in _TSV.items()) + f" FROM ms WHERE union_name='Channel_L_Standalone' ORDER BY md5('42|'||s1_id||'|'||cand_id), s1_id, cand_id LIMIT {SAMPLE}", *L.PAIR_BASE, L.RECOVERED, LINKS_SQL)
def snk_miss_tsv(spark, sf_dir):
    """A bounded sample of missed links with 21 derived columns and no raw text, written and read back."""
    m = missed_links(spark, sf_dir).where("union_name = 'Channel_L_Standalone'")
    sample = sampling.bottom_k(m, SAMPLE, "42", "s1_id", "cand_id").select(*[F.expr(v).alias(k) for k, v in _TSV.items()])
    path = scratch(spark, "misses")
    tsv.write_report(sample, path)
    return tsv.read_report(spark, path, sample.schema)


_TAXONOMY = L.TAXONOMY_SQL


@query(f"""SELECT category, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),6) AS percent, string_agg(s1_id||'>'||cand_id, ' ' ORDER BY s1_id, cand_id) FILTER (WHERE r<=3) AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY s1_id, cand_id) AS r FROM (SELECT {_TAXONOMY} AS category, s1_id, cand_id FROM md ORDER BY md5('42|'||s1_id||'|'||cand_id), s1_id, cand_id LIMIT 500)) GROUP BY 1""", *L.PAIR_BASE, L.RECOVERED, L.MISSED, L.AUDIT)
def agg_taxonomy(spark, sf_dir):
    """Why links are missed, for a sample of at most 500 of them: counts, parts of a hundred and three examples of each class."""
    kinds = L.missed_kinds(spark, sf_dir)
    sample = sampling.bottom_k(kinds, 500, "42", "s1_id", "cand_id")
    ranked = sample.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("s1_id", "cand_id")))
    shown = F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.concat("s1_id", F.lit(">"), "cand_id")))), " ")
    counted = ranked.groupBy("category").agg(F.count(F.lit(1)).alias("n"), shown.alias("examples"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))  # a row a class


# ---- Reduced keys of the audit ----------------------------------------------------------------------------------

_AUDIT_KEYS = " UNION ALL ".join([
    "SELECT entity_id, country, 'A' AS channel, packed AS kval FROM ak WHERE packed<>''", "SELECT entity_id, country, 'G', substr(replace(packed,' ',''),1,8) FROM ak WHERE length(replace(packed,' ',''))>=5",
    "SELECT entity_id, country, 'B', unnest(t[1:3]) FROM ak", "SELECT entity_id, country, 'E', t[1]||'_'||t[2] FROM ak WHERE len(t)>=3", "SELECT entity_id, country, 'E', t[2]||'_'||t[3] FROM ak WHERE len(t)>=3",
    "SELECT entity_id, country, 'C', cp FROM ak WHERE cp IS NOT NULL", "SELECT entity_id, country, 'C', digits[1]||'_'||addr_words3[1] FROM ak WHERE len(digits)>0 AND len(addr_words3)>0", "SELECT entity_id, country, 'F', addr_words3[2] FROM ak WHERE len(addr_words3)>=2"])


@query(f"SELECT * FROM ({_AUDIT_KEYS})", L.KR, f"ak as (select kr.*, array_to_string([w for w in legal_words if {L.LIGHT_LIST}],' ') as packed, [w for w in legal_words if length(w)>=3 and {L.LIGHT_LIST}] as t from kr)")
def blk_audit(spark, sf_dir):
    """The reduced keys of the audit of misses: legal names without their stop words, first tokens in order, fewer keys a channel."""
    recs = D.noisy_records(spark, sf_dir)
    light = T.name_words(F.col("legal_name"))
    t = F.filter(light, lambda w: F.length(w) >= 3)
    recs = recs.select("entity_id", "country", F.array_join(light, " ").alias("packed"), t.alias("t"), "digits", F.col("addr_words3").alias("w"), at(T.postals(F.col("clean_addr")), 0).alias("cp"))
    tight, n = F.replace("packed", F.lit(" "), F.lit("")), F.size("t")
    one = [
        key("A", F.col("packed")), key("G", F.substring(tight, 1, 8), F.length(tight) >= 5), *[key("B", at(F.col("t"), i)) for i in range(3)], key("E", joined(at(F.col("t"), 0), at(F.col("t"), 1)), n >= 3),
        key("E", joined(at(F.col("t"), 1), at(F.col("t"), 2)), n >= 3), key("C", F.col("cp")), key("C", joined(at(F.col("digits"), 0), at(F.col("w"), 0))), key("F", at(F.col("w"), 1)),
    ]
    return recs.select("entity_id", "country", F.explode(keys(*one)).alias("k")).select("entity_id", "country", F.col("k.ktype").alias("channel"), "k.kval")

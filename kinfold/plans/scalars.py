"""Queries of scalar functions, similarities and pair features over the noisy records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..functions.values import ADDRESS_FORMS
from ..operators.features import FEATURES, pair_features, with_feature_fields
from . import testdata as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def bars(x: Column) -> Column:
    return F.array_join(x, "|")


def scalar(name: str, column: Callable[..., Column], text: str | None) -> None:
    """column gets the raw name and address, the clean ones, and the legal name."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.noisy_records(spark, sf_dir).select("entity_id", column(*map(F.col, ("name", "addr", "clean_name", "clean_addr", "legal_name"))).alias("value"))

    QUERIES[name] = query
    if text:
        SQL[name] = D.sql(f"SELECT entity_id, {text} AS value FROM rec")


def grams_sql(x: str, n: int) -> str:
    return f"[substr({x}, i::int, {n}) for i in range(1, greatest(length({x}) - {n - 2}, 1))]"


def barred(x: str) -> str:
    return f"array_to_string({x}, '|')"


def first_seen(x: str) -> str:
    return f"[v for v, i in {x} if list_position({x}, v) = i]"


padded, careted = "(' '||clean_name||' ')", "('^'||replace(clean_name,' ','_')||'$')"
bare = f"case when clean_name='' then [] when length(clean_name)<3 then [clean_name] else list_distinct({grams_sql('clean_name', 3)}) end"
latin = r"lower(trim(regexp_replace(regexp_replace(strip_accents(name),'[^a-zA-Z0-9\s]',' ','g'),'\s+',' ','g')))"
scalar("fn_raw", lambda name, addr, cn, ca, ln: T.raw(F.concat(F.lit(" \t"), name, F.lit(" \n"))), "name")
scalar("fn_base", lambda name, addr, cn, ca, ln: T.base(F.concat(F.lit("  "), F.upper(F.lit("Ab")), F.lit("  "), name)), r"trim('ab '||trim(regexp_replace(lower(name),'\s+',' ','g')))")
scalar("fn_digits", lambda name, addr, cn, ca, ln: T.ascii_digits(F.translate(addr, "0123456789", "०१२३४५६७८९")), "trim(addr)")
scalar("fn_clean", lambda name, addr, cn, ca, ln: T.clean(name), "clean_name")
scalar("fn_level2", lambda name, addr, cn, ca, ln: T.level2(addr), D.clean_sql("replace(addr,'&',' ')"))
scalar("fn_legal", lambda name, addr, cn, ca, ln: T.legal(name), "legal_name")
scalar("fn_addr_canon", lambda name, addr, cn, ca, ln: T.address(F.concat(addr, F.lit(" Main St., Apt 4B Park Rd.")), True), D.forms_sql(D.clean_sql("addr||' Main St., Apt 4B Park Rd.'"), ADDRESS_FORMS))
scalar("fn_translit", lambda name, addr, cn, ca, ln: T.transliterate(name), rf"case when regexp_matches(name,'[^\x00-\x7F]') then {latin} else name end")
scalar("fn_is_non_ascii", lambda name, addr, cn, ca, ln: T.is_non_ascii(name), r"regexp_matches(name,'[^\x00-\x7F]')")
scalar("fn_squeeze", lambda name, addr, cn, ca, ln: T.squeeze(cn), "array_to_string([substr(clean_name,i::int,1) for i in range(1,length(clean_name)+1) if i=1 or substr(clean_name,i::int,1)<>substr(clean_name,(i-1)::int,1)],'')")
scalar("fn_acronym", lambda name, addr, cn, ca, ln: T.acronym(F.col("name_words")), r"array_to_string([lower(substr(w,1,1)) for w in name_words if regexp_matches(w,'^[\pL\pN]')],'')")
scalar("fn_tokens", lambda name, addr, cn, ca, ln: bars(T.name_tokens(ln)), barred("name_tokens"))
scalar("fn_ngrams", lambda name, addr, cn, ca, ln: bars(T.ngrams(cn)), barred(f"case when clean_name='' then [] else {grams_sql(padded, 3)} end"))
scalar("fn_ngrams_caret", lambda name, addr, cn, ca, ln: bars(T.ngrams_caret(cn)), barred(f"case when clean_name='' then [] else {grams_sql(careted, 3)} end"))
scalar("fn_ngrams_bare", lambda name, addr, cn, ca, ln: bars(F.array_sort(T.ngrams_bare(cn))), barred(f"list_sort({bare})"))
scalar("fn_digits_seq", lambda name, addr, cn, ca, ln: bars(T.digit_runs(ca)), barred("digits"))
scalar("fn_postal", lambda name, addr, cn, ca, ln: bars(T.postals(addr)), barred("postals"))
scalar("fn_landmark", lambda name, addr, cn, ca, ln: bars(T.landmarks(addr)), r"array_to_string(regexp_extract_all(addr,'(?i)\b(?:near|opp|opposite|behind|beside|adj|adjacent|next\s+to|opp\.)\s+([a-zA-Z0-9]+)',1),'|')")
scalar("fn_zip_us", lambda name, addr, cn, ca, ln: (F.col("country") == "en") & addr.rlike(r"(?<!\d)\d{5}(?!\d)"), r"country='en' and regexp_matches(addr,'(^|[^0-9])[0-9]{5}($|[^0-9])')")
scalar("fn_pin_in", lambda name, addr, cn, ca, ln: (F.col("country") == "es") & addr.rlike(r"(?<!\d)\d{6}(?!\d)"), r"country='es' and regexp_matches(addr,'(^|[^0-9])[0-9]{6}($|[^0-9])')")
scalar("fn_postal_fr", lambda name, addr, cn, ca, ln: (F.col("country") == "fr") & addr.rlike(r"(?<!\d)\d{5}(?!\d)"), r"country='fr' and regexp_matches(addr,'(^|[^0-9])[0-9]{5}($|[^0-9])')")
scalar("fn_has_digit", lambda name, addr, cn, ca, ln: addr.rlike(r"\p{Nd}"), "regexp_matches(addr,'[0-9]')")
scalar("fn_has_comma", lambda name, addr, cn, ca, ln: F.contains(addr, F.lit(",")), "contains(addr,',')")
scalar("fn_scripts", lambda name, addr, cn, ca, ln: bars(T.scripts(name)), r"case when regexp_matches(name,'\pL') then 'LATIN' else '' end")
scalar("fn_addr_tokens", lambda name, addr, cn, ca, ln: bars(T.address_tokens(ca)), barred(first_seen(D.words_sql("clean_addr", "length(w)>=3", D.NOT_DIGITS, f"not list_contains({D.ADDRESS_STOP},w)"))))
scalar("fn_entity_text", lambda name, addr, cn, ca, ln: T.entity_text(name, addr, F.col("country")), "concat_ws(' | ',legal_name,clean_addr,country)")
scalar("fn_hash64", lambda name, addr, cn, ca, ln: F.xxhash64(cn), None)
scalar("fn_len_chars", lambda name, addr, cn, ca, ln: F.length(name), "length(name)")
scalar("fn_len_tokens", lambda name, addr, cn, ca, ln: F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")), r"len([w for w in regexp_split_to_array(name,'\s+') if w<>''])")
scalar("fn_card_bucket", lambda name, addr, cn, ca, ln: T.cardinality(F.size("name_tokens")), "case len(name_tokens) when 0 then 'singleton' when 1 then '1' when 2 then '2' else case when len(name_tokens)<=4 then '3-4' else '5+' end end")


def fn_classify_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = D.table(spark, sf_dir, "documents").select(F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("c"))
    return chars.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select(T.char_class(F.col("c")).alias("kind"), "n").groupBy("kind").agg(F.sum("n").alias("n"))


QUERIES["fn_classify_char"] = fn_classify_char
SQL["fn_classify_char"] = r"""SELECT case when c ~ '[\x00-\x7F]' then 'ascii' when c between 'À' and 'ɏ' then 'latin_accented' else 'other' end AS kind, count(*) AS n
FROM (SELECT unnest(string_split(text,'')) AS c FROM documents) GROUP BY 1"""


def linked_pairs(spark: SparkSession, sf_dir: str, fields: bool = False) -> DataFrame:
    """Truth pairs of records with all their columns, a and b, and perhaps the fields of features."""
    recs = D.noisy_records(spark, sf_dir)
    recs = with_feature_fields(recs).select("entity_id", "src", "truth_key", "fields") if fields else recs
    a, b = recs.where("src = 'S1'").select(F.struct("*").alias("a")), recs.where("src <> 'S1'").select(F.struct("*").alias("b"))
    return a.join(b, F.col("a.truth_key") == F.col("b.truth_key")).select(F.col("a.entity_id").alias("s1_id"), F.col("b.entity_id").alias("cand_id"), "a", "b")


PAIRS = "p as (select a.entity_id as s1_id, b.entity_id as cand_id, a, b from rec a join rec b on a.truth_key=b.truth_key where a.src='S1' and b.src<>'S1')"


def similar(name: str, column: Callable[..., Column], text: str | None) -> None:
    """column gets functions from a field's name to that field of either record."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return linked_pairs(spark, sf_dir).select("s1_id", "cand_id", F.round(column(lambda x: F.col(f"a.{x}"), lambda x: F.col(f"b.{x}")), 9).alias("value"))

    QUERIES[name] = query
    if text:
        SQL[name] = D.sql(f"SELECT s1_id, cand_id, round({text}, 9)::double AS value FROM p", PAIRS)


def both_sql(x: str, y: str) -> str:
    return f"len(list_intersect({x},{y}))"


def jaccard_sql(x: str, y: str) -> str:
    return f"(case when len({x})>0 and len({y})>0 then {both_sql(x, y)}/len(list_distinct(list_concat({x},{y}))) else 0.0 end)"


def dice_sql(x: str, y: str) -> str:
    return f"(case when len({x})>0 and len({y})>0 then 2*{both_sql(x, y)}/(len(list_distinct({x}))+len(list_distinct({y}))) else 0.0 end)"


def overlap_sql(x: str, y: str) -> str:
    return f"(case when len({x})>0 and len({y})>0 then {both_sql(x, y)}/least(len(list_distinct({x})),len(list_distinct({y}))) else 0.0 end)"


def bare_sql(x: str, n: int) -> str:
    return f"(case when {x}='' then [] when length({x})<{n} then [{x}] else list_distinct({grams_sql(x, n)}) end)"


def ngram_sql(x: str, y: str, n: int) -> str:
    return f"(case when {x}='' or {y}='' then 0.0 when {x}={y} then 1.0 else {jaccard_sql(bare_sql(x, n), bare_sql(y, n))} end)"


def length_sql(x: str, y: str) -> str:
    return f"(case when length({x})+length({y})>0 then abs(length({x})-length({y}))/(length({x})+length({y})) else 0.0 end)"


def prefix_sql(x: str, y: str) -> str:
    return f"(list_max([case when substr({x},1,i::int)=substr({y},1,i::int) then i else 0 end for i in range(0, least(length({x}),length({y}))+1)]))"


def lcs_sql(name: str, x: str, y: str) -> str:
    """CTEs that give `name`: s1_id, cand_id, r, the indel ratio of x and y; the shorter text's matches are bits of one number."""
    return f"""{name}_t as (select s1_id, cand_id, {x} as x, {y} as y from p), {name}_u as (select *, case when length(x)<=length(y) then x else y end as u, case when length(x)<=length(y) then y else x end as v from {name}_t),
{name}_r(s1_id, cand_id, u, v, j, free) as (select s1_id, cand_id, u, v, 0, (1::hugeint<<length(u))-1 from {name}_u union all
 select s1_id, cand_id, u, v, j+1, ((free+met)|(free-met))&((1::hugeint<<length(u))-1) from (select *, free & list_sum([case when substr(u,i::int,1)=substr(v,j+1,1) then 1::hugeint<<(i-1)::int else 0::hugeint end for i in range(1,length(u)+1)])::hugeint as met from {name}_r where j<length(v) and u<>'')),
{name} as (select t.s1_id, t.cand_id, case when t.x=t.y then 1.0 when t.x='' or t.y='' then 0.0 else 2*(length(r.u)-bit_count(r.free))/(length(t.x)+length(t.y)) end as r
 from {name}_u t join {name}_r r using (s1_id, cand_id) where r.j=length(r.v) or (r.u='' and r.j=0))"""


def tokens_sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort([w for w in string_split({x},' ') if w<>'']),' ')"


RATIOS = {
    "name_fuzz_ratio": lcs_sql("q1_ratio", "a.clean_name", "b.clean_name"), "name_token_sort_ratio": lcs_sql("q2_ratio", tokens_sorted_sql("a.clean_name"), tokens_sorted_sql("b.clean_name")),
    "addr_fuzz_ratio": lcs_sql("q3_ratio", "a.clean_addr", "b.clean_addr"), "addr_token_sort_ratio": lcs_sql("q4_ratio", tokens_sorted_sql("a.clean_addr"), tokens_sorted_sql("b.clean_addr")),
}
nw, an, bn = ("a.name_words", "b.name_words"), "a.clean_name", "b.clean_name"
chars = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda c: c.rlike(r"^[\p{L}\p{N}]")))
chars_sql = lambda x: rf"list_distinct([c for c in string_split({x},'') if regexp_matches(c,'[\pL\pN]')])"
similar("sim_jaccard", lambda A, B: S.jaccard(A("name_words"), B("name_words")), jaccard_sql(*nw))
similar("sim_dice", lambda A, B: S.dice(A("name_words"), B("name_words")), dice_sql(*nw))
similar("sim_overlap", lambda A, B: S.overlap(A("name_words"), B("name_words")), overlap_sql(*nw))
similar("sim_ngram_jaccard", lambda A, B: S.ngram_jaccard(A("clean_name"), B("clean_name"), T.ngrams_bare(A("clean_name")), T.ngrams_bare(B("clean_name"))), ngram_sql(an, bn, 3))
similar("sim_indel_ratio", lambda A, B: S.indel_ratio(A("clean_name"), B("clean_name")), None)
similar("sim_token_sort", lambda A, B: S.indel_ratio(S.sorted_tokens(A("clean_name")), S.sorted_tokens(B("clean_name"))), None)
for _name, _feature_name in (("sim_indel_ratio", "name_fuzz_ratio"), ("sim_token_sort", "name_token_sort_ratio")):
    SQL[_name] = D.sql(f"SELECT s1_id, cand_id, round(r, 9)::double AS value FROM {RATIOS[_feature_name][:8]}", PAIRS, RATIOS[_feature_name])
similar("sim_len_diff", lambda A, B: S.length_difference(A("clean_name"), B("clean_name")), length_sql(an, bn))
similar("fn_prefix_len", lambda A, B: T.prefix_length(A("clean_name"), B("clean_name")).cast("double"), prefix_sql(an, bn))
similar("sim_prefix_ratio", lambda A, B: S.prefix_ratio(A("clean_name"), B("clean_name"), T.prefix_length(A("clean_name"), B("clean_name"))), f"case when greatest(length({an}),length({bn}))>0 then {prefix_sql(an, bn)}/greatest(length({an}),length({bn})) else 0.0 end")
similar("sim_char_set_jaccard", lambda A, B: S.jaccard_loose(chars(A("legal_name")), chars(B("legal_name"))), jaccard_sql(chars_sql("a.legal_name"), chars_sql("b.legal_name")))
similar("sim_jaccard_loose", lambda A, B: S.jaccard_loose(A("name_tokens"), B("name_tokens")), jaccard_sql("a.name_tokens", "b.name_tokens"))


def feat_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_features(linked_pairs(spark, sf_dir, True).withColumn("channel_hits", F.lit(1))).select("s1_id", "cand_id", *[F.round(F.col(f).cast("double"), 9).alias(f) for f in FEATURES])


def _feature(f: str):
    return lambda spark, sf_dir: feat_all(spark, sf_dir).select("s1_id", "cand_id", f)


QUERIES["feat_all"] = feat_all
aw = ("a.addr_words", "b.addr_words")
aa, ba, sq = "a.clean_addr", "b.clean_addr", SQL["fn_squeeze"]
squeeze_sql = lambda x: f"array_to_string([substr({x},i::int,1) for i in range(1,length({x})+1) if i=1 or substr({x},i::int,1)<>substr({x},(i-1)::int,1)],'')"
exact_sql = lambda x: f"(a.{x}=b.{x} and a.{x}<>'')::int"
acr_sql = lambda r: rf"array_to_string([lower(substr(w,1,1)) for w in {r}.name_words if regexp_matches(w,'^[\pL\pN]')],'')"
p3 = lambda r: f"[substr(w,1,3) for w in {r}.postals]"
lm = lambda r: rf"list_transform([lower(x) for x in regexp_extract_all({r}.addr,'(?i)\b(?:near|opp|opposite|behind|beside|adj|adjacent|next\s+to|opp\.)\s+([a-zA-Z0-9]+)',1) if length(x)>=3], lambda x: x)"
FEATURE_SQL = {
    "name_clean_exact": exact_sql("clean_name"), "name_legal_exact": exact_sql("legal_name"), "name_token_jaccard": jaccard_sql(*nw), "name_token_dice": dice_sql(*nw),
    "name_token_overlap": overlap_sql(*nw), "name_c3_jaccard": ngram_sql(an, bn, 3), "name_c4_jaccard": ngram_sql(an, bn, 4), "name_len_diff_ratio": length_sql(an, bn),
    "name_prefix_ratio": f"(case when greatest(length({an}),length({bn}))>0 then {prefix_sql(an, bn)}/greatest(length({an}),length({bn})) else 0.0 end)",
    "name_acronym_match": f"({acr_sql('a')}<>'' and {acr_sql('b')}<>'' and ({acr_sql('a')}={acr_sql('b')} or {acr_sql('a')}={bn} or {acr_sql('b')}={an}))::int",
    "name_squeezed_c3": ngram_sql(squeeze_sql(an), squeeze_sql(bn), 3), "addr_clean_exact": exact_sql("clean_addr"), "addr_token_jaccard": jaccard_sql(*aw), "addr_token_dice": dice_sql(*aw),
    "addr_token_overlap": overlap_sql(*aw), "addr_c3_jaccard": ngram_sql(aa, ba, 3), "addr_len_diff_ratio": length_sql(aa, ba), "postal_exact_match": "(len(list_intersect(a.postals,b.postals))>0)::int",
    "postal_prefix3_match": f"(len(list_intersect({p3('a')},{p3('b')}))>0)::int", "digits_overlap_ratio": overlap_sql("a.digits", "b.digits"),
    "numeric_post_match": f"(len(list_intersect({p3('a')},{p3('b')}))>0 and len(list_intersect(a.digits,b.digits))>0)::int", "landmark_match": f"(len(list_intersect({lm('a')},{lm('b')}))>0)::int",
    "name_x_addr_jaccard": f"{jaccard_sql(*nw)}*{jaccard_sql(*aw)}", "name_c3_x_addr_c3": f"{ngram_sql(an, bn, 3)}*{ngram_sql(aa, ba, 3)}", "cand_is_s2": "0", "channel_hits": "1",
}
latin_of = lambda x: rf"(case when regexp_matches({x},'[^\x00-\x7F]') then {D.latin_sql(x)} else {x} end)"
FEATURE_SQL |= {
    "name_translit_c3": ngram_sql("ta", "tb", 3), "name_translit_exact": "(ta=tb and ta<>'')::int",
}
LATIN_PAIRS = f"pl as (select *, {latin_of('a.clean_name')} as ta, {latin_of('b.clean_name')} as tb from p)"
for _f in FEATURES:
    QUERIES[f"feat_{_f}"] = _feature(_f)
    if _f in FEATURE_SQL:
        SQL[f"feat_{_f}"] = D.sql(f"SELECT s1_id, cand_id, round({FEATURE_SQL[_f]}::double, 9) AS {_f} FROM pl", PAIRS, LATIN_PAIRS)
    else:
        SQL[f"feat_{_f}"] = D.sql(f"SELECT s1_id, cand_id, round(r, 9)::double AS {_f} FROM {RATIOS[_f][:8]}", PAIRS, RATIOS[_f])
SQL["feat_all"] = D.sql(
    "SELECT s1_id, cand_id, " + ", ".join(f"round({FEATURE_SQL[f] if f in FEATURE_SQL else RATIOS[f][:8] + '.r'}::double, 9) AS {f}" for f in FEATURES)
    + " FROM pl " + " ".join(f"JOIN {x[:8]} USING (s1_id, cand_id)" for x in RATIOS.values()), PAIRS, LATIN_PAIRS, *RATIOS.values(),
)


def sim_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(S.cosine(F.col("x"), F.col("y")), 5).alias("value"))


QUERIES["sim_cosine"] = sim_cosine
SQL["sim_cosine"] = "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"

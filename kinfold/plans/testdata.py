"""The driver's documents as noisy business records, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.values import ADDRESS_STOP_WORDS, LEGAL_FORMS, STOP_WORDS
from ..operators.records import records
from ..session import remove, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three records for each document; records of one document (truth_key) are the same business.

    Some documents have twins too, whose names and addresses agree to the letter or but for case, and some a branch of one
    company whose name and address very many records share.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower("text"), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    w = F.col("w")
    t = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")).select("doc_id", "lang", "n_chars", F.split(text, " ").alias("w")).withColumns({
        "n4": F.array_join(F.slice(w, 1, 4), " "), "a8": F.concat_ws(" ", F.col("n_chars").cast("string"), F.array_join(F.slice(w, 5, 8), " ")),
        "zip": (F.col("doc_id") % 90000 + 10000).cast("string"),
    })
    one = lambda i: F.get("w", F.lit(i))
    rest = F.array_join(F.slice(w, 2, 3), " ")
    kind = F.col("doc_id") % 5
    s2 = (
        F.when(kind == 0, F.concat("n4", F.lit(" pvt ltd"))).when(kind == 1, rest)
        .when(kind == 2, F.concat(F.substring(one(0), 1, 2), F.substring(one(0), 4, 1 << 20), F.lit(" "), rest))
        .when(kind == 3, F.concat_ws(" ", one(3), one(2), one(1), one(0)))
        .otherwise(F.concat_ws("", *[F.substring(one(i), 1, 1) for i in range(4)]))
    )
    third = F.col("doc_id") % 3
    with_zip = F.concat("a8", F.lit(" "), "zip")
    near = F.concat(F.col("a8"), F.lit(" near "), F.coalesce(one(5), F.lit("")), F.lit(" "), F.col("zip"))
    doc, padded = F.col("doc_id"), F.lpad(F.col("doc_id").cast("string"), 8, "0")

    def record(src: str, name: Column, address: Column, mark: str = "") -> Column:
        key = doc + {"": 0, "T": 10**9, "B": 2 * 10**9}[mark]
        return F.struct(F.concat(F.lit(f"{src}-{mark}"), padded).alias("id"), name.alias("nm"), address.alias("ad"), key.alias("key"))

    twin = F.concat(F.lit("The "), "n4", F.lit(" Co"))
    branch, road = F.lit("Meridian Freight Pvt Ltd"), F.lit("7 Harbour Wharf 40007")
    made = F.array(
        record("S1", F.concat("n4", F.lit(" private limited")), with_zip),
        F.when(doc % 7 != 0, record("S2", s2, with_zip)),
        F.when((doc % 7 != 0) & (doc % 4 != 0), record("S3", F.replace("n4", F.lit(" "), F.lit(" - ")), F.when(third == 0, F.col("a8")).when(third == 1, near).otherwise(""))),
        F.when(doc % 25 == 4, record("S1", twin, with_zip, "T")), F.when(doc % 25 == 4, record("S3", twin, with_zip, "T")), F.when(doc % 50 == 4, record("S2", F.concat(F.lit("the "), "n4", F.lit(" co")), F.col("a8"), "T")),
        F.when(doc % 100 == 7, record("S1", branch, road, "B")), F.when(doc % 2 == 1, record("S2", branch, road, "B")),
    )
    return t.select("lang", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("r")).select(
        F.col("r.id").alias("entity_id"), F.col("r.nm").alias("business_name"), F.col("r.ad").alias("business_address"), F.col("lang").alias("country"), F.col("r.key").alias("truth_key"),
    )


_held: dict[tuple, DataFrame] = {}


def held(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """make(), persisted: the queries of one session share it, and a lost or evicted block is worked out again."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held:
        _held[key] = make().persist(StorageLevel.MEMORY_AND_DISK)
    return _held[key]


def stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """make(), written once a session: for tables that are far smaller as files than in memory, whose shuffle files shall not stay beside what is made of them."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held:
        _held[key] = written(make(), name)
    return _held[key]


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a small table may be one file of one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _files(df) < cores else df


def _files(df: DataFrame) -> int:
    return len(df.inputFiles())


def noisy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir, "records", lambda: records(noisy(spark, sf_dir)))


def release() -> None:
    """Give back what the queries of this process hold."""
    while _held:
        table = _held.popitem()[1]
        remove(table) if hasattr(table, "_kinfold_path") else table.unpersist()


def truth(recs: DataFrame) -> DataFrame:
    """Links of S1 records to S2 and S3 records with the same key."""
    s1 = recs.where("src = 'S1'").select(F.col("entity_id").alias("s1_id"), "truth_key")
    return s1.join(recs.where("src <> 'S1'").select(F.col("entity_id").alias("cand_id"), "truth_key"), "truth_key").select("s1_id", "cand_id")


def quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


STOP, ADDRESS_STOP = quoted(STOP_WORDS), quoted(ADDRESS_STOP_WORDS)


def clean_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({x}),'&',' and '),'[^\pL\pN_\s]',' ','g'),'\s+',' ','g'))"


def latin_sql(x: str) -> str:
    """Transliteration of Latin text that isn't ASCII."""
    return rf"lower(trim(regexp_replace(regexp_replace(strip_accents({x}),'[^a-zA-Z0-9\s]',' ','g'),'\s+',' ','g')))"


def forms_sql(x: str, table) -> str:
    """Replacement of whole tokens: spaces are doubled so that neighbours don't share one."""
    out = f"' '||replace({x},' ','  ')||' '"
    for pattern, word in table:
        for found in ([pattern.replace(r"\s*", "  "), pattern.replace(r"\s*", "")] if r"\s*" in pattern else [pattern]):
            out = f"replace({out},' {found} ',' {word.replace(' ', '  ')} ')"
    return rf"trim(regexp_replace({out},'\s+',' ','g'))"


def words_sql(x: str, *conditions: str) -> str:
    return f"[w for w in string_split({x},' ') if " + " and ".join(["w<>''", *conditions]) + "]"


LIGHT = f"not list_contains({STOP},w)"
NOT_DIGITS = "not regexp_full_match(w,'[0-9]+')"
RECORDS = rf"""c as (select doc_id, lang, n_chars, {clean_sql('text')} as ct from documents),
t as (select doc_id, lang, n_chars, string_split(ct,' ') as w, array_to_string(string_split(ct,' ')[1:4],' ') as n4,
  cast(n_chars as varchar)||' '||array_to_string(string_split(ct,' ')[5:12],' ') as a8, cast(doc_id%90000+10000 as varchar) as zip from c),
noisy as (
 select 'S1' as src, '' as mark, doc_id, 0 as add, n4||' private limited' as nm, a8||' '||zip as ad, lang from t
 union all
 select 'S2', '', doc_id, 0, case doc_id%5 when 0 then n4||' pvt ltd' when 1 then array_to_string(w[2:4],' ')
   when 2 then substr(w[1],1,2)||substr(w[1],4)||' '||array_to_string(w[2:4],' ') when 3 then concat_ws(' ',w[4],w[3],w[2],w[1])
   else concat_ws('',substr(w[1],1,1),substr(w[2],1,1),substr(w[3],1,1),substr(w[4],1,1)) end, a8||' '||zip, lang from t where doc_id%7<>0
 union all
 select 'S3', '', doc_id, 0, replace(n4,' ',' - '), case doc_id%3 when 0 then a8 when 1 then a8||' near '||coalesce(w[6],'')||' '||zip else '' end, lang
   from t where doc_id%7<>0 and doc_id%4<>0
 union all
 select s, 'T', doc_id, 1000000000, case s when 'S2' then 'the '||n4||' co' else 'The '||n4||' Co' end, case s when 'S2' then a8 else a8||' '||zip end, lang
   from t, unnest(['S1','S2','S3']) as u(s) where doc_id%25=4 and (s<>'S2' or doc_id%50=4)
 union all
 select s, 'B', doc_id, 2000000000, 'Meridian Freight Pvt Ltd', '7 Harbour Wharf 40007', lang from t, unnest(['S1','S2']) as u(s) where case s when 'S1' then doc_id%100=7 else doc_id%2=1 end),
q0 as (select src||'-'||mark||lpad(cast(doc_id as varchar),8,'0') as entity_id, src, doc_id+add as truth_key, lang as country, trim(nm) as name, trim(ad) as addr,
  {clean_sql('nm')} as clean_name, {clean_sql('ad')} as clean_addr from noisy),
q1 as (select *, trim(regexp_replace(lower(name),'\s+',' ','g')) as base_name, {forms_sql('clean_name', LEGAL_FORMS)} as legal_name from q0),
rec as (select *, {words_sql('clean_name', LIGHT)} as name_words, {words_sql('legal_name')} as legal_words, {words_sql('legal_name', 'length(w)>=3', LIGHT)} as name_tokens,
  {words_sql('clean_addr', NOT_DIGITS, LIGHT)} as addr_words, {words_sql('clean_addr', NOT_DIGITS, LIGHT, 'length(w)>=3')} as addr_words3,
  {words_sql('clean_addr', NOT_DIGITS, LIGHT, 'length(w)>=4')} as addr_words4, {words_sql('clean_addr', "regexp_full_match(w,'[0-9]+')")} as digits,
  {words_sql('addr', "regexp_full_match(w,'[0-9]{5,6}')")} as postals, case when regexp_matches(name,'[^\x00-\x7F]') then {forms_sql(clean_sql(latin_sql('name')), LEGAL_FORMS)} else legal_name end as rom from q1),
truth as (select a.entity_id as s1_id, b.entity_id as cand_id from rec a join rec b using (truth_key) where a.src='S1' and b.src<>'S1')"""


def sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([RECORDS, *ctes]) + "\n" + body

"""Queries that write files and read them back: sources, results, samples, models, inference and its counters."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels as C
from ..operators import decide, matcher, metrics, validate
from ..operators.features import FEATURES, LEGACY_FEATURES
from ..session import remove, scratch, written
from ..sources import tsv
from . import linkage as L
from . import testdata as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = D.sql(sql, *ctes)
        return f

    return register


_paths: dict[tuple, str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """The path that write(path) filled, once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _paths:
        path = scratch(spark, name)
        write(path)
        _paths[key] = path
    return _paths[key]


# ---- Sources ----------------------------------------------------------------------------------------------------

HEADER = "\t".join(tsv.COLUMNS)


def source_file(spark, sf_dir, faulty: bool) -> str:
    """The noisy records as a tab-separated file; with faults, one row in 37 lacks two fields."""
    recs = D.noisy(spark, sf_dir)
    whole, short = (F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in columns]) for columns in (tsv.COLUMNS, tsv.COLUMNS[:2]))
    lines = recs.select((F.when(F.col("truth_key") % 37 == 0, short).otherwise(whole) if faulty else whole).alias("value"))
    return once(spark, sf_dir, f"source-{faulty}", lambda path: tsv.write_lines(lines, HEADER, path))


FIELDS = "entity_id, trim(name) AS business_name, trim(addr) AS business_address, country"


@query(f"SELECT {FIELDS} FROM rec WHERE truth_key%37<>0")
def src_tsv(spark, sf_dir):
    return tsv.read_source(spark, source_file(spark, sf_dir, True))


@query(f"SELECT {FIELDS} FROM rec")
def src_tsv_strict(spark, sf_dir):
    return tsv.read_source_strict(spark, source_file(spark, sf_dir, False))


@query("SELECT count(*) AS rows, sum((truth_key%37=0)::int)::bigint AS bad_rows, true AS header_ok FROM rec")
def src_tsv_audit(spark, sf_dir):
    return tsv.audit_source(spark, source_file(spark, sf_dir, True))


@query(f"SELECT {FIELDS} FROM rec")
def src_dict(spark, sf_dir):
    order = ["country", "business_name", "entity_id", "business_address"]
    lines = D.noisy(spark, sf_dir).select(F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in order], F.lit("more")).alias("value"))
    return tsv.read_named(spark, once(spark, sf_dir, "named", lambda path: tsv.write_lines(lines, "\t".join([*order, "note"]), path)))


@query("SELECT s1_id AS id FROM sp WHERE fold='val'", L.SPLIT)
def src_idlist_json(spark, sf_dir):
    ids = L.smp_stratified(spark, sf_dir).where("fold = 'val'").select(F.col("s1_id").alias("id"))
    return tsv.read_id_json(spark, once(spark, sf_dir, "ids", lambda path: tsv.write_id_json(ids, path)))


@query("SELECT s1_id, cand_id FROM truth")
def src_dense_json(spark, sf_dir):
    pairs = D.truth(D.noisy_records(spark, sf_dir))
    return tsv.read_candidates_json(spark, once(spark, sf_dir, "dense", lambda path: tsv.write_candidates_json(pairs, path)), by_line=True)


# ---- Results ----------------------------------------------------------------------------------------------------

def id_list_file(spark, sf_dir) -> str:
    recs = D.noisy_records(spark, sf_dir)
    return once(spark, sf_dir, "truth", lambda path: tsv.write_id_lists(L.entities(spark, sf_dir), D.truth(recs), path))


@query("SELECT entity_id AS s1_id, coalesce(ids,'') AS ids FROM rec LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS ids FROM truth GROUP BY 1) ON s1_id=entity_id WHERE src='S1'")
def snk_pairs_tsv(spark, sf_dir):
    """The result file as written and read: a row for each entity, an empty list where nothing was found."""
    return tsv.read_truth(spark, id_list_file(spark, sf_dir)).select("s1_id", F.array_join(F.array_sort("cand_ids"), ",").alias("ids"))


@query(f"SELECT {L.EVALUATION} FROM ec", L.PREDICTED, L.COUNTS)
def snk_json(spark, sf_dir):
    report = metrics.evaluate(L.legal_counts(spark, sf_dir))
    path = once(spark, sf_dir, "report", lambda path: report.coalesce(1).write.json(path))
    return spark.read.schema(report.schema).json(path)


@query(f"""SELECT * FROM (SELECT 0 AS place, '| union | recovered | full | zero |' AS line UNION ALL SELECT 1, '|---|---|---|---|' UNION ALL
SELECT 1 + row_number() OVER (ORDER BY union_name), '| '||union_name||' | '||recovered||' | '||full_coverage||' | '||zero_coverage||' |' FROM (SELECT union_name, {L.COVERAGE} FROM uc GROUP BY 1))""", *L.PAIR_BASE, L.unions_sql(L.UNIONS))
def snk_markdown(spark, sf_dir):
    """The report of the unions, 33 rows, as a Markdown table."""
    report = L.coverage(L.union_counts(spark, sf_dir, L.UNIONS)).orderBy("union_name").select("union_name", "recovered", "full_coverage", "zero_coverage").collect()
    lines = ["| union | recovered | full | zero |", "|---|---|---|---|", *("| " + " | ".join(map(str, r)) + " |" for r in report)]
    return spark.createDataFrame(list(enumerate(lines)), "place long, line string")


@query("SELECT fold, count(*) AS n, min(s1_id) AS first, max(s1_id) AS last FROM sp GROUP BY 1", L.SPLIT)
def snk_split(spark, sf_dir):
    """Both id lists of a split as files, read back."""
    split = L.smp_stratified(spark, sf_dir)
    out = None
    for fold in ("train", "val"):
        ids = split.where(F.col("fold") == fold).select(F.col("s1_id").alias("id"))
        path = once(spark, sf_dir, f"split-{fold}", lambda path, ids=ids: tsv.write_id_json(ids, path))
        read = tsv.read_id_json(spark, path).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).select(F.lit(fold).alias("fold"), "*")
        out = read if out is None else out.unionByName(read)
    return out


@query("SELECT s1_id, count(*) AS n FROM truth GROUP BY 1")
def snk_dense(spark, sf_dir):
    return src_dense_json(spark, sf_dir).groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))


def result_file(spark, sf_dir) -> str:
    """A result file with faults, as written."""
    return once(spark, sf_dir, "faulty", lambda path: L.result_lines(spark, sf_dir).write.text(path))


@query("SELECT id, array_to_string(ids,'|') AS ids, malformed FROM pl", L.LINES, L.PARSED)
def src_rawlines(spark, sf_dir):
    return validate.parse_lines(tsv.read_lines(spark, result_file(spark, sf_dir))).select("id", F.array_join("ids", "|").alias("ids"), "malformed")


@query("SELECT id AS s1_id, unnest(list_distinct(ids)) AS cand_id FROM gd", L.LINES, L.PARSED)
def src_truth(spark, sf_dir):
    return validate.parse_lines(tsv.read_lines(spark, result_file(spark, sf_dir))).where("not malformed").select(F.col("id").alias("s1_id"), F.explode(F.array_distinct("ids")).alias("cand_id"))


# ---- Validation of files ----------------------------------------------------------------------------------------

HEADERS = {
    "good": "source1_entity_id\tmatched_entity_ids", "cased": "Source1_Entity_Id\tMATCHED_entity_ids", "comma": "source1_entity_id,matched_entity_ids", "other": "id\tids", "empty": "",
}


@query("SELECT * FROM (VALUES ('good','ok'),('cased','ok'),('comma','comma'),('other','wrong'),('empty','empty')) AS t(file, verdict)")
def val_header(spark, sf_dir):
    """The first lines of five written files, judged."""
    out = []
    for name, header in HEADERS.items():
        line = spark.createDataFrame([(header,)], "value string")
        path = once(spark, sf_dir, f"header-{name}", lambda path, line=line: line.coalesce(1).write.text(path))
        first = spark.read.text(path).first()
        out.append((name, validate.check_header(first and first.value, ("source1_entity_id", "matched_entity_ids"))))
    return spark.createDataFrame(out, "file string, verdict string")


_FOUND = {
    "malformed": "SELECT id FROM pl WHERE malformed", "intra_duplicate": "SELECT id FROM gd WHERE len(ids)<>len(list_distinct(ids))",
    "self_match": "SELECT id FROM gd WHERE len([x for x in ids if starts_with(x,'S1-')])>0", "bad_prefix": "SELECT id FROM gd WHERE len([x for x in ids if not regexp_matches(x,'^S[123]-')])>0",
    "duplicate_row": "SELECT id FROM gd GROUP BY 1 HAVING count(*)>1", "missing": "SELECT entity_id AS id FROM rec WHERE src='S1' AND entity_id NOT IN (SELECT id FROM gd)",
    "extra": "SELECT DISTINCT id FROM gd WHERE id NOT IN (SELECT entity_id FROM rec WHERE src='S1')",
    "unknown": "SELECT id FROM (SELECT DISTINCT unnest(ids) AS id FROM gd) WHERE id NOT IN (SELECT entity_id FROM rec WHERE src<>'S1')",
}


@query(" UNION ALL ".join(
    f"SELECT '{k}' AS issue, count(*) AS n, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE r<=5),'') AS ids, count(*)>0 AS failed FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM ({v}))" for k, v in _FOUND.items()), L.LINES, L.PARSED)
def val_exit(spark, sf_dir):
    """Every rule with how often it is broken, its first ids, and whether the file fails by it."""
    recs = D.noisy_records(spark, sf_dir)
    required, known = (recs.where(c).select(F.col("entity_id").alias("id")) for c in ("src = 'S1'", "src <> 'S1'"))
    return validate.examples(validate.parse_lines(L.result_lines(spark, sf_dir)), required, known).withColumn("failed", F.col("n") > 0)


_STRICT = """SELECT truth_key AS pos, CASE WHEN truth_key%97=1 THEN 'row_count' WHEN truth_key%89=2 THEN 'columns' WHEN truth_key%83=3 THEN 'id_order' WHEN truth_key%79=4 THEN 'duplicate' WHEN truth_key%73=5 THEN 'prefix' WHEN truth_key%71=6 THEN 'subset' END AS problem
FROM rec WHERE src='S1' AND (truth_key%97=1 OR truth_key%89=2 OR truth_key%83=3 OR truth_key%79=4 OR truth_key%73=5 OR truth_key%71=6)"""


@query(_STRICT)
def val_streaming(spark, sf_dir):
    """Three files read in step, with a fault of every kind here and there."""
    k = F.col("truth_key")
    s1 = D.noisy_records(spark, sf_dir).where("src = 'S1'").select(k.alias("pos"), "truth_key", "entity_id", F.concat_ws("\t", "entity_id", F.lit("n"), F.lit("a"), "country").alias("value"))
    lists = F.when(k % 79 == 4, "S2-1,S2-1").when(k % 73 == 5, "S2-1,X9-1").otherwise("S2-1,S3-1")
    candidates = s1.where(k % 97 != 1).select("pos", F.concat_ws("\t", F.when(k % 83 == 3, "S1-other").otherwise(F.col("entity_id")), lists, F.when(k % 89 == 2, "more")).alias("value"))
    matches = s1.select("pos", F.concat_ws("\t", "entity_id", F.when(k % 71 == 6, "S3-9").when(k % 2 == 0, "S2-1").otherwise("")).alias("value"))
    return validate.strict(s1.select("pos", "value"), candidates, matches)


SQL["src_lockstep"] = D.sql("SELECT truth_key AS pos, entity_id AS s, case when truth_key%50=3 then 'S1-other' else entity_id end AS c, entity_id AS m FROM rec WHERE src='S1' AND (truth_key%50=3 OR truth_key%31=5)")


def src_lockstep(spark, sf_dir):
    """Rows at which three files differ in their ids, or list a match that is no candidate."""
    s1 = D.noisy_records(spark, sf_dir).where("src = 'S1'").select(F.col("truth_key").alias("pos"), F.col("entity_id").alias("id"))
    c = s1.select("pos", F.when(F.col("pos") % 50 == 3, "S1-other").otherwise(F.col("id")).alias("id"), F.array(F.lit("S2-1")).alias("ids"))
    m = s1.select("pos", "id", F.when(F.col("pos") % 31 == 5, F.array(F.lit("S3-9"))).otherwise(F.array(F.lit("S2-1"))).alias("ids"))
    return validate.lockstep(s1, c, m)


QUERIES["src_lockstep"] = src_lockstep


# ---- Channels as a registry -------------------------------------------------------------------------------------

@query("SELECT * FROM (VALUES " + ", ".join(f"('{c.name}', {c.bit}, {c.cap}, {str(c.whole).lower()})" for c in C.CHANNELS.values()) + ") AS t(channel, bit, cap, whole)")
def chan_interface(spark, sf_dir):
    """The registered channels; another one is a further Channel with its own bit and keys."""
    return spark.createDataFrame([(c.name, c.bit, c.cap, c.whole) for c in C.CHANNELS.values()], "channel string, bit int, cap int, whole boolean")


@query(f"SELECT entity_id FROM rec EXCEPT SELECT entity_id FROM ({L.KEY_SQL['C']})", L.KR)
def flt_nonempty_key(spark, sf_dir):
    """Records whose addresses give no key: parts of keys that are missing make none."""
    recs = D.noisy_records(spark, sf_dir)
    return recs.select("entity_id").join(C.channel_keys(recs, ["C"]).select("entity_id"), "entity_id", "left_anti")


# ---- Models and inference ---------------------------------------------------------------------------------------

def half() -> Column:
    """Which half of the entities an entity is in, 0 or 1."""
    return F.pmod(F.crc32("s1_id"), F.lit(2))


#: Scores are worked out and written for so many parts of the candidates, one after the other, so that only one part's shuffled texts are on disk.
PARTS = 8


def in_parts(pairs: DataFrame, scores) -> DataFrame:
    """scores(pairs) of every pair, a part of the candidates at a time: what a join adds to candidates is made once for each."""
    out = None
    for part in range(PARTS):
        made = written(scores(pairs.where(F.pmod(F.xxhash64("cand_id"), F.lit(PARTS)) == part)), f"scores{part}")
        out = made if out is None else out.unionByName(made)
    return out


def model_files(spark, sf_dir) -> str:
    """A model trained on the pairs of half the entities, with its calibrated rule, saved."""
    def write(path: str) -> None:
        truth = D.truth(D.noisy_records(spark, sf_dir))
        training = matcher.training_set(L.lexical_pairs(spark, sf_dir).where(half() == 0), truth)
        model = matcher.fit(L.featured(spark, sf_dir, training))
        held = L.entities(spark, sf_dir).where(half() == 1)
        scored = in_parts(L.lexical_pairs(spark, sf_dir).where(half() == 1), lambda p: matcher.score(model, L.featured(spark, sf_dir, p)))
        best = decide.calibrate(scored, held, truth.where(half() == 1)).first()
        config = {
            "blocking": "A-L", "max_bucket_size": 80, "cap_per_channel": C.CHANNELS["A"].cap, "train_sample_s1": None, "val_sample_s1": None, "seed": 42,
            "tau": best.tau, "tau_null": best.tau_null, "delta_multi": best.delta, "validation_macro_f05": best.macro_f05,
            "validation_precision": best.tp / max(1, best.n_pred), "validation_recall": best.tp / max(1, truth.where(half() == 1).count()), "singleton_accuracy": None,
        }
        matcher.save_model(model, path, config)

    return once(spark, sf_dir, "model", write)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES)) + ") AS t(place, feature)")
def src_model(spark, sf_dir):
    """The features of the reloaded model, in the order that scoring asserts."""
    _, config = matcher.load_model(model_files(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(config["feature_names"])), "place int, feature string")


@query()
def snk_model(spark, sf_dir):
    """The saved configuration as name and JSON value."""
    _, config = matcher.load_model(model_files(spark, sf_dir))
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(config.items())], "name string, value string")


def scored_by_model(spark, sf_dir) -> DataFrame:
    """Every candidate pair of every entity, scored by the reloaded model."""
    model, _ = matcher.load_model(model_files(spark, sf_dir))
    return D.held(spark, sf_dir, "model scores", lambda: in_parts(L.lexical_pairs(spark, sf_dir), lambda p: matcher.score(model, L.featured(spark, sf_dir, p))))


@query()
def ml_score(spark, sf_dir):
    return scored_by_model(spark, sf_dir)


@query()
def agg_importance(spark, sf_dir):
    model, _ = matcher.load_model(model_files(spark, sf_dir))
    return spark.createDataFrame(sorted(matcher.importance(model).items(), key=lambda x: -x[1]), "feature string, gain double")


def cross_fitted(spark, sf_dir, pairs: DataFrame, featured, features, training, **sizes) -> DataFrame:
    """Scores of all pairs, those of each half of the entities by trees trained on the other half. One task trains a model, so both train at once."""
    rows = written(featured(training), "both halves")
    try:
        with ThreadPoolExecutor(2) as pool:
            models = list(pool.map(lambda fold: matcher.train(rows.where(half() != fold), features=features, **sizes), (0, 1)))
    finally:
        remove(rows)
    out = None
    for fold in (0, 1):
        scores = in_parts(pairs.where(half() == fold), lambda p, model=models[fold]: matcher.score(model, featured(p)))
        out = scores if out is None else out.unionByName(scores)
    return out


@query()
def ml_gbdt(spark, sf_dir):
    """Scores of the candidates of every entity."""
    pairs = L.lexical_pairs(spark, sf_dir)
    training = matcher.training_set(pairs, D.truth(D.noisy_records(spark, sf_dir)))
    return cross_fitted(spark, sf_dir, pairs, lambda p: L.featured(spark, sf_dir, p), FEATURES, training)


@query()
def ml_gbdt_legacy(spark, sf_dir):
    """The same with the 19 features, random negatives and parameters of the earlier models, on the candidates of A to G."""
    pairs = L.pair_table(spark, sf_dir).where(F.col("mask").bitwiseAND(L.mask_of("ABCDEFG")) != 0)
    training = matcher.random_negatives(pairs, D.truth(D.noisy_records(spark, sf_dir)))
    return cross_fitted(spark, sf_dir, pairs, lambda p: L.featured(spark, sf_dir, p, True), LEGACY_FEATURES, training, trees=150, depth=6, leaves=31, step=0.1, share=0.8, least=50)


@query()
def infer_run(spark, sf_dir):
    """Inference from end to end: reload, retrieve, score, decide, write both result files and read them back; ids as lists, all entities."""
    _, config = matcher.load_model(model_files(spark, sf_dir))
    everyone, scored = L.entities(spark, sf_dir), scored_by_model(spark, sf_dir)
    chosen = decide.by_null_margin(scored, config["tau"], config["tau_null"], config["delta_multi"])
    found = once(spark, sf_dir, "candidates", lambda path: tsv.write_id_lists(everyone, scored, path, ("source1_entity_id", "candidate_entity_ids")))
    matched = once(spark, sf_dir, "matches", lambda path: tsv.write_id_lists(everyone, chosen, path))
    read = [tsv.read_truth(spark, p).select("s1_id", F.col("cand_ids").alias(n)) for p, n in ((found, "candidates"), (matched, "matches"))]
    return read[0].join(read[1], "s1_id", "full").select("s1_id", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("candidates", "matches")])


COUNTERS = "SELECT (SELECT count(*) FROM rec WHERE src='S1') AS entities, (SELECT count(*) FROM sc) AS candidates, (SELECT count(*) FROM mg) AS matches, (SELECT count(DISTINCT s1_id) FROM mg) AS matched_entities"


@query(COUNTERS, *L.PAIR_BASE, L.SCORE, f"mg as ({L._MARGIN})")
def snk_infer_meta(spark, sf_dir):
    """Counters of an inference run, by the stand-in scores, as JSON and back."""
    scored = L.scored(spark, sf_dir)
    chosen = decide.by_null_margin(scored, 0.6, 0.7, 0.1)
    counts = [df.agg(*a) for df, a in (
        (L.entities(spark, sf_dir), [F.count(F.lit(1)).alias("entities")]), (scored, [F.count(F.lit(1)).alias("candidates")]),
        (chosen, [F.count(F.lit(1)).alias("matches"), F.count_distinct("s1_id").alias("matched_entities")]))]
    row = {k: v for df in counts for k, v in df.first().asDict().items()}
    report = spark.createDataFrame([row], "entities long, candidates long, matches long, matched_entities long")
    path = once(spark, sf_dir, "counters", lambda path: report.coalesce(1).write.json(path))
    return spark.read.schema(report.schema).json(path)


# ---- Fusion with vectors ----------------------------------------------------------------------------------------

_FUSED = """fz as (select coalesce(s.s1_id,d.s1_id) as s1_id, coalesce(s.cand_id,d.cand_id) as cand_id, s.s1_id is not null as lexical, coalesce(score, 0.65) as score
 from sc s full join (select s1_id, cand_id from truth where ascii(right(cand_id,1))%2=0) d on s.s1_id=d.s1_id and s.cand_id=d.cand_id),
ch as (select name, s1_id, cand_id from (select n.name, fz.*, max(score) over (partition by n.name, s1_id) as top from fz, (values ('lexical'),('fused')) as n(name) where n.name='fused' or lexical) where top>=0.7 and score>=0.6 and score>=top-0.1)"""
_FUSED_COUNTS = "ec as (select n.name, s.entity_id as s1_id, (select count(*) from truth t where t.s1_id=s.entity_id) as n_true, (select count(*) from ch where ch.name=n.name and ch.s1_id=s.entity_id) as n_pred, (select count(*) from ch join truth t using (s1_id, cand_id) where ch.name=n.name and ch.s1_id=s.entity_id) as tp from rec s, (values ('lexical'),('fused')) as n(name) where src='S1')"


@query(f"SELECT * FROM (SELECT name, {L.EVALUATION} FROM ec GROUP BY 1) JOIN (SELECT n.name, count(*) AS pairs, count(t.s1_id) AS recovered FROM fz LEFT JOIN truth t USING (s1_id, cand_id), (values ('lexical'),('fused')) as n(name) WHERE n.name='fused' OR lexical GROUP BY 1) USING (name)",
       *L.PAIR_BASE, L.SCORE, _FUSED, _FUSED_COUNTS)
def eval_fusion(spark, sf_dir):
    """The decisions on lexical candidates alone and on those united with dense ones, both evaluated; dense ones have a stand-in score."""
    recs = D.noisy_records(spark, sf_dir)
    truth = D.truth(recs)
    dense = truth.where(F.ascii(F.right("cand_id", F.lit(1))) % 2 == 0).withColumn("dense", F.lit(True))
    both = L.scored(spark, sf_dir).withColumn("lexical", F.lit(True)).join(dense, ["s1_id", "cand_id"], "full").fillna(0.65, ["score"])
    out = None
    for name, pairs in (("lexical", both.where("lexical")), ("fused", both)):
        chosen = decide.by_null_margin(pairs, 0.6, 0.7, 0.1)
        report = metrics.evaluate(metrics.entity_counts(L.entities(spark, sf_dir), truth, chosen))
        found = pairs.join(truth.withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.count("t").alias("recovered"))
        row = report.join(F.broadcast(found)).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    return out

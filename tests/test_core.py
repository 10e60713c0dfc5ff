import inspect

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold import catalog
from kinfold.functions import similarity as S
from kinfold.functions import text as T
from kinfold.operators import boosting, channels, decide, dense, features, matcher, metrics, sampling, validate
from kinfold.operators.records import records
from kinfold.sources import tsv
from kinfold.streaming import arrivals

SF = "/root/testdata/sf0.001"


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("function", "text", "expected"), [
    (T.base, "  Héllo   Wörld  ", "héllo wörld"), (T.base, "मॉडर्न   फाइनेंस", "मॉडर्न फाइनेंस"), (T.base, "ＡＢ　ﬁ", "ab fi"), (T.base, None, ""),
    (T.clean, "B&B Retail, Inc.", "b and b retail inc"), (T.clean, "<< Team Ecole >>", "team ecole"), (T.clean, "मॉडर्न फाइनेंस", "म डर न फ इन स"), (T.clean, "३४ x", "34 x"),
    (T.legal, "XYZ Pvt Ltd", "xyz private limited"), (T.legal, "XYZ Private Limited", "xyz private limited"), (T.legal, "Acme Robotics Inc.", "acme robotics incorporated"),
    (T.legal, "Apex Corp", "apex corporation"), (T.legal, "Delta Co.", "delta company"), (T.legal, "Income Tax Solutions", "income tax solutions"), (T.legal, "pvtltd", "private limited"),
    (lambda c: T.address(c, True), "123 Main St., Apt 4B", "123 main street apartment 4b"), (lambda c: T.address(c, True), "456 Park Rd.", "456 park road"),
    (T.squeeze, "williams bookkeeper", "wiliams bokeper"), (T.transliterate, "Plain ASCII", "Plain ASCII"), (T.transliterate, "Maison de Santé", "maison de sante"),
    (T.transliterate, "स्टार", "star"), (T.postals, "KH 570, NEW DELHI 110001", ["110001"]), (T.landmarks, "Plot 4 near Temple, opp. Bank", ["Temple", "Bank"]),
])
def test_text(spark, function, text, expected):
    assert value(spark, function, text) == expected


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_indel_ratio(spark):
    pairs = [("", ""), ("a", ""), ("kitten", "sitting"), ("private limited", "pvt ltd"), ("abc", "abc"), ("aab", "baa")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r.r == pytest.approx(1.0 if not r.a and not r.b else 2 * lcs(r.a, r.b) / (len(r.a) + len(r.b)))


def test_metrics(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    truth = spark.createDataFrame([("a", "S2-47"), ("a", "S3-812"), ("d", "S2-1")], "s1_id string, cand_id string")
    got = spark.createDataFrame([("a", "S2-47"), ("a", "S2-193"), ("a", "S3-812"), ("c", "S2-9"), ("d", "S3-2")], "s1_id string, cand_id string")
    rows = {r.s1_id: r.f05 for r in metrics.entity_metrics(metrics.entity_counts(e, truth, got)).collect()}
    assert rows == {"a": pytest.approx(5 / 7), "b": 1.0, "c": 0.0, "d": 0.0}


def test_channels(spark):
    rows = [("S1-1", "Apex Global Logistics Pvt Ltd", "12 Rue Verte near Temple 75001", "fr"), ("S2-1", "", "", "fr"), ("S2-2", "IBM", "9 Long Street Bengaluru", "in")]
    keys = channels.channel_keys(records(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")), ["A", "E", "G", "I", "L", "H1"])
    got = {(r.entity_id, r.channel, r.ktype, r.kval) for r in keys.collect()}
    assert ("S1-1", "E", "drop0", "global_logistics") in got and ("S1-1", "I", "landmark", "temple") in got and ("S1-1", "L", "acr_p3", "agl_750") in got
    assert ("S2-2", "L", "acr_city", "ibm_bengaluru") in got and not [k for k in got if k[0] == "S2-1"]


def test_decisions_and_split(spark):
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.85), ("a", "z", 0.5), ("b", "x", 0.6)], "s1_id string, cand_id string, score double")
    assert {(r.s1_id, r.cand_id) for r in decide.by_null_margin(scored, 0.5, 0.7, 0.1).collect()} == {("a", "x"), ("a", "y")}
    e = spark.range(1000).select(F.concat(F.lit("S1-"), "id").alias("s1_id"), (F.col("id") % 3).alias("g"))
    split = sampling.stratified_split(e, ["g"]).groupBy("g").pivot("fold").count().collect()
    assert sorted((r.train, r.val) for r in split) == [(267, 66), (267, 66), (268, 66)]
    best = decide.calibrate(scored, spark.createDataFrame([("a",), ("b",)], "s1_id string"), spark.createDataFrame([("a", "x"), ("a", "y")], "s1_id string, cand_id string")).first()
    assert best.macro_f05 == 1.0


def test_files(spark, tmp_path):
    path = str(tmp_path / "s.tsv")
    with open(path, "w") as f:
        f.write("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t A \tB\tfr\nS1-2\tx\nS1-3\tC\t\tin\n")
    assert [tuple(r) for r in tsv.read_source(spark, path).collect()] == [("S1-1", "A", "B", "fr"), ("S1-3", "C", "", "in")]
    assert tsv.read_source(spark, path).count() == 2
    assert tuple(tsv.audit_source(spark, path).first()) == (3, 1, True)
    with pytest.raises(Exception):
        tsv.read_source_strict(spark, path).collect()
    e, p = spark.createDataFrame([("a",), ("b",)], "s1_id string"), spark.createDataFrame([("a", "S3-2"), ("a", "S2-1")], "s1_id string, cand_id string")
    out = str(tmp_path / "out")
    tsv.write_id_lists(e, p, out)
    assert {(r.s1_id, tuple(r.cand_ids)) for r in tsv.read_truth(spark, out).collect()} == {("a", ("S2-1", "S3-2")), ("b", ())}
    assert validate.check_header("source1_entity_id\tmatched_entity_ids", ("source1_entity_id", "matched_entity_ids")) == "ok"
    assert validate.check_header("a,b", ("a", "b")) == "comma" and validate.check_header("", ("a", "b")) == "empty"


def test_reports_keep_empty_texts(spark, tmp_path):
    rows = [("S1-1", "", 0.5, True), ("S1-2", None, None, None), ("S1-3", "LATIN", 0.0, False)]
    report = spark.createDataFrame(rows, "id string, scripts string, x double, y boolean")
    tsv.write_report(report, str(tmp_path / "r"))
    assert sorted(map(tuple, tsv.read_report(spark, str(tmp_path / "r"), report.schema).collect())) == rows


@pytest.mark.parametrize(("name", "want"), [
    ("स्टार प्रोड्यूसर प्राइवेट लिमिटेड", {("rom_snk", "starprod")}), ("জয়", {("rom_exact", "jy")}), ("Santé Générale SARL", {("rom_exact", "sante generale sarl"), ("rom_snk", "santegen"), ("rom_pair", "sante_generale")}),
    ("Apex Co", {("rom_exact", "apex company"), ("rom_snk", "apexcomp"), ("rom_word", "apex")}),
])
def test_romanised_keys(spark, name, want):
    row = spark.createDataFrame([("S1-1", name, "", "in")], "entity_id string, business_name string, business_address string, country string")
    got = {(r.ktype, r.kval) for r in channels.channel_keys(records(row), ["J"]).collect()}
    assert want <= got


def test_transliteration_of_marks_and_scripts(spark):
    """A mark of its own is a gap; letters of the seven scripts go by the table, in texts with others too."""
    assert value(spark, T.transliterate, "Cafe\u0301 Ünïon") == "cafe union" and value(spark, T.transliterate, "½ Øre") == "1 2 re"
    assert value(spark, T.transliterate, "ಕರ್ನಾಟಕ Café") == "krnatk cafe" and value(spark, T.transliterate, "தமிழ்") == "thmizh"
    assert value(spark, T.scripts, "Apex मॉ Ж 12") == ["CYRILLIC", "DEVANAGARI", "LATIN"] and value(spark, T.ascii_digits, "२३ ৪৫") == "23 45"


def test_caps_of_postings(spark):
    keys = [(f"{s}-{i:03}", s, "fr", c, "t", "v") for s, n in (("S2", 20), ("S3", 20)) for i in range(n) for c in ("A", "C")]
    keys += [(f"S2-{i:03}", "S2", "fr", "H1", "h1", f"k{n}") for n in (150, 151, 300, 301) for i in range(n)]
    keys += [("S1-1", "S1", "fr", c, "t", "v") for c in ("A", "C")] + [("S1-1", "S1", "fr", "H1", "h1", f"k{n}") for n in (150, 151, 300, 301)]
    frame = spark.createDataFrame(keys, "entity_id string, src string, country string, channel string, ktype string, kval string")
    got = channels.candidate_pairs(frame, ["A", "C", "H1"]).collect()
    mask = {r.cand_id: r.mask for r in got}
    bit = lambda name: channels.mask_of([name])
    assert sum(bool(m & bit("A")) for m in mask.values()) == 30 and sum(bool(m & bit("C")) for m in mask.values()) == 15
    assert sum(bool(m & bit("H1@150")) for m in mask.values()) == 150 and sum(bool(m & bit("H1@300")) for m in mask.values()) == 300
    assert {r.hits for r in got if r.cand_id == "S2-003"} == {2}


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(dense, "ITEMS", 40)
    monkeypatch.setattr(dense, "QUERIES", 5)
    rng = np.random.default_rng(1)
    vectors = np.round(rng.normal(size=(300, 6)), 1)
    vectors[7] = 0
    vectors[20:30] = vectors[10:20]
    rows = [(i, i % 3 if i % 5 else 0, vectors[i].tolist()) for i in range(300)]
    frame = spark.createDataFrame([*rows, (900, 0, None)], "id long, label int, vector array<double>")
    got = dense.nearest(frame.where("id % 10 = 0"), frame, 4, "label").collect()
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for q, label, _ in rows[::10]:
        want = sorted((-round(float(unit[q] @ unit[i]), 6) + 0.0, i) for i, x, _ in rows if x == label)[:4]
        assert [(r.item_id, r.similarity) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in want]


def test_json_files(spark, tmp_path):
    ids = spark.createDataFrame([('S1-2',), ('S1-"quoted"\\',), ('S1-1',)], "id string")
    tsv.write_id_json(ids, str(tmp_path / "ids"))
    assert sorted(r.id for r in tsv.read_id_json(spark, str(tmp_path / "ids")).collect()) == sorted(r.id for r in ids.collect())
    import json
    assert json.loads("".join(next((tmp_path / "ids").glob("part-*.txt")).read_text())) == sorted(r.id for r in ids.collect())
    (tmp_path / "one.json").write_text('{"S1-1": ["S2-1", "S3-2"], "S1-2": []}')
    assert {tuple(r) for r in tsv.read_candidates_json(spark, str(tmp_path / "one.json")).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2")}
    (tmp_path / "list.json").write_text('["a", "b"]')
    assert [r.id for r in tsv.read_id_json(spark, str(tmp_path / "list.json")).collect()] == ["a", "b"]


def test_models(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"S1-{i}", f"S2-{i}", float(i % 2), *[float(i % 2) + float(rng.normal(scale=0.2)) for _ in features.FEATURES]) for i in range(200)]
    frame = spark.createDataFrame(rows, ["s1_id", "cand_id", "label", *features.FEATURES])
    model = matcher.fit(frame, trees=2, depth=2)
    matcher.save_model(model, str(tmp_path / "m"), {"tau": 0.5})
    again, config = matcher.load_model(str(tmp_path / "m"))
    assert config["tau"] == 0.5 and config["feature_names"] == features.FEATURES and set(matcher.importance(again)) == set(features.FEATURES)
    assert {(r.cand_id, r.score) for r in matcher.score(again, frame).collect()} == {(r.cand_id, r.score) for r in matcher.score(model, frame).collect()}
    with pytest.raises(ValueError, match="order"):
        matcher.load_model(str(tmp_path / "m"), features.FEATURES[::-1])


def test_pair_texts(spark):
    """Features made of one text a record, in Python, are those of the JVM."""
    from kinfold.operators import pair_texts

    rows = [("Apex  Global & Co.", "12 Rue Verte near Temple 75001"), ("Maison de Santé", "9 Long Street opp. Bank 110001"), ("स्टार Loggistics Pvt Ltd", "३४ Road 40007"), ("", ""), ("ab", "7"), ("IBM", "9 Long Street Bengaluru"), (None, None), ("Apex Global", "the 9"), ("apex the apex the", "9 9 75001 \t75002"), ("India Best Market", "= 7")]
    made = records(spark.createDataFrame([(f"S{1 + i % 3}-{i}", n, a, "in") for i, (n, a) in enumerate(rows * 3)], "entity_id string, business_name string, business_address string, country string"))
    ids = made.select(F.col("entity_id").alias("s1_id")).crossJoin(made.select(F.col("entity_id").alias("cand_id"))).withColumns({"hits": F.lit(2).cast("long"), "channel_hits": F.lit(2)})
    side = lambda frame, key, x: frame.select(F.col("entity_id").alias(key), x)
    for fields, text, jvm, names in (
        (features.with_feature_fields, pair_texts.with_text, features.pair_features, features.FEATURES),
        (features.with_legacy_fields, pair_texts.with_legacy_text, features.legacy_pair_features, features.LEGACY_FEATURES),
    ):
        a, b = (side(fields(made), key, F.struct("fields").alias(x)) for key, x in (("s1_id", "a"), ("cand_id", "b")))
        want = jvm(ids.join(a, "s1_id").join(b, "cand_id")).select("s1_id", "cand_id", *names)
        got = pair_texts.featured(ids.drop("channel_hits"), *[side(text(made), key, "text") for key in ("s1_id", "cand_id")], legacy=names is features.LEGACY_FEATURES).select("s1_id", "cand_id", *names)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 900


def test_trees():
    """A first split against all possible ones, scores against a walk down the trees, and all leaves and rounds asked for."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (4000, 4)) / 40
    x[:, 3] = 0.5
    y = (np.sin(9 * x[:, 0]) + x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=4000) > 0.5).astype(float)
    edges = [sorted(set(c)) for c in x.T.tolist()]
    cut = [(x[:1500], y[:1500]), (x[1500:1500], y[1500:1500]), (x[1500:], y[1500:])]
    one = boosting.grow(cut, list("abcd"), edges, 1, 2, 1, 1.0, 1.0, 40, 1)
    best = max((sum((y[s] - y.mean()).sum() ** 2 / s.sum() for s in (x[:, j] <= e, x[:, j] > e)), j, k) for j in range(3) for k, e in enumerate(edges[j][:-1]) if min((x[:, j] <= e).sum(), (x[:, j] > e).sum()) >= 40)
    assert (one.feature[0][0], one.bin[0][0]) == best[1:]
    whole = boosting.grow(cut, list("abcd"), edges, 250, 63, 8, 0.08, 0.85, 20, 42)
    assert len(whole.feature) == 250 and {sum(f < 0 for f in tree) for tree in whole.feature[:10]} == {63}
    raw = np.full(200, whole.start)
    for feature, limit, left, value in zip(whole.feature, whole.bin, whole.left, whole.value, strict=True):
        for i in range(200):
            node = 0
            while feature[node] >= 0:
                node = left[node] + int(x[i, feature[node]] > edges[feature[node]][limit[node]])
            raw[i] += value[node]
    assert np.allclose(whole.probability(x[:200]), 1 / (1 + np.exp(-raw)), rtol=0, atol=1e-12)
    assert np.mean((whole.probability(x) > 0.5) == y) > 0.9 and whole.gain[3] == 0
    for labels in (np.zeros(50), np.ones(50)):
        assert np.allclose(boosting.grow([(x[:50], labels)], list("abcd"), edges, 5, 63, 8, 0.1, 0.85, 10, 1).probability(x[:9]), labels[:9], atol=1e-6)


@pytest.mark.parametrize(("name", "sizes"), [("ml_gbdt", (250, 63, 8, 0.08, 0.85, 40)), ("ml_gbdt_legacy", (150, 31, 6, 0.1, 0.8, 50))])
def test_published_sizes(spark, monkeypatch, name, sizes):
    """Both halves' models have the rounds, leaves, depth, step, share of features and least rows that were published."""
    real, seen = matcher.train, []

    def train(rows, **given):
        asked = inspect.signature(real).bind(rows, **given)
        asked.apply_defaults()
        seen.append(tuple(asked.arguments[k] for k in ("trees", "leaves", "depth", "step", "share", "least")))
        return real(rows, **given | {"trees": 1})

    monkeypatch.setattr(matcher, "train", train)
    scores = catalog.QUERIES[name](spark, SF)
    assert seen == [sizes, sizes] and scores.count() == scores.select("s1_id", "cand_id").distinct().count() > 0


def test_scores_in_parts(spark):
    from kinfold.plans import files

    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{j}", i + j) for i in range(40) for j in range(3)], "s1_id string, cand_id string, hits int")
    seen = []

    def scores(part):
        seen.append(part.count())
        return part.select("s1_id", "cand_id", (F.col("hits") / 100).alias("score"))

    out = files.in_parts(pairs, scores)
    assert sum(seen) == 120 and max(seen) < 60
    assert sorted(map(tuple, out.collect())) == sorted((r.s1_id, r.cand_id, r.hits / 100) for r in pairs.collect())


def test_short_fields(spark):
    """Features of pairs that travel with short texts are those of whole fields, and no part repeats a candidate."""
    from kinfold.plans import files

    rows = [("Apex  Global & Co.", "12 Rue Verte near Temple 75001"), ("Maison de Santé", "9 Long Street opp. Bank 110001"), ("स्टार Loggistics Pvt Ltd", "३४ Road 40007"), ("", ""), ("ab", "7"), ("IBM", "9 Long Street Bengaluru"), (None, None), ("Apex Global", "")]
    made = records(spark.createDataFrame([(f"S{1 + i % 3}-{i}", n, a, "in") for i, (n, a) in enumerate(rows * 3)], "entity_id string, business_name string, business_address string, country string"))
    ids = made.select(F.col("entity_id").alias("s1_id")).crossJoin(made.select(F.col("entity_id").alias("cand_id"))).withColumn("channel_hits", F.lit(1))
    side = lambda frame, key, x: frame.select(F.col("entity_id").alias(key), x)
    b = side(features.with_feature_fields(made), "cand_id", F.struct("fields").alias("b"))
    whole = features.pair_features(ids.join(side(features.with_feature_fields(made), "s1_id", F.struct("fields").alias("a")), "s1_id").join(b, "cand_id"))
    short = features.with_fields_of(ids.join(side(features.with_short_fields(made), "s1_id", F.col("short").alias("a")), "s1_id").join(b, "cand_id"), "a")
    got = lambda frame: sorted(map(tuple, frame.select("s1_id", "cand_id", *features.FEATURES).collect()))
    assert got(features.pair_features(short, a="a_")) == got(whole) and len(got(whole)) == 24 * 24
    old = lambda frame: sorted(map(tuple, frame.select("s1_id", "cand_id", *features.LEGACY_FEATURES).collect()))
    b = side(features.with_legacy_fields(made), "cand_id", F.struct("fields").alias("b"))
    whole = features.legacy_pair_features(ids.join(side(features.with_legacy_fields(made), "s1_id", F.struct("fields").alias("a")), "s1_id").join(b, "cand_id"))
    short = features.with_legacy_fields_of(ids.join(side(made, "s1_id", features.short_legacy_fields().alias("a")), "s1_id").join(b, "cand_id"), "a")
    assert old(features.legacy_pair_features(short, a="a_")) == old(whole)
    parts = []
    files.in_parts(ids.withColumn("score", F.lit(0.5)), lambda p: parts.append({r.cand_id for r in p.collect()}) or p)
    assert sum(map(len, parts)) == len(set().union(*parts)) == 24


def test_either_uncapped(spark):
    """Keys with many pairs are dealt over tasks; ids of several records give each pair once."""
    from kinfold.plans import linkage

    rows = [(f"S1-{i}", "S1", "fr", "hot", "road" if i % 2 else "") for i in range(60)] + [(f"S2-{i}", "S2", "fr", "hot", "road") for i in range(90)]
    rows += [("S1-a", "S1", "fr", "", "lane"), ("S3-a", "S3", "fr", "", "lane"), ("S3-b", "S3", "de", "x", "lane"), ("S1-c", "S1", "de", "x", ""), ("S3-0", "S3", "fr", None, "road"), ("S1-z", "S1", None, "hot", "road")]
    rows += [("S1-1", "S1", "fr", "hot", "lane"), ("S2-1", "S2", "fr", "x", "lane"), ("S2-1", "S2", "fr", "hot", "lane"), ("S2-2", "S2", "fr", "hot", "road")]
    for given in (rows, rows[:-4]):
        frame = spark.createDataFrame(given, "entity_id string, src string, country string, clean_name string, clean_addr string")
        got = linkage.either_uncapped(frame, 16).withColumn("task", F.spark_partition_id()).collect()
        same = lambda x, y: x[2] and x[2] == y[2] and ((x[3] and x[3] == y[3]) or (x[4] and x[4] == y[4]))
        want = sorted({(x[0], y[0]) for x in given for y in given if x[1] == "S1" and y[1] != "S1" and same(x, y)})
        assert sorted((r.s1_id, r.cand_id) for r in got) == want and len(want) > 5400
        tasks = [r.task for r in got]
        assert max(map(tasks.count, set(tasks))) < 0.5 * len(want)


def test_strict_files(spark):
    lines = lambda rows: spark.createDataFrame(list(enumerate(rows)), "pos long, value string")
    source = lines([f"S1-{i}\tn\ta\tfr" for i in range(8)])
    found = lines(["S1-0\tS2-1,S3-1", "S1-1\t", "S1-9\tS2-1", "S1-3\tS2-1,S2-1", "S1-4\tX2-1", "S1-5\tS2-1", "S1-6\tS2-1\tmore", "S1-7\tS2-1"])
    matched = lines(["S1-0\tS3-1", "S1-1\t", "S1-2\t", "S1-3\t", "S1-4\t", "S1-5\tS3-5", "S1-6\t"])
    got = {r.pos: r.problem for r in validate.strict(source, found, matched).collect()}
    assert got == {2: "id_order", 3: "duplicate", 4: "prefix", 5: "subset", 6: "columns", 7: "row_count"}


def test_arrivals(spark, tmp_path):
    """A stream of new records against stored postings finds what a batch finds."""
    rows = [("S1-1", "Apex Global Logistics Ltd", "12 Rue Verte 75001", "fr"), ("S1-2", "Nothing Alike", "", "fr")]
    held = records(spark.createDataFrame([("S2-1", "Apex Global Logistics Limited", "12 Rue Verte 75001", "fr")], "entity_id string, business_name string, business_address string, country string"))
    names = ["A", "C", "E", "G"]
    postings = channels.postings(channels.channel_keys(held, names), names).drop("n")
    frame = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = arrivals.match_arrivals(stream, postings, names).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {tuple(r) for r in arrivals.match_arrivals(frame, postings, names).collect()}
    assert {tuple(r) for r in spark.table("arrived").collect()} == want and {r[0] for r in want} == {"S1-1"}


@pytest.mark.parametrize("name", [
    "fn_legal", "fn_translit", "sim_dice", "sim_indel_ratio", "feat_all", "blk_e", "blk_j", "blk_d_relaxed", "blk_audit", "idx_postings", "join_hits", "join_exact_clean_pair", "join_exact_base_name", "union_nested", "union_v2",
    "agg_dup_rate", "agg_exact_eval", "agg_miss_audit", "agg_volume_nearest", "agg_len_stats", "cal_grid", "eval_fusion", "knn_dense", "smp_stratified", "snk_markdown", "snk_miss_tsv", "src_tsv", "src_dict", "src_idlist_json",
    "src_truth", "topk_char_tfidf", "val_exit", "val_prefix", "val_streaming", "val_unknown",
])
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "part", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = c.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    same = lambda r: str(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r))
    assert got.columns and sorted(got.columns) == sorted(columns)
    assert sorted(same(r[c] for c in columns) for r in got.collect()) == sorted(map(same, want.fetchall()))

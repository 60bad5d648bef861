"""Literal tables with values worked out by hand from the rules."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colscope import DataComparator, DataProfiler, RelationshipAnalyzer, RelationshipConfig, profile_of, semantic_type_counts, semantic_types
from colscope.functions import special
from colscope.operators import corr, relate
from colscope.operators.corr import tau_b


def by(df, key="column"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def f1(spark):
    age = [25.0, 32.0, 47.0, None, 29.0, 400.0]
    salary = [50000, 60000, 75000, 52000, 61000, 59000]
    city = ["Delhi", "Mumbai", "Delhi", "Pune", "Mumbai", " Mumbai"]
    return spark.createDataFrame(list(zip(age, salary, city, range(1, 7), strict=True)), "age double, salary long, city string, id long")


@pytest.fixture(scope="module")
def farm(spark):
    rnd = random.Random(0)
    rows = []
    for i in range(1000):
        district = f"D{rnd.randrange(5)}"
        distance = rnd.uniform(1, 100)
        land = rnd.uniform(1, 10)
        procurement = 100 * int(district[1]) + rnd.gauss(0, 20)
        rows.append((i, f"Farmer {i}", district, land, procurement, distance, 3 * distance + rnd.gauss(0, 5), procurement * 2, 1))
    return spark.createDataFrame(rows, "farmer_id long, farmer_name string, district string, land_area double, procurement double, distance double, transport_cost double, quantity_kg double, constant_col long").cache()


def test_schema_and_statistics(f1):
    s = by(f1.profile.schema())
    assert [(r.position, r.column) for r in f1.profile.schema().collect()] == [(1, "age"), (2, "salary"), (3, "city"), (4, "id")]
    assert (s["age"].non_null_count, s["age"].missing_count, s["age"].missing_pct, s["age"].unique_count) == (5, 1, 16.67, 5)
    assert s["city"].unique_pct == 66.67
    r = by(f1.profile.statistics())
    age = r["age"]
    want = (106.6, 32.0, 164.2264, 29.0, 47.0, 329.4, 385.88, 2.2219, 4.9478, 53.4477, 38.6072, 181.4933, 117.36, 154.0585, 0)
    assert (age["mean"], age.median, age["std"], age.q1, age.q3, age.p95, age.p99, age.skewness, age.kurtosis, age.geometric_mean, age.harmonic_mean, age.rms, age.mad, age.cv_pct, age.z_outlier_count) == want
    assert (r["id"].skewness, r["id"].kurtosis, r["id"].cv_pct) == (0.0, -1.2, 53.4522)
    assert (r["city"]["mode"], r["city"].mode_frequency, r["city"]["mean"]) == ("Delhi", 2, None)
    q = by(f1.profile.quality())
    assert (q["age"].outlier_count, q["age"].outlier_pct, q["city"].duplicate_count, q["city"].zero_count) == (1, 16.67, 2, None)


def test_scores(f1):
    got = {r.metric: r.score for r in f1.profile.quality_score().collect()}
    want = {"Overall Quality Score": 96.66, "Missing Score": 95.83, "Duplicate Score": 100.0, "Outlier Score": 91.66, "Data Type Score": 100.0, "Invalid Values Score": 95.83}
    assert all(abs(got[k] - v) <= 0.011 for k, v in want.items()) and list(got) == list(want)
    c = by(f1.profile.quality_score(by="column"))
    assert (c["age"].quality_score, c["salary"].quality_score, c["city"].quality_score, c["id"].quality_score) == (93.33, 96.67, 90.0, 100.0)
    only = {r.metric: r.score for r in f1.profile.quality_score(weights={"missing": 1, "duplicates": 0, "outliers": 0, "dtypes": 0, "invalid": 0}).collect()}
    assert only["Overall Quality Score"] == only["Missing Score"]


def test_ml_and_etl(f1):
    m = by(f1.profile.ml())
    assert m["id"].feature_status == "Possible ID" and m["age"].transformation == "Log Transform" and m["age"].scaling_suggestion == "RobustScaler"
    assert (m["city"].cardinality, m["city"].encoding_suggestion) == ("Low", "OneHot Encoding")
    e = by(f1.profile.etl())
    assert e["city"].issue == "Duplicate Values, Extra Spaces" and e["city"].recommended_action == "Remove Duplicates"
    assert e["age"].issue == "Missing Values, Outliers" and e["age"].etl_status == "Needs Cleaning" and e["id"].etl_status == "Ready"


def test_reports_are_one_kernel_run(f1):
    p = DataProfiler(f1)
    report = p.info_dataframe()
    assert list(report) == ["Schema", "Statistics", "Quality", "ML", "ETL"]
    assert report["Schema"].count() == 4 and len(p._stats) == 1
    text = repr(report)
    assert "6 rows  ×  4 columns" in text and "Quality Score" in text
    assert "<html" in report._repr_html_() and "—" in report._repr_html_()


def test_errors(spark, f1):
    for bad in (lambda: DataProfiler([1]), lambda: RelationshipAnalyzer(1), lambda: DataComparator().summary(f1, 1), lambda: profile_of(None)):
        with pytest.raises(TypeError):
            bad()
    p = f1.profile
    for bad in (
        lambda: p.info("x"), lambda: p.schema("x"), lambda: p.quality_score(by="x"), lambda: p.quality_score(weights={"x": 1}),
        lambda: p.quality_score(weights=dict.fromkeys(("missing", "duplicates", "outliers", "dtypes", "invalid"), 0)), lambda: p.pii(min_confidence=101),
        lambda: p.correlations("x"), lambda: p.correlations(by="x"), lambda: f1.select("city", "id").profile.correlations(), lambda: p.alerts(min_severity="x"),
        lambda: p.compare(f1, level="x"), lambda: p.compare(f1, columns=["nope"]), lambda: f1.select("city").profile.schema("numeric"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_odd_values(spark):
    rows = [(float("nan"), float("inf"), True, None, " x", [1.0], {"a": 1}), (1.0, 1.0, False, None, "é", [1.0], {"a": 1}), (None, -1.0, True, None, "", None, None)]
    df = spark.createDataFrame(rows, "nan double, inf double, flag boolean, empty string, `a.b c` string, arr array<double>, m map<string,int>")
    s = by(df.profile.schema())
    assert s["nan"].missing_count == 2 and s["empty"].unique_count == 0 and s["arr"].unique_count == 1 and s["m"].unique_count == 1
    q = by(df.profile.quality_score(by="column"))
    assert q["inf"].data_type_score == 66.67
    assert by(df.profile.etl())["a.b c"].space_issue_count == 1 and by(df.profile.etl())["a.b c"].empty_string_count == 1
    none = df.limit(0)
    for part in (none.profile.schema(), none.profile.statistics(), none.profile.quality(), none.profile.ml(), none.profile.etl(), none.profile.quality_score()):
        assert part.count() >= 6
    assert none.profile.alerts().count() == 0
    assert profile_of(df.select("empty")).pii().count() == 0


def test_pii(spark):
    cols = {
        "email": ["john.doe@gmail.com", "a@b.co", "x.y@z.org", "q@r.io", "none"],
        "mobile": ["9876543210", "+91 98765 43210", "919876543210", "(987) 654-3210", "12"],
        "pan_no": ["ABCDE1234F", "ABCDE1235F", "ABCDE1236F", "ABCDE1237F", "x"],
        "aadhaar": ["1234 5678 9012", "1234 5678 9013", "123456789014", "1234 5678 9015", "x"],
        "ip_col": ["192.168.1.1", "10.0.0.1", "8.8.8.8", "300.1.1.1", "01.2.3.4"],
        "full_name": ["Rahul Sharma", "Anna-Lena O'Neil", "J. R. Smith", "Ann Lee", "x"],
        "address": ["12 Main Street, Pune", "Flat 3, Sector 9", "4 Lake Road", "77 Park Avenue", "nowhere"],
        "salary": [50000, 60000, 70000, 80000, 90000],
    }
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} {'long' if c == 'salary' else 'string'}" for c in cols))
    found = {r.column: (r.pii_type, r.confidence_pct) for r in df.profile.pii().collect()}
    assert found == {
        "email": ("EMAIL", 90.0), "mobile": ("PHONE", 90.0), "pan_no": ("POSSIBLE_PAN", 90.0), "aadhaar": ("POSSIBLE_ID", 90.0), "ip_col": ("IP", 70.0),
        "full_name": ("POSSIBLE_NAME", 90.0), "address": ("POSSIBLE_ADDRESS", 90.0),
    }
    m = df.profile.pii(mask=True).first()
    assert tuple(m)[:7] == ("j*******@gmail.com", "98******10", "AB*******F", "********9012", "192.168.1.***", "R**** S*****", "[REDACTED ADDRESS]") and m.salary == 50000
    assert spark.createDataFrame([(9876543210 + i,) for i in range(3)], "mobile long").profile.pii().first().pii_type == "PHONE"


def test_correlations(spark, f1):
    rnd = random.Random(1)
    rows = [(a := rnd.gauss(0, 1), 2 * a + rnd.gauss(0, 0.05), rnd.gauss(0, 1), 1.0, None if i % 5 == 0 else a * a * (1 if a > 0 else -1)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double, d double")
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=list("abckd"))
    p = {(r.column_a, r.column_b): r for r in df.profile.correlations(by="pairs").collect()}
    assert len(p) == 6 and abs(p["a", "b"].correlation - pdf.a.corr(pdf.b)) < 1e-4 and p["a", "b"].r_squared == round(p["a", "b"].correlation ** 2, 4)
    s = {(r.column_a, r.column_b): r.correlation for r in df.profile.correlations("spearman", "pairs").collect()}
    part = pdf[["c", "d"]].dropna().rank()
    assert abs(s["c", "d"] - part.c.corr(part.d)) < 1e-4 and s["a", "d"] == 1.0
    assert df.profile.correlations(by="pairs", threshold=0.9).count() >= 1
    m = by(df.profile.correlations())
    assert m["a"]["a"] == 1.0 and m["a"]["b"] == m["b"]["a"] and m["k"]["a"] is None and m["k"]["k"] is None
    k = {(r.column_a, r.column_b): r.correlation for r in spark.createDataFrame([(1, 1), (2, 3), (3, 2), (3, 3), (4, 9), (1, 1)], "x int, y int").profile.correlations("kendall", "pairs").collect()}
    xs, ys = [1, 2, 3, 3, 4, 1], [1, 3, 2, 3, 9, 1]
    sign = lambda v: (v > 0) - (v < 0)
    pairs = [(sign(xs[i] - xs[j]), sign(ys[i] - ys[j])) for i in range(6) for j in range(i)]
    want = sum(a * b for a, b in pairs) / math.sqrt(sum(a * a for a, _ in pairs) * sum(b * b for _, b in pairs))
    assert abs(k["x", "y"] - want) < 1e-4
    import numpy as np

    assert tau_b(np.array([1.0]), np.array([1.0]), np.array([5.0])) is None


def test_alerts(spark):
    rows = [(25.0, 1, "a@b.co", "1", "x"), (32.0, 1, "c@d.co", "2", "y"), (47.0, 1, "e@f.co", "3", "x"), (None, 1, "g@h.co", "4", "y"), (29.0, 1, "i@j.co", "5", "x"), (400.0, 1, "k@l.co", "6", "z")]
    df = spark.createDataFrame(rows, "age double, constant_col long, email string, code_as_text string, city string")
    got = {(r.column, r.alert): r.severity for r in df.profile.alerts().collect()}
    assert got == {
        ("constant_col", "Constant Column"): "High", ("email", "Potential PII"): "High", ("age", "Missing Values"): "Medium", ("age", "Skewed Distribution"): "Medium",
        ("age", "Outliers"): "Medium", ("code_as_text", "Wrong Data Type"): "Medium",
    }
    assert df.profile.alerts(min_severity="high").count() == 2
    twice = spark.createDataFrame([(i % 2,) for i in range(30)], "x long").profile.alerts()
    assert ("(table)", "Duplicate Rows") in {(r.column, r.alert) for r in twice.where("severity = 'High'").collect()}


def test_semantic_types(spark):
    n = 40
    cols = {
        "user_id long": range(n), "amount double": [i * 1.5 for i in range(n)], "lat double": [i / 2 for i in range(n)], "tax_rate double": [i / 100 for i in range(n)], "z double": [float(i) for i in range(n)],
        "yes string": ["Yes" if i % 2 else "no" for i in range(n)], "one string": ["c"] * n, "mail string": [f"u{i}@x.org" for i in range(n)], "tel string": [f"98765432{i:02}" for i in range(n)],
        "day string": [f"2020-01-{i % 28 + 1:02}" for i in range(n)], "about string": [f"this is a long free text number {i}" for i in range(n)], "grp string": ["abc"[i % 3] for i in range(n)], "tag string": [f"t{i}" for i in range(n)], "none string": [None] * n,
    }
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(cols))
    got = semantic_types(df)
    assert list(got.values()) == ["id", "currency", "latitude", "percentage", "numeric", "boolean", "constant", "email", "phone", "date", "text", "categorical", "id", "categorical"]
    assert semantic_type_counts(df)["categorical"] == 2


def test_relationships(farm):
    r = farm.profile.relationships()
    rows = {(x["column_a"], x["column_b"]): x for x in r.rows}
    x = rows["distance", "transport_cost"]
    assert x["method"] in ("Pearson", "Spearman") and x["strength"] > 0.9 and (x["classification"], x["direction"], x["significance"], x["confidence"]) == ("Strong", "Positive", "Significant", "High")
    assert rows["district", "procurement"]["strength"] > 0.5 and rows["district", "procurement"]["method"] == "ANOVA (eta²)"
    assert not any({"constant_col", "farmer_id"} & set(p) for p in rows)
    assert ("farmer_id", "farmer_name") in {d[:2] for d in r.dependency_rows if d[2] > 99}
    assert ["procurement", "quantity_kg"] in r.groups
    s = r.summary()
    assert s["pairs_analyzed"] + s["ignored_pairs"] == s["possible_pairs"] == 36 and len(s) == 13 and s["pairs_analyzed"] == r.to_dataframe().count()
    top = [x.strength for x in r.top(3).collect()]
    assert top == sorted(top, reverse=True)
    m = by(r.matrix())
    assert m["distance"]["transport_cost"] == m["transport_cost"]["distance"] and m["distance"]["distance"] == 1.0
    assert any("causation" in i for i in r.insights())
    assert json.loads(r.to_json())["summary"]["strong"] == s["strong"]
    page, plain = r.to_html(), r.to_html(style="table")
    assert all(x in page for x in ("<svg", "foreignObject", "Top Relationships", "Insights", "Redundant / Derived Columns")) and "<svg" not in plain
    with pytest.raises(ValueError):
        r.to_html(style="x")
    g = r.graph(2)
    assert len(g) == 2 and g.nodes == sorted(g.nodes) and g.to_dataframe().count() == 2


def test_relationship_rules(spark):
    few = RelationshipAnalyzer(spark.createDataFrame([(i, i * i) for i in range(5)], "a long, b long")).analyze()
    assert few.rows[0]["notes"] == "Not enough valid observations" and few.insights() == ["[none] no pair stands out"]
    assert "No meaningful relationships to graph" in few.to_html() and "empty" in repr(few.graph())
    rnd = random.Random(4)
    rows = [(a := rnd.choice("xyz"), a.upper(), f"k{i % 60}", f"2020-{i // 28 % 12 + 1:02}-{i % 28 + 1:02}", float(i // 28 % 12 * 31 + i % 28)) for i in range(336)]
    df = spark.createDataFrame(rows, "a string, b string, many string, `day` string, sales double")
    r = RelationshipAnalyzer(df).analyze()
    got = {(x["column_a"], x["column_b"]): x for x in r.rows}
    assert got["a", "b"]["strength"] == 1.0 and got["a", "b"]["notes"] == "Normalized Mutual Info: 1.00"
    assert got["many", "sales"]["notes"].startswith("Too many") and got["many", "sales"]["classification"] == "Not Meaningful"
    assert (got["day", "sales"]["direction"], got["day", "sales"]["method"]) == ("Increasing", "Datetime Trend (Spearman)") and got["day", "sales"]["strength"] > 0.99
    assert ("a", "day") not in got
    capped = RelationshipAnalyzer(df, RelationshipConfig(max_pairs=2, sample_size=100)).analyze()
    assert capped.summary()["capped_at_max_pairs"] and capped.summary()["analyzed_rows"] == 100 and capped.summary()["is_sampled"]
    ids = spark.createDataFrame([(i, 100 - i) for i in range(100)], "id1 long, id2 long")
    assert not RelationshipAnalyzer(ids).analyze().rows and len(RelationshipAnalyzer(ids, RelationshipConfig(include_id_pairs=True, max_categories=200)).analyze().rows) == 1
    odd = spark.createDataFrame([(float(i), i * 2.0) for i in range(200)], "`a<script>` double, `b&col` double")
    page = RelationshipAnalyzer(odd).analyze().to_html()
    assert "<script>" not in page and "a&lt;script&gt;" in page


def test_equal_columns(spark):
    df = spark.createDataFrame([(i, i, 49 - i) for i in range(50)], "a long, b int, c long")
    assert relate.equal_columns(df) == [("a", "b")]
    assert relate.equal_columns(df, confirm=False) == [("a", "b"), ("a", "c")]


def test_special_functions():
    assert abs(special.p_correlation(0.5, 20) - 0.02477) < 1e-4
    assert abs(special.p_f(4.26, 2, 9) - 0.05) < 1e-3 and abs(special.p_chi2(3.841, 1) - 0.05) < 1e-3 and abs(special.p_chi2(18.307, 10) - 0.05) < 1e-3
    assert abs(special.p_kendall(0.0, 10) - 1) < 1e-12
    assert special.benjamini_hochberg([0.01, None, 0.04, 0.03, 0.5], 0.05) == [True, None, False, False, False]
    assert special.benjamini_hochberg([0.01, 0.02, 0.03, 0.04], 0.05) == [True] * 4


def test_compare(spark, f1):
    before = spark.createDataFrame([(25.0, "Delhi", 1), (32.0, "Mumbai", 2), (47.0, "Delhi", 3), (None, "Pune", 4), (29.0, "Mumbai", 5), (400.0, " Mumbai", 6)], "age double, city string, old_col long")
    after = spark.createDataFrame([(25, "Delhi", 1), (32, "Mumbai", 2), (47, "Delhi", 3), (30, "Pune", 4), (29, "Mumbai", 5), (48, "Mumbai", 6)], "age long, city string, new_col long")
    rows = {(r.section, r.metric): r for r in before.profile.compare(after).collect()}
    assert rows["Missing", "age"].status == "Fixed" and rows["Missing", "age"].change == -1
    assert (rows["Schema", "new_col"].status, rows["Schema", "old_col"].status, rows["Schema", "age"].status) == ("New Column", "Deleted Column", "Dtype Changed")
    assert rows["Outlier", "age"].status == "Reduced"
    assert (rows["Statistics", "age_mean"].before_value, rows["Statistics", "age_mean"].after_value) == (106.6, 35.1667)
    assert (rows["Quantile", "age_Q95"].before_value, rows["Quantile", "age_Q95"].after_value) == (329.4, 47.75)
    assert rows["Category", "city"].change == -1 and rows["Dataset", "Rows"].status == "Same" and rows["Dataset", "Missing Cells"].status == "Improved"
    assert before.profile.compare(before, changes_only=True).count() == 0
    assert {r.section for r in before.profile.compare(after, level="schema").collect()} == {"Schema"}
    assert {r.section for r in before.profile.compare(after, level="dataset").collect()} == {"Dataset"}
    s = by(before.profile.compare_summary(after))
    assert s["old_col"].status == "Removed" and s["new_col"].status == "Added" and s["age"].summary == "dtype double->bigint; missing 1->0; outliers 1->0; mean 106.6->35.17"
    assert "Comparison" in before.profile.compare_html(after)


def test_csv_and_html(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f"{i},{i * 0.5}\n" for i in range(5000)))
    p = DataProfiler.from_csv(str(path), sample_size=500, random_state=1, spark=spark)
    n = p.df.count()
    assert p.is_sampled and p.total_rows_in_source == 5000 and 300 <= n <= 900 and n == p.df.count()
    whole = DataProfiler.from_csv(str(path), spark=spark, columns=["b"])
    assert not whole.is_sampled and whole.df.columns == ["b"]
    out = tmp_path / "r.html"
    assert out.write_text(p.to_html()) and "Sampled" in p.to_html(str(out), section="Schema") and "<html" in out.read_text()


def test_repartitioning_changes_nothing(f1):
    for section in ("Schema", "Statistics", "Quality", "ML", "ETL"):
        assert f1.profile.info(section).collect() == f1.repartition(5, "city").profile.info(section).collect()


def test_streaming(spark, tmp_path):
    from colscope.streaming.windows import profile_batches, windowed_quality

    df = spark.createDataFrame([(f"2024-01-01 0{h}:{m:02}:00", None if m == 5 else float(m), "k") for h in range(3) for m in range(0, 30, 5)], "t string, x double, k string").select(F.col("t").cast("timestamp").alias("t"), "x", "k")
    df.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, windowed_quality(df, "t").collect()))
    assert want[0][2:] == (6, 1, 14.0, 0.0, 25.0, 0)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_quality(stream, "t").writeStream.outputMode("complete").format("memory").queryName("wq").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("wq").collect())) == want
    seen = []
    q = stream.writeStream.foreachBatch(profile_batches("schema", lambda r, e: seen.append(r.count()))).start()
    q.processAllAvailable()
    q.stop()
    assert seen and seen[0] == 3


def _jobs(spark, run):
    """What ``run`` returns, and the plan of every query that it started."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = store.executionsList(int(before), 100_000)
    return out, [found.apply(i).physicalPlanDescription() for i in range(found.size())]


def test_spearman_groups_once(spark):
    """One set of bounds and few jobs for all columns, however many pairs have nulls; and the ranks are right."""
    r = np.random.default_rng(3)
    n = 25_000
    a, b, c = r.normal(size=n), r.normal(size=n), r.integers(0, 5, n).astype(float)
    b += a
    d = np.where(r.random(n) < 0.3, np.nan, c + r.normal(size=n).round(1))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "d": d})).selectExpr("a", "b", "c", "nanvl(d, null) as d").cache()
    pairs = [(x, y) for i, x in enumerate("abcd") for y in "abcd"[i + 1 :]]
    got, plans = _jobs(spark, lambda: corr.spearman_pairs(df, pairs))
    want = pd.DataFrame({"a": a, "b": b, "c": c, "d": d})
    for x, y in pairs:
        part = want[[x, y]].dropna().rank()
        assert got[x, y] == (pytest.approx(part[x].corr(part[y]), abs=1e-9), len(part)), (x, y)
    assert sum("percentile_approx" in p for p in plans) == 1 and len(plans) < 20


def test_pearson_of_shifted_and_constant(spark):
    """Means are taken off within a pair's complete rows: a large offset, or a column that is constant only there, gives no noise."""
    rows = [(1e9 + i % 7, 0.1 if i % 2 else 5.0, float(i) if i % 2 else None, 1e9 + i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = corr.pearson_pairs(df, [("a", "d"), ("b", "c"), ("a", "b")])
    assert got["a", "d"] == (pytest.approx(1.0, abs=1e-12), 1000) and got["b", "c"] == (None, 500) and got["a", "b"][1] == 1000


def test_dependencies_sort_no_rows(spark):
    """Texts as targets: groups are kept in hash tables, and a source without repeats is not grouped at all."""
    rows = [(f"k{i:05}", f"g{i % 9}", f"name {i % 9} " + "x" * 3, f"h{i % 9 if i % 50 else i % 8}", None if i % 4 else "z") for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, g string, t string, h string, z string")
    out, plans = _jobs(spark, lambda: RelationshipAnalyzer(df).analyze().dependency_rows)
    found = {r[:2]: r[2:] for r in out}
    assert found["g", "t"] == (100.0, 2000) and found["k", "h"] == (100.0, 2000) and found["t", "g"] == (100.0, 2000) and ("h", "g") not in found
    assert plans and not any("SortAggregate" in p for p in plans)

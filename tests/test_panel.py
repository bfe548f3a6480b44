"""Parsing, calendar, roll-up, mapping, joins and contracts on small literals."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwise.functions import codes as C
from cellwise.functions import measures as M
from cellwise.operators import audit, checks, joins, labels, mapping, panel, profile, relations, rollup
from cellwise.operators import calendar as cal
from cellwise.sources import files, loads, sinks


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    "text, value",
    [("12", 12.0), (" 1.5 ", 1.5), ("-3", -3.0), ("1e3", 1000.0), ("D", None), ("N", None), ("S", None), ("X", None),
     ("", None), (None, None), ("12D", None), ("1_000", None), ("NaN", None), ("0", 0.0)],
)
def test_parse_measure(spark, text, value):
    assert one(spark, M.parse_measure(F.col("t")), t=text) == value


@pytest.mark.parametrize("text, estimate, margin", [("-666666666", None, None), ("-5", -5.0, None), ("7", 7.0, 7.0), ("-222222222", None, None)])
def test_sentinels(spark, text, estimate, margin):
    assert one(spark, M.parse_estimate(F.col("t")), t=text) == estimate
    assert one(spark, M.parse_margin(F.col("t")), t=text) == margin


def test_average_pay_rounds_half_even(spark):
    df = spark.createDataFrame([(5.0, 2.0), (7.0, 2.0), (3.0, 0.0)], "p double, e double")
    assert [r[0] for r in df.select(M.average_pay(F.col("p"), F.col("e"))).collect()] == [2.0, 4.0, None]


def test_missing_reason_cascade(spark):
    rows = [
        ("D", "5", "direct_match", "unresolved", "industry_mismatch"),
        ("D", "5", "unresolved", "unresolved", "geography_mismatch"),
        ("D", "S", "direct_match", "directly_comparable", "numerator_suppressed"),
        ("x1", "5", "direct_match", "directly_comparable", "numerator_missing"),
        ("4", "", "direct_match", "official_mapping_required", "denominator_missing"),
        ("4", "0", "direct_match", "directly_comparable", "denominator_zero"),
        ("4", "8", "direct_match", "directly_comparable", "other"),
        (None, "8", "direct_match", "directly_comparable", "numerator_missing"),
    ]
    df = spark.createDataFrame(rows, "n string, d string, p string, c string, want string")
    got = df.select("want", M.missing_ratio_reason(F.col("n"), F.col("d"), F.col("p"), F.col("c")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_codes(spark):
    assert one(spark, C.normalize_code(F.col("c"), 5), c=" 42 ") == "00042"
    assert one(spark, C.normalize_code(F.col("c"), 2), c="12345") == "12345"
    assert one(spark, C.sector_of(F.col("c")), c="321") == "31-33"
    assert one(spark, C.hash_bucket(F.col("c")), c="10180") == 7462
    for code, valid in (("31-33", True), ("33-31", False), ("1", False), ("1234567", False), ("11", True), ("ab", False)):
        assert one(spark, C.is_valid_code(F.col("c")), c=code) is valid
    with pytest.raises(Exception, match="No vintage"):
        one(spark, C.vintage_of(F.lit("BDS"), F.lit(1999)), c="x")


GROWTH = "geo int, ind int, yr int, employment double, is_suppressed boolean"


def test_growth_needs_the_prior_calendar_year(spark):
    rows = [
        (1, 1, 2020, 100.0, False), (1, 1, 2021, 110.0, False), (1, 1, 2023, 121.0, False),
        (1, 2, 2021, 50.0, False), (2, 1, 2020, 0.0, False), (2, 1, 2021, 5.0, False),
        (3, 1, 2020, 10.0, True), (3, 1, 2021, 20.0, False), (4, 1, 2020, 10.0, False), (4, 1, 2021, 20.0, True),
    ]
    df = spark.createDataFrame(rows, GROWTH)
    grown = cal.add(df, ["geo", "ind"], "yr", cal.growths({"employment": "g"}, "is_suppressed"))
    got = {(r.geo, r.ind, r.yr): r.g for r in grown.collect()}
    assert got[1, 1, 2021] == pytest.approx(0.1)
    assert got[4, 1, 2021] == pytest.approx(1.0)
    assert all(got[k] is None for k in [(1, 1, 2020), (1, 1, 2023), (1, 2, 2021), (2, 1, 2021), (3, 1, 2021)])


def test_lags_share_one_exchange(spark):
    df = spark.createDataFrame([(1, 1, 2020, 1.0, False)], GROWTH)
    plan = cal.add(df, ["geo", "ind"], "yr", cal.lags(["employment"], (1, 2, 3), "is_suppressed"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_exact_pairs(spark):
    df = spark.createDataFrame([("a", y, float(y)) for y in (2010, 2012, 2013, 2014, 2016)] + [("b", 2013, 1.0)], "k string, yr int, v double")
    got = cal.exact_pairs(df, ["k"], "yr", 3, ["v"], {"v": "later"}).collect()
    assert {(r.predictor_year, r.target_year, r.later) for r in got} == {(2010, 2013, 2013.0), (2013, 2016, 2016.0)}
    with pytest.raises(ValueError):
        cal.exact_pairs(df, ["k"], "yr", 0)


def test_transitions_need_consecutive_years(spark):
    rows = [("f", "a", 2013, 0, "training"), ("f", "a", 2014, 1, "validation"), ("f", "a", 2016, 0, "validation"), ("f", "a", 2017, 0, "validation")]
    df = spark.createDataFrame(rows, "fold string, k string, yr int, gap int, role string")
    got = cal.transitions(df, ["fold", "k"], "yr", "gap", "role", "validation").collect()
    assert sorted((r.yr, r.transition) for r in got) == [(2014, "non_gap_to_gap"), (2017, "non_gap_to_non_gap")]


def test_coverage_rollup(spark):
    rows = [
        ("g1", 2020, "m1", 1.0, False), ("g1", 2020, "m2", 2.0, False),
        ("g1", 2021, "m1", 1.0, False),
        ("g1", 2022, "m1", 1.0, False), ("g1", 2022, "m2", None, True),
        ("g1", 2023, "m1", 1.0, False), ("g1", 2023, "m2", None, False),
        ("g1", 2024, "m1", 0.0, False), ("g1", 2024, "m2", 0.0, False),
    ]
    df = spark.createDataFrame(rows, "g string, yr int, m string, v double, s boolean")
    expected = spark.createDataFrame([("g1", 2)], "g string, expected bigint")
    got = {r.yr: r for r in rollup.coverage_rollup(df, expected, ["g", "yr"], "g", "m", ["v"], "s").collect()}
    assert got[2020].is_complete and got[2020].v == 3.0
    assert got[2024].is_complete and got[2024].v == 0.0
    for year in (2021, 2022, 2023):
        assert not got[year].is_complete and got[year].v is None
    assert got[2022].members_suppressed == 1 and got[2023].members_missing == 1


def test_reciprocal_mapping(spark):
    edges = [("11", "11"), ("22", "23"), ("31", "40"), ("32", "40"), ("51", "51"), ("51", "52")]
    got = {r.source_code: (r.category_status, r.target_code) for r in mapping.reciprocal(spark.createDataFrame(edges, "old string, new string")).collect()}
    assert got["11"] == ("directly_comparable", "11")
    assert got["22"] == ("official_mapping_required", "23")
    assert {got[c] for c in ("31", "32", "51")} == {("unresolved", None)}


def test_broken_chain_fails(spark):
    first = spark.createDataFrame([("a", "b"), ("a", "c")], "old string, new string")
    second = spark.createDataFrame([("b", "d")], "old string, new string")
    with pytest.raises(Exception, match="No hand-off"):
        mapping.chain([first, second]).collect()
    assert [r.code for r in mapping.missing_handoffs(first, second).collect()] == ["c"]


def test_classification_parents(spark):
    codes = spark.createDataFrame([(c, "x") for c in ("31-33", "321", "3211", "321199", "11", "111", "3")], "c string, t string")
    got = {r.code: r.parent for r in mapping.classification(codes, "c", "t").collect()}
    assert got == {"31-33": None, "11": None, "111": "11", "321": "31-33", "3211": "321", "321199": "3211"}


def test_checked_join_fails_on_duplicates(spark):
    left = spark.createDataFrame([(1,), (1,)], "k int")
    right = spark.createDataFrame([(1, "a")], "k int, v string")
    assert joins.checked_join(left, right, ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate keys"):
        joins.checked_join(left, right, ["k"], validate="one_to_one").collect()
    with pytest.raises(Exception, match="duplicate keys"):
        joins.checked_join(right, left, ["k"]).collect()


def test_reconciled_fails_on_one_sided_key(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    assert joins.reconciled(a, a, ["k"], ["v"], "t").count() == 2
    with pytest.raises(Exception, match="sides disagree"):
        joins.reconciled(a, a.filter("k = 1"), ["k"], ["v"], "t").collect()


def test_collapse_conflict(spark):
    ok = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None), (2, None)], "k int, v double")
    assert {r.k: r.v for r in profile.collapse(ok, ["k"], ["v"]).collect()} == {1: 2.0, 2: None}
    for bad in ([(1, 2.0), (1, 3.0)], [(1, 2.0), (1, None)]):
        with pytest.raises(Exception, match="Conflicting"):
            profile.collapse(spark.createDataFrame(bad, "k int, v double"), ["k"], ["v"]).collect()


def test_numeric_summary_treats_infinity_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (16.0,), (32.0,), (64.0,), (float("inf"),), (None,)], "v double")
    got = profile.numeric_summary(df, ["v"]).first()
    assert (got["count"], got.missing_count, got.nonfinite_count) == (8, 1, 1)
    finite = pd.Series([1.0, 2, 4, 8, 16, 32, 64])
    assert got.median == 8.0 and got.excess_kurtosis == pytest.approx(finite.kurt()) and got.skewness == pytest.approx(finite.skew())
    assert profile.numeric_summary(spark.createDataFrame([(3.0,)] * 5, "v double"), ["v"]).first().skewness == 0.0


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert df.select(relations.pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_student_p_values():
    from cellwise.functions.tails import student_two_sided

    assert student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert student_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert student_two_sided(0.0, 7) == pytest.approx(1.0)


def test_quadrant_ties_are_high(spark):
    df = spark.createDataFrame([(1, "s", 1.0, 1.0), (1, "s", 2.0, 2.0), (1, "s", 3.0, None)], "yr int, ind string, r double, g double")
    got = {r.r: r.quadrant for r in relations.with_quadrants(df, ["yr", "ind"], "r", "g").collect()}
    assert got == {1.0: "low_growth_low_startup", 2.0: "high_growth_high_startup"}


def test_clustered_ols_matches_numpy(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.normal(size=300), "z": rng.choice(["a", "b", "c"], 300), "c": rng.integers(0, 30, 300)})
    pdf["y"] = 1 + 2 * pdf.x + (pdf.z == "b") * 3 + rng.normal(size=300)
    design = np.column_stack([np.ones(300), pdf.x, pdf.z == "b", pdf.z == "c"]).astype(float)
    bread = np.linalg.inv(design.T @ design)
    beta = bread @ design.T @ pdf.y
    e = pdf.y.to_numpy() - design @ beta
    scores = pd.DataFrame(design * e[:, None]).groupby(pdf.c).sum().to_numpy()
    meat = scores.T @ scores * len(scores) / (len(scores) - 1) * 299 / 296
    got = relations.clustered_ols(spark.createDataFrame(pdf), "y", ["x"], ["z"], ["c"]).toPandas()
    assert np.allclose(got.coefficient, beta) and np.allclose(got.std_error, np.sqrt(np.diag(bread @ meat @ bread)))
    lever = np.einsum("ij,jk,ik->i", design, bread, design)
    w = design * (e / (1 - lever))[:, None]
    hc3 = relations.clustered_ols(spark.createDataFrame(pdf), "y", ["x"], ["z"]).toPandas()
    assert np.allclose(hc3.std_error, np.sqrt(np.diag(bread @ w.T @ w @ bread)))


def test_structural_causes(spark):
    rows = [(1, 1, 2010, None, None, True), (1, 1, 2011, 0.1, None, False), (1, 1, 2013, None, None, True), (1, 1, 2014, None, None, False)]
    df = spark.createDataFrame(rows, "geo int, ind int, yr int, g double, g_lag1 double, s boolean")
    rules = {
        "g": {"growth": True, "flags": [(F.col("s"), "source_data_quality_missing")]},
        "g_lag1": {"lag": 1, "growth": True, "flags": [(F.col("s"), "source_data_quality_missing")]},
    }
    got = {(r.variable, r.cause_category): r.missing_count for r in profile.structural_missingness(df, ["geo", "ind"], "geo", "yr", rules, 2010).collect()}
    assert got["g", "expected_structural_missing"] == 1 and got["g", "source_data_quality_missing"] == 1
    assert got["g", "unexplained_missing"] == 1
    assert got["g_lag1", "expected_structural_missing"] == 3 and got["g_lag1", "unexplained_missing"] == 1


def test_idempotent_load(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int")
    loads.append_new(rows, path, ["id"], None)
    loads.append_new(rows, path, ["id"], spark.read.parquet(path))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b"]
    counts = loads.load_counts(rows, spark.read.parquet(path), ["id"]).first()
    assert (counts.rows_read, counts.rows_inserted, counts.rows_skipped) == (3, 0, 3)


def test_upsert_and_fingerprint(spark):
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "z", 2), (3, "w", 2)], "k int, v string, n int")
    got = {r.k: r.v for r in loads.upsert(old, new, ["k"], F.col("n")).collect()}
    assert got == {1: "x", 2: "z", 3: "w"}
    assert profile.unchanged(profile.fingerprint(old), profile.fingerprint(old.orderBy(F.desc("k"))))
    assert not profile.unchanged(profile.fingerprint(old), profile.fingerprint(new))


def test_source_contracts(spark):
    df = spark.createDataFrame([("2020", "a"), ("20x0", "b"), (None, "")], "year string, k string")
    with pytest.raises(ValueError, match="lacks required"):
        files.require_columns(df, ["year", "nope"])
    with pytest.raises(ValueError, match="no rows"):
        files.require_rows(df.limit(0))
    row = files.field_failures(df, {"year": files.is_year(F.col("year")), "k": M.not_blank(F.col("k"))}).first()
    assert (row.row_count, row.year, row.k) == (3, 2, 1)
    with pytest.raises(ValueError, match="declared"):
        sinks.enforce_types(df, {"nope": "int"})


def test_checks_report_failures(spark):
    df = spark.createDataFrame([(1, 2020, -1.0), (1, 2020, 50.0), (2, None, 101.0)], "k int, yr int, v double")
    conditions = {"year": checks.outside_years("yr", 2010, 2023), **checks.negative(["v"]), **checks.outside_percent(["v"])}
    got = {r.name: (r.status, r.observed) for r in checks.row_checks(df, conditions, "t").collect()}
    assert got == {"year": ("fail", "1"), "nonnegative_v": ("fail", "1"), "percentage_v": ("fail", "2")}
    assert checks.unique_key(df, ["k"], "t").first().status == "fail"
    with pytest.raises(ValueError, match="nonnegative_v"):
        checks.enforce(checks.row_checks(df, conditions, "t"))
    assert checks.forbidden_columns(df, fragments=["future_"]).first().status == "pass"


def test_source_overlap_and_common(spark):
    a = spark.createDataFrame([("11",), ("22",)], "code string")
    b = spark.createDataFrame([("22",), ("22",)], "code string")
    overlap = audit.source_overlap({"a": a, "b": b}, "code")
    assert [r.code for r in audit.common_codes(overlap).collect()] == ["22"]
    with pytest.raises(ValueError, match="common"):
        audit.common_codes(audit.source_overlap({"a": a.filter("code = '11'"), "b": b}, "code"))


def test_folds():
    folds = labels.expanding_folds(2010, 2014, 2017, 3, start=3)
    assert [(f.train_last, f.eval_first, f.eval_last) for f in folds] == [(2012, 2013, 2013), (2013, 2014, 2014), (2014, 2015, 2017)]
    with pytest.raises(ValueError, match="overlap"):
        labels.Fold("x", 2010, 2014, 2014, 2015, 3).validate()
    with pytest.raises(ValueError, match="holdout"):
        labels.validate_folds(folds[:-1])


def test_labels_are_inclusive(spark):
    rows = spark.createDataFrame([("f", -2.0), ("f", -1.0), ("f", 0.0), ("f", None)], "fold string, r double")
    cuts = spark.createDataFrame([("f", -2.0, -1.0, 0.0, -3.0)], "fold string, residual_p10 double, residual_p20 double, residual_p25 double, residual_minus_1sd double")
    got = {r.r: (r.gap_p20, r.gap_margin) for r in labels.with_labels(rows, cuts, ["fold"], "r").collect()}
    assert got == {-2.0: (1, -1.0), -1.0: (1, 0.0), 0.0: (0, 1.0)}


def test_thresholds_use_linear_interpolation(spark):
    df = spark.createDataFrame([("f", float(v)) for v in (1, 2, 3, 4, 6)] + [("f", float("nan"))], "fold string, residual double")
    got = labels.thresholds(df, ["fold"]).first()
    assert got.train_n == 5 and got.residual_p20 == pytest.approx(1.8) and got.residual_minus_1sd == pytest.approx(got.residual_mean - got.residual_sd)


def test_panel_shape_counts_balance(spark):
    df = spark.createDataFrame([(1, 1, 2020), (1, 1, 2021), (2, 1, 2021)], "geo int, ind int, yr int")
    got = panel.shape(df, ["geo", "ind"], "yr").first()
    assert (got.panel_count, got.balanced_panels, got.unbalanced_panels, got.rows_per_panel) == (2, 1, 1, 1.5)

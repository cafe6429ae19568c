"""Sentences whose rows stand together: the same results as by joins, without a join or a shuffle by sentence."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from treeloom.functions import columns as C
from treeloom.functions import grams
from treeloom.functions.values import per_value
from treeloom.operators import correspondence as P
from treeloom.operators import edges as E
from treeloom.operators import together as T
from treeloom.operators.resolve import swap_rows
from treeloom.plans import catalog, fixture

SF = "/root/testdata/sf0.001"
NO_JOIN = [
    "a14_label_confusion", "j2_quad", "j6_k8_aligned_table", "t27_alignment", "a16_j11_consistent_tokens", "f13_gram_tags", "t10_mirror_swap", "t11_mirror_relative", "t12_root_path", "t13_w10_order_residual",
    "t19_t24_certified", "t36_gold_check", "t5_cross_lca", "a20_of_extended_and_certified", "a16_consistency", "t26_comparison", "t9_bridge_candidates", "t8_chain_candidates", "a20_diagnosis", "k5_ellipsis_dump",
    "t25_certified_candidates", "s1_k1_conllu_round_trip", "t16_extended_stepwise", "t14_t15_extended", "a15_coverage", "f17_relation_rules", "t17_topdown", "t28_swapped_rows", "t18_ordered_alignment",
    "a15_j11_certification_of_masked_tokens", "f1_f4_parsed_features", "j4_inverted_pairs",
]


def plan(df, mode="simple"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", NO_JOIN)
def test_no_join_and_no_shuffle_of_tokens(spark, name):
    said = plan(catalog.queries()[name](spark, SF))
    assert "Join" not in said and "hashpartitioning(sent_id" not in said and "Exchange hashpartitioning(doc_id" in said


@pytest.mark.parametrize("name", ["f17_relation_rules", "a16_consistency", "a6_a7_error_sets", "a8_control_signatures"])
def test_methods_that_the_jvm_compiles(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", plan(catalog.queries()[name](spark, SF), "codegen"))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000


def test_features_without_lambdas(spark):
    f = F.lit("A=1")
    for c in (C.feature(f, "A"), C.last_feature(f, "A")):
        assert "lambda" not in str(c)
    rows = spark.createDataFrame([(None,), ("",), ("Case=a",), ("Case=a|Case=b",), ("XCase=a",), ("Case",), ("Case=",), ("X=1|Case=a=b|Y=2",)], "feats string")
    got = [tuple(r) for r in rows.select(C.feature(F.col("feats"), "Case"), C.last_feature(F.col("feats"), "Case")).collect()]
    none = ("∅", "∅")
    assert got == [none, none, ("a", "a"), ("a", "b"), none, none, ("", ""), ("a=b", "a=b")]


def test_texts_as_columns(spark):
    raw = ["NID ABC ЧТО|ТО", "S ЕД ИМ", "S МН ТВОР РОД|МЕТА", "", None, "S", "NID", "nid x", "NID 1 ЕД", "S СЛ|НЕПРАВ НЕСТАНД", "S НЕТ", "V НЕСОВ\tСТРАД  НЕСОВ"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "n long, x string")
    got = {r["n"]: (r["upos"], r["feats"], r["misc"]) for r in per_value(rows, "x", grams.parse_text, ("upos", "feats", "misc")).collect()}
    assert got == {r["n"]: tuple(r["p"]) for r in rows.select("n", grams.parse(F.col("x")).alias("p")).collect()}
    feats = spark.createDataFrame([(x,) for x in (None, "", "_", "B=1|A=2", "A=1|A=2|B=x=y", "bare|=v|A=")], "f string")
    for r in feats.select("f", C.parse_feats(F.col("f")).alias("p")).collect():
        assert C.feats_of_text(r["f"]) == [tuple(x) for x in r["p"]]


@pytest.fixture(scope="module")
def rows(spark):
    """Random pairs of trees, a third of them alike, sentences scattered over small batches."""
    rng, out = random.Random(8), []
    for k in range(90):
        rng = random.Random(8) if k % 3 == 0 else rng
        n = rng.randint(1, 12)
        heads = [[0] + [rng.randint(1, i) for i in range(1, n)] for _ in range(2)]
        turn = rng.sample(range(1, n + 1), n)
        heads[1] = [0 if not heads[1][turn.index(i)] else turn[heads[1][turn.index(i)] - 1] for i in range(1, n + 1)]
        for i in range(1, n + 1):
            gold = rng.choice([None, rng.randint(1, n)]) if k % 2 else None
            out.append((f"s{k:02d}", i, heads[0][i - 1], heads[1][i - 1], rng.random() < 0.2, f"w{k}-{i}", f"u{i % 3}", f"t{i % 4}", gold, rng.random() < 0.2))
    rows = spark.createDataFrame(out, "sent_id string, id long, head_ud long, head_str long, punct boolean, form string, ud_deprel string, str_deprel string, gold long, punct_str boolean")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield T.arranged(rows, "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def same(a, b):
    names = sorted(b.columns)
    assert sorted(a.columns) == names
    key = lambda df: sorted(tuple(str(r[c]) for c in names) for r in df.collect())
    want = key(b)
    assert key(a) == want and want


def sides(rows):
    mark = lambda c: F.when(F.col(c), "PUNCT").otherwise("X").alias("upos")
    return [rows.select("sent_id", "id", "form", F.col(f"head_{s}").alias("head"), F.col(f"{s}_deprel").alias("deprel"), mark(c)) for s, c in (("ud", "punct"), ("str", "punct_str"))]


@pytest.mark.parametrize("mode", ["strict", "strict_plus", "extended", "extended_stepwise", "topdown", "fi2003", "certified"])
def test_matches(rows, mode):
    same(T.matches(rows, mode), P.matches(P.packed(rows), mode))


def test_tables_of_matches(rows):
    found, (ud, st) = P.matches(P.packed(rows), "strict"), sides(rows)
    same(T.comparison(rows), P.comparison(found, ud, st))
    same(T.units(rows), P.units(found, rows))
    masked = rows.withColumn("mask", F.expr("id % 3 <> 0"))
    same(T.units(masked, include_punct=True, include_root=False, mask="mask"), P.units(found, rows, True, False, masked.where("mask")))
    forth, back = P.alignment(found, rows)
    same(T.alignment(rows), forth.withColumn("side", F.lit("ud")).unionByName(back.withColumn("side", F.lit("str"))))
    same(T.with_aligned(rows, "form"), P.with_aligned(rows.select("sent_id", "id", "form"), back))
    gold = rows.where("gold is not null").select("sent_id", F.col("id").alias("ud_id"), F.col("gold").alias("str_id"))
    same(T.gold_check(rows), P.gold_check(gold, P.token_links(found, ud, st), ud, st))


def test_diagnoses(rows):
    packed = P.packed(rows)
    same(T.diagnosis(rows, "extended", "certified"), P.diagnosis(P.matches(packed, "extended"), P.matches(packed, "certified"), rows))
    first = P.matches(packed, "strict")
    second = first.withColumn("status", F.expr("CASE WHEN status = 'unresolved' AND ud_id % 3 = 0 THEN 'restructured' ELSE status END"))
    same(T.diagnosis(rows, "strict", lambda ids, open_: open_ & (ids % 3 != 0)), P.diagnosis(first, second, rows))


def test_families_and_trees(rows):
    every = ["strict_plus", "head_bridge", "mirror_swap", "mirror_relative", "root_path", "order_residual", "lca"]
    same(T.candidates(rows, *every), P.candidates(P.packed(rows), *every))
    ud, st = sides(rows)
    same(T.cross_lca(rows), E.cross_lca(ud, st))
    same(T.inverted(rows), E.inverted(ud, st))
    same(T.swap_rows(rows, "form"), swap_rows(st.select("sent_id", "id", "head", "form"), E.inverted(ud, st)))


def test_a_document_that_stands_twice(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 6")
    docs.unionByName(docs.where("doc_id = 3")).write.parquet(str(tmp_path / "documents.parquet"))
    assert fixture.stands_together(spark, SF) and not fixture.stands_together(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("t7_matches", "a16_consistency", "j2_quad"):
        df = catalog.queries()[name](spark, str(tmp_path))
        want = con.sql(catalog.oracle_sql()[name])
        at = [want.columns.index(c) for c in df.columns]
        assert sorted(tuple(map(str, r)) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall()), name

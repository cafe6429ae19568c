import os
import random
from functools import cache

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from treeloom.operators import edges as E
from treeloom.operators import correspondence as P
from treeloom.operators import joins, matching, splits
from treeloom.operators.matching import propagate
from treeloom.operators.resolve import swap_inverted, swap_rows
from treeloom.plans import catalog
from treeloom.sources import conllu, sinks, treebank_xml

SF = "/root/testdata/sf0.001"
FAST = ["a1_morph_error_matrix", "a3_syntax_error_matrix", "a12_noise_share", "e1_tagging", "e3_complete_match", "e4_ellipsis_attachment", "e7_paired_test", "t7_j14_strict", "t9_bridge_candidates", "t25_certified_candidates", "t6_lca_candidates", "a15_coverage", "a20_diagnosis", "a21_category_summary", "t27_alignment", "j5_tokenisation", "j2_quad", "e3_with_missing_predictions", "f3_feature_values", "f11_same_form", "f17_relation_rules", "w6_folds", "w7_folds_with_dev_and_swap", "w8_shuffle_split", "w1_w2_packages", "t1_validity"]


def text(v):
    return "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in names) for r in df.collect())
    want = con.sql(catalog.oracle_sql()[name])
    at = [want.columns.index(c) for c in names]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())


def trees(spark, ud, st):
    make = lambda heads: spark.createDataFrame([("s", i, h, f"r{i}", "X") for i, h in enumerate(heads, 1)], "sent_id string, id long, head long, deprel string, upos string")
    return make(ud), make(st)


def test_identical_and_reversed(spark):
    assert {r["status"] for r in E.strict(*trees(spark, [0, 1, 1], [0, 1, 1])).collect()} == {"same_dir"}
    assert [r["status"] for r in E.strict(*trees(spark, [0, 1], [2, 0])).collect()] == ["mirrored"]


def test_chain_candidates(spark):
    # ud 1 > 2 > 3; str joins 2-3 and 1-3
    rows = E.chain_candidates(*trees(spark, [0, 1, 2], [0, 3, 1])).collect()
    assert [(r["ud_lo"], r["ud_hi"], r["str_lo"], r["str_hi"]) for r in rows] == [(1, 2, 1, 3)]


def test_validity_of_a_cycle(spark):
    bad, _ = trees(spark, [0, 3, 2], [0, 1, 1])
    r = E.validity(bad).first()
    assert (r["roots"], r["unreachable"], r["is_tree"]) == (1, 2, False)


def test_propagation_is_in_order():
    assert propagate([(1, 2), (1, 3)], {(1, 2): {(5, 6)}, (1, 3): {(5, 6)}}) == {(1, 2): (5, 6)}


def test_extended_is_injective(spark):
    rows = [r for r in P.matches(P.packed(P.both(*trees(spark, [0, 1, 1, 3, 3], [3, 1, 0, 5, 3]))), "extended").collect() if r["str_lo"] is not None]
    assert len({(r["str_lo"], r["str_hi"]) for r in rows}) == len(rows)


def test_swap(spark):
    assert swap_inverted({1: 0, 2: 1, 3: 2}, [(1, 2)]) == ({1: 2, 2: 0, 3: 1}, {1: 2, 2: 1, 3: 3})
    tokens = spark.createDataFrame([("s", 1, 0, "a"), ("s", 2, 1, "b"), ("s", 3, 2, "c")], "sent_id string, id long, head long, form string")
    pairs = spark.createDataFrame([("s", 1, 2)], "sent_id string, lo long, hi long")
    assert sorted(map(tuple, swap_rows(tokens, pairs).collect())) == [("s", 1, 2, "b"), ("s", 2, 0, "a"), ("s", 3, 1, "c")]


def test_deep_chain(spark):
    tree, _ = trees(spark, range(256), [0])
    got = E.ancestors(tree)
    assert got.count() == 256 * 255 // 2 and E.validity(tree).first()["is_tree"]
    assert E.cross_lca(tree, tree).where("id = 256").first()["lca"] == 255


def all_best(pools, weights):
    """Every best matching, by trying all."""
    us, best, found = sorted(pools), (-1, 0), []

    def go(i, used, chosen, total):
        nonlocal best, found
        if i == len(us):
            if (len(chosen), total) > best:
                best, found = (len(chosen), total), []
            if (len(chosen), total) == best:
                found.append(dict(chosen))
            return
        go(i + 1, used, chosen, total)
        for s in pools[us[i]] - used:
            go(i + 1, used | {s}, chosen | {us[i]: s}, total + weights.get(us[i], {}).get(s, 0))

    go(0, frozenset(), {}, 0)
    return best, {u: {x[u] for x in found if u in x} for u in us}, {u: any(u not in x for x in found) for u in us}, True


def test_best_matchings_against_all():
    rng = random.Random(1)
    for turn in range(300):
        right = [(0, j + 1) for j in range(rng.randint(1, 5))]
        pools = {(9, 10 + i): set(rng.sample(right, rng.randint(1, len(right)))) for i in range(rng.randint(1, 5))}
        weights = {u: {s: rng.randint(0, 2) for s in pool} for u, pool in pools.items()} if turn % 2 else {}
        assert matching.optima(pools, weights) == all_best(pools, weights)


def test_large_components_are_not_certified():
    pools = {(0, i): {(0, i), (0, i % 17 + 1)} for i in range(1, 18)}
    assert matching.components(pools) == [sorted(pools)]
    best, choices, _, exact = matching.optima(pools)
    assert best[0] == 17 and not exact and all(len(c) == 1 for c in choices.values())


def pair(ud, st, punct=()):
    return matching.Pair(matching.Tree(enumerate(ud, 1)), matching.Tree(enumerate(st, 1)), frozenset(punct))


def test_lca_paths():
    # ud 2 over 5, str 2 over 3 over 5: the str edges of the path share a token with {2, 5}
    p = pair([2, 0, 2, 2, 2], [2, 0, 2, 2, 3])
    assert matching.lca(p) == {(2, 5): {(2, 3), (3, 5)}}
    # paths of one edge more than the limit pass
    chain, star = [0, 1, 2, 3, 4], [0, 1, 2, 3, 1]
    assert (1, 5) in matching.lca(pair(star, chain), 3) and (1, 5) not in matching.lca(pair(star, chain), 2)


def test_modes_of_a_regrouped_sentence():
    # a coordination: ud 2 over 5, str 2 over 3 over 5
    p = pair([2, 0, 5, 2, 2], [2, 0, 2, 2, 3])
    by = {mode: {m.ud: (m.st, m.status, m.certification) for m in matching.MODES[mode](p)} for mode in matching.MODES}
    assert by["strict"][2, 5] == (None, "unresolved", "candidate_gap") and by["strict"][3, 5] == ((3, 5), "exact_mirrored", "strict")
    assert by["extended"][2, 5] == by["extended_stepwise"][2, 5] == ((2, 3), "restructured", "strict")
    assert by["topdown"][2, 5][0] == by["certified"][2, 5][0] == (2, 3)
    # of alignments that cost the same, the one in which the last children meet
    assert by["fi2003"][2, 5][0] == (2, 4)
    for found in by.values():
        taken = [s for s, *_ in found.values() if s]
        assert len(taken) == len(set(taken)) and set(found) == set(p.ud.arcs)


def test_every_mode_is_injective_on_random_trees():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(2, 14)
        make = lambda: [0] + [rng.randint(1, i) for i in range(1, n)]
        p = pair(make(), make(), [n])
        for mode, matcher in matching.MODES.items():
            found = matcher(p)
            taken = [m.st for m in found if m.st]
            assert [m.ud for m in found] == list(p.ud.arcs) and len(taken) == len(set(taken)) and set(taken) <= set(p.st.arcs), mode
            assert all(m.st == m.ud for m in found if m.ud in p.st.arcs and mode != "fi2003"), mode


def alignment_cost(a, b):
    """Least cost of two ordered forests, nodes as (token, children), by the definition: meet, or a gap whose children stand in its place."""

    @cache
    def cost(x, y):
        if not x and not y:
            return 0
        out = []
        if x:
            out.append(cost(x[:-1] + x[-1][1], y) + matching.GAP)
        if y:
            out.append(cost(x, y[:-1] + y[-1][1]) + matching.GAP)
        if x and y:
            out.append(cost(x[:-1], y[:-1]) + cost(x[-1][1], y[-1][1]) + (matching.MISMATCH if x[-1][0] != y[-1][0] else 0))
        return min(out)

    return cost(a, b)


def test_alignment_never_beats_the_edit_distance():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randint(2, 7)
        p = pair([0] + [rng.randint(1, i) for i in range(1, n)], [0] + [rng.randint(1, i) for i in range(1, n)])
        forest = lambda t, nodes: tuple((i, forest(t, tuple(sorted(t.children.get(i, ()))))) for i in nodes)
        total, pairs = matching.align(matching._Ordered(p.st), matching._Ordered(p.ud), None)
        assert total >= alignment_cost(forest(p.st, tuple(p.st.roots)), forest(p.ud, tuple(p.ud.roots))) and len({s for s, _ in pairs}) == len(pairs)
        same = matching.align(matching._Ordered(p.st), matching._Ordered(p.st), 8)
        assert same[0] == 0 and same[1] == {(i, i) for i in p.st.ids}


def test_families_agree_with_their_joins(spark):
    from treeloom.operators import candidates as K

    rng = random.Random(2)
    rows, want = ([], []), {f: set() for f in ("strict_plus", "head_bridge", "mirror_swap", "mirror_relative", "root_path", "order_residual")}
    for k in range(60):
        n = rng.randint(3, 9)
        heads = [[0] + [rng.randint(1, i) for i in range(1, n)] for _ in range(2)]
        turn = rng.sample(range(1, n + 1), n)
        heads[1] = [0 if not heads[1][turn.index(i)] else turn[heads[1][turn.index(i)] - 1] for i in range(1, n + 1)]
        for side in range(2):
            rows[side].extend((f"s{k}", i, h, "r", "PUNCT" if i == 2 else "X") for i, h in enumerate(heads[side], 1))
        p = pair(*heads, [2])
        for name, found in want.items():
            found |= {(f"s{k}", *u, *s) for u, pool in P.FAMILIES[name](p).items() for s in pool}
    ud, st = (spark.createDataFrame(r, "sent_id string, id long, head long, deprel string, upos string") for r in rows)
    joined = {"strict_plus": E.chain_candidates, "head_bridge": E.bridge_candidates, "mirror_swap": K.mirror_swap, "mirror_relative": K.mirror_relative, "root_path": K.root_path, "order_residual": K.order_residual}
    for name, f in joined.items():
        assert {tuple(r) for r in f(ud, st).select("sent_id", "ud_lo", "ud_hi", "str_lo", "str_hi").collect()} == want[name], name
    assert all(want.values())


def test_folds_over_many_partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    sents = spark.range(200_000).select(F.format_string("%08d", F.pmod(F.col("id") * 7919, F.lit(200_000))).alias("sent_id"), F.rand(3).alias("more"))
    try:
        for parts in ("3", "40"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = splits.folds(sents, 7, "sent_id").withColumn("want", F.least(F.floor(F.col("sent_id").cast("long") / 28572) + 1, F.lit(99)))
            assert [r["n"] for r in got.groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").collect()] == [28572] * 3 + [28571] * 4
            edges = got.groupBy("fold").agg(F.min("sent_id").alias("a"), F.max("sent_id").alias("b")).orderBy("fold").collect()
            assert all(x["b"] < y["a"] for x, y in zip(edges, edges[1:], strict=False))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pairs_and_errors(spark):
    a = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y"), ("t", 1, "z")], "sent_id string, id long, form string")
    b = spark.createDataFrame([("s", 4, "x"), ("s", 9, "q"), ("t", 5, "z")], "sent_id string, id long, form string")
    assert sorted((r["sent_id"], r["place"], r["form"], r["form_b"]) for r in joins.zipped(a, b, "sent_id", "id").collect()) == [("s", 1, "x", "x"), ("s", 2, "y", "q"), ("t", 1, "z", "z")]
    with pytest.raises(Exception, match="two lengths"):
        joins.zipped(a, b.where("id <> 9"), "sent_id", "id").collect()
    assert joins.same_number(a, b).count() == 3
    with pytest.raises(Exception, match="not the same text"):
        joins.same_number(a, b.limit(1)).collect()
    with pytest.raises(Exception, match="occurs twice"):
        splits.without_repeats(a).collect()
    assert splits.without_repeats(a.where("id = 1")).count() == 2


def test_gold_check(spark):
    ud, st = (t.withColumn("form", F.concat(F.lit("w"), "id")) for t in trees(spark, [0, 1, 1, 1], [0, 1, 2, 1]))
    links = P.token_links(P.matches(P.packed(P.both(ud, st)), "strict"), ud, st)
    assert sorted(tuple(r) for r in links.collect()) == [("s", 1, 1), ("s", 2, 2), ("s", 4, 4)]
    gold = spark.createDataFrame([("s", 1, 1), ("s", 2, 3), ("s", 3, 3)], "sent_id string, ud_id long, str_id long")
    got = {r["ud_id"]: (r["expected_str_id"], r["actual_str_id"], r["ok"]) for r in P.gold_check(gold, links, ud, st).collect()}
    assert got == {1: (1, 1, True), 2: (3, 2, False), 3: (3, None, False), 4: (None, 4, False)}


def test_conllu_file(spark, tmp_path):
    lines = ["# sent_id = a", "1\tHi\thi\tX\t_\tA=1\t0\troot\t_\t_", "1-2\tHi there\t_\t_\t_\t_\t_\t_\t_\t_", "2.1\t_\t_\t_\t_\t_\t_\t_\t_\t_", "2\tthere\t_\tY\t_\t_\t1\tdep\t_\t_", ""]
    (tmp_path / "x.conllu").write_text("\n".join(lines) + "\n# sent_id = b\n" + "\n".join(lines[1:2]) + "\n")
    rows = conllu.parse_tokens(conllu.read_blocks(spark, str(tmp_path))).collect()
    assert sorted((r["sent_id"], r["id"], r["form"], r["head"]) for r in rows) == [("a", 1, "Hi", 0), ("a", 2, "there", 1), ("b", 1, "Hi", 0)]


def test_treebank_xml(spark, tmp_path):
    (tmp_path / "x.tgt").write_text('<text><body><S ID="1">«<W ID="1" DOM="_root" FEAT="V" LEMMA="GO" LINK="">go</W>,<W ID="2" DOM="1" FEAT="S" LEMMA="HE" LINK="pred">he</W>.</S></body></text>')
    rows = sorted(treebank_xml.read(spark, str(tmp_path)).collect(), key=lambda r: r["id"])
    assert [(r["form"], r["head"], r["is_punct"]) for r in rows] == [("«", None, True), ("go", 0, False), (",", None, True), ("he", 2, False), (".", None, True)]


def test_entry(spark):
    assert entry.entry(spark).columns
    assert os.path.exists(SF) and len(entry.queries()) >= 40


def test_candidate_families(spark):
    from treeloom.operators import candidates as K

    pairs = lambda df: {tuple(r)[1:] for r in df.select(*K.KEY).collect()}
    t = trees(spark, [0, 1, 2], [0, 3, 1])
    assert pairs(K.mirror_relative(*t)) == {(1, 2, 1, 3)}
    assert pairs(K.root_path(*trees(spark, [0, 1, 1], [2, 0, 2]))) == {(1, 3, 2, 3)}
    assert pairs(K.order_residual(*trees(spark, [0, 1, 1], [0, 1, 2]))) == {(1, 3, 2, 3)}
    assert pairs(K.mirror_swap(*trees(spark, [0, 1, 2, 1], [0, 3, 4, 1]))) == {(1, 2, 3, 4)}


def test_restored_forms(spark):
    from treeloom.operators.ellipsis import restore_forms

    target = spark.createDataFrame([("s", 1, "_", "_"), ("s", 2, "_", "A=1"), ("s", 3, "x", "_"), ("n", 1, "_", None)], "sent_id string, id int, form string, misc string")
    ref = spark.createDataFrame([("s", 1, "a", 1), ("s", 2, "b", 1), ("s", 1, "late", 2)], "sent_id string, id int, form string, split_ord int")
    assert sorted(map(tuple, restore_forms(target, ref).collect()), key=str) == [("n", 1, "_", None), ("s", 1, "a", "Ellipsis=Yes"), ("s", 2, "b", "A=1|Ellipsis=Yes"), ("s", 3, "x", "_")]


def test_lines_of_a_conllu_file_survive(spark, tmp_path):
    text = "# sent_id = a\n# note\n1\tHi\t_\t_\t_\t_\t0\troot\t_\t_\n1.1\t_\t_\t_\t_\t_\t_\t_\t_\t_\nodd line"
    (tmp_path / "x.conllu").write_text(text + "\n\n1\tx\t_\t_\t_\t_\tq\t_\t_\t_\n\n")
    blocks = conllu.read_blocks(spark, str(tmp_path))
    lines = conllu.read_lossless(blocks)
    assert sorted(r["block"] for r in conllu.from_lossless(lines, "file", "part", "block_no").collect()) == sorted(r["block"] for r in blocks.collect())
    assert [r["id"] for r in lines.where("sent_id = 'a'").orderBy("line_no").collect()] == [None, None, 1, None, None]
    assert sorted((r["sent_id"], r["head"], r["deprel"]) for r in conllu.gold_frame(blocks).collect()) == [("a", 0, "root"), ("sent_2", 0, "")]
    with pytest.raises(Exception, match="not ten columns"):
        conllu.parse_tokens(blocks, strict=True).collect()


def test_strict_reader_wants_numbers(spark):
    block = spark.createDataFrame([("1.1\tx" + "\t_" * 8,)], "block string")
    with pytest.raises(Exception, match="not a token's id"):
        conllu.parse_tokens(block, strict=True).collect()


def test_carriage_returns(spark, tmp_path):
    line = "1\tx" + "\t_" * 8
    (tmp_path / "x.conllu").write_bytes(f"{line}\r\n\r\n{line}\r\n".encode())
    assert conllu.parse_tokens(conllu.read_blocks(spark, str(tmp_path), whole=True)).count() == 2


def test_reports_links_and_manifest(spark):
    lines = ["=== run1 ===", "Corpus: ud", "UAS | 91.5", "LAS | 90", "Corpus: str", "UAS | 80.25", "=== run2 ===", "Corpus: ud", "UAS | 92"]
    rows = conllu.parse_report(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")).collect()
    assert sorted((r["run"], r["corpus"], r["metric"], r["value"]) for r in rows) == [("run1", "str", "UAS", 80.25), ("run1", "ud", "LAS", 90.0), ("run1", "ud", "UAS", 91.5), ("run2", "ud", "UAS", 92.0)]
    tex = spark.createDataFrame([("\\draw (str-w-3) -- (ud-w-12);\n\\draw (str-w-1) -- (ud-w-2);",)], "t string")
    assert tex.select(conllu.gold_links(F.col("t")).alias("x")).first()["x"] == [(3, 12), (1, 2)]
    files = spark.createDataFrame([("/o/run2/ud-new-bert/test.pred.conllu",), ("/d/str/test.conllu",)], "file string")
    assert sorted(tuple(r)[1:] for r in conllu.manifest(files).collect()) == [("str", "full", 1, "test", "gold"), ("ud", "new", 2, "test", "pred")]


def test_written_result_sets(spark, tmp_path):
    make = lambda heads: spark.createDataFrame([("s", i, f"w{i}", h, f"r{i}", "X") for i, h in enumerate(heads, 1)], "sent_id string, id long, form string, head long, deprel string, upos string")
    ud, st = make([2, 0, 5, 2, 2]), make([2, 0, 2, 2, 3])
    found = P.matches(P.packed(P.both(ud, st)), "certified")
    places = sinks.write_correspondence(found, ud, st, str(tmp_path), "certified")
    back = {name: spark.read.option("header", True).csv(place) for name, place in places.items()}
    assert len(back["compare_certified"].columns) == 11 and len(back["compare_certified_detailed"].columns) == 10 and len(back["coverage_certified"].columns) == 14
    assert back["coverage_certified"].first()["resolved_pct"] == "100.0" and back["label_confusion_certified"].count() == 4
    sinks.write_aligned(found, ud, st, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/ud-aligned").where("aligned_id is not null").count() == 5
    sinks.write_csv(ud.limit(1), f"{tmp_path}/once")
    sinks.write_csv(ud, f"{tmp_path}/once")
    assert spark.read.option("header", True).csv(f"{tmp_path}/once").count() == 1
    sinks.write_outcomes(ud.withColumn("outcome", F.when(F.col("id") > 3, "aligned").otherwise("unaligned")), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("outcome = 'aligned'").count() == 2
    sinks.write_listing(sinks.listing(ud, "t", ["form"]), f"{tmp_path}/list")
    assert spark.read.text(f"{tmp_path}/list").first()[0] == "t"
    scores = spark.createDataFrame([("run1", "ud", "LAS", 90.0), ("run1", "ud", "UPOS", 97.125)], "run string, corpus string, metric string, value double")
    assert sinks.report(scores).first()["block"].split("\n")[-2:] == ["UPOS     |  97.12", "LAS      |  90.00"]
    summary = spark.createDataFrame([("ud", "LAS", 5, 90.0, 0.5)], "corpus string, metric string, runs long, mean double, std double")
    assert sinks.report_over_runs(summary).first()["line"] == "LAS      |  90.00 ± 0.50  (n=5)"


def test_concatenated_files(spark, tmp_path):
    for name in "ba":
        (tmp_path / f"{name}.conllu").write_text("\n\n".join(f"# sent_id = {name}{i}\n1\tx" + "\t_" * 8 for i in range(3)) + "\n\n")
    sinks.concatenate(spark, str(tmp_path), str(tmp_path / "all"))
    got = conllu.parse_tokens(conllu.read_blocks(spark, str(tmp_path / "all"), "*.txt"))
    assert sorted(r["sent_id"] for r in got.collect()) == ["a0", "a1", "a2", "b0", "b1", "b2"]


def test_pictures(spark):
    from treeloom.sources import pictures

    make = lambda heads: spark.createDataFrame([("s", i, f"w_{i}", h, "punct" if i == 4 else f"r{i}", "X") for i, h in enumerate(heads, 1)], "sent_id string, id long, form string, head long, deprel string, upos string")
    ud, st = make([0, 1, 1, 1, 2]), make([2, 0, 2, 2, 3])
    got = pictures.album(ud, st, "strict", ["s"])["s"]
    links = spark.createDataFrame([(got,)], "t string").select(conllu.gold_links(F.col("t")).alias("x")).first()["x"]
    # {1, 2} turned round, and the roots; 3 and 5 are open, 4 is punctuation
    assert sorted(map(tuple, links)) == [(1, 2), (2, 1)] and "% open: 3 w_3, 5 w_5" in got and r"w\_4" in got and got.count("textcolor") == 4
    assert pictures.escape("a_b%\\") == r"a\_b\%\textbackslash{}" and pictures.escape(None) == "" and [pictures.separation(n) for n in (8, 12, 16, 40)] == ["0.6cm", "0.4cm", "0.3cm", "0.2cm"]
    with pytest.raises(KeyError):
        pictures.album(ud, st, "strict", ["t"])


def test_enhanced_graph_as_a_tree(spark):
    from treeloom.operators import conversion

    # "Mary likes tea and John (likes) coffee": 4.1 is the elided verb, its subject and object are orphans in the basic tree
    rows = [
        ("a", "1", "2", "nsubj", "2:nsubj"), ("a", "2", "0", "root", "0:root"), ("a", "3", "2", "obj", "2:obj"), ("a", "4", "5", "cc", "4.1:cc"),
        ("a", "4.1", None, None, "2:conj:and"), ("a", "5", "2", "conj", "4.1:nsubj"), ("a", "6", "5", "orphan", "4.1:obj"),
        # an elided root takes the word that was root, for a rule to name
        ("b", "0.1", None, None, "0:root"), ("b", "1", "0", "root", "0:root"), ("b", "2", "1", "advmod", "0.1:advmod"),
        # an ellipsis that hangs on its only dependent stays below it
        ("c", "1", "0", "root", "0:root"), ("c", "2", "1", "nmod", "2.1:nmod"), ("c", "2.1", None, None, "2:acl"),
    ]
    tokens = spark.createDataFrame(rows, "sent_id string, id string, head string, deprel string, deps string")
    got = {(r["sent_id"], r["id"]): (r["head"], r["deprel"]) for r in conversion.enhanced_to_basic(tokens).collect()}
    assert got["a", "4.1"] == ("2", "conj") and got["a", "4"] == ("4.1", "cc") and got["a", "5"] == ("4.1", "nsubj") and got["a", "6"] == ("4.1", "obj") and got["a", "1"] == ("2", "nsubj")
    assert got["b", "0.1"] == ("0", "root") and got["b", "1"] == ("0.1", "TEMP") and got["b", "2"] == ("0.1", "advmod")
    assert got["c", "2.1"] == ("2", "acl") and got["c", "2"] == ("1", "nmod")
    for sent in "abc":
        up = {i: h for (s, i), (h, _) in got.items() if s == sent}
        for token in up:
            for _ in up:
                token = up.get(token, "0")
            assert token == "0"


def test_repaired_roots(spark):
    from treeloom.operators import conversion

    tokens = spark.createDataFrame([("s", "1", "в", "в", "ADP", None, "2", "case"), ("s", "2", "доме", "дом", "NOUN", "Case=Acc", "3.1", "TEMP"), ("s", "3", "он", "он", "PRON", "Case=Nom", "3.1", "TEMP"), ("s", "4", "x", "x", "NOUN", None, "9.1", "TEMP")], "sent_id string, id string, form string, lemma string, upos string, feats string, head string, deprel string")
    partners = spark.createDataFrame([("s", "3.1", "V", "быть")], "sent_id string, id string, upos string, lemma string")
    got = {r["id"]: r["deprel"] for r in conversion.repair_roots(tokens, partners).collect()}
    # with a preposition below it the accusative is no object; a head without a partner names nothing
    assert got == {"1": "case", "2": "obl", "3": "nsubj", "4": "TEMP"}


def test_normalised_tokens(spark):
    from treeloom.operators import normalise as N

    def words(*rows):
        made = [N.Word(form, lemma=form, upos="PUNCT" if rel == "punct" else "X", rel=rel) for form, _, rel in rows]
        for w, (_, head, _) in zip(made, rows, strict=True):
            w.head = made[head - 1] if head else None
        return made

    def told(target, source):
        got, why = N.normalise(words(*target), words(*source))
        place = {w: i for i, w in enumerate(got, 1)}
        return why or [(w.form, place[w.head] if w.head else 0, w.rel) for w in got]

    # quotes come off, two words are one, punctuation is the target's
    assert told([("дом", 2, "a"), ("кто-то", 0, "root"), (".", 2, "punct")], [("«дом»", 3, "s"), ("кто", 3, "q"), ("то", 0, "root")]) == [("дом", 2, "s"), ("кто-то", 0, "root"), (".", 2, "punct")]
    # a hyphenated word in either order, a word that stands later, spelling twins
    assert told([("а-б", 0, "root"), ("со", 3, "x"), ("г", 1, "x")], [("б", 0, "root"), ("а", 1, "p"), ("г", 1, "p"), ("с", 3, "r")]) == [("а-б", 0, "root"), ("со", 3, "r"), ("г", 1, "p")]
    # a particle and its pronoun, unless the target writes them apart
    assert told([("некого", 2, "o"), ("звать", 0, "root")], [("не", 2, "n"), ("кого", 3, "o"), ("звать", 0, "root")]) == [("некого", 2, "o"), ("звать", 0, "root")]
    assert told([("не", 2, "o"), ("кого", 0, "root")], [("не", 2, "n"), ("кого", 0, "root")]) == [("не", 2, "n"), ("кого", 0, "root")]
    # an ellipsis that the target lacks goes, and its dependent hangs where it hung; of two in a run the one that more hangs on stays
    assert told([("я", 2, "s"), ("иду", 0, "root")], [("я", 2, "s"), ("_", 3, "e"), ("иду", 0, "root")]) == [("я", 2, "s"), ("иду", 0, "root")]
    assert told([("_", 0, "root"), ("дом", 1, "x")], [("_", 2, "e"), ("_", 0, "root"), ("дом", 2, "o")]) == [("_", 0, "root"), ("дом", 1, "o")]
    # a root that goes leaves its place to the target's root
    assert told([("он", 2, "s"), ("дома", 0, "root")], [("он", 2, "s"), ("_", 0, "root"), ("дома", 2, "l")]) == [("он", 2, "s"), ("дома", 0, "root")]
    # a glued token, and reasons
    assert told([('"а б"', 0, "root"), ("в", 1, "x")], [("б", 0, "root"), ("а", 1, "p"), ("в", 1, "p")]) == [('"а б"', 0, "root"), ("в", 1, "p")]
    assert told([("а", 0, "root")], [("б", 0, "root")]).startswith("word 0") and told([("а", 0, "root"), ("б", 1, "x")], [("а", 0, "root")]).startswith("source ends")
    assert told([("а", 0, "root")], [("а", 0, "root"), ("б", 1, "x")]) == "1 source words are left" and told([("_", 0, "root")], [("а", 0, "root")]).startswith("no ellipsis")

    schema = "sent_id string, id long, form string, lemma string, upos string, feats string, head long, deprel string"
    ud = spark.createDataFrame([("a", 1, "x1", None, "N", None, 2, "o"), ("a", 2, "y", None, "V", None, 0, "root"), ("b", 1, "z", None, "N", None, 0, "root")], schema)
    st = spark.createDataFrame([("a", 1, "x1", "l", "S", "F=1", 2, "s"), ("a", 2, "Y", None, "V", None, 0, "root"), ("c", 1, "z", None, "N", None, 0, "root")], schema)
    got = sorted(N.normalise_tokens(ud, st).collect(), key=lambda r: (r["sent_id"], r["id"] or 0))
    assert [tuple(r) for r in got] == [("a", 1, "x1", "l", "S", "F=1", 2, "s", None), ("a", 2, "y", None, "V", None, 0, "root", None), ("b", *[None] * 7, "no source")]

import itertools

from compare import connection, spark_rows, sql_rows
from odd import LONG, no_documents, odd_documents

from termscale.llm.decontaminate import MASKS, MATCHES, WINDOW, clean_documents, overlaps
from termscale.llm.queries import DECONTAMINATION, op4_decontamination

ITEM = [f"word{i}" for i in range(20)]


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_no_window_escapes_the_masks():
    for missing in itertools.combinations(range(WINDOW), WINDOW - MATCHES):
        placed = ({at + o for o in mask} for mask in MASKS for at in range(WINDOW - max(mask)))
        assert any(not positions & set(missing) for positions in placed)


def test_against_sql(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = spark_rows(op4_decontamination(spark, sf_dir))
        assert rows == sql_rows(connection(sf_dir), DECONTAMINATION) and rows[1]


def test_main_path_is_native(spark):
    plan = op4_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_planted_cases(spark):
    def with_changes(*places):
        return ["other" if i in places else w for i, w in enumerate(ITEM)]

    docs = {
        1: ["a", "b", *ITEM, "c"],
        2: ["x", *with_changes(4, 9, 15)],
        3: with_changes(1, 3, 5, 7, 9, 11, 13, 15, 17),
        4: ITEM[:12],
        5: ITEM[:11] + ["x", "y"],
        6: ["WORD0,", *[f"({w})" for w in ITEM[1:]]],
        7: ["seven", "words", "are", "not", "enough", "for", "it"],
        8: "eight short words in a row are enough".split(),
        9: "eight short words in a line are enough".split(),
    }
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    items = [" ".join(ITEM), " ".join(docs[7]), " ".join(docs[8])]
    found = {(r.doc_id, r.item_id): (r.doc_pos, r.item_pos, r.n_matched) for r in overlaps(table, bench(spark, items)).collect()}
    assert found == {
        (1, 0): (2, 0, 13),
        (2, 0): (1, 0, 11),
        (4, 0): (0, 0, 12),
        (5, 0): (0, 0, 11),
        (6, 0): (0, 0, 13),
        (8, 2): (0, 0, 8),
    }
    assert sorted(r.doc_id for r in clean_documents(table, bench(spark, items)).collect()) == [3, 7, 9]


def test_odd_rows(spark):
    items = bench(spark, [None, "", "a row without an id of its own", " ".join(LONG.split()[500:530])])
    found = sorted((r.doc_id, r.item_id) for r in overlaps(odd_documents(spark), items).fillna(-1).collect())
    assert found == [(-1, 2), (7, 3)]
    kept = clean_documents(odd_documents(spark), items)
    assert kept.columns == odd_documents(spark).columns and kept.count() == 11
    assert overlaps(no_documents(spark), items).count() == 0
    assert overlaps(odd_documents(spark), bench(spark, ["x"]).limit(0)).count() == 0

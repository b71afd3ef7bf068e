import re

import pytest
from compare import connection, spark_rows, sql_rows
from odd import no_documents, odd_documents

from termscale.llm import licences
from termscale.llm.licences import TEMPLATES, licence_notices, template_table
from termscale.llm.queries import LICENCES, op7_licences
from termscale.session import written


def test_against_sql(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = spark_rows(op7_licences(spark, sf_dir))
        assert rows == sql_rows(connection(sf_dir), LICENCES) and rows[1]


def test_main_path_is_native(spark):
    plan = op7_licences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_planted_cases(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n"
        'documentation files (the "Software"), to deal in the Software without restriction, including without\n'
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the\n"
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    )
    texts = {
        1: "first line\nLICENSED under the Apache License -- version 2.0\nlast line",
        2: f"A paragraph of two\nlines.\n \n{mit}\n\nend",
        3: "Licensed under the Apache",
        4: "the license under which the work of the free software foundation is licensed",
        5: "Licensed under CC BY 4.0.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = sorted((r.doc_id, r.kind, r.number, r.licence) for r in licence_notices(docs).collect())
    assert found == [
        (1, "line", 1, "Apache-2.0"),
        (2, "paragraph", 1, "MIT"),
        (5, "line", 0, "CC-BY-4.0"),
    ]


def test_notices_beside_other_text(spark):
    gpl = next(text for licence, text in TEMPLATES if licence == "GPL-3.0-or-later").split()
    header = [" ".join(gpl[i : i + 7]) for i in range(0, len(gpl), 7)]
    around = ["Frobnicator, a tool that turns one thing into another.", "It is slow, but it does not stop before the end."] * 4
    texts = {
        1: "Copyright (c) 2024 Acme Inc. All rights reserved.",
        2: "\n".join(f" * {line}" for line in [*around, *header, *around]),
        3: "\n".join(f"dnl {line}" for line in [*around, *header, *around]),
        4: "Copyright 2020 Acme. All rights reserved. The rest is released under the MIT License. Ask us for more.",
        5: "Licensed under the MIT License.\n\nAll rights of the river are reserved for others.",
        6: "\n\n".join([*around, *header, *around]),
    }
    docs = spark.createDataFrame([*texts.items(), (None, texts[1]), (1, texts[1])], "doc_id long, text string")
    found = sorted(((r.doc_id or 0, r.kind, r.number, r.licence, r.dice) for r in licence_notices(docs).collect()))
    before = sum(len(line.replace(",", "").split()) for line in around)
    assert found == [
        (0, "window", 5, "All-Rights-Reserved", 1.0),
        (1, "window", 5, "All-Rights-Reserved", 1.0),
        (1, "window", 5, "All-Rights-Reserved", 1.0),
        (2, "window", before, "GPL-3.0-or-later", 1.0),
        (3, "window", before, "GPL-3.0-or-later", 1.0),
        (4, "window", 3, "All-Rights-Reserved", 1.0),
        (4, "window", 9, "MIT", 1.0),
        (5, "line", 0, "MIT", 1.0),
        (6, "window", before, "GPL-3.0-or-later", 1.0),
    ]


def test_odd_rows(spark):
    own = spark.createDataFrame(
        [(3, "own", "one row without an id of its own"), (4, "own", "a row without an id of its own"), (5, "none", "x")],
        "template_id int, licence string, template string",
    )
    found = licence_notices(odd_documents(spark), own).collect()
    assert sorted((r.doc_id, r.template_id, round(r.dice, 3)) for r in found) == [(None, 3, 0.857), (None, 4, 1.0)]
    assert licence_notices(no_documents(spark), own).count() == 0
    assert licence_notices(odd_documents(spark), template_table(spark).limit(0)).count() == 0


def test_units_are_split_into_words_once(spark, monkeypatch):
    plans = []

    def noted(df, label, by=()):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label, by)

    monkeypatch.setattr(licences, "written", noted)
    op7_licences(spark, "/root/testdata/sf0.001")
    units, windows = plans
    assert len(re.findall(r"split\(lower\(x#\d+\.unit", units)) == 1
    assert len(re.findall(r"split\(lower\(regexp_replace\(text", windows)) == 1


def _near_notices():
    """Notices beside other text, whole, and with more and more of their words replaced."""
    texts = []
    for k, (_, template) in enumerate(TEMPLATES):
        words = template.split()
        for step in range(2, 9):
            changed = [f"other{i}" if i % step == 0 else word for i, word in enumerate(words)]
            texts += [f"before {k} {' '.join(changed)} after", f"before {' '.join(words[: len(words) * step // 9])} after"]
        texts += [f"before {template} after", template, "\n".join(words)]
    return [*texts, None, "", "one", *texts[:3]]


def test_many_templates_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(None if i % 50 == 0 else i, text) for i, text in enumerate(_near_notices())], "doc_id long, text string")
    found = spark_rows(licence_notices(docs))
    monkeypatch.setattr(licences, "IN_ROW", 0)
    assert found == spark_rows(licence_notices(docs)) and any("window" in row for row in found[1])


def _shuffled(plan):
    """The bytes that the shuffles of a plan that ran have written, before compression."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_texts_without_notices_are_not_shuffled(spark):
    texts = [" ".join(f"word{i * k % 997}" for i in range(2000)) for k in range(1, 41)]
    texts.append(f"{texts[0]} All rights reserved. {texts[1]}")
    # Some bigrams of a template, but fewer than a window needs.
    texts.append(f"you may not use this file except {texts[2]}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "-1")
        found = licence_notices(docs)
        assert [(r.doc_id, r.kind, r.licence) for r in found.collect()] == [(40, "window", "All-Rights-Reserved")]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert len(texts[40]) < _shuffled(found._jdf.queryExecution().executedPlan()) < 2 * len(texts[40])


@pytest.fixture
def unseen_sizes(spark):
    """No join becomes a broadcast by the sizes of tables or of stages that have ended."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_units_without_template_bigrams_are_not_shuffled(spark, monkeypatch, unseen_sizes):
    shuffled = {}

    def noted(df, label, by=()):
        df.collect()
        shuffled[label] = _shuffled(df._jdf.queryExecution().executedPlan())
        return written(df, label, by)

    monkeypatch.setattr(licences, "written", noted)
    lines = [" ".join(f"word{i * k % 997}" for i in range(20)) for k in range(1, 401)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "All rights reserved.\nAsk us.")], "doc_id long, text string")
    assert [(r.doc_id, r.kind, r.number) for r in licence_notices(docs).collect()] == [(2, "line", 0)]
    # Rows of the bounds, of the notice's pair with its template, and of the best of it.
    assert 0 < shuffled["licence-units"] < 2_000

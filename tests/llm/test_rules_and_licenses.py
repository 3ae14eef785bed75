import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crossgrain.llm import license_scan as L
from crossgrain.llm import quality_rules as Q
from tests.conftest import canonical, duck, same_as_oracle
from tests.llm.conftest import prose

WORD = re.compile("[^\x20\x09-\x0D]+")


def metrics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), base


def test_metrics_of_odd_documents(odd_docs, odd_rows):
    got = Q.apply_rules(odd_docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert canonical(tuple(r)[:-1] for r in got) == canonical((d, *metrics(t)) for d, t in odd_rows)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_no_documents(no_docs):
    assert Q.apply_rules(no_docs).count() == 0 and L.scan_licenses(no_docs).count() == 0


def test_order_changes_no_verdict(spark, sf_dir):
    docs = Q.table(spark, sf_dir, "documents")
    m, order = Q.with_metrics(docs), Q.cascade_order(docs, Q.RULES, 300)
    assert {e.rule.name for e in order} == {r.name for r in Q.RULES}
    kept = lambda o: sorted(r[0] for r in m.where(Q.rejected_by(o).isNull()).select("doc_id").collect())
    assert kept(order) == kept(order[::-1])
    first = order[0]
    assert all(first.share / first.cost >= e.share / e.cost - 1e-9 for e in order)
    assert [[e.rule.name for e in Q.cascade_order(docs, Q.RULES, 300)] for _ in range(2)] == [[e.rule.name for e in order]] * 2


def test_cheap_rules_that_reject_go_first(spark):
    texts = ["few words"] * 5 + ["A" * 3000 + " word" * 60] * 3 + [prose(100, k) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = [e.rule.name for e in Q.cascade_order(docs, Q.RULES, 10_000)]
    assert order[0] == "few_words" and order.index("repeated_words") < order.index("capitals") and order[-1] in ("capitals", "digits", "replacement_characters")


def test_the_sample_reads_few_files(spark, tmp_path):
    spark.range(4000).selectExpr("id doc_id", "concat('text ', id) text").repartition(20).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    one, two = ([r["doc_id"] for r in Q.sample_documents(docs, 400, 4).collect()] for _ in range(2))
    assert sorted(one) == sorted(two) and 250 < len(one) < 600 and Q.sample_documents(docs, 400, 4).select(F.input_file_name()).distinct().count() == 4


@pytest.mark.parametrize("op", [Q, L])
def test_native_plan(spark, sf_dir, op):
    df = next(iter(op.QUERIES.values()))(spark, sf_dir)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


@pytest.mark.parametrize(("op", "name"), [(Q, "op1_quality_rules"), (L, "op7_license_scan")])
def test_oracle(spark, sf_dir, op, name):
    assert same_as_oracle(op.QUERIES[name](spark, sf_dir), op.ORACLE_SQL[name], duck(sf_dir))


def licenses(text, templates=L.TEMPLATES, threshold=0.8, least_window=L.LEAST_WINDOW):
    """All windows and templates, word by word."""
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    at = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    parsed = L.parse_templates(templates, threshold, least_window)
    found, best = set(), 0.0
    for size in {t.window for t in parsed}:
        for i in range(max(1, -(-len(w) // size) - 1)):
            b = set(w[i * size : (i + 2) * size])
            met = {k: t for k, t in enumerate(parsed) if t.window == size and len(t.words & b) >= threshold * len(t.words) - 1e-9 and t.marks <= b}
            for t in met.values():
                if not any(t.words < o.words and o.label != t.label for o in met.values()):
                    found.add(t.label)
                    best = max(best, len(t.words & b) / len(t.words))
    base = {label for _, label in at}
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if at else best


def test_licenses_of_odd_documents(spark, odd_docs, odd_rows):
    more = [(20, "MIT license, mit-license\nthe MIT\nlicense"), (21, "Released under the license"), (22, "General  Public\nLicense and Apache (License)"), (23, "xx Released, under; the MIT License!"), (24, "Licensed under CC BY-NC 4.0."), (25, "mité license mit")]
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert canonical(tuple(r) for r in L.scan_licenses(docs).collect()) == canonical((d, *licenses(t)) for d, t in [*odd_rows, *more])


#: Openings as they stand at the head of files: wrapped, with comment marks.
WRAPPED = {
    "mit": "# Permission is hereby granted, free of charge, to any person obtaining a\n# copy of this software and associated documentation files (the \"Software\"),\n# to deal in the Software without restriction",
    "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n *\n * 1. Redistributions",
    "mpl": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one",
    "isc": "// Permission to use, copy, modify, and/or distribute this software for any\n// purpose with or without fee is hereby granted, provided",
    "gpl": "dnl This program is free software: you can redistribute it and/or modify\ndnl it under the terms of the GNU General Public License as published by\ndnl the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General\nPublic License as published",
    "agpl": "This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU Affero General Public License as",
    "apache": "you may not use this file except in compliance with the\nLicense. You may obtain a copy of the License at",
    "cc-by": "Licensed under CC BY 4.0", "cc-by-nc": "Licensed under CC BY-NC 4.0", "cc-by-sa": "Licensed\nunder CC BY-SA 4.0",
}


def test_wrapped_notices_and_two_in_one_text(spark):
    rows = [(k, f"intro words\n\n{t} more words {prose(200, k)}") for k, t in enumerate(WRAPPED.values())]
    both = "\n".join((WRAPPED["mit"], prose(10, 3), WRAPPED["bsd"].replace("source", "sauce")))
    rows += [(90, both.replace("\n", " ")), (91, f"{WRAPPED['cc-by']} {prose(40, 1)} {WRAPPED['cc-by-nc']}"), (92, prose(500, 9))]
    got = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    labels = {label: set(got[k]["labels"].split(",")) for k, label in enumerate(WRAPPED)}
    assert {k: v - {"gpl"} if k in ("agpl", "lgpl") else v for k, v in labels.items()} == {k: {k} for k in WRAPPED}
    assert got[90]["labels"] == "bsd,mit" and got[91]["labels"] == "cc-by,cc-by-nc" and (got[92]["labels"], got[92]["score"]) == ("", 0.0)
    for d, text in rows:
        assert canonical([tuple(got[d])]) == canonical([(d, *licenses(text))])


def test_template_bound_and_many_words(spark):
    with pytest.raises(ValueError):
        L.parse_templates((("x", " ".join(f"w{i}" for i in range(L.MAX_TEMPLATE_WORDS + 1))),))
    many = tuple((f"t{k}", " ".join(f"v{k}x{i}" for i in range(40))) for k in range(100))
    docs = spark.createDataFrame([(1, f"{prose(100, 1)} {many[7][1]} {prose(100, 2)}"), (2, prose(50, 3))], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in L.scan_licenses(docs, many).collect()} == {1: "t7", 2: ""}


def test_prefix_and_position_filters_lose_nothing(spark):
    import random

    r = random.Random(4)
    templates = tuple(("t%d" % k, " ".join(r.sample([f"v{i}" for i in range(30)], r.randint(1, 12)))) for k in range(12))
    rows = [(i, "\n".join(" ".join(r.choices([f"v{k}" for k in range(30)] + ["zz"], k=r.randint(0, 25))) for _ in range(3))) for i in range(60)]
    got = {(x["doc_id"], x["labels"], x["score"]) for x in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates, 0.7, L.PHRASES, 4).collect()}
    assert got == {(i, *licenses(text, templates, 0.7, 4)[5:]) for i, text in rows}

"""Licence headers that wrap over lines, in several kinds of comments, amid code."""

import textwrap

import pytest

from gridloom.llm import licenses as L

TEXTS = {name: text for name, text in reversed(L.TEMPLATES)}  # the first, whole notice of each


@pytest.mark.parametrize("first, mark, last", [("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "// ", ""), ("\n", "", "\n")])
def test_wrapped_headers(spark, first, mark, last):
    names = ["AGPL-3.0", "Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0"]
    code = "\n".join(f"total_{i} = compute(total_{i - 1}, weight[{i}])" for i in range(60))
    header = lambda name: first + "\n".join(mark + x for x in textwrap.wrap(TEXTS[name], 60)) + last
    rows = [(i, f"s/{i}.c", f"{header(name)}\n{code}") for i, name in enumerate(names)]
    mit = first + "\n".join(mark + x for x in textwrap.wrap(next(t for n, t in L.TEMPLATES if n == "MIT"), 60)) + last
    rows += [(50, "s/m.c", f"{mit}\n{code}"), (51, "s/n.c", code)]
    got = {r["doc_id"]: (r["license"], r["found"]) for r in L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {**{i: (name, "header") for i, name in enumerate(names)}, 50: ("MIT", "header"), 51: (None, None)}

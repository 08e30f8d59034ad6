import math
import re
from collections import Counter

from paceline.llm import licenses

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
FILES = [
    ("a/LICENSE", MIT),
    ("a/x.py", "some code here\nand more of it\nno notice"),
    ("a/b/y.py", "deep down\n"),
    ("a/b/c/LICENSE.txt", "The " + APACHE),
    ("a/b/c/z.py", "code"),
    ("a/b/c/own.py", "a long line of prose that has nothing to do with it\n" * 3 + "  " + MIT + "  \nend"),
    ("top.py", "code without any directory"),
    ("d/e.py", None), ("d/f.py", ""), (None, "prose prose prose\n" * 4 + APACHE),
    ("d/g.py", "Our license fees are due on the first of the month, as agreed with all customers"),
    ("a/x.py", "some code here\nand more of it\nno notice"),
    ("both/1", APACHE), ("both/2", MIT), ("both/3", "nothing"), ("ab/q.py", "a name that begins alike"),
]


def vector(line):
    return Counter(re.findall(licenses.Settings().terms, line.lower()))


def cosines(files, settings):
    lines = [
        line.strip()
        for _, text in files
        for line in (text or "").split("\n")
        if re.search(settings.anchors, line)
    ]
    seen = Counter(t for line in lines for t in vector(line))

    def weights(line):
        return {t: n * (1 + math.log((1 + len(lines)) / (1 + seen[t]))) for t, n in vector(line).items()}

    def norm(w):
        return math.sqrt(sum(x * x for x in w.values()))

    out = {}
    for line in lines:
        w = weights(line)
        scores = [
            (round(sum(w.get(t, 0) * x for t, x in v.items()) / (norm(w) * norm(v)), 6), name)
            for name, text in settings.templates
            for v in [weights(text)]
        ]
        score, name = min(scores, key=lambda s: (-s[0], s[1]))
        if score >= settings.score:
            out[line] = (name, score)
    return out


def test_scores_and_inheritance(spark):
    settings = licenses.Settings()
    files = spark.createDataFrame(FILES, "path string, text string").selectExpr("*", "1 as how", "2 as x")
    found = licenses.licensed(files.repartition(3)).collect()
    assert len(found) == len(FILES) and found[0].asDict().keys() == {
        "path", "x", "license", "how", "score", "license_dir",
    }
    got = {r.path: (r.license, r.how, r.license_dir) for r in found}
    assert got == {
        "a/LICENSE": ("MIT", "file", None),
        "a/x.py": ("MIT", "inherited", "a"),
        "a/b/y.py": ("MIT", "inherited", "a"),
        "a/b/c/LICENSE.txt": ("Apache-2.0", "file", None),
        "a/b/c/z.py": ("Apache-2.0", "inherited", "a/b/c"),
        "a/b/c/own.py": ("MIT", "header", None),
        "top.py": (None, "none", None),
        "d/e.py": (None, "none", None),
        "d/f.py": (None, "none", None),
        None: ("Apache-2.0", "header", None),
        "d/g.py": (None, "none", None),
        "both/1": ("Apache-2.0", "file", None),
        "both/2": ("MIT", "file", None),
        "both/3": ("Apache-2.0", "inherited", "both"),
        "ab/q.py": (None, "none", None),
    }
    wanted = cosines(FILES, settings)
    for r in found:
        if r.how in ("file", "header"):
            text = dict(FILES)[r.path]
            best = max(wanted[x.strip()][1] for x in text.split("\n") if x.strip() in wanted)
            assert abs(r.score - best) < 2e-6


def test_empty_table(spark):
    assert licenses.licensed(spark.createDataFrame([], "path string, text string")).count() == 0


def test_columns_that_share_names_with_inner_ones(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    names = ["dir", "is_file", "up", "best", "size", "file", "line", "dir_license"]
    more = files.selectExpr("*", *(f"concat('{n}', path) as {n}" for n in names))
    found = licenses.licensed(more)
    assert found.columns == ["path", *names, "license", "how", "score", "license_dir"]
    plain = sorted(map(str, licenses.licensed(files).collect()))
    assert sorted(map(str, found.drop(*names).collect())) == plain
    assert all(r.path is None or r[n] == n + r.path for r in found.collect() for n in names)


GPL2 = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version {} of the License, or
# (at your option) any later version.
"""


def test_license_files_headers_and_tags(spark):
    texts, code = dict(licenses.full_texts()), "x = compute(y, z)  # and so on\n" * 60
    prose = "the river by the house is old and the cloud above it was grey that day " * 40
    rows = [(f"{n}/LICENSE", f"Copyright (c) 2020 Some One\n\n{text}", n, "file") for n, text in texts.items()]
    rows += [(f"{n}/src/x.py", "no notice", n, "inherited") for n in texts]
    rows += [
        ("h/mit.py", "".join(f"// {x}\n" for x in texts["MIT"].split("\n")) + code, "MIT", "header"),
        ("h/gpl2.py", GPL2.format(2) + code, "GPL-2.0", "header"),
        ("h/gpl3.py", GPL2.format(3) + "\n" + code, "GPL-3.0", "header"),
        ("h/two.py", "# This work is licensed under the GNU General\n# Public License, version 2.\n" + code, "GPL-2.0", "header"),
        ("h/tag.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */\n" + code, "GPL-2.0", "header"),
        ("h/both.rs", "// SPDX-License-Identifier: MIT OR Apache-2.0\n" + code, "MIT OR Apache-2.0", "header"),
        ("h/long.md", f"{prose.strip()}. {APACHE} {prose}", "Apache-2.0", "header"),
        ("h/plain.md", f"{prose}, a license for it, {prose}", None, "none"),
    ]
    files = spark.createDataFrame([r[:2] for r in rows], "path string, text string").repartition(3)
    found = {r.path: (r.license, r.how) for r in licenses.licensed(files).collect()}
    assert found == {r[0]: r[2:] for r in rows}


def test_one_long_text_does_not_end_the_job(spark):
    """Dotted runs, tags and words without an end beside a notice."""
    rows = [
        ("p/a.py", f"{MIT}\n" + "a.b-" * 50_000 + "c"),
        ("p/b.py", f"# {MIT}\n" + "x" * 400_000),
        ("p/c.py", "SPDX-License-Identifier: MIT" + " OR MIT" * 10_000 + "\n"),
        ("p/d.py", "some words " * 30_000 + MIT),
    ]
    found = {r.path: r.license for r in licenses.licensed(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found["p/a.py"] == found["p/b.py"] == found["p/d.py"] == "MIT" and found["p/c.py"].startswith("MIT OR MIT")


def test_files_without_a_path_keep_to_themselves(spark):
    rows = [(None, f"code and code and code and more of it\n{MIT}\nend"), (None, "nothing"), (None, f"more of it, prose and prose and prose and prose and prose and prose\n{APACHE}"), (None, None)]
    found = licenses.licensed(spark.createDataFrame(rows, "path string, text string")).collect()
    assert Counter((r.license, r.how) for r in found) == Counter(
        [("MIT", "header"), ("Apache-2.0", "header"), (None, "none"), (None, "none")]
    )

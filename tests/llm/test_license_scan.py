import math
import re

from pyspark.sql import functions as F

from corpuslens.llm import license_scan as L
from corpuslens.llm import queries as Q

NOTICE = dict(L.TEMPLATES)


def words(t):
    return re.findall(r"[^\W_]+(?:\.\d+)*", t.lower())


def brute(files, least=0.7):
    """Every line against every template, every file against every directory."""
    n = len(NOTICE)
    df = {}
    for t in NOTICE.values():
        for w in set(words(t)):
            df[w] = df.get(w, 0) + 1
    vec = lambda t: {w: words(t).count(w) * (math.log((1 + n) / (1 + df.get(w, 0))) + 1) for w in set(words(t))}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    tv = {k: vec(t) for k, t in NOTICE.items()}
    def best(units):
        found = []
        for u in units:
            v = vec(u)
            for k, t in tv.items():
                if v and (c := round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 6)) >= least:
                    found.append((-c, k))
        return min(found, default=None)
    is_license = lambda p: re.match("(?i)" + L.LICENSE_FILE, p.rsplit("/", 1)[-1])
    folder = lambda p: p.rpartition("/")[0]
    own = {}
    for p, t in files:
        p = p or ""
        b = best((t or "").split("\n") + ([t or ""] if is_license(p) else []))
        if b:
            own[p] = min(own.get(p, b), b)
    dirs = {}
    for p, b in own.items():
        if is_license(p):
            dirs[folder(p)] = min(dirs.get(folder(p), b), b)
    out = []
    for p, _ in files:
        p = p or ""
        if p in own:
            out.append((p, own[p][1], -own[p][0], "header", None))
            continue
        d = folder(p)
        while d not in dirs and d:
            d = d.rpartition("/")[0]
        out.append((p, dirs[d][1], -dirs[d][0], "inherited", d) if d in dirs else (p, None, None, "none", None))
    return sorted(out, key=str)


FILES = [("a/b/x.py", "code\n# " + NOTICE["MIT"] + "\nmore"), ("a/b/c/y.py", "no notice"), ("a/b/LICENSE", NOTICE["Apache-2.0"] + "\n"), ("a/LICENSE.txt", NOTICE["GPL-3.0"]),
         ("a/z.py", "license"), ("a/q/z.py", None), ("top.py", ""), ("b/COPYING", "Released under\nthe MIT\nLicense."), ("b/k/l/m.c", "x"), ("b/mine.c", "RELEASED UNDER THE MIT LICENSE!"),
         ("c/LICENSE", "nothing known"), ("c/x", "y"), (None, NOTICE["MPL-2.0"]), ("c/x", "y"), ("a/b/long.txt", "filler word\n" * 20_000 + "This work is licensed under the GNU General Public License, version 3"),
         ("d/LICENSE", NOTICE["MIT"]), ("d/LICENSE-2", NOTICE["Apache-2.0"]), ("d/x", "z"), ("d2/x", "z"), ("d/e/part.py", "Licensed under the Apache License, Version 2.0 and some further words")]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(FILES, "path string, text string").withColumn("license_id", F.lit(1)).withColumn("score", F.lit("x")).withColumn("dir", F.lit(0))
    got = sorted((tuple(r) for r in L.scan(df, L.templates(spark)).collect()), key=str)
    assert got == brute(FILES)


def test_root_license_and_empty(spark):
    files = [("LICENSE", NOTICE["MIT"]), ("x/y/z", "t"), ("w", None)]
    df = spark.createDataFrame(files, "path string, text string")
    assert sorted((tuple(r) for r in L.scan(df, L.templates(spark)).collect()), key=str) == brute(files)
    assert L.scan(df.limit(0), L.templates(spark)).count() == 0
    assert {r.how for r in L.scan(df, L.templates(spark).limit(0)).collect()} == {"none"}


def test_plan_is_native(spark, sf):
    plan = Q.QUERIES["op1_license_scan"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_texts_headers_and_titles(spark):
    from corpuslens.llm import license_texts as W
    full, head = dict(W.TEXTS), dict(reversed(W.HEADERS))
    mark = lambda m, t: "".join(f"{m} {x}\n" for x in t.split("\n"))
    code = "\n\nint main() {\n  return other_words(1, 2);\n}\n" * 40
    files = [("m/LICENSE", "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + full["MIT"].partition("\n")[2], "MIT"), ("g/COPYING", full["GPL-3.0"], "GPL-3.0"),
             ("b/LICENSE", "Copyright 2019 A. Company, all rights reserved\n" + full["BSD-3-Clause"], "BSD-3-Clause"), ("b2/LICENSE", full["BSD-2-Clause"], "BSD-2-Clause"),
             ("g/x.c", mark("//", "Copyright (C) 2001 Somebody\n\n" + head["GPL-3.0"]) + code, "GPL-3.0"), ("a/x.py", "#!/usr/bin/env python\n" + mark("#", head["Apache-2.0"]) + code, "Apache-2.0"),
             ("l/x.c", "/*\n" + mark(" *", head["LGPL-3.0"]) + " */" + code, "LGPL-3.0"), ("s/x.c", "// SPDX-License-Identifier: MIT\n" + code, "MIT"),
             ("s/y.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */" + code, "GPL-2.0"), ("t/LICENSE", "MIT License\n\n(c) Jane", "MIT"), ("m/sub/x", "no words", "MIT"),
             ("n/x.py", "# Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0. Written in a long line with some more words on what it does" + code, "Apache-2.0"),
             ("z/x", code + "copyright is a word, so is license, and permission", None), ("z/y", None, None), (None, "SPDX-License-Identifier: Unheard-Of", None)]
    df = spark.createDataFrame([(p, t) for p, t, _ in files], "path string, text string")
    got = {r.path: r for r in L.scan(df, L.templates(spark), texts=L.texts(spark)).collect()}
    assert {p: r.license_id for p, r in got.items()} == {p or "": i for p, _, i in files}
    assert got["m/sub/x"].how == "inherited" and got["g/x.c"].how == "header"
    assert L.scan(df.limit(0), L.templates(spark), texts=L.texts(spark)).count() == 0


def test_spdx_expressions_and_denials(spark):
    rows = [("p/a", "// SPDX-License-Identifier: BSD-2-Clause-Patent"), ("p/b", "# SPDX-License-Identifier: Apache-2.0 OR MIT"),
            ("p/c", "/* spdx-license-identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND MIT */"), ("p/d", "SPDX-License-Identifier: MITx"),
            ("p/e", "This is not licensed under the MIT License."), ("p/f", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."),
            ("p/g", "SPDX-License-Identifier: LGPL-2.1+\nReleased under the MIT License."), ("p/h", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"][2:]: (r["license_id"], r["licenses"]) for r in L.scan(files, L.templates(spark), texts=L.texts(spark), all_licenses=True).collect()}
    assert got == {"a": ("BSD-2-Clause-Patent", ["BSD-2-Clause-Patent"]), "b": ("Apache-2.0", ["Apache-2.0", "MIT"]), "c": ("GPL-2.0", ["GPL-2.0", "MIT"]), "d": (None, None),
                   "e": (None, None), "f": ("Apache-2.0", ["Apache-2.0", "MIT"]), "g": ("LGPL-2.1", ["LGPL-2.1", "MIT"]), "h": (None, None)}


def test_query_keeps_null_negative_and_repeated_ids(spark, tmp_path):
    notice = "Released under the MIT License.\n" + "x " * 30
    rows = [(None, notice, "en", "s1", 9), (-1, notice, "en", "s1", 9), (None, "plain", None, None, 5), (-7, "plain", "en", "s2", 5), (5, notice, "en", "s3", 9), (5, "other", "de", "s4", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r["doc_id"], r["how"]) for r in Q.QUERIES["op1_license_scan"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, "header"), (-1, "header"), (None, "none"), (-7, "none"), (5, "header"), (5, "none")], key=str)

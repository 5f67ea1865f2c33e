from graphtables.llm import licenses
from tests.llm.samples import awkward_texts, frame

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
GPL = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License\n"
       "as published by the Free Software Foundation, either version 3\nof the License, or (at your option) any later version.")


def files(spark, rows):
    return spark.createDataFrame([(i, p, t, "x", 1.0) for i, p, t in rows],
                                 "doc_id long, path string, text string, license string, cosine double").repartition(3)


def test_own_and_inherited(spark):
    body = "\n".join(f"some line {i} of a file about nothing in particular" for i in range(30))
    rows = [
        (1, "LICENSE", "intro\n" * 20 + MIT), (2, "a/file.py", body), (3, "a/b/COPYING.txt", APACHE), (4, "a/b/c/d/deep.txt", body),
        (5, "a/b/own.txt", body + "\n" + MIT + "\n" + body), (6, "z/half.txt", GPL), (7, "z/y/x.txt", body), (8, None, body), (9, None, MIT),
        (10, "ab/file.py", None), (11, "z/y/talk.txt", body + "\nthe licensed plumber met a driver whose license expired long ago"),
        (None, "a/b/c/null-id.txt", ""), (2, "a/file.py", body)]
    got = licenses.scan(files(spark, rows)).collect()
    by = {(r.id, r.path): (r.license, r.origin, r.license_path) for r in got}
    assert len(got) == len(rows)
    assert by == {
        (1, "LICENSE"): ("MIT", "own", None), (2, "a/file.py"): ("MIT", "inherited", "LICENSE"),
        (3, "a/b/COPYING.txt"): ("Apache-2.0", "own", None), (4, "a/b/c/d/deep.txt"): ("Apache-2.0", "inherited", "a/b/COPYING.txt"),
        (5, "a/b/own.txt"): ("MIT", "own", None), (6, "z/half.txt"): ("GPL-3.0", "own", None),
        (7, "z/y/x.txt"): ("GPL-3.0", "inherited", "z/half.txt"), (8, None): (None, None, None), (9, None): ("MIT", "own", None),
        (10, "ab/file.py"): ("MIT", "inherited", "LICENSE"), (11, "z/y/talk.txt"): ("GPL-3.0", "inherited", "z/half.txt"),
        (None, "a/b/c/null-id.txt"): ("Apache-2.0", "inherited", "a/b/COPYING.txt")}


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rows = [(i, f"d{(i or 0) % 3}/{i}.txt", t) for i, t in awkward_texts()] + [(900, "d1/LICENSE", MIT), (901, "d2/x/NOTICE", APACHE)]
    before = sorted(map(repr, licenses.scan(files(spark, rows)).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, licenses.scan(files(spark, rows)).collect())) == before


def test_every_notice_matches_itself(spark):
    rows = [(n, None, f"line before\n{text}\nline after") for n, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {r.id: r.license for r in licenses.scan(files(spark, rows)).collect()}
    assert got == {n: name for n, (name, _) in enumerate(licenses.TEMPLATES)}


def test_empty_table(spark):
    docs = frame(spark, []).withColumnRenamed("id", "path")
    assert licenses.scan(docs).collect() == []


def test_standard_headers_and_short_texts(spark):
    """Each is nearer to its own licence than to the notices of its relatives."""
    gnu = ("# This {0} is free software{3} you can redistribute it and/or\n# modify it under the terms of the GNU {1}\n"
           "# as published by the Free Software Foundation{4} either\n# version {2} of the License, or (at your option) any later version.\n#\n"
           "# This {0} is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY.  See the GNU {1} for more details.")
    general = "General Public License"
    cc = "This work is licensed under a Creative Commons {} 4.0 International License."
    one_line = {name: text for name, text in licenses.TEMPLATES if name in ("MIT", "ISC", "BSD-2-Clause")}
    texts = [
        ("GPL-2.0", gnu.format("program", general, 2, ";", ";")), ("GPL-3.0", gnu.format("program", general, 3, ":", ",")),
        ("AGPL-3.0", gnu.format("program", f"Affero {general}", 3, ":", ",")),
        ("LGPL-2.1", gnu.format("library", f"Lesser {general}", "2.1", ";", ";")),
        ("LGPL-3.0", gnu.format("library", f"Lesser {general}", 3, ":", ",")),
        ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
        ("CC-BY-SA-4.0", cc.format("Attribution-ShareAlike")), ("CC-BY-NC-ND-4.0", cc.format("Attribution-NonCommercial-NoDerivatives")),
        ("CC-BY-4.0", cc.format("Attribution")), *one_line.items(),
        ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is")]
    assert len(one_line["MIT"]) > 900 and len(one_line["ISC"]) > 600 and len(one_line["BSD-2-Clause"]) > 1100
    got = {r.id: r.license for r in licenses.scan(files(spark, [(n, None, t) for n, (_, t) in enumerate(texts)])).collect()}
    assert got == {n: name for n, (name, _) in enumerate(texts)}

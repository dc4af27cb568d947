from ledgerscope.llm import licenses as L


def scan(spark, docs_of, docs, **kw):
    return {r.doc_id: [(n["line"], n["license_id"]) for n in r.notices] for r in L.scan_licenses(docs_of(docs), **kw).collect()}


def test_equivalent_forms_match(spark, docs_of):
    docs = [(1, "LICENCED  under the Apache Licence; version 2.0 !"), (2, "licensed under the apache license v2"),
            (3, "Some prose.\n  Released under the MIT Licence.  \nmore prose"),
            (4, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + L.MIT.upper().replace("\n", "  \n ")),
            (5, "(c) 2001 X\n" + L.MIT), (6, "Licensed under CC-BY-NC, 4.0"), (7, "Copyright 2020 A. All rights reserved."),
            (8, "All rights reserved")]
    got = scan(spark, docs_of, docs)
    assert got[1] == got[2] == [(0, "Apache-2.0"), (1, "Apache-2.0")]
    assert got[3] == [(2, "MIT")]
    assert got[4] == [(0, "MIT")] and got[5] == [(0, "MIT")]
    assert got[6] == [(0, "CC-BY-NC-4.0"), (1, "CC-BY-NC-4.0")]
    assert got[7] == [] and got[8][0] == (0, "LicenseRef-all-rights-reserved")


def test_only_entire_units_match(spark, docs_of):
    docs = [(1, "It was released under the MIT License."), (2, L.MIT[:-20]), (3, "Licensed under CC BY-NC 3.0."), (4, "word " * 50_000)]
    assert all(n == [] for n in scan(spark, docs_of, docs).values())


def test_edges(spark, docs_of):
    line = "Licensed under CC BY 4.0."
    docs = [(1, None), (2, ""), (3, " \n..."), (4, line), (4, line), (None, line), (5, (line + "\n") * 3)]
    rows = L.scan_licenses(docs_of(docs)).collect()
    assert len(rows) == 7
    assert sorted(len(r.notices) for r in rows) == [0, 0, 0, 2, 2, 2, 3]
    assert scan(spark, docs_of, [(1, line)], known=[]) == {1: []}
    assert L.scan_licenses(docs_of([])).collect() == []


def test_canonical_forms_are_distinct_by_licence(spark):
    digests, lengths = L.known_digests(spark, L.KNOWN)
    assert digests.count() == len({L_ for _, L_ in L.KNOWN}) and lengths


def test_texts_headers_and_wrapped_notices(spark, docs_of):
    text = lambda name: (L.TEXTS / f"{name}.txt").read_text()
    header = L.HEADERS["Apache-2.0"]
    docs = [(1, text("Apache-2.0")), (2, text("GPL-3.0")), (3, "BSD 3-Clause License\n\nCopyright (c) 2020, A\n\n" + text("BSD-3-Clause")),
            (4, "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + L.MIT), (5, "import x\n\n" + header.replace(" you", "\n\nyou") + "\ncode = 1"),
            (6, "Prose\nLicensed under the Apache\nLicense, Version 2.0.\nmore"), (7, text("Unlicense"))]
    got = scan(spark, docs_of, docs)
    assert got[1] == [(0, "Apache-2.0")] and got[2] == [(0, "GPL-3.0")] and got[3] == [(0, "BSD-3-Clause")] and got[4] == [(0, "MIT")]
    assert got[5] == [(3, "Apache-2.0")] and got[6] == [(2, "Apache-2.0")] and got[7] == [(0, "Unlicense")]

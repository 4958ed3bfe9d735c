"""Whole texts of common licences, and lines that only look like claims of copyright."""

from sextile.llm import licences


def test_whole_texts_and_claims(spark):
    known = list(licences.CATALOGUE)
    mit = known[0][1]
    folder = licences.files("sextile.llm") / "licence_texts"
    names = "Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 MPL-2.0 CC0-1.0 Unlicense"
    rows = {i: (n, (folder / f"{n}.txt").read_text("utf-8")) for i, n in enumerate(names.split())}
    rows[20] = ("MIT", "Copyright 2020 Someone\n" + mit.replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS"))
    rows[21] = ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2021, Me\nAll rights reserved.\n\n" + rows[2][1])
    rows[22] = (None, rows[0][1][:-900])
    docs = spark.createDataFrame([(i, t) for i, (_, t) in rows.items()], "doc_id long, text string")
    found = licences.scan_licences(docs, licences.catalogue(spark)).collect()
    assert {r.doc_id: r.text_licence for r in found} == {i: n for i, (n, _) in rows.items()}

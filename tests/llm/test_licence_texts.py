"""Full licence texts, headers and notices by rule."""

import hashlib
from pathlib import Path

import duckdb
import pytest

from harrow.llm import licenses as L


def test_known_texts(spark):
    at = {}
    for n, t in L.KNOWN:
        at.setdefault(n, t)
    copy = "Copyright (c) 2020, Some One\n"
    rows = [(1, copy + L._BSD3.upper()), (2, copy + L._0BSD), (3, "/* " + L._ZLIB.replace("acknowledgment", "acknowledgement") + " */"), (4, L._UNLICENSE.replace("https", "http")), (5, L._BSL.replace("\n", " ")), (6, L._GNU_HEADER.format(kind="Lesser ", version="2.1")), (7, copy + L._APACHE_HEADER), (8, "// Licensed under CC BY-NC 4.0."), (9, "x\n# SPDX-License-Identifier: GPL-2.0-or-later"), (10, L._BSD3 + " and more"), (11, None), (12, "")]
    d = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, license string")
    got = {r.doc_id: (r.text_license, r.licenses) for r in L.scan(d).collect()}
    assert [got[i][0] for i in range(1, 11)] == ["BSD-3-Clause", "0BSD", "Zlib", "Unlicense", "BSL-1.0", "LGPL-2.1-or-later", "Apache-2.0", "CC-BY-NC-4.0", None, None]
    assert got[9][1] == "GPL-2.0-or-later" and got[11] == got[12] == (None, "")


def test_digests_of_published_texts(spark, tmp_path):
    folder = Path("/usr/share/common-licenses")
    names = {n: f for n, f in {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}.items() if (folder / f).exists()}
    if not names:
        pytest.skip("no published texts on this machine")
    rows, want = [], []
    for n, f in names.items():
        text = (folder / f).read_text(encoding="utf-8")
        terms = text.split("END OF TERMS AND CONDITIONS")[0]
        for t, found in [(text, n), (text.upper().replace("HTTPS", "http"), n), (" * " + text.replace("\n", "\r\n * "), n), (terms, n), (text + "\nNo warranty at all.", None), (text.replace("warrant", "guarant", 1), None if "warrant" in text else n)]:
            rows.append((len(rows), t))
            want.append(found)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text_license for r in L.scan(d).collect()}
    assert [got[i] for i in range(len(rows))] == want
    # the same by SQL
    d.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert {r[0]: r[1] for r in con.execute(L.scan_sql()).fetchall()} == got


def test_digests_of_ones_own(spark):
    d = spark.createDataFrame([(1, "My Licence, 2nd ed."), (2, L._MIT)], "doc_id long, text string")
    form = hashlib.sha256(b"my license 2nd ed").hexdigest()
    got = {r.doc_id: (r.text_license, r.n_notices) for r in L.scan(d, L.known(spark, digests=[("mine", form), ("other", form)])).collect()}
    assert got == {1: ("mine", 1), 2: (None, 0)}

"""Archive lines as old crawlers wrote them, and licenses named in one line."""

import pytest
from pyspark.sql import functions as F

from quern.llm import arc_to_warc, license_scan
from quern.llm.spark_io import written


def archive(*records, version=1):
    head = f"{version} 0 x\n{arc_to_warc.ARC_NAMES[version]}\n\n".encode()
    block = f"filedesc://x.arc 0.0.0.0 19960101000000 text/plain{' 200 - - 0 x.arc' if version == 2 else ''} {len(head)}\n".encode() + head
    return block + b"".join(b"\n" + line.encode() + b"\n" + body for line, body in records) + b"\n"


@pytest.mark.parametrize(
    "line, url, kind",
    [
        ("http://a/x y.html 1.2.3.4 19970101000000 text/html 5", "http://a/x y.html", "text/html"),
        ("http://a/ 1.2.3.4 19970101000000 text/html; charset=utf-8 5", "http://a/", "text/html; charset=utf-8"),
        ("http://a/1 2 19980101 q 1.2.3.4 19970101000000 text/html 5", "http://a/1 2 19980101 q", "text/html"),
        ("http://a/ 2001:db8::1 1997 no-type 5", "http://a/", "no-type"),
    ],
)
def test_lines_with_blanks(line, url, kind):
    (r,) = arc_to_warc.parse_arc(archive((line, b"hello")))
    assert (r["url"], r["content_type"], r["content"]) == (url, kind, b"hello")


def test_version_2_lines_with_blanks():
    (r,) = arc_to_warc.parse_arc(archive(("http://a/x y 1.2.3.4 19970101000000 text/html; a=b 200 sum - 17 f.arc 5", b"hello"), version=2))
    assert (r["url"], r["content_type"], r["status"], r["checksum"], r["offset"]) == ("http://a/x y", "text/html; a=b", "200", "sum", "17")


def test_bad_records_are_rows(spark, tmp_path):
    good = ("http://a/ 1.2.3.4 19970101000000 text/html 5", b"hello")
    files = [
        archive(good, ("what is this 3", b"abc"), ("http://b/ 1.2.3.4 00000000000000 text/html 5", b"later")),
        archive(good, ("http://c/ 1.2.3.4 19970101000000 text/html 500", b"short")),
        archive(good, ("no length at all", b"x"), good),
        b"no archive\n", b"", b"\x1f\x8bbroken", archive(good, version=2),
    ]
    frame = spark.createDataFrame([(f, None) for f in files] + [(None, None)], "content binary, keys array<long>")
    records = written(arc_to_warc.convert_arc(frame))
    rows = records.collect()
    assert sorted(r["uri"] for r in rows if r["error"] is None) == ["http://a/"] * 3 + ["http://b/"]
    assert {r["date"] for r in rows if r["uri"] == "http://b/"} == {arc_to_warc.NO_DATE}
    assert len([r for r in rows if r["error"]]) == 6 and all(r["payload"] for r in rows if r["error"])
    path = str(tmp_path / "warc")
    arc_to_warc.write_warc(arc_to_warc.with_revisits(records), path)
    assert arc_to_warc.read_warc(spark, path).count() == 4


def test_no_pages_and_one_very_long_one(spark, tmp_path):
    schema = "page_id long, url string, html string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert arc_to_warc.op5_arc_to_warc(spark, str(tmp_path / "none")).count() == 0
    long = "<p>a very long page é</p>" * 1_000_000
    spark.createDataFrame([(1, "http://a/", long), (2, "http://b/", "x"), (3, None, None)], schema).write.parquet(str(tmp_path / "long" / "pages.parquet"))
    got = {r["page_id"]: r["payload_bytes"] for r in arc_to_warc.op5_arc_to_warc(spark, str(tmp_path / "long")).collect()}
    assert got == {1: len(long.encode()), 2: 1, 3: 0}


NAMED = {
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2",
    "It is licensed under the GNU Affero General Public License version 3.": "agpl-3",
    "Licensed under the GNU Lesser General Public License version 2.1.": "lgpl-2.1",
    "This work is licensed under a Creative Commons Attribution 2.5 License.": "cc-by",
    "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.": "cc0-1",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.": "epl-2",
    "The code is released under the ISC license.": "isc",
    "// SPDX-License-Identifier: MIT": "mit",
    "/* SPDX-License-Identifier: GPL-2.0-or-later */": "gpl-2",
    "# SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "SPDX-License-Identifier: Proprietary": "",
    "The license identifier was changed; the ISC wrote to us, and the public license was lost.": "",
}


def test_licenses_named_in_a_line(spark):
    df = spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string").withColumn("label", F.lit(1))
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-licenses-")
    df.write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r["labels"] for r in license_scan.op8_diagonal_voting(spark, folder).collect()}
    assert [got[i] for i in range(len(NAMED))] == list(NAMED.values())

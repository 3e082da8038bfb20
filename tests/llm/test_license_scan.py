import pathlib

import pytest
from comparing import DATA, assert_same, connection
from pyspark.sql import functions as F

from kinlace.llm import license_scan as l


def test_query(spark):
    assert_same(l.op3_license_scan(spark, DATA), l.op3_sql(), connection())


def scan(spark, texts, **k):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("license", F.lit("y"))
    return {r["doc_id"]: r for r in l.scan_licenses(df, l.known_digests(spark), **k).collect()}


def test_whole_texts_in_other_clothes(spark):
    mit = l.KNOWN["MIT"]
    dressed = "Copyright (c) 2020 Someone\n(C) 2019 Other\nCopyright by Others\n\n" + mit.upper().replace(",", " ;").replace(" ", "\n\t ").replace("MERCHANTABILITY", "MERCHANTIBILITY")
    got = scan(spark, [mit, dressed, mit + " more", None, "", "!!!", "Licenced under CC BY-SA 4.0!\nother", "licensed under cc by sa 4.0"])
    assert got[0]["license"] == got[1]["license"] == "MIT" and got[2]["license"] is None
    assert all(got[i]["digest"] is None and got[i]["license"] is None for i in (3, 4, 5))
    assert got[6]["license"] is None and got[6]["notices"] == ["notice:CC-BY-SA-4.0"]
    assert got[7]["license"] == "notice:CC-BY-SA-4.0"


def test_notices_of_the_tables(spark):
    got = scan(spark, ["x\nThis work is licensed under the GNU General Public License, version 3.", "x\nReleased under the MIT License.", "x\nDistributed under the BSD 3-Clause License"])
    assert [got[i]["notices"][0].split(":")[1] for i in range(3)] == ["GPL-3.0", "MIT", "BSD-3-Clause"]


def test_without_heads_and_ties(spark):
    texts = ["x\nLicensed under the MIT License", "x\nLicensed under the MIT License"]
    assert scan(spark, texts, max_heads=0)[1]["notices"] == scan(spark, texts)[0]["notices"] == ["notice:MIT"]
    two = l.known_digests(spark, {"b": "Same words", "a": "same, WORDS.", "none": "!"})
    assert [r["license"] for r in two.collect()] == ["a"]


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "Licensed under CC0 1.0"), (1, "Licensed under CC0 1.0"), (None, "Licensed under CC0 1.0")], "doc_id long, text string")
    assert l.scan_licenses(df, l.known_digests(spark)).filter("size(notices) = 1").count() == 3
    assert l.scan_licenses(df.limit(0), l.known_digests(spark)).count() == 0


def test_repeated_ids_keep_their_own_notices(spark):
    df = spark.createDataFrame([(1, "Licensed under CC0 1.0\nx"), (1, "nothing here"), (None, "x\nLicensed under CC0 1.0"), (None, "y")], "doc_id long, text string")
    got = [(r["doc_id"], r["notices"]) for r in l.scan_licenses(df, l.known_digests(spark)).collect()]
    assert sorted(n for _, n in got) == [[], [], ["notice:CC0-1.0"], ["notice:CC0-1.0"]]


def test_whole_licences_and_punctuation(spark):
    names = [n for n in l.KNOWN if not n.startswith("notice:")]
    assert len(names) + len(l.DIGESTS) >= 20 and len({l.digest(l.canonical(l.KNOWN[n].encode())[0]) for n in names}) == len(names)
    bsd = l.KNOWN["BSD-3-Clause"].replace('"AS IS"', "\u201cAS\u00a0IS\u201d").replace("; ", " \u2014 ").replace("(", "\u300a")
    got = scan(spark, [bsd, "Copyright (c) 2001 X\n" + l.KNOWN["Unlicense"], l.KNOWN["MIT-0"], "caf\u00e9 \u2019s", "cafe s"])
    assert [got[i]["license"] for i in range(3)] == ["BSD-3-Clause", "Unlicense", "MIT-0"] and got[3]["digest"] != got[4]["digest"]


SHIPPED = pathlib.Path("/usr/share/common-licenses")


@pytest.mark.skipif(not (SHIPPED / "GPL-3").exists(), reason="the box has no licence texts")
def test_digests_are_those_of_the_texts(spark):
    texts = [(SHIPPED / n).read_text(encoding="utf-8") for n in ("GPL-2", "GPL-3", "Apache-2.0", "MPL-2.0")]
    got = scan(spark, [t.replace("\n", "\r\n").upper() for t in texts])
    assert [got[i]["license"] for i in range(4)] == ["GPL-2.0", "GPL-3.0", "Apache-2.0", "MPL-2.0"]

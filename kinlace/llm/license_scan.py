"""Licence scan by canonical digests.

A text is brought into a canonical form (case, punctuation, copyright lines, equivalent spellings),
digested as a whole, and hash-joined to the digests of known licences. The same is done with each
line, which finds one-line notices. The known digests are a table of the caller, which Spark broadcasts
only while it is below the session's broadcast threshold; while they are at most `max_heads`, their
first bytes go to the tasks too, so that lines that can't be known are not sent.

Defined cases: a null or empty text, and one of which nothing stays, has no digest and no licence;
if two known licences have equal digests, the least name stands; repeated documents each get a row;
other columns, also such as `digest`, are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlace.llm import textkit as tk
from kinlace.llm.tables import annotate, saved, scratch, table

#: Pairs (canonical words, their replacement): equivalent spellings, put to one form.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("while", "whilst"),
    ("https", "http"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""
_BSD_BEGIN = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to
<https://unlicense.org/>"""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person
or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated
by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND
NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES
OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: name -> text of whole licences and of one-line notices.
KNOWN: dict[str, str] = {
    "MIT": _MIT,
    "MIT:titled": "MIT License " + _MIT,
    "MIT:titled-the": "The MIT License " + _MIT,
    "MIT-0": _MIT.replace(", subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of\nthe Software.", "."),
    "ISC": _ISC,
    "ISC:titled": "ISC License " + _ISC,
    "Zlib": _ZLIB,
    "Zlib:titled": "zlib License " + _ZLIB,
    "BSD-2-Clause": f"{_BSD_BEGIN} {_BSD_END}",
    "BSD-2-Clause:titled": f"BSD 2-Clause License {_BSD_BEGIN} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_BEGIN} {_BSD_THIRD} {_BSD_END}",
    "BSD-3-Clause:titled": f"BSD 3-Clause License {_BSD_BEGIN} {_BSD_THIRD} {_BSD_END}",
    "0BSD": _0BSD,
    "Unlicense": _UNLICENSE,
    "BSL-1.0": _BSL,
} | {
    f"notice:{name}": f"Licensed under {spoken}."
    for name, spoken in (
        ("CC-BY-4.0", "CC BY 4.0"),
        ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
        ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
        ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
        ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
        ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
        ("CC0-1.0", "CC0 1.0"),
        ("MIT", "the MIT License"),
        ("Apache-2.0", "the Apache License, Version 2.0"),
        ("GPL-3.0", "the GNU General Public License v3.0"),
    )
}

#: Other ways to say a licence's name, and to say that it holds; each is a notice of its own name, as in notice:MIT:released-1.
_SPOKEN: dict[str, tuple[str, ...]] = {
    "MIT": ("the MIT License", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "BSD-3-Clause"),
    "ISC": ("the ISC License", "ISC"),
    "Zlib": ("the zlib License", "Zlib"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "Unlicense": ("the Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0"),
} | {
    f"{short}-{v}": (f"the GNU {long} General Public License, version {v[:-2] if v.endswith('.0') else v}".replace("  ", " "), f"the GNU {long} General Public License v{v}".replace("  ", " "), f"{short}-{v}")
    for short, long, versions in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser", ("2.1", "3.0")), ("AGPL", "Affero", ("3.0",)))
    for v in versions
} | {f"CC-{kind}-4.0": (f"CC {kind} 4.0", f"CC-{kind}-4.0") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")}
_SAID = {
    "licensed": "Licensed under {}.",
    "released": "Released under {}.",
    "distributed": "Distributed under {}.",
    "work": "This work is licensed under {}.",
    "software": "This software is licensed under {}.",
    "project": "This project is licensed under {}.",
}
_plain = lambda text: " ".join(re.findall("[a-z0-9]+", text.lower()))
_have = {_plain(t) for t in KNOWN.values()}
for _name, _forms in _SPOKEN.items():
    for _how, _said in _SAID.items():
        for _i, _form in enumerate(_forms, 1):
            _text = _said.format(_form)
            if _plain(_text) not in _have:  # the first name of a text stands
                _have.add(_plain(_text))
                KNOWN[f"notice:{_name}:{_how}-{_i}"] = _text

#: Not any line that begins with the word: in a wrapped licence, that may be the licence's own text.
_COPYRIGHT_LINE = r"(?m)^[ \t]*(?:(?i:copyright)[ \t:]*(?:\([cC]\)|©|[0-9]{4}|(?i:by)[ \t])|\([cC]\)[ \t]*(?:(?i:copyright)|[0-9]{4})|©|(?i:all rights reserved)).*$"
_COPYRIGHT = re.compile(_COPYRIGHT_LINE.encode())
_OPENS = (b"copyright", b"(c)", "©".encode(), b"all rights reserved")
#: Letters go to lower case; ASCII but letters and digits goes to blanks.
_WORDS = bytes(c + 32 if 0x41 <= c < 0x5B else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: Punctuation, signs and blanks beyond ASCII, as ranges of code points; they are blanks too.
_BEYOND = ((0xA0, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0x2000, 0x206F), (0x3000, 0x3003), (0x3008, 0x3011), (0xFEFF, 0xFEFF))
_PUNCTUATION = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _BEYOND) + "]")
_SPELL = [(f" {a} ".encode(), f" {b} ".encode()) for a, b in SPELLINGS]


def _blanked(text: bytes) -> bytes:
    if text.isascii():
        return text
    return _PUNCTUATION.sub(" ", text.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


def _spelled(words: bytes) -> bytes:
    out = b" " + words + b" "
    for a, b in _SPELL:
        out = out.replace(a, b)
    return out.strip(b" ")


def canonical(text: bytes) -> tuple[bytes, list[bytes]]:
    """The whole text's canonical form without copyright lines, and those of its lines that have words."""
    lines = text.split(b"\n")
    kept = [x for x in lines if not (x.lstrip(b" \t")[:20].lower().startswith(_OPENS) and _COPYRIGHT.match(x))]
    words = b" ".join(_blanked(b"\n".join(kept)).translate(_WORDS).split())
    whole = _spelled(words)
    plain = whole == words and len(kept) == len(lines)  # then no line has a spelling to change
    each = (b" ".join(_blanked(x).translate(_WORDS).split()) for x in lines)
    return whole, [x if plain else _spelled(x) for x in each if x]


def digest(canon: bytes) -> bytes | None:
    return hashlib.sha256(canon).digest() if canon else None


#: Of each whole text that is known by its digest only: name -> sha256 of its canonical form, in hex.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "910dd57cf0592e2fd177c02a60cdb87c6c204a10dcb34944f8cd8a807ecda3e7",
    "Artistic-1.0": "b9039fa3e3abf261842ba3d22a27f89bc70885b5993065f1cb471cab489a730b",
    "BSD-UC": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "3a1205cbbc6ec235f5102e529da718c39760affd513721da8c4c4dcd7e9e300c",
    "GFDL-1.3": "c9dbf03023bbdaa396068f70c178d2f2bb6e423a636d445b883cca4e8e5efe79",
    "GPL-1.0": "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f",
    "GPL-2.0": "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6",
    "GPL-3.0": "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8",
    "LGPL-2.0": "43e9e891645f774ea0321c6d95b3d31fe844708b3ff3d029708b0041f7f47301",
    "LGPL-2.1": "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}


def known_digests(spark: SparkSession, known: dict[str, str] | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """known_digest binary, license of mappings name -> text and name -> digest in hex; those of this module by default."""
    if known is None and digests is None:
        known, digests = KNOWN, DIGESTS
    least: dict[bytes, str] = {bytes.fromhex(d): name for name, d in sorted((digests or {}).items(), reverse=True)}
    for name, text in sorted((known or {}).items(), reverse=True):
        if d := digest(canonical(text.encode())[0]):
            least[d] = min(name, least.get(d, name))
    return spark.createDataFrame(list(least.items()), "known_digest binary, license string")


def _digests(texts: pa.Array, heads: frozenset[bytes] | None) -> list[pa.Array]:
    """heads: beginnings of the known digests; other lines' digests need not travel."""
    chars, whole, lines = [], [], []
    for s in tk.slices(texts):
        for i in range(s.n):
            canon, each = canonical(s.text(i))
            chars.append(len(canon.decode("utf-8", "replace")))
            whole.append(digest(canon))
            found = {digest(x) for x in each}
            lines.append(list(found) if heads is None else [d for d in found if d[:8] in heads])
    return [pa.array(chars, pa.int64()), pa.array(whole, pa.binary()), pa.array(lines, pa.list_(pa.binary()))]


def scan_licenses(documents: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heads: int = 1_000_000) -> DataFrame:
    """doc_id, canonical_chars, digest (hex), license (of the whole text, or null), notices (sorted array of the
    licences whose text is one whole line), for each row of documents."""
    spark = documents.sparkSession
    heads = None
    if known.count() <= max_heads:
        heads = frozenset(bytes(r[0]) for r in known.select(F.substring("known_digest", 1, 8)).distinct().collect())
    # a row goes by a number of its own, as ids may repeat
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    made = annotate(docs, "text", lambda texts: _digests(texts, heads), "canonical_chars long, digest binary, lines array<binary>").drop("text")
    made = saved(made, scratch(spark, "license-digests"))
    whole = made.join(known, F.col("digest") == F.col("known_digest"), "left").select("row", "doc_id", "canonical_chars", F.lower(F.hex("digest")).alias("digest"), "license")
    lines = made.select(F.col("row").alias("hit_row"), F.explode("lines").alias("line"))
    hits = lines.join(known, F.col("line") == F.col("known_digest")).groupBy("hit_row").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    return whole.join(hits, F.col("row") == F.col("hit_row"), "left").select(
        "doc_id", "canonical_chars", "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark))
    return out.select("doc_id", "canonical_chars", "digest", "license", F.array_join("notices", ",").alias("notices"))


def _sql_canonical(x: str, lines: bool) -> str:
    out = f"coalesce({x}, '')"
    if lines:
        out = rf"regexp_replace({out}, '{_COPYRIGHT_LINE}', '', 'g')"
    beyond = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _BEYOND)
    out = f"regexp_replace({out}, '[{beyond}]', ' ', 'g')"
    out = f"translate({out}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = rf"(' ' || trim(regexp_replace({out}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') || ' ')"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out}, ' ')"


def op3_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN.items())
    more = ", ".join(f"('{k}', '{v}')" for k, v in DIGESTS.items())
    return f"""
WITH known AS (
  SELECT known_digest, min(license) AS license FROM (
    SELECT sha256({_sql_canonical('text', True)}) AS known_digest, license FROM (VALUES {rows}) AS v(license, text)
    UNION ALL SELECT known_digest, license FROM (VALUES {more}) AS v(license, known_digest)
  ) GROUP BY known_digest
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, text FROM documents
), whole AS (
  SELECT n, doc_id, {_sql_canonical('text', True)} AS canon FROM docs
), lines AS (
  SELECT DISTINCT n, {_sql_canonical('line', False)} AS canon
  FROM (SELECT n, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs)
), hits AS (
  SELECT n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM lines JOIN known ON sha256(canon) = known_digest WHERE canon <> '' GROUP BY n
)
SELECT w.doc_id, length(canon) AS canonical_chars, CASE WHEN canon <> '' THEN sha256(canon) END AS digest,
  k.license, coalesce(h.notices, '') AS notices
FROM whole w LEFT JOIN known k ON canon <> '' AND sha256(canon) = known_digest LEFT JOIN hits h USING (n)
"""

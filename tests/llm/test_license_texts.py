"""Documents that are a whole licence, as files carry it."""

from pathlib import Path

import pytest

from ledgerlens.llm import license_scan

SHORT = {name: text for name, text in license_scan.KNOWN if len(text) > 300}
ISC = SHORT["0BSD"].replace("is hereby granted.", "is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.")
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def licenses_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.document_license for r in sorted(license_scan.scan(df).collect(), key=lambda r: r.doc_id)]


def test_short_licenses_with_title(spark):
    got = licenses_of(spark, [
        f"MIT License\n\nCopyright (c) 2021 A B\n\n{SHORT['MIT']}", SHORT["MIT"], f"BSD Zero Clause License\n\n(c) 2021\n\n{SHORT['0BSD']}",
        f"ISC License\n\nCopyright 2021\n\n{ISC}", f"BSD 2-Clause License\n\nCopyright (c) 2021, A\nAll rights reserved.\n\n{BSD.format('')}",
        f"Copyright (c) 2021, A\n\n{BSD.format(NAME)}", f"MIT License\n\nand more\n{SHORT['MIT']}"])
    assert got == ["MIT", "MIT", "0BSD", "ISC", "BSD-2-Clause", "BSD-3-Clause", None]


@pytest.mark.skipif(not Path("/usr/share/common-licenses").is_dir(), reason="no licence texts on this machine")
def test_long_licenses(spark):
    texts = [(Path("/usr/share/common-licenses") / f).read_text() for f in FILES]
    assert licenses_of(spark, texts) == list(FILES.values())
    assert licenses_of(spark, [t + "\nand more" for t in texts]) == [None] * len(texts)


def test_one_license_a_digest(spark):
    digests = [r.digest for r in license_scan.known(spark).collect()]
    assert len(digests) == len(set(digests)) < 1000

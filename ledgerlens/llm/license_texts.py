"""Write ledgerlens/llm/license_digests.csv: canonical digests of whole licence texts.

python -m ledgerlens.llm.license_texts < FILES: paths of files that may hold a whole licence (LICENSE, COPYING, ...).  A licence is
taken from /usr/share/common-licenses, its other printings from files with the same first and last words and at
most 2 % other words.  Short licences are built from their paragraphs below, and taken
from files that lack nothing but lines starting with 'copyright'; the printed line says in how many of
the files each was found.
"""

import csv
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from ledgerlens.llm import license_scan
from ledgerlens.session import get_spark

COMMON = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0",
          "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
          "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0"}
#: The first words of licences that common-licenses lacks; at least two files must agree.
FIRST = {"attribution 4 0 international creative commons": "CC-BY-4.0", "attribution sharealike 4 0 international creative commons": "CC-BY-SA-4.0",
         "attribution noncommercial 4 0 international creative commons": "CC-BY-NC-4.0", "gnu affero general public license version 3 19 november 2007": "AGPL-3.0"}
TERMS = "END OF TERMS AND CONDITIONS"
MIT, ZERO = (next(t for name, t in license_scan.KNOWN if name == n and len(t) > 300) for n in ("MIT", "0BSD"))
ISC = ZERO.replace("is hereby granted.", "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")
HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
TWO = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TITLES = {"MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
          "ISC": ["", "ISC License", "The ISC License", "ISC License (ISC)"], "0BSD": ["", "0BSD", "Zero-Clause BSD", "BSD Zero Clause License"],
          "BSD-2-Clause": ["", "BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'],
          "BSD-3-Clause": ["", "BSD License", "BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License']}


def short():
    bodies = {"MIT": [MIT], "0BSD": [ZERO], "ISC": [ISC], "BSD-2-Clause": [], "BSD-3-Clause": []}
    for holder in ("HOLDER", "HOLDERS", "OWNER"):
        for a, b, c in (("", "", ""), ("1. ", "2. ", "3. ")):
            two = HEAD + a + ONE + b + TWO
            bodies["BSD-2-Clause"].append(two + TAIL.format(holder))
            bodies["BSD-3-Clause"].append(two + c + THREE + TAIL.format(holder))
    for name, texts in bodies.items():
        for title in TITLES[name]:
            for rights in ("", "All rights reserved."):
                yield from ((name, f"{title}\n{rights}\n{t}") for t in texts)


def common():
    for file, name in COMMON.items():
        text = (Path("/usr/share/common-licenses") / file).read_text(errors="replace")
        parts = [text, *([text[:text.index(TERMS) + len(TERMS)], text[:text.index(TERMS)]] if TERMS in text else [])]
        body = text.split("\n\n", 1)[1]  # without the title lines
        yield from ((name, p) for p in parts)
        yield from ((name, p[len(text) - len(body):]) for p in parts)


def canonical(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = df.select("n", F.array_join(license_scan.canonical_lines(F.col("text")), " ").alias("t")).select("n", "t", F.sha2("t", 256).alias("d")).collect()
    return [(r.t, r.d) for r in sorted(rows, key=lambda r: r.n)]


def wrapped(want, words):
    """Whether words are the wanted ones less lines that start with 'copyright', which a canonical text drops."""
    i = j = 0
    while i < len(want):
        if j < len(words) and want[i] == words[j]:
            i, j = i + 1, j + 1
            continue
        n = next((n for n in range(1, 20) if want[i + n:i + n + 3] == words[j:j + 3]), 0) if want[i] == "copyright" else 0
        if not n:
            return False
        i += n
    return j == len(words)


def main(files):
    spark = get_spark("license-digests")
    own = [*short(), *common()]
    made = [(name, *td) for (name, _), td in zip(own, canonical(spark, [t for _, t in own]))]
    seen = canonical(spark, sorted({p.read_text(errors="replace"): 0 for p in map(Path, files)}))
    out = {(d, name) for name, _, d in made}
    small = [(name, t.split()) for name, t, _ in made if len(t) <= 5000]
    long = [(name, t.split()) for name, t, _ in made if len(t) > 5000]
    agree = Counter(d for _, d in canonical(spark, [p.read_text(errors="replace") for p in map(Path, files)]))
    for t, d in seen:
        words = t.split()
        out |= {(d, name) for name, want in small if words[:4] == want[:4] and len(words) < len(want) and wrapped(want, words)}
        for name, want in long:
            if words[:6] == want[:6] and words[-6:] == want[-6:] and abs(len(words) - len(want)) <= len(want) // 50:
                x, y = Counter(words), Counter(want)
                if sum(((x - y) + (y - x)).values()) <= len(want) // 50:
                    out.add((d, name))
        out |= {(d, name) for first, name in FIRST.items() if t.startswith(first) and agree[d] >= 2}
    if len({d for d, _ in out}) != len(out):
        raise SystemExit("a text has two licences")
    with open(Path(license_scan.__file__).with_name("license_digests.csv"), "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([("license", "digest"), *sorted((name, d) for d, name in out)])
    for name in sorted({n for _, n in out}):
        mine = [d for d, n in out if n == name]
        print(name, len(mine), "digests,", sum(agree[d] for d in mine), "files")


if __name__ == "__main__":
    main(sys.stdin.read().splitlines())

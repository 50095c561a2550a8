"""Licence scans of long texts, and notices and SPDX lines against plain Python."""

import re
import time

from conceptsearch.llm import license_scan
from conceptsearch.llm.license_names import SPDX_WORDS

SCHEMA = "doc_id long, text string"


def names(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [r["licenses"] for r in license_scan.licenses(df).orderBy("doc_id").collect()]


def test_long_texts_end_no_executor(spark):
    full = [license_scan.SENTENCES[k] for k in ("bsd-source", "bsd-binary", "bsd-name")]
    texts = ["All rights reserved.\n" * 100_000,
             "SPDX-License-Identifier: " + "-".join(["ab"] * 350_000),
             "SPDX-License-Identifier: MIT" + " OR Apache-2.0" * 70_000,
             "SPDX-License-Identifier: (MIT " + "(" * 500_000,
             (full[0] + ".\n") * 3000 + full[1] + ".\n" + ("All rights reserved.\n" * 3000) + full[2] + ".",
             "." * 300_000 + "x", "a " * 500_000, "under the MIT " * 50_000,
             "Neither the name of " * 20_000, "GNU General Public License version 2 " * 20_000]
    began = time.time()
    got = names(spark, texts)
    assert got[0] == "all-rights-reserved" and got[2] == "Apache-2.0,MIT" and got[3] == "MIT"
    assert got[4] == "BSD-3-Clause,all-rights-reserved" and got[5:8] == ["", "", ""]
    assert len(got[1]) > 1_000_000 and time.time() - began < 120


def test_rules_want_their_order(spark):
    a, b, c = (license_scan.SENTENCES[k] + ". " for k in ("mit-grant", "mit-condition", "mit-warranty"))
    assert names(spark, [a + b + c, a + c + b, b + a + c, c + a + b + a + c, a + "Other words. " + b + b + c, a + b]) == \
        ["MIT", "", "", "MIT", "MIT", ""]


def test_typographic_punctuation_is_punctuation(spark):
    sentence = license_scan.SENTENCES["mit-warranty"]
    curly = sentence.replace('"AS IS"', "“AS IS”").replace(", EXPRESS", "—EXPRESS")
    rest = license_scan.SENTENCES["mit-grant"].replace('"Software"', "„Software“") + ".\n" + license_scan.SENTENCES["mit-condition"] + ".\n"
    assert names(spark, [rest + curly + ".", "Licensed under the ‘MIT’ License.", "Licenséd under the MIT License."]) == ["MIT", "MIT", ""]


def brute_spdx(text):
    """Identifiers of SPDX lines, word by word."""
    out = set()
    for line in re.split(r"[\r\n]", text):
        at = line.lower().find("spdx-license-identifier:")
        if at < 0:
            continue
        words, keep = re.findall(r"[^ \t()]+", line[at + 24:]), True
        for k, w in enumerate(words):
            if k % 2:
                if w.lower() not in ("and", "or", "with"):
                    break
                keep = w.lower() != "with"
            elif keep and (re.search("[0-9-]", w) or w.rstrip("+").lower() in {x.lower() for x in SPDX_WORDS}):
                base = re.sub("(?i)-only$", "", re.sub(r"\+$", "-or-later", w))
                out.add(base)
    return ",".join(sorted(out))


def test_spdx_lines_match_plain_python(spark):
    lines = ["MIT", "Apache-2.0 OR MIT", "(MIT AND BSD-3-Clause)", "GPL-2.0-or-later WITH Classpath-exception-2.0",
             "LGPL-2.1+", "(MIT OR (Apache-2.0 AND ISC)) and Zlib", "word", "MPL-2.0 */ more text", "GPL-3.0-only",
             "\tMIT\t", "MIT or\tISC with Foo-1.0 and Zlib", "LicenseRef-Own-1.0", ""]
    texts = [f"// SPDX-License-Identifier: {x}\nint main;" for x in lines] + ["# spdx-license-identifier: MIT\n# SPDX-License-Identifier: ISC"]
    assert names(spark, texts) == [brute_spdx(t) for t in texts]


def test_clashing_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "Licensed under the MIT License.", "x", 1), (None, None, "y", 2), (None, None, "y", 2)],
                               "doc_id long, text string, licenses string, flat int")
    out, named = license_scan.scan(df)
    assert out.columns[:4] == df.columns and named["licenses"] == "licenses_"
    assert sorted((str(r["doc_id"]), r["licenses"], r["licenses_"]) for r in out.collect()) == \
        [("1", "x", ["MIT"]), ("None", "y", []), ("None", "y", [])]

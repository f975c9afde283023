from tarnwick.llm.license_scan import KNOWN_TEXTS, known_digests, license_matches
from tests.llm.common import documents, edge_texts

MIT = next(t for i, kind, t in KNOWN_TEXTS if i == "MIT" and kind == "text")


def test_whole_texts_and_notices(spark):
    variant = "Copyright (c) 2024 Some One\nAll rights reserved.\n\n" + MIT.upper().replace(",", " ;").replace("\n", "\n * ").replace("SUBLICENSE", "SUBLICENCE")
    texts = [
        *edge_texts(), MIT, variant, "story.\n  Licenced under the Apache Licence -- Version 2.0\nmore", "Released under the MIT License. And more.",
        "# Released under the MIT license\n# released under the MIT Licence!!\nLicensed under CC BY-NC 4.0.",
    ]
    n = len(edge_texts())
    got = sorted((r.doc_id, r.unit, r.license_id, r.n_units) for r in license_matches(documents(spark, texts)).collect())
    assert got == [(n, "text", "MIT", 1), (n + 1, "text", "MIT", 1), (n + 2, "line", "Apache-2.0", 1), (n + 4, "line", "CC-BY-NC-4.0", 1), (n + 4, "line", "MIT", 2)]
    assert license_matches(documents(spark, texts).limit(0)).count() == 0


def text_of(name):
    return next(t for i, kind, t in KNOWN_TEXTS if i == name and kind in ("text", "header"))


def commented(text, sign):
    return "\n".join(f"{sign} {x}".rstrip() for x in text.split("\n"))


def test_usual_files(spark):
    texts = [
        "MIT License\n\nCopyright (c) 2024 Some One\n\n" + MIT,
        "The MIT License (MIT)\n\nCopyright Jane Doe\n\n" + MIT,
        "/*\n" + commented("Copyright 2020-2024 A. Body <a@b.org>\n\n" + MIT, " *") + "\n */\nint main() {\n  return 0;\n}",
        "#!/usr/bin/env python\n\n" + commented(text_of("Apache-2.0"), "#") + "\nimport os",
        "BSD 3-Clause License\n\nCopyright (c) 2020, Some Organisation\nAll rights reserved.\n\n" + text_of("BSD-3-Clause"),
        text_of("Unlicense").replace("recognize", "recognize"), text_of("Zlib"), "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + text_of("BSL-1.0"),
        text_of("BSD-2-Clause") + "\nAnd one thing more.", "Copyright law is old. " + MIT, "MIT License",
    ]
    got = sorted((r.doc_id, r.unit, r.license_id) for r in license_matches(documents(spark, texts)).collect())
    assert got == [
        (0, "text", "MIT"), (1, "text", "MIT"), (2, "comment", "MIT"), (3, "comment", "Apache-2.0"), (4, "text", "BSD-3-Clause"), (5, "text", "Unlicense"), (6, "text", "Zlib"), (7, "text", "BSL-1.0"),
    ]


def test_first_word_and_length_tests_lose_nothing(spark):
    known = known_digests(spark, [("A", "text", "version 3 alpha"), ("B", "text", "noncommercial use"), ("C", "text", "license"), ("D", "text", "favor")])
    docs = documents(spark, ["V3 alpha", "Non-commercial use!", "licence", "FAVOUR", "3 alpha"])
    assert sorted((r.doc_id, r.license_id) for r in license_matches(docs, known).collect() if r.unit == "text") == [(0, "A"), (1, "B"), (2, "C"), (3, "D")]


def test_own_texts_and_ties(spark):
    known = known_digests(spark, [("B", "text", "alpha beta"), ("A", "text", "Alpha, BETA!"), ("C", "text", "...")])
    assert [(r.license_id) for r in known.collect()] == ["A"]
    docs = documents(spark, [(1, "alpha\nbeta"), (1, "alpha\nbeta"), (None, "ALPHA -- beta")])
    got = sorted(((r.doc_id, r.unit) for r in license_matches(docs, known).collect()), key=str)
    assert got == sorted([(1, "text"), (1, "text"), (None, "text"), (None, "line")], key=str)
